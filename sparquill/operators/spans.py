"""Positional queries: spans are rows (doc_id, start, end), end exclusive."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import Index


def term(index: Index, word: str) -> DataFrame:
    return index.terms(word).select("doc_id", F.explode("positions").alias("start")).withColumn("end", F.col("start") + 1)


def multi_term(index: Index, accept: Callable[[Column], Column]) -> DataFrame:
    """Spans of all terms that ``accept`` holds for."""
    return index.matching(accept).select("doc_id", F.explode("positions").alias("start")).withColumn("end", F.col("start") + 1)


def either(*spans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, spans).distinct()


def near(spans: list[DataFrame], slop: int, ordered: bool = True) -> DataFrame:
    """Spans that hold one of each, with at most ``slop`` positions between them; ordered: in order, without overlap.

    Joined by document; only the spans of documents that have all are paired.
    """
    rows = spans[0].select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("len"))
    for s in spans[1:]:
        own = s.select("doc_id", F.col("start").alias("s2"), F.col("end").alias("e2"))
        rows = rows.join(own, "doc_id")
        if ordered:
            rows = rows.filter((F.col("s2") >= F.col("end")) & (F.col("s2") - F.col("end") <= slop))
        else:
            rows = rows.filter((F.col("s2") >= F.col("end")) | (F.col("e2") <= F.col("start")) | (F.lit(len(spans) > 2)))
        rows = rows.select("doc_id", F.least("start", "s2").alias("start"), F.greatest("end", "e2").alias("end"), (F.col("len") + F.col("e2") - F.col("s2")).alias("len"))
        rows = rows.filter(F.col("end") - F.col("start") - F.col("len") <= slop)
    return rows.select("doc_id", "start", "end").distinct()


def excluding(include: DataFrame, exclude: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Spans of ``include`` that none of ``exclude`` overlaps, widened by ``before`` and ``after``."""
    x = exclude.select(F.col("doc_id").alias("xd"), F.col("start").alias("xs"), F.col("end").alias("xe"))
    clash = (F.col("doc_id") == F.col("xd")) & (F.col("xs") < F.col("end") + after) & (F.col("xe") > F.col("start") - before)
    return include.join(x, clash, "left_anti")


def first(spans: DataFrame, end: int) -> DataFrame:
    """Spans that end within the first ``end`` positions."""
    return spans.filter(F.col("end") <= end)


def between(spans: DataFrame, start: int, end: int) -> DataFrame:
    return spans.filter((F.col("start") >= start) & (F.col("end") <= end))


def _inside() -> Column:
    return (F.col("doc_id") == F.col("xd")) & (F.col("start") <= F.col("xs")) & (F.col("xe") <= F.col("end"))


def containing(big: DataFrame, little: DataFrame) -> DataFrame:
    """Spans of ``big`` that contain one of ``little``."""
    return big.join(little.select(F.col("doc_id").alias("xd"), F.col("start").alias("xs"), F.col("end").alias("xe")), _inside(), "left_semi")


def within(big: DataFrame, little: DataFrame) -> DataFrame:
    """Spans of ``little`` that one of ``big`` contains."""
    b = big.select(F.col("doc_id").alias("xd"), F.col("start").alias("xs"), F.col("end").alias("xe"))
    return little.join(b, (F.col("doc_id") == F.col("xd")) & (F.col("xs") <= F.col("start")) & (F.col("end") <= F.col("xe")), "left_semi")


def sloppy_freq(spans: DataFrame, terms: int = 1) -> DataFrame:
    """(doc_id, freq): sum of 1 / (1 + positions that no term fills)."""
    return spans.groupBy("doc_id").agg(F.sum(1 / (F.col("end") - F.col("start") - terms + 1)).alias("freq"))
