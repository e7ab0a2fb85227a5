"""Facet counts: flat, hierarchical, by range, drill-down and sideways, and statistics over hits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(hits: DataFrame, dim: str, k: int | None = None, value: Column | None = None) -> DataFrame:
    """(label, value): hits, or the sum of ``value``, of each label of a dimension, the largest first."""
    rows = hits.filter(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("label")).agg((F.count("*") if value is None else F.sum(value)).alias("value"))
    return rows if k is None else rows.orderBy(F.desc("value"), "label").limit(k)


def multi_counts(hits: DataFrame, labels: str, key: str) -> DataFrame:
    """Counts where a hit has an array of labels; a label counts once a hit."""
    return hits.select(key, F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("value"))


def path_counts(hits: DataFrame, path: Column, value: Column | None = None, sep: str = "/") -> DataFrame:
    """(path, depth, value): counts or sums of every label path and all its parents."""
    parts = hits.select(path.alias("_p"), (F.lit(1) if value is None else value).alias("_v"))
    each = parts.select("_v", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    return each.groupBy(F.array_join(F.slice("_p", F.lit(1), F.col("depth")), sep).alias("path"), "depth").agg(F.sum("_v").alias("value"))


def children(tree: DataFrame, parent: str, k: int, sep: str = "/") -> DataFrame:
    """The largest ``k`` children of a path."""
    depth = 1 + parent.count(sep) + 1 if parent else 1
    rows = tree.filter(F.col("depth") == depth)
    return (rows.filter(F.col("path").startswith(parent + sep)) if parent else rows).orderBy(F.desc("value"), "path").limit(k)


@dataclass
class Range:
    label: str
    low: float
    high: float
    with_low: bool = True
    with_high: bool = False

    def holds(self, x: Column) -> Column:
        return (x >= self.low if self.with_low else x > self.low) & (x <= self.high if self.with_high else x < self.high)


def range_counts(hits: DataFrame, value: str, ranges: Sequence[Range]) -> DataFrame:
    """(label, value): hits in each range; ranges may overlap. One pass, one row of counts."""
    row = hits.agg(*[F.count_if(r.holds(F.col(value))).alias(f"c{i}") for i, r in enumerate(ranges)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r.label).alias("label"), F.col(f"c{i}").alias("value")) for i, r in enumerate(ranges)])).alias("x")).select("x.*")


def drill_down(hits: DataFrame, chosen: dict[str, Sequence]) -> DataFrame:
    """Hits with one of the chosen values in every dimension."""
    return reduce(lambda d, x: d.filter(F.col(x[0]).isin(*x[1])), chosen.items(), hits)


def drill_sideways(hits: DataFrame, chosen: dict[str, Sequence]) -> DataFrame:
    """(dim, label, value): for each chosen dimension its counts under the other dimensions' choices only.

    One pass: a hit counts for a dimension if every other one fits.
    """
    fits = {d: F.col(d).isin(*v) for d, v in chosen.items()}
    each = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label"), reduce(lambda a, b: a & b, [f for o, f in fits.items() if o != d], F.lit(True)).alias("fit")) for d in chosen]
    rows = hits.select(F.explode(F.array(*each)).alias("x")).filter("x.fit and x.label is not null")
    return rows.groupBy("x.dim", "x.label").agg(F.count("*").alias("value"))


def grouped_counts(hits: DataFrame, group: str, facet: str) -> DataFrame:
    """(label, value): for each facet value the number of groups that have it."""
    return hits.groupBy(F.col(facet).alias("label")).agg(F.count_distinct(group).alias("value"))


def sampled_counts(hits: DataFrame, dim: str, share: float, seed: int = 1) -> DataFrame:
    """Counts estimated from a sample of the hits."""
    return hits.sample(share, seed).groupBy(F.col(dim).alias("label")).agg(F.round(F.count("*") / share).cast("long").alias("value"))


def stats(hits: DataFrame, value: str) -> DataFrame:
    """One row: count, missing, min, max, sum, mean, variance and stdev (of the population) of a column."""
    x = F.col(value)
    return hits.agg(F.count(x).alias("count"), F.count_if(x.isNull()).alias("missing"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("stdev"))


def frequent_terms(vocabulary: DataFrame, k: int, by: str = "df") -> DataFrame:
    return vocabulary.orderBy(F.desc(by), "term").limit(k)


def ranked(rows: DataFrame, dims: Sequence[str], k: int) -> DataFrame:
    """The largest ``k`` labels of each dimension of counts(dim, label, value)."""
    w = Window.partitionBy(*dims).orderBy(F.desc("value"), "label")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
