"""Where queries and their SQL oracles are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import Index


class Tables:
    """The tables of a data folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def index(self) -> Index:
        """The documents, split at blanks."""
        return Index.build(self.documents)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        own = name or f.__name__
        QUERIES[own] = run
        if sql:
            ORACLES[own] = sql
        return f

    return add


#: Common table expressions of the text queries: tokens, lengths, statistics, positions, frequencies.
TEXT = """
tok as (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as t from documents),
dl as (select doc_id, len(t) as dl, case when len(t) < 8 then len(t)
  else (len(t) >> (length(bin(len(t))) - 4)) << (length(bin(len(t))) - 4) end as dl_q from tok),
st as (select count(*) as n, avg(dl) as a, cast(sum(dl) as bigint) as total from dl),
pos as (select doc_id, unnest(t) as term, unnest(range(len(t))) as pos from tok),
tf as (select term, doc_id, count(*) as tf from pos group by all),
df as (select term, count(*) as df, cast(sum(tf) as bigint) as ctf from tf group by all)
"""
#: BM25 of a row of tf joined with df, dl and st; with the length as a byte keeps it, or exact.
BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * {dl} / a))"
LOSSY, EXACT = BM25.format(dl="dl_q"), BM25.format(dl="dl")


def words(*terms: str) -> str:
    """A list of SQL strings."""
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def scored(*terms: str, model: str = LOSSY) -> str:
    """TEXT, and s: (doc_id, term, s) of the given terms by a model."""
    return f"{TEXT}, s as (select doc_id, term, {model} as s from tf join df using (term) join dl using (doc_id) cross join st where term in ({words(*terms)}))"


def top(k: int = 5) -> str:
    return f"order by score desc, doc_id limit {k}"
