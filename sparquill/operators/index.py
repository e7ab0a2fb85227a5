"""The index: documents with their tokens, and term postings derived from them.

For a handful of query terms a document's own token array holds all that is
needed, so postings of given terms are made without a shuffle. Queries by
pattern look at the vocabulary of each document the same way. A saved index is
Parquet: postings sorted by term and document, so that row groups are skipped
by the term's range, and a table of document lengths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass
class Index:
    """docs: doc_id, dl, dl_q and what else documents have; postings(): term, doc_id, tf, dl, dl_q, positions."""

    docs: DataFrame
    #: None: postings come from the column ``tokens`` of docs.
    table: DataFrame | None = None
    #: Whether scores use the length as one byte keeps it.
    lossy: bool = True

    @classmethod
    def build(cls, documents: DataFrame, text: str = "text", tokens: Callable[[Column], Column] = T.split_space, lossy: bool = True) -> Index:
        docs = documents.withColumn("tokens", tokens(F.coalesce(F.col(text), F.lit(""))))
        docs = docs.withColumn("dl", F.size("tokens")).withColumn("dl_q", T.four_bits(F.size("tokens")))
        return cls(docs, None, lossy)

    def terms(self, *terms: str) -> DataFrame:
        """Postings of the given terms."""
        given = list(dict.fromkeys(terms))
        if self.table is not None:
            return self.table.filter(F.col("term").isin(given))
        if not given:
            return self.matching(lambda x: F.lit(False))
        own = F.array(*[F.struct(F.lit(t).alias("term"), _positions(F.col("tokens"), lambda x, t=t: x == t).alias("positions")) for t in given])
        any_of = F.arrays_overlap("tokens", F.array(*map(F.lit, given)))
        rows = self.docs.filter(any_of).select("doc_id", "dl", "dl_q", F.explode(F.filter(own, lambda x: F.size(x["positions"]) > 0)).alias("x"))
        return rows.select("x.term", "doc_id", F.size("x.positions").alias("tf"), "dl", "dl_q", "x.positions")

    def matching(self, accept: Callable[[Column], Column]) -> DataFrame:
        """Postings of the terms that ``accept`` holds for."""
        if self.table is not None:
            return self.table.filter(accept(F.col("term")))
        tokens = F.col("tokens")
        found = F.array_distinct(F.filter(tokens, accept))
        rows = self.docs.select("doc_id", "dl", "dl_q", "tokens", F.explode(found).alias("term"))
        return rows.select("term", "doc_id", _positions(tokens, lambda x: x == F.col("term")).alias("positions"), "dl", "dl_q").select("term", "doc_id", F.size("positions").alias("tf"), "dl", "dl_q", "positions")

    def postings(self) -> DataFrame:
        """All postings."""
        if self.table is not None:
            return self.table
        rows = self.docs.select("doc_id", "dl", "dl_q", F.posexplode("tokens").alias("pos", "term"))
        return rows.groupBy("term", "doc_id", "dl", "dl_q").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "doc_id", "tf", "dl", "dl_q", "positions")

    def bags(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, len, tokens): each document's tokens and the length that scores use; of a table of postings only tokens that ``wanted`` (term) has, in no order."""
        length = F.col("dl_q" if self.lossy else "dl").alias("len")
        if self.table is None:
            return self.docs.select("doc_id", length, "tokens")
        rows = self.table.join(F.broadcast(wanted), "term", "left_semi").select("doc_id", length, F.array_repeat("term", F.col("tf")).alias("t"))
        return rows.groupBy("doc_id", "len").agg(F.flatten(F.collect_list("t")).alias("tokens"))

    def frequencies(self) -> DataFrame:
        """(term, doc_id, tf) of all postings. Each document's tokens are counted in its own row, without a shuffle."""
        if self.table is not None:
            return self.table.select("term", "doc_id", "tf")
        rows = self.docs.select("doc_id", F.sort_array("tokens").alias("t")).filter(F.size("t") > 0)
        t = F.col("t")
        ends = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.get(t, i - 1).eqNullSafe(F.get(t, i)))
        rows = rows.select("doc_id", "t", ends.alias("e"))
        e = F.col("e")
        each = F.transform(e, lambda i, k: F.struct(F.get(t, i - 1).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("tf")))
        return rows.select("doc_id", F.inline(each)).select("term", "doc_id", "tf")

    def vocabulary(self) -> DataFrame:
        """(term, df, ctf). Each document's own counts are made before the shuffle."""
        return self.frequencies().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("ctf"))

    def stats(self) -> DataFrame:
        """One row: n, avgdl, total."""
        return self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total"))

    def doc_freqs(self, terms: list[str]) -> DataFrame:
        """(term, df) of each given term; 0 for one that is nowhere."""
        asked = self.docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        found = self.terms(*terms).groupBy("term").agg(F.count("*").alias("df"))
        return asked.join(F.broadcast(found), "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))

    def save(self, path: str) -> None:
        self.postings().repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        self.docs.drop("tokens").write.mode("overwrite").parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str, lossy: bool = True) -> Index:
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), lossy)

    def append(self, other: Index) -> Index:
        """Both indexes as one; documents' ids must differ."""
        docs = self.docs.unionByName(other.docs, allowMissingColumns=True)
        table = None if self.table is None and other.table is None else self.postings().unionByName(other.postings())
        return Index(docs, table, self.lossy)


def _positions(tokens: Column, accept: Callable[[Column], Column]) -> Column:
    """Places (from 0) of the tokens that ``accept`` holds for."""
    marked = F.transform(tokens, lambda x, i: F.when(accept(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def open_index(spark: SparkSession, url: str) -> Index:
    """The saved index that ``index:saved:<path>`` names."""
    parts = url.split(":", 2)
    if len(parts) != 3 or parts[:2] != ["index", "saved"]:
        raise ValueError(f"not an index address: {url}")
    return Index.load(spark, parts[2])
