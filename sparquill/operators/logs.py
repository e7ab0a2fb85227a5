"""Query-log and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decade(n: Column) -> Column:
    """Number of decimal digits less one: floor(log10(n)) without rounding errors; null below 1."""
    return F.when(n >= 1, F.length(n.cast("long").cast("string")) - 1)


def decade_histogram(counts: DataFrame, n: str) -> DataFrame:
    return counts.groupBy(decade(F.col(n)).alias("decade")).agg(F.count("*").alias("terms"))


def summary(log: DataFrame, query: str, order: list[str]) -> DataFrame:
    """One row: queries, distinct queries, queries equal to the one before.

    order: columns of which the first is a session or user; repeats are looked for inside it.
    """
    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    return log.withColumn("_b", F.lag(query).over(w)).agg(F.count("*").alias("total"), F.count_distinct(query).alias("distinct"), F.count_if(F.col("_b") == F.col(query)).alias("repeats"))


def terms_per_query(log: DataFrame, terms: Column) -> DataFrame:
    rows = log.groupBy(F.size(terms).alias("terms")).agg(F.count("*").alias("queries"))
    total = log.agg(F.count("*")).scalar()
    return rows.withColumn("share", F.col("queries") / total)


def pair_counts(log: DataFrame, key: str, terms: Column, chosen: DataFrame) -> DataFrame:
    """(a, b, n): in how many rows both of two chosen terms (a < b) are. chosen: a bounded list of terms.

    Pairs come from each row's own short list, so nothing is joined.
    """
    listed = chosen.agg(F.collect_set("term").alias("_listed"))
    own = log.select(key, terms.alias("_own")).crossJoin(F.broadcast(listed))  # one row
    own = own.select(key, F.array_sort(F.array_intersect(F.array_distinct("_own"), "_listed")).alias("t")).filter(F.size("t") > 1)
    a = own.select("t", F.posexplode("t").alias("i", "a"))
    return a.select("a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def locality(events: DataFrame, term: str, at: str, window: int) -> DataFrame:
    """One row: the share of events whose term was seen among the ``window`` before."""
    w = Window.partitionBy(term).orderBy(at)
    near = F.coalesce(F.col(at) - F.lag(at).over(w) <= window, F.lit(False))
    return events.withColumn("_n", near).agg(F.count("*").alias("events"), F.count_if("_n").alias("local"), (F.count_if("_n") / F.count("*")).alias("share"))


def blocks(trace: DataFrame, offset: str, size: str, block: int = 4096) -> DataFrame:
    """A row for each block that a read touches."""
    first = F.floor(F.col(offset) / block)
    last = F.floor((F.col(offset) + F.greatest(F.col(size), F.lit(1)) - 1) / block)
    return trace.withColumn("block", F.explode(F.sequence(first, last)))


def doc_freq_mismatch(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(term, ours, theirs) where two term tables differ; 0 where one lacks the term."""
    a, b = ours.select("term", F.col("df").alias("ours")), theirs.select("term", F.col("df").alias("theirs"))
    rows = a.join(b, "term", "full").select("term", F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))
    return rows.filter("ours <> theirs")


def latency_buckets(rows: DataFrame, value: str, growth: float = 0.01) -> DataFrame:
    """(bucket, n): counts in buckets that grow exponentially; histograms of parts add up."""
    return rows.filter(F.col(value) > 0).groupBy(F.floor(F.log(F.col(value)) / F.log(F.lit(1 + growth))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, value: str, at: list[float]) -> DataFrame:
    """(p, value): exact percentiles, interpolated."""
    return rows.agg(F.percentile(value, F.array(*map(F.lit, at))).alias("v")).select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*map(F.lit, at)), F.col("i")).alias("p"), "value")


def unique_in_window(log: DataFrame, query: str, order: str, window: int) -> DataFrame:
    """The log without queries among the last ``window`` that stayed; by rising ``order``.

    What stays depends on what stayed before for the same query only if the
    window counts queries given; then it is a per-query recurrence, so each
    query's times are folded on their own.
    """
    fold = F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast("array<bigint>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) > window), F.concat(kept, F.array(t.cast("bigint")))).otherwise(kept))
    return log.groupBy(query).agg(fold.alias("_k")).select(query, F.explode("_k").alias(order))
