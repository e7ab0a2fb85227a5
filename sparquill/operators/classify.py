"""Classification by naive Bayes and by neighbours, data splits, and quality of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def naive_bayes(train: DataFrame, docs: DataFrame, label: str = "label", tokens: str = "tokens") -> DataFrame:
    """(doc_id, label, score): each document's likeliest class.

    score is log prior plus the sum over its tokens of log((count + 1) / (total + vocabulary)),
    over words that training has. Counts are partial aggregates; the classes are
    few, and a document's tokens are counted before they meet them.
    """
    each = train.select(label, F.explode(tokens).alias("term"))
    counts = each.groupBy("term", label).agg(F.count("*").alias("c"))
    words = counts.select("term").distinct()
    size = words.agg(F.count("*")).scalar()
    totals = counts.groupBy(label).agg(F.sum("c").alias("total"))
    priors = train.groupBy(label).agg(F.count("*").alias("docs"))
    n = train.agg(F.count("*")).scalar()
    classes = priors.join(totals, label, "left").select(label, F.ln(F.col("docs") / n).alias("prior"), (F.coalesce("total", F.lit(0)) + size).alias("base"))
    own = docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    seen = own.join(words, "term", "left_semi")
    # log((c + 1) / base) = log(c + 1) where the class has the word, less log(base) a token
    gains = seen.join(counts, "term").groupBy("doc_id", label).agg(F.sum(F.col("n") * F.ln(F.col("c") + 1)).alias("gain"))
    length = seen.groupBy("doc_id").agg(F.sum("n").alias("length"))
    pairs = docs.select("doc_id").join(length, "doc_id", "left").crossJoin(F.broadcast(classes))  # a class each: a handful
    scored = pairs.join(gains, ["doc_id", label], "left").select("doc_id", label, (F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.coalesce("length", F.lit(0)) * F.ln("base")).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", label)).alias("x"))
    return best.select("doc_id", f"x.{label}", "x.score")


def vote(neighbours: DataFrame, label: str = "label", key: str = "query_id") -> DataFrame:
    """(query, label, votes): the most frequent class among the neighbours; the smaller class of equals."""
    counts = neighbours.groupBy(key, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), label)
    return counts.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def split(rows: DataFrame, key: str, test: float = 0.1, validation: float = 0.1) -> DataFrame:
    """``rows`` with ``part``: train, validation or test, by a hash of the key, so that the split never changes."""
    x = F.pmod(F.xxhash64(key), F.lit(10_000)) / 10_000
    return rows.withColumn("part", F.when(x < test, "test").when(x < test + validation, "validation").otherwise("train"))


def quality(ranked: DataFrame, relevant: DataFrame, at: tuple[int, ...] = (1, 5, 10), key: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Per query: precision at each n of ``at``, recall, average precision and reciprocal rank.

    ranked: query, document, rank from 1. relevant: (query, document), distinct;
    or documents alone, relevant to every query: these are counted once and not
    repeated for each query. Queries of which ranked has no row are left out;
    those without a relevant document have 0.
    """
    shared = key not in relevant.columns
    on = [doc] if shared else [key, doc]
    judged = ranked.join(relevant.select(*on).withColumn("rel", F.lit(1)), on, "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("so_far", F.sum("rel").over(w))
    points = [(F.sum(F.when(F.col("rank") <= n, F.col("rel")).otherwise(0)) / n).alias(f"p{n}") for n in at]
    out = judged.groupBy(key).agg(*points, F.sum("rel").alias("found"), F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("gain"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    if shared:
        out = out.withColumn("total", relevant.agg(F.count("*")).scalar())
    else:
        out = out.join(relevant.groupBy(key).agg(F.count("*").alias("total")), key, "left")
    total = F.coalesce("total", F.lit(0))
    over = lambda x: F.when(total > 0, x / F.nullif(total, F.lit(0))).otherwise(0.0)
    return out.select(key, *[f"p{n}" for n in at], over(F.col("found")).alias("recall"), over(F.col("gain")).alias("average_precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def mean_quality(stats: DataFrame, key: str = "query_id") -> DataFrame:
    """One row: the means over queries."""
    return stats.agg(*[F.avg(c).alias(c) for c in stats.columns if c != key])


def good_queries(vocabulary: DataFrame, n_docs: Column, low: float = 0.01, high: float = 0.1, k: int = 20) -> DataFrame:
    """Terms that are neither rare nor common, the most frequent first."""
    return vocabulary.filter((F.col("df") >= low * n_docs) & (F.col("df") <= high * n_docs)).orderBy(F.desc("df"), "term").limit(k)
