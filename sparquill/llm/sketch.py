"""Bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes (48 bits) of
a text's shingles. Sketches of parts merge to the sketch of the whole. From them
resemblance, containment and the number of distinct shingles are estimated;
below ``k`` distinct shingles all three are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 256
WORDS = 5
#: Ranges of ids by which neighbours are brought together: so many, and so many in each of them, at most.
QUANTILES, FINE = 256, 1024
#: Bits of a hash in a sketch.
HASH_BITS = 48
_WHITE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """``df`` with the sketch ``out`` of the column ``text``, split at white space.

    A text of fewer words has one shingle, all its words; one without words, or
    null, has the empty sketch.
    """
    parts, hashes = f"_{out}_words", f"_{out}_hashes"
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_WHITE))
    df = df.withColumn(parts, F.split(trimmed, r"\s+"))
    df = df.withColumn(hashes, F.transform(parts, lambda w: F.xxhash64(w)))
    own = F.col(hashes)
    many = F.slice(F.transform(own, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(own, i + F.lit(j)) for j in range(1, words)]), 64 - HASH_BITS)), 1, F.size(own) - F.lit(words - 1))
    few = F.array(F.shiftrightunsigned(F.xxhash64(own), 64 - HASH_BITS))
    none = F.array().cast("array<bigint>")
    shingles = F.when(F.size(own) >= words, many).when((F.size(own) == 1) & (F.get(F.col(parts), F.lit(0)) == ""), none).otherwise(few)
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(parts, hashes)


def merge(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch): the sketch of each key's parts together. Only ``k`` hashes a key and task are shuffled on."""
    each = df.select(key, F.explode(sketch).alias("_h")).distinct()
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_h"))).filter(F.col("_n") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def distinct(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = F.element_at(sketch, -1).cast("double") + 1
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * float(1 << HASH_BITS) / last)


def _shared(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """How many of the ``k`` smallest hashes of the union both have, and how many those are."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)).cast("double"), F.size(union)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1; two empty sketches are alike (1)."""
    both, n = _shared(a, b, k)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(n, F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained (1)."""
    both, n = _shared(a, b, k)
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    inter = both / F.greatest(n, F.lit(1)) * distinct(union, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), inter / F.greatest(distinct(a, k), F.lit(1.0))))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: 12 hexadecimal digits a hash, in ascending order; empty for the empty sketch."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), HASH_BITS // 4, "0"))), "")


def with_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with ``_part``, a number that rises with the doc_id, for about ``parts`` ranges of as many rows; of null ids negative numbers by a hash of the row.

    QUANTILES approximate quantiles split the ids, and those in each range, up to
    FINE, split it again, so ids that clump are spread like others. Only rows that
    share an id stay together. The second splits are a table of a row a range.
    """
    ids = docs.select("doc_id")
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 0.5 / QUANTILES)}) or [0]
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("doc_id")))
    fine = max(1, min(FINE, -(-parts // max(1, len(bounds) - 1))))
    if fine == 1:
        part = at.cast("long")
    else:
        cuts = F.percentile_approx("doc_id", [i / fine for i in range(1, fine)], 100 * fine)
        cuts = materialize(ids.filter("doc_id is not null").groupBy(at.alias("_at")).agg(cuts.alias("_cuts")))
        docs = docs.withColumn("_at", at).join(cuts, "_at", "left")
        part = F.col("_at").cast("long") * fine + F.size(F.filter("_cuts", lambda x: x <= F.col("doc_id")))
    part = F.when(F.col("doc_id").isNotNull(), part).otherwise(-1 - F.pmod(F.xxhash64("text"), F.lit(parts)))
    return docs.withColumn("_part", part).drop("_at", "_cuts")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``sketch``, and ``next`` (text, sketch) of the next document: that with the next smaller doc_id, of the smallest the one with the largest.

    Texts are shuffled once, by ranges of ids. The largest id of each range is
    copied to the range above (of the topmost to the lowest), so that a window
    over one range sees every next document. What is looked at across ranges are
    their largest ids, one row a range.
    """
    tasks = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = 16 * tasks  # by hash to tasks; several a task even out
    base = with_ranges(docs.select("doc_id", "text"), parts)
    heads = base.filter("doc_id is not null").groupBy("_part").agg(F.max("doc_id").alias("_head"))
    above = F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.first("_part").over(Window.orderBy("_part")))
    heads = materialize(heads.select("_head", above.alias("_above")))  # a row a range: QUANTILES * FINE, at most
    rows = base.join(heads, F.col("doc_id") == F.col("_head"), "left")
    places = F.array_compact(F.array(F.struct("_part", F.lit(False).alias("ghost")), F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("_part"), F.lit(True).alias("ghost")))))
    rows = rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p._part", "p.ghost").repartition(tasks, "_part")
    rows = with_sketch(rows, "text", "sketch")
    order = Window.partitionBy("_part").orderBy(F.desc("ghost"), "doc_id", F.desc("text"))
    ends = (F.lead("doc_id").over(order).isNull()) | (F.lead("doc_id").over(order) != F.col("doc_id")) | (F.lead("ghost").over(order) != F.col("ghost"))
    rows = rows.withColumn("_mark", F.when(ends, F.struct("text", "sketch")))
    rows = rows.withColumn("next", F.when(F.col("doc_id").isNotNull(), F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))))
    return rows.filter("not ghost").select("doc_id", "text", "sketch", "next")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced by the next document's beginning.

    The next document is that with the next smaller doc_id, of the smallest the
    one with the largest. Null texts count as empty. Where rows share a doc_id,
    the least of their texts stands for it as a next document. A row with a null
    doc_id has no next document: its last third is only cut off.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, cut = F.length("text"), "cast(floor(length(text) / 3) as int)"
    both = with_next(own).withColumn("edited", F.concat(F.expr(f"left(text, length(text) - {cut})"), F.coalesce(F.expr(f"left(next.text, {cut})"), F.lit(""))))
    both = both.select("doc_id", "text", "sketch", F.col("next.sketch").alias("next_sketch"), "edited")
    out = with_sketch(both, "edited", "edited_sketch")
    none = F.array().cast("array<bigint>")
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", none)).alias("near_next"),
        distinct(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
