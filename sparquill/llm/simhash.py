"""Near-duplicate detection on 64-bit SimHash fingerprints by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, steps, unused
from .components import components

BITS = 64
SEED = 42
#: Members of a bucket up to which its fingerprints are compared in pairs. Beyond it, codes link them without pairs.
BUCKET = 64
_SIGNED = 1 << 63


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hash of each word shingle of ``text``, repeats included; of all its words if they are fewer, of nothing without any."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), len(parts)
    words = min(words, n)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - words + 1].tolist(), ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the 64-bit ``hashes`` have; 0 without any."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the word shingles of ``text``, repeats included; 0 if it has no word."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(key, doc_id, fp): fp is the fingerprint as a signed long. A null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            found = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["key", "doc_id", "fp"])

    return docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, fp long")


def agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for how many of them bits i and j are both set (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(own), 50_000):
                bits = np.unpackbits(np.ascontiguousarray(own[k : k + 50_000]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(own)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for cell, n in cells:  # 4097 rows, whatever the input
        out[cell] = n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about one size; bits that correlate over the fingerprints come together."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        pool = sorted(free)
        start = max(pool, key=lambda b: (like[b, pool].sum(), -b))
        own = [start]
        free.discard(start)
        while len(own) < size:
            nxt = max(sorted(free), key=lambda b: (like[b, own].sum(), -b))
            own.append(nxt)
            free.discard(nxt)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds, one a partition, with the sum ``total`` and the least sum of estimated candidates; -1 leaves a partition out.

    costs: for each partition the estimate by threshold. Dynamic programming over partitions and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in own.items():
                if spent + t not in step or cost + c < step[spent + t][0]:
                    step[spent + t] = (cost + c, [*chosen, t])
        best = step
    return best[total][1]


def plan(fps: DataFrame, threshold: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe.

    If every partition i differed in more than t_i bits, the fingerprints would differ in at least
    sum(t_i + 1) bits; so with a sum of t_i of threshold - partitions + 1 none within ``threshold`` is missed.
    """
    parts = threshold + 1
    n, both = agreement(fps)
    groups = group_bits(n, both, parts)
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), _masked(F.col("fp"), g).alias("key")) for i, g in enumerate(groups)])).alias("x")).select("x.*")
    pairs = dict(keyed.groupBy("p", "key").agg(F.count("*").cast("double").alias("n")).groupBy("p").agg(F.sum(F.col("n") * F.col("n"))).collect())  # a row for each partition
    p = both.diagonal() / max(n, 1)
    costs = []
    for i, g in enumerate(groups):
        same = p[g] ** 2 + (1 - p[g]) ** 2
        odds = (1 - same) / np.maximum(same, 1e-9)
        grown = [1.0]  # expected candidates within t bits, against those equal in the partition
        for t in range(1, threshold + 1):
            grown.append(grown[-1] + float(odds.sum()) ** t / float(np.prod(range(1, t + 1))))
        probes = [float(sum(np.prod([len(g) - k for k in range(j)]) / max(1, np.prod(range(1, j + 1))) for j in range(t + 1))) for t in range(threshold + 1)]
        costs.append({-1: 0.0} | {t: pairs.get(i, 0.0) * grown[t] + n * probes[t] for t in range(threshold + 1)})
    return [(g, t) for g, t in zip(groups, allocate(costs, threshold - parts + 1)) if t >= 0]


def _long(x: int) -> int:
    return (x ^ _SIGNED) - _SIGNED


def _masked(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(_long(sum(1 << b for b in bits))))


def _near(bits: list[int], t: int) -> list[int]:
    """Masks with at most ``t`` of ``bits``."""
    out = [0]
    for b in bits:
        out += [x | 1 << b for x in out if x.bit_count() < t]
    return out


def links(fps: DataFrame, threshold: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between different fingerprints of ``fps`` (fp, distinct) that join all within ``threshold`` bits.

    A bucket is what shares a partition's bits. Up to ``bucket`` members probe it
    and are verified pair by pair. Of a larger one no pairs are made: each
    fingerprint that is in it or probes it goes to all codes within half the
    threshold of it, and those that meet at a code - at most as many as there
    are codes about one - are linked to the first of them. For threshold 2 two
    fingerprints meet at a code if and only if they differ in at most 2 bits, so
    nothing is lost and nothing false is linked.
    """
    if threshold != 2:
        raise ValueError("the way for large buckets is for threshold 2")
    chosen = plan(fps, threshold)
    index = reduce(DataFrame.union, [fps.select(F.lit(i).alias("p"), _masked(F.col("fp"), g).alias("key"), "fp") for i, (g, _) in enumerate(chosen)])
    probe = reduce(
        DataFrame.union,
        [fps.select(F.lit(i).alias("p"), F.explode(F.array(*[_masked(F.col("fp"), g).bitwiseXOR(F.lit(_long(m))) for m in _near(g, t)])).alias("key"), "fp") if t else fps.select(F.lit(i).alias("p"), _masked(F.col("fp"), g).alias("key"), "fp") for i, (g, t) in enumerate(chosen)],
    )
    sizes = materialize(index.groupBy("p", "key").agg(F.count("*").alias("n")).filter("n > 1 or p in ({})".format(",".join([str(i) for i, (_, t) in enumerate(chosen) if t] or ["-1"]))))
    cold, hot = sizes.filter(F.col("n") <= bucket).select("p", "key"), sizes.filter(F.col("n") > bucket).select("p", "key")
    a, b = index.join(cold, ["p", "key"], "left_semi"), probe.withColumnRenamed("fp", "other")
    pairs = a.join(b, ["p", "key"]).filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= threshold))
    pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    crowd = probe.join(hot, ["p", "key"], "left_semi").select("fp").distinct()
    codes = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_long(1 << k))) for k in range(BITS)])).alias("code"))
    met = codes.groupBy("code").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def _components(own: DataFrame, threshold: int) -> DataFrame:
    """(fp, least, component) of each fingerprint of ``own``: its smallest doc_id, and the fingerprint that stands for its component."""
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(fps.select("fp"), threshold))
    return materialize(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))


def near_duplicates(docs: DataFrame, threshold: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 lower-case hexadecimal digits. component_id: the smallest
    doc_id that links of at most ``threshold`` differing bits reach. Equal
    fingerprints, those of empty texts (0) included, are one component; copies
    are folded before any linking. A null doc_id is kept and never a component's
    id unless it has no other. Other columns are not kept.
    """
    own = materialize(fingerprints(docs, words))
    joined = _components(own, threshold)
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key() -> Column:
    """A hash of doc_id and text: what tells rows of ``docs`` apart, null ids and repeated ones included."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``groups`` (key, doc_id, component): that with the smallest doc_id, null last, then by key.

    What goes are keys, a written table whose size Spark knows: texts are shuffled
    only if that table is too large to send, and for rows that repeat one id and text.
    """
    head = unused(docs, "head")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "key"))
    heads = materialize(groups.groupBy("component").agg(first.alias("head")).select(F.col("head.key").alias("key"), F.lit(True).alias("stays")))
    keys = groups.groupBy("key").agg(F.count("*").alias("n")).join(heads, "key", "left").filter("stays is null or n > 1")
    goes = materialize(keys.select(F.col("key").alias(head), F.col("stays").isNotNull().alias("repeated")))
    keyed = docs.withColumn(head, row_key())
    alone = keyed.join(goes.select(head), head, "left_anti")
    once = keyed.join(goes.filter("repeated").select(head), head, "left_semi").dropDuplicates([head])
    return alone.unionByName(once).drop(head)


def keep_one(docs: DataFrame, threshold: int = 2, words: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id, null last. Repeats of its row stay one row.

    Rows with null ids or with equal ids and different texts are told apart by
    their texts. Documents without a word share one fingerprint, so one of them stays.
    """
    own = materialize(fingerprints(docs, words))
    return one_of_each(docs, own.join(_components(own, threshold).select("fp", "component"), "fp"))
