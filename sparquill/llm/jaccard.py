"""Near copies by the Jaccard similarity of word shingles, for the corpus pipeline.

Candidates come from the links of SimHash fingerprints, which join equal and
nearly equal texts, large groups included, without pairs. These alone do not
find all: texts of similarity 0.8 differ in some 7 of 64 bits and often in more,
for which the pigeonhole principle leaves parts of so few bits that all texts
are candidates of each other. So texts that share one of their rarest shingles
are candidates too, which misses nothing (see prefix()). Every link is verified
on the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, steps
from .components import components
from .simhash import majority, one_of_each, row_key, shingle_hashes
from .simhash import links as simhash_links

#: Words of a shingle, and the similarity of near copies as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: Cells in which the shingles of all texts are counted. The counts only order shingles: with fewer cells there are more candidates, never fewer links.
CELLS, SLICE = 1 << 18, 1 << 12
#: Rounds that link a bucket's members to one of them, before pairs are made of what no link joins.
STARS = 2
#: Ratio of neighbouring classes of size.
CLASS = 1.05
SEED = 42


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; of all its words if they are fewer, of nothing without any."""
    return np.unique(shingle_hashes(text, words))


def _cells(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(docs: DataFrame) -> np.ndarray:
    """How many distinct shingles of texts fall in each of CELLS cells, over all of ``docs``. What reaches the driver is CELLS numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, texts in steps(batches, "text"):
            for x in texts:
                np.add.at(total, _cells(shingles(x)), 1)
        parts = total.astype("<u4").reshape(-1, SLICE)  # less than 2**32 texts in a task
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = defaultdict(lambda: np.zeros(SLICE, np.int64))
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] += np.frombuffer(x, "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "counts"])

    schema, out = "slice long, counts binary", np.zeros((CELLS // SLICE, SLICE), np.int64)
    for k, x in docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():  # CELLS / SLICE rows
        out[k] += np.frombuffer(x, np.int64)
    return out.ravel()


def prefix(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest hashes of a set, rarest first: so many that two alike sets have one of them in common.

    Sets whose similarity is part / whole or more share at least that fraction of
    either, so all but the last part of a set, less one, can be passed over: the first
    hash in common, in an order that all sets agree on, comes before it. Which order
    is a matter of cost only.
    """
    part, whole = SIMILARITY
    n = len(own)
    return own[np.lexsort((own, counts[_cells(own)]))][: n - -(-part * n // whole) + 1 if n else 0]


def may_be_alike(size: str, pos: str, other_size: str, other_pos: str) -> Column:
    """False only for sets that are not alike, if the hash at ``pos`` of one and ``other_pos`` of the other is the first that they share: none before it is in both."""
    part, whole = SIMILARITY
    return F.expr(f"least({size} - {pos}, {other_size} - {other_pos}) * {part + whole} >= {part} * ({size} + {other_size})")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of SIMILARITY or more."""
    part, whole = SIMILARITY
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * whole >= (len(a) + len(b) - both) * part


def _sets(docs: DataFrame) -> DataFrame:
    """(key, doc_id, node, fp, size, tokens) of every row: node is a hash of its set of shingles, fp its SimHash fingerprint, tokens its prefix()."""
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(docs))  # CELLS numbers, 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            rows = []
            for x in texts:
                hashes = shingle_hashes(x, WORDS)
                own = np.unique(hashes)
                rows.append((xxhash.xxh3_64_intdigest(own.tobytes()), majority(hashes), len(own), prefix(own, counts.value).view(np.int64)))
            nodes, fps, sizes, tokens = zip(*rows)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *signed, pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["key", "doc_id", "node", "fp", "size", "tokens"])

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "key long, doc_id long, node long, fp long, size long, tokens array<long>")


def _close(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal, each with the first of them, or linked by SimHash."""
    firsts = materialize(nodes.filter("size > 0").groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.filter("size > 0").join(firsts, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash_links(firsts.select("fp")).toDF("fp_a", "fp_b")
    near = near.join(firsts.toDF("fp_a", "a"), "fp_a").join(firsts.toDF("fp_b", "b"), "fp_b").select("a", "b")
    return equal.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``nodes`` (node, key) that are alike, by the texts of ``docs``, of which only theirs are copied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(shingles)
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3))
            yield batch.select([0, 1]).filter(pa.array([alike(known(x.as_py()), known(y.as_py())) for x, y in rows], pa.bool_()))

    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node"))
    texts = materialize(docs.select(row_key().alias("key"), "text").join(ends, "key").dropDuplicates(["node"]).select("node", "text"))
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    out = materialize(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    release(ends, texts)
    return out


def shared_tokens(nodes: DataFrame) -> DataFrame:
    """(token, pos, node, size) of the prefixes' hashes that two of ``nodes`` (node, size, tokens) have; pos is a hash's place in its own prefix."""
    index = nodes.select("node", F.col("size").cast("int"), F.posexplode("tokens").alias("pos", "token"))
    shared = index.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    return materialize(index.join(shared, "token"))


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(CLASS))).cast("int")


def rest_pairs(left: DataFrame) -> DataFrame:
    """Rows of ``left`` (token, pos, node, size, component) beside those of no smaller sets (other, other_size, other_pos, other_component) that have the token, where sizes and places let them be alike.

    If the token is the first that both share, the smaller set has at most a ninth of
    its hashes before it, and the places bound the sizes of the other. So these
    join by token and class of size, and a set meets only classes within its bounds.
    Two members of the component that most of a token's rows belong to do not meet.
    """
    part, whole = SIMILARITY
    most_of = left.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "component"))["component"].alias("most"))
    left = materialize(left.join(most_of, "token").withColumn("main", F.col("component") == F.col("most")).drop("most"))
    least = F.ceil(F.col("size") * part / whole)
    most = F.least(F.col("size"), F.floor((F.col("size") - F.col("pos")) * (part + whole) / part) - F.col("size"))
    large = left.filter(most >= least).withColumn("class", F.explode(F.sequence(_class(least), _class(most))))
    small = left.filter(f"pos * {part + whole} <= size * {whole - part}").withColumn("class", _class(F.col("size")))
    small = small.select("token", "class", F.col("node").alias("other"), F.col("size").alias("other_size"), F.col("pos").alias("other_pos"), F.col("component").alias("other_component"), F.col("main").alias("other_main"))
    one, two = large.filter("not main").join(small, ["token", "class"]), large.filter("main").join(small.filter("not other_main"), ["token", "class"])
    return one.union(two).drop("main", "other_main")


def links(left: DataFrame, close: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): alike pairs that join all alike pairs of ``left``, and those of ``close``. left: shared_tokens(); nodes: (node, key).

    What shares a token is a bucket. Its members are linked to one of them where the
    two are alike: first the one with the fewest rare hashes, as a text has from
    which the others were made, then the one with the most links. Pairs
    are made only of members that no link joins after that, and of those by
    rest_pairs(): all that can be alike. A large group of near copies is so joined by
    its stars. Where many texts have most of a passage and none is alike to one of
    them, their pairs remain, and are quadratic.
    """
    found, tried = _verified(close, nodes, docs), close
    for turn in range(STARS + 1):
        parts = materialize(components(found).toDF("node", "own"))
        labelled = left.join(parts, "node", "left").withColumn("component", F.coalesce("own", "node")).drop("own")
        several = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
        labelled = materialize(labelled.join(several, "token"))
        if turn < STARS:
            ends = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
            known = F.col("pos") / F.col("size") if turn == 0 else -F.coalesce("links", F.lit(0)).cast("double")
            first = F.min(F.struct(known.alias("known"), F.xxhash64("node", F.lit(turn)).alias("o"), "node", "size", "pos", "component"))
            heads = labelled.join(ends, "node", "left").groupBy("token").agg(first.alias("h")).select("token", *[F.col(f"h.{x}").alias(y) for x, y in (("node", "other"), ("size", "other_size"), ("pos", "other_pos"), ("component", "other_component"))])
            pairs = labelled.join(heads, "token")
        else:
            pairs = rest_pairs(labelled)
        pairs = pairs.filter(F.col("component") != F.col("other_component")).filter(may_be_alike("size", "pos", "other_size", "other_pos"))
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        release(labelled)
        found = found.union(_verified(pairs, nodes, docs))
        tried = tried.union(pairs)
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """(key, doc_id, component) of every row: rows of one component are joined by pairs of SIMILARITY or more. Rows without a word are one component."""
    own = materialize(_sets(docs))
    nodes = materialize(own.groupBy("node").agg(F.min("key").alias("key"), F.any_value("fp").alias("fp"), F.any_value("size").alias("size")))
    close = materialize(_close(nodes))
    left = shared_tokens(own.select("key", "node", "size", "tokens").join(nodes.select("key"), "key", "left_semi"))
    parts = components(links(left, close, nodes, docs))
    joined = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return own.select("key", "doc_id", "node").join(joined, "node").select("key", "doc_id", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of near copies: that with the smallest doc_id, null last, then by text."""
    return one_of_each(docs, near_copies(docs))
