"""Exact top-k inner products by pivot-table elimination.

Every vector carries its distances to a fixed set of pivots. For a query q and a
candidate v, |d(q,p) - d(v,p)| is a lower bound of d(q,v) for each pivot p, and
so, as 2<q,v> = |q|^2 + |v|^2 - d(q,v)^2, the largest of them bounds the score
from above. Candidates are evaluated in the order of that bound until none can
reach the k-th score found. The same holds for blocks of vectors by the ranges
of their distances: pairs of blocks are taken in the order of their bounds, and
a pair that cannot reach the k-th scores found so far is never brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Pivots: the vectors whose hashed ids come first. They only tighten bounds; any choice gives the same result.
PIVOTS = 32
#: Rows of a block of candidates and of queries, about; a task holds one of each.
BLOCK, QUERY_BLOCK = 8_192, 8_192
#: Ranges of distance that a pivot's vectors are cut into, at most; further blocks part them by hash.
CUTS = 64
#: Queries that are bounded and evaluated at once.
CHUNK = 64
#: What rounding may add to a bound, relative and absolute: distances are kept as floats, scores are whole numbers.
SLACK, WHOLE = 1e-6, 0.5
#: Sums below this are exact in doubles.
_EXACT = 1 << 53

def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, dim, v): v is floor(scale * component), in doubles. Rows without an id and vectors that are null or hold a null or non-finite component go."""
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), v.alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def with_pivots(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with ``to_pivots``, the distances to the pivots of their dimension, and ``square``, that to the origin squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[list[float]] = [[]] * len(rows)
            squares = [0.0] * len(rows)
            for dim in set(dims):
                at = [i for i, d in enumerate(dims) if d == dim]
                v = np.array([rows[i] for i in at], np.float64).reshape(len(at), dim)
                found, own = _distances(v, pivots.get(dim, np.zeros((0, dim)))), (v * v).sum(1)
                for i, x, y in zip(at, found.tolist(), own.tolist()):
                    out[i], squares[i] = x, y
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float32())), pa.array(squares, pa.float64())], ["vec_id", "dim", "v", "to_pivots", "square"])

    return vectors.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, v array<double>, to_pivots array<float>, square double")


def _in_blocks(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """``rows`` with the number ``name`` of a block of about ``size`` of them: alike in their nearest pivot, and in the distance to it.

    As many pivots as there are blocks part the rows, then ranges of distance,
    then a hash, so that any number of equal vectors spreads over blocks.
    """
    own = F.slice("to_pivots", 1, max(1, min(PIVOTS, n // size)))
    near = F.coalesce(F.array_min(own), F.lit(0.0)).cast("double")
    rows = rows.withColumn("cell", F.coalesce(F.array_position(own, F.array_min(own)), F.lit(0))).withColumn("near", near * (1 + F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) * 1e-12))
    cuts = F.percentile_approx("near", [i / CUTS for i in range(1, CUTS)], 10_000)
    cells = materialize(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).alias("parts"), cuts.alias("cuts")))  # a row a pivot and dimension
    rows = rows.join(cells, ["dim", "cell"])
    ranges = F.least("parts", F.lit(CUTS))
    place = F.floor(F.size(F.filter("cuts", lambda x: x <= F.col("near"))) * ranges / CUTS)
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("parts") / ranges))
    return rows.withColumn(name, F.xxhash64("cell", place, salt)).drop("cell", "near", "parts", "cuts")


def _ranges(rows: DataFrame, block: str, p: str) -> DataFrame:
    """Of each block: least and largest distance to each pivot, and the largest square. Names begin with ``p``."""
    each = lambda f: F.array(*[f(F.get("to_pivots", F.lit(i))) for i in range(PIVOTS)])
    return rows.groupBy("dim", block).agg(each(F.min).alias(f"{p}low"), each(F.max).alias(f"{p}high"), F.max("square").alias(f"{p}square"))


def _bound() -> Column:
    """The largest score that a query of one block can have with a candidate of the other."""
    apart = F.expr(f"array_max(transform(sequence(0, {PIVOTS - 1}), i -> greatest(coalesce(get(vlow, i) - get(qhigh, i), 0), coalesce(get(qlow, i) - get(vhigh, i), 0), 0)))").cast("double")
    both = F.col("qsquare") + F.col("vsquare")
    return (both - apart * apart) / 2 + SLACK * both + WHOLE


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hits (query, id, score) each query's ``k`` best: ids and scores, m x k, filled up with no score."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    kept = rank < k
    best_ids, best = np.zeros((m, k), np.int64), np.full((m, k), -np.inf)
    best_ids[q[kept], rank[kept]], best[q[kept], rank[kept]] = ids[kept], scores[kept]
    return best_ids, best


def search(q: np.ndarray, q_ids: np.ndarray, q_to: np.ndarray, v: np.ndarray, ids: np.ndarray, v_to: np.ndarray, k: int, least: np.ndarray | None = None, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the ``k`` best rows of ``v`` for each row of ``q``, ties to the smaller id; a row with the query's id takes no part.

    ``least``: for each query a score that is no hit's below it. Every candidate
    has its own bound, the best of all pivots. A query takes candidates by
    falling bound, eight times as many in each step, and stops where no bound
    reaches its k-th score. Queries with alike distances are evaluated together.
    """
    m, n = len(q), len(v)
    order = np.lexsort((q_to.min(1), q_to.argmin(1))) if q_to.shape[1] else np.arange(m)
    squares = (v * v).sum(1)
    out = []
    for a in range(0, m, CHUNK):
        who = order[a : a + CHUNK]
        own, to = q[who], q_to[who]
        apart = np.zeros((len(who), n))
        for p in range(v_to.shape[1]):
            np.maximum(apart, np.abs(to[:, p, None] - v_to[None, :, p]), out=apart)
        bound = (own * own).sum(1)[:, None] + squares
        bound += 2 * SLACK * bound + 2 * WHOLE - apart * apart
        bound /= 2
        bound[ids == q_ids[who, None]] = -np.inf
        floor = np.full(len(who), -np.inf) if least is None else least[who].astype(np.float64)
        rows, found, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        taken, width = np.isneginf(bound), 8 * k
        while True:
            limit = floor if width >= n else np.maximum(floor, np.partition(bound, n - width, axis=1)[:, n - width])
            want = (bound >= limit[:, None]) & ~taken
            columns, pairs = np.flatnonzero(want.any(0)), int(want.sum())
            if pairs:
                if 4 * pairs < len(who) * len(columns):  # queries want different candidates
                    i, j = np.nonzero(want)
                    got = np.einsum("ij,ij->i", own[i], v[j])
                    good = got >= floor[i]
                    i, j, got = i[good], j[good], got[good]
                else:
                    whole = own @ v[columns].T
                    pairs = whole.size
                    i, j = np.nonzero((whole >= floor[:, None]) & want[:, columns])
                    j, got = columns[j], whole[i, j]
                if stats is not None:
                    stats["evaluated"] = stats.get("evaluated", 0) + pairs
                best_ids, best = _best(np.concatenate([rows, i]), np.concatenate([found, ids[j]]), np.concatenate([scores, got]), len(who), k)
                floor = np.maximum(floor, best[:, -1])
                rows, ranks = np.nonzero(best > -np.inf)
                found, scores = best_ids[rows, ranks], best[rows, ranks]
            if width >= n:
                break
            taken |= want
            width *= 8
        out.append((who[rows], found, scores))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _pair(k: int):
    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(queries) or not len(rows):
            return none
        v, ids, v_to = _matrix(rows["v"]), rows["vec_id"].to_numpy(), _matrix(rows["to_pivots"])
        q, q_ids, q_to = _matrix(queries["v"]), queries["vec_id"].to_numpy(), _matrix(queries["to_pivots"])
        if not v.size or float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < _EXACT:
            found, got, scores = search(q, q_ids, q_to, v, ids, v_to, k, queries["least"].to_numpy(np.float64))
            return pd.DataFrame({"query_id": q_ids[found], "vec_id": got, "score": scores.astype(np.int64)})
        out = [none]
        for i, q_id in enumerate(q_ids):  # components so large that doubles round: whole numbers of any size
            own = [int(x) for x in q[i]]
            best = sorted((-sum(a * int(b) for a, b in zip(own, row)), int(x)) for row, x in zip(v, ids) if x != q_id)[:k]
            out.append(pd.DataFrame({"query_id": q_id, "vec_id": [x for _, x in best], "score": [-s for s, _ in best]}))
        return pd.concat(out)

    return run


def top_k(vectors: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, scale: int = 64, block: int = BLOCK, query_block: int = QUERY_BLOCK, stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` highest integer inner products, all if there are fewer.

    Vectors meet those of their own dimension only. Rows with a query's vec_id
    are the query itself; repeats of a row are one row. Ties go to the smaller
    vec_id. Components are floor(scale * x); scores must fit a long.

    A task holds one block of queries and one of candidates. Bounds of all pairs
    of blocks come from a row a block. Each block of queries takes its pairs by
    falling bound, four times as many in each round; a pair whose bound is below
    the least k-th score of the block so far is left out, and then no vector of
    it is copied. ``stats`` gets the numbers of pairs, and of pairs brought together.
    """
    given = quantise(vectors, scale).dropDuplicates(["vec_id", "v"])
    first = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # PIVOTS rows, whatever the input
    pivots = {d: np.array([r["v"] for r in first if r["dim"] == d], np.float64).reshape(-1, d) for d in {r["dim"] for r in first}}
    table = materialize(with_pivots(given, pivots))
    n, n_queries = table.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    rows, queries = _in_blocks(table, n, block, "vb"), _in_blocks(table.filter(is_query), n_queries, query_block, "qb")
    bounds = _ranges(queries, "qb", "q").join(_ranges(rows, "vb", "v"), "dim").select("dim", "qb", "vb", _bound().alias("bound"))
    turn = F.row_number().over(Window.partitionBy("dim", "qb").orderBy(F.desc("bound"), "vb"))
    pairs = materialize(bounds.withColumn("turn", turn))
    last, key = pairs.agg(F.max("turn")).first()[0] or 0, ["dim", "qb", "vb"]
    best = materialize(table.limit(0).selectExpr("vec_id as query_id", "vec_id", "vec_id as score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    done, width = 0, 1
    while done < last:
        kth = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).select("query_id", F.col("s").cast("double").alias("least"))
        asking = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").drop("query_id").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        floors = asking.groupBy("dim", "qb").agg(F.min("least").alias("floor"))
        todo = pairs.filter(F.col("turn").between(done + 1, done + width)).join(floors, ["dim", "qb"]).filter("bound >= floor")
        todo = materialize(todo.select(*key))
        n_todo = todo.count()
        if stats is not None:
            stats["pairs"], stats["met"] = pairs.count(), stats.get("met", 0) + n_todo
        if not n_todo:  # bounds fall: no later pair can do more
            break
        ours, theirs = asking.join(todo, ["dim", "qb"]), rows.join(todo, ["dim", "vb"])
        ours, theirs = (x.select(*[F.col(c).alias(c) for c in (*key, "vec_id", "v", "to_pivots", *extra)]) for x, extra in ((ours, ["least"]), (theirs, [])))
        found = ours.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInPandas(_pair(k), "query_id long, vec_id long, score long")
        ranked = best.union(found).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        old, best = best, materialize(ranked.select("query_id", "vec_id", "score"))
        release(old, todo)
        done, width = done + width, 4 * width
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 20 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
