"""Sorting, paging, rescoring, diversity, grouping and joins between hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_MODES = {"none": None, "avg": F.avg, "max": F.max, "min": F.min, "total": F.sum}


def top(rows: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + k`` of the order, without sorting the rest."""
    return rows.orderBy(*order).offset(offset).limit(k) if offset else rows.orderBy(*order).limit(k)


def after(rows: DataFrame, k: int, score: float, doc_id: int, by: str = "score", key: str = "doc_id") -> DataFrame:
    """The next page by keyset: rows after (score, doc_id) by falling score, then rising id."""
    later = (F.col(by) < score) | ((F.col(by) == score) & (F.col(key) > doc_id))
    return rows.filter(later).orderBy(F.desc(by), key).limit(k)


def merge_top(shards: Sequence[DataFrame], k: int, *order: Column, offset: int = 0) -> DataFrame:
    """Top rows of several shards' top rows."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return top(out, k, *order, offset=offset)


def best_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_groups(rows: DataFrame, group: str, group_order: Column, order: Sequence[Column], groups: int, k: int, tie: Column | None = None) -> DataFrame:
    """The first ``groups`` groups by an aggregate of theirs, and of each its first ``k`` rows.

    The group ranking is a partial aggregate and a top-n; only rows of chosen
    groups, found by a join with that bounded list, are ranked inside.
    """
    chosen = rows.groupBy(group).agg(group_order.alias("_g")).orderBy(F.desc("_g"), tie if tie is not None else F.col(group)).limit(groups)
    chosen = chosen.select(group, "_g", F.row_number().over(Window.orderBy(F.desc("_g"), group)).alias("group_rank"))
    own = rows.join(F.broadcast(chosen), group)
    return best_per_group(own, [group], order, k).drop("_g")


def diversified(rows: DataFrame, key: str, order: Sequence[Column], k: int, per_key: int) -> DataFrame:
    """Top ``k`` with at most ``per_key`` rows of each key."""
    return best_per_group(rows, [key], order, per_key, "_r").drop("_r").orderBy(*order).limit(k)


def rescore(hits: DataFrame, second: DataFrame, n: int, weight: float, key: str = "doc_id") -> DataFrame:
    """The first ``n`` hits, with ``weight`` times the second score added where there is one."""
    firsts = hits.orderBy(F.desc("score"), key).limit(n)
    own = second.select(key, F.col("score").alias("_second"))
    return own.join(F.broadcast(firsts), key, "right").select(key, (F.col("score") + weight * F.coalesce("_second", F.lit(0.0))).alias("score"))


def rescore_by(hits: DataFrame, n: int, order: Sequence[Column], key: str = "doc_id") -> DataFrame:
    """The first ``n`` hits in another order."""
    return hits.orderBy(F.desc("score"), key).limit(n).orderBy(*order)


def to_parent(children: DataFrame, key: str, mode: str = "avg", score: str = "score") -> DataFrame:
    """(key, score): the children's scores, combined for each parent."""
    f = SCORE_MODES[mode]
    rows = children.groupBy(key)
    return rows.agg(f(score).alias("score")) if f else rows.agg(F.lit(1.0).alias("score"))


def to_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Children of the parents, with the parent's score."""
    return children.join(parents.select(F.col(parent_key).alias("_p"), "score"), F.col(child_key) == F.col("_p")).drop("_p")


def key_join(to: DataFrame, to_key: str, hits: DataFrame, from_key: str, mode: str = "none", least: int = 0, most: int | None = None) -> DataFrame:
    """Rows of ``to`` whose key some hit has; the hits' scores combined as score, from ``least`` to ``most`` hits a key."""
    f = SCORE_MODES[mode]
    if f is None and not least and most is None:
        return to.join(hits.select(F.col(from_key).alias("_k")).distinct(), F.col(to_key) == F.col("_k"), "left_semi")
    own = hits.groupBy(F.col(from_key).alias("_k")).agg((f("score") if f else F.lit(1.0)).alias("score"), F.count("*").alias("_n"))
    own = own.filter(F.col("_n") >= least) if most is None else own.filter(F.col("_n").between(least, most))
    return to.join(own.drop("_n"), F.col(to_key) == F.col("_k")).drop("_k")


def parents_by_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, value: str, pick: str = "min") -> DataFrame:
    """Parents with the smallest or largest value of their children, to sort by; null without children."""
    own = children.groupBy(F.col(child_key).alias("_p")).agg((F.min if pick == "min" else F.max)(value).alias("child_value"))
    return parents.join(own, F.col(parent_key) == F.col("_p"), "left").drop("_p")


def select_value(values: Column, pick: str) -> Column:
    """One value of a multi-valued column: min, max, middle_min or middle_max."""
    n = F.size(values)
    if pick in ("min", "max"):
        return (F.array_min if pick == "min" else F.array_max)(values)
    at = F.floor((n - 1) / 2) if pick == "middle_min" else F.floor(n / 2)
    return F.get(F.sort_array(values), at.cast("int"))


def early_terminated(rows: DataFrame, presorted_by: str, partition: str, n: int) -> DataFrame:
    """The first ``n`` rows of each presorted part."""
    return best_per_group(rows, [partition], [F.col(presorted_by)], n, "_r").drop("_r")
