"""Query trees that compile to one DataFrame of (doc_id, score)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import MODELS, Model, Stats
from .index import Index


class Query:
    """hits(index) is (doc_id, score), a row for each matching document."""

    def hits(self, index: Index) -> DataFrame:
        raise NotImplementedError

    def boosted(self, factor: float) -> Query:
        return Boost(self, factor)


def weighted(index: Index, rows: DataFrame, model: Model, tf: Column | str = "tf", df: Column | None = None, ctf: Column | None = None) -> DataFrame:
    """(doc_id, score) of rows of one term's postings. Statistics are scalar subqueries, so the plan stays one."""
    stats = index.stats()
    df = rows.agg(F.count_distinct("doc_id")).scalar() if df is None else df
    ctf = rows.agg(F.sum("tf")).scalar() if ctf is None else ctf
    tf = F.col(tf) if isinstance(tf, str) else tf
    dl = F.col("dl_q" if index.lossy else "dl")
    given = Stats(tf, df, ctf, dl, stats.select("n").scalar(), stats.select("avgdl").scalar(), stats.select("total").scalar())
    return rows.select("doc_id", model(given).cast("double").alias("score"))


@dataclass
class Term(Query):
    term: str
    model: Model = MODELS["bm25"]

    def hits(self, index: Index) -> DataFrame:
        return Terms([self.term], None, self.model).hits(index)


@dataclass
class MatchAll(Query):
    def hits(self, index: Index) -> DataFrame:
        return index.docs.select("doc_id", F.lit(1.0).alias("score"))


@dataclass
class MatchNone(Query):
    def hits(self, index: Index) -> DataFrame:
        return index.docs.select("doc_id", F.lit(1.0).alias("score")).filter(F.lit(False))


@dataclass
class Bool(Query):
    """must and filter clauses all match, must_not none, at least min_should of should; the score sums must and should.

    Without must and filter at least one should clause matches. Only must_not matches nothing.
    """

    must: Sequence[Query] = ()
    filter: Sequence[Query] = ()
    should: Sequence[Query] = ()
    must_not: Sequence[Query] = ()
    min_should: int | None = None
    max_clauses: int = 1024

    def hits(self, index: Index) -> DataFrame:
        kinds = [("must", self.must), ("filter", self.filter), ("should", self.should), ("must_not", self.must_not)]
        if sum(len(x) for _, x in kinds) > self.max_clauses:
            raise ValueError("too many clauses")
        if not (self.must or self.filter or self.should):
            return MatchNone().hits(index)
        least = self.min_should if self.min_should is not None else int(not self.must and not self.filter)
        rows = [q.hits(index).select("doc_id", F.lit(kind).alias("kind"), ("score" if kind in ("must", "should") else F.lit(0.0).alias("score"))) for kind, clauses in kinds for q in clauses]
        of = lambda k: F.count_if(F.col("kind") == k)
        every = reduce(DataFrame.union, rows).groupBy("doc_id").agg(F.sum("score").alias("score"), of("must").alias("m"), of("filter").alias("f"), of("should").alias("s"), of("must_not").alias("x"))
        return every.filter((F.col("m") == len(self.must)) & (F.col("f") == len(self.filter)) & (F.col("s") >= least) & (F.col("x") == 0)).select("doc_id", "score")


@dataclass
class Terms(Query):
    """Documents with all of the terms, or at least ``least`` different ones; a term given twice counts twice.

    On an index of token arrays that is one scan for the statistics of all terms
    together and one that scores row by row: nothing is shuffled. On a table of
    postings, rows of the terms are added up by document.
    """

    terms: Sequence[str]
    least: int | None = None
    model: Model = MODELS["bm25"]

    def hits(self, index: Index) -> DataFrame:
        times = Counter(self.terms)
        if not times:
            return MatchNone().hits(index)
        need = len(times) if self.least is None else self.least
        length = F.col("dl_q" if index.lossy else "dl")
        if index.table is not None:
            rows, stats = index.terms(*times), index.stats()
            df = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))  # a row a term
            given = Stats(F.col("tf"), F.col("df"), F.col("ctf"), length, *[stats.select(c).scalar() for c in ("n", "avgdl", "total")])
            weight = F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col("term"))
            scored = rows.join(F.broadcast(df), "term").select("doc_id", (self.model(given) * weight).cast("double").alias("score"))
            return scored.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("_met")).filter(F.col("_met") >= need).select("doc_id", "score")
        counted = index.docs.select("doc_id", "dl", "dl_q", *[_frequency(t).alias(f"f{i}") for i, t in enumerate(times)])
        whole = [F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("total")]
        each = [x for i in range(len(times)) for x in (F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}"), F.sum(f"f{i}").alias(f"ctf{i}"))]
        known = counted.agg(*whole, *each).select(F.struct("*").alias("s")).scalar()
        of = lambda name: known.getField(name)
        parts = [F.when(F.col(f"f{i}") > 0, n * self.model(Stats(F.col(f"f{i}"), of(f"df{i}"), of(f"ctf{i}"), length, of("n"), of("avgdl"), of("total")))).otherwise(0.0) for i, n in enumerate(times.values())]
        met = reduce(Column.__add__, [F.when(F.col(f"f{i}") > 0, 1).otherwise(0) for i in range(len(times))])
        return counted.filter(met >= need).select("doc_id", reduce(Column.__add__, parts).cast("double").alias("score"))


def _frequency(term: str) -> Column:
    return F.size(F.filter("tokens", lambda x: x == term))


def all_of(terms: Sequence[str], model: Model = MODELS["bm25"]) -> Query:
    """Documents with all terms; a term given twice counts twice. No terms match nothing."""
    return Terms(terms, None, model)


def any_of(terms: Sequence[str], model: Model = MODELS["bm25"]) -> Query:
    return Terms(terms, 1, model)


@dataclass
class DisMax(Query):
    queries: Sequence[Query]
    tie: float = 0.0

    def hits(self, index: Index) -> DataFrame:
        rows = reduce(DataFrame.union, [q.hits(index) for q in self.queries])
        return rows.groupBy("doc_id").agg((F.max("score") + self.tie * (F.sum("score") - F.max("score"))).alias("score"))


@dataclass
class Constant(Query):
    query: Query
    score: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        return self.query.hits(index).select("doc_id", F.lit(float(self.score)).alias("score"))


@dataclass
class Boost(Query):
    query: Query
    factor: float

    def hits(self, index: Index) -> DataFrame:
        return self.query.hits(index).select("doc_id", (F.col("score") * self.factor).alias("score"))


@dataclass
class Boosting(Query):
    """Documents of ``query``; those that ``context`` matches too have their score multiplied."""

    query: Query
    context: Query
    factor: float

    def hits(self, index: Index) -> DataFrame:
        demoted = self.context.hits(index).select("doc_id", F.lit(True).alias("c"))
        return self.query.hits(index).join(demoted, "doc_id", "left").select("doc_id", F.when(F.col("c"), F.col("score") * self.factor).otherwise(F.col("score")).alias("score"))


@dataclass
class Synonyms(Query):
    """Terms scored as one: frequencies added, document frequency the largest."""

    terms: Sequence[str]
    model: Model = MODELS["bm25"]

    def hits(self, index: Index) -> DataFrame:
        rows = index.terms(*self.terms)
        df = rows.groupBy("term").agg(F.count("*").alias("df")).agg(F.max("df")).scalar()
        own = rows.groupBy("doc_id", "dl", "dl_q").agg(F.sum("tf").alias("tf"))
        return weighted(index, own, self.model, df=df)


@dataclass
class Vocabulary(Query):
    """Documents with any term that ``accept`` holds for; constant score."""

    accept: Callable[[Column], Column]
    score: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        if index.table is None:
            found = index.docs.filter(F.exists("tokens", self.accept))
        else:
            found = index.matching(self.accept).select("doc_id").distinct()
        return found.select("doc_id", F.lit(float(self.score)).alias("score"))


def terms_in(terms: Sequence[str]) -> Query:
    return Vocabulary(lambda x: x.isin(*terms))


def prefix(start: str) -> Query:
    return Vocabulary(lambda x: x.startswith(start))


def wildcard(pattern: str) -> Query:
    r"""``*`` stands for any characters, ``?`` for one, ``\`` takes the next as it is."""
    out, escaped = "", False
    for c in pattern:
        if escaped or c not in "*?\\":
            out, escaped = out + re.sub(r"([^\w])", r"\\\1", c), False
        elif c == "\\":
            escaped = True
        else:
            out += ".*" if c == "*" else "."
    return Vocabulary(lambda x: x.rlike(f"(?s)^{out}$"))


def regexp(pattern: str) -> Query:
    """Terms that the whole pattern matches; the syntax common to both dialects."""
    if re.search(r"(?<!\\)[~@#&<>]", pattern):
        raise ValueError("complement, intersection, any string and numeric ranges are not supported")
    return Vocabulary(lambda x: x.rlike(f"^(?:{pattern})$"))


def term_range(low: str | None, high: str | None, with_low: bool = True, with_high: bool = False) -> Query:
    def accept(x: Column) -> Column:
        a = F.lit(True) if low is None else (x >= low if with_low else x > low)
        b = F.lit(True) if high is None else (x <= high if with_high else x < high)
        return a & b

    return Vocabulary(accept)


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; most + 1 if it is larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def edit_distance(column: Column, to: str, most: int) -> Column:
    @F.pandas_udf("int")
    def run(words: pd.Series) -> pd.Series:
        known = {w: edits(w, to, most) for w in words.unique()}
        return words.map(known)

    return run(column)


@dataclass
class Fuzzy(Query):
    """Terms within ``most`` edits that share a prefix; the best ``expansions``, each scored by 1 - edits / shorter length."""

    term: str
    most: int = 2
    prefix: int = 0
    expansions: int = 50
    transpositions: bool = True

    def expand(self, index: Index) -> DataFrame:
        """(term, boost), the best expansions."""
        near = F.length("term").between(len(self.term) - self.most, len(self.term) + self.most)
        words = index.docs.select(F.explode(F.array_distinct("tokens")).alias("term")) if index.table is None else index.table.select("term")
        words = words.filter(near & F.col("term").startswith(self.term[: self.prefix])).distinct()
        d = edit_distance(F.col("term"), self.term, self.most) if self.transpositions else F.levenshtein("term", F.lit(self.term))
        found = words.withColumn("d", d).filter(F.col("d") <= self.most)
        boost = 1 - F.col("d") / F.least(F.length("term"), F.lit(len(self.term)))
        return found.select("term", boost.alias("boost")).orderBy(F.desc("boost"), "term").limit(self.expansions)

    def hits(self, index: Index) -> DataFrame:
        found = self.expand(index)  # at most ``expansions`` rows
        rows = index.matching(lambda x: F.length(x).between(len(self.term) - self.most, len(self.term) + self.most) & x.startswith(self.term[: self.prefix]))
        return rows.join(F.broadcast(found), "term").groupBy("doc_id").agg(F.sum("boost").alias("score"))


@dataclass
class CommonTerms(Query):
    """Terms of at most ``most`` documents (a share below 1) decide what matches, the others only add to scores."""

    terms: Sequence[str]
    most: float
    need_all_rare: bool = False

    def hits(self, index: Index) -> DataFrame:
        rows = index.terms(*self.terms)
        stats = index.stats()
        n = stats.select("n").scalar()
        df = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
        bound = self.most * n if self.most < 1 else F.lit(self.most)
        rare = df.withColumn("rare", F.col("df") <= F.ceil(bound))
        dl = F.col("dl_q" if index.lossy else "dl")
        given = Stats(F.col("tf"), F.col("df"), F.col("ctf"), dl, n, stats.select("avgdl").scalar(), stats.select("total").scalar())
        scored = rows.join(F.broadcast(rare), "term").withColumn("s", MODELS["bm25"](given))
        every = scored.groupBy("doc_id").agg(F.sum("s").alias("score"), F.count_if("rare").alias("r"))
        some = rare.agg(F.count_if("rare")).scalar()
        need = some if self.need_all_rare else F.least(some, F.lit(1))
        return every.filter(F.col("r") >= need).select("doc_id", "score")


@dataclass
class Phrase(Query):
    """Documents where the terms stand one after another; each slot may be several terms. Scored as a conjunction."""

    terms: Sequence[str | Sequence[str]]
    model: Model = MODELS["bm25"]

    def slots(self) -> list[list[str]]:
        return [[t] if isinstance(t, str) else list(t) for t in self.terms]

    def matches(self, index: Index) -> DataFrame:
        """(doc_id, dl, dl_q, starts): positions of the first slot."""
        slots = self.slots()
        rows = index.terms(*[t for s in slots for t in s])
        at = rows.groupBy("doc_id", "dl", "dl_q").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        none = F.array().cast("array<int>")
        own = lambda s: reduce(F.array_union, [F.coalesce(F.try_element_at("at", F.lit(t)), none) for t in s])
        shifted = lambda s, i: F.transform(own(s), lambda p: p - i)
        starts = reduce(F.array_intersect, [shifted(s, i) for i, s in enumerate(slots)])
        return at.select("doc_id", "dl", "dl_q", F.array_sort(starts).alias("starts")).filter(F.size("starts") > 0)

    def hits(self, index: Index) -> DataFrame:
        found = self.matches(index).select("doc_id")
        slots = self.slots()
        scored = Bool(must=[Term(s[0], self.model) if len(s) == 1 else Synonyms(s, self.model) for s in slots]).hits(index)
        return scored.join(found, "doc_id", "left_semi")


@dataclass
class SloppyPhrase(Query):
    """Documents where the terms stand within ``slop`` moves of the phrase, in any order; the frequency sums 1 / (1 + moves)."""

    terms: Sequence[str]
    slop: int
    model: Model = MODELS["bm25"]

    def hits(self, index: Index) -> DataFrame:
        rows = index.terms(*self.terms)
        first = None
        for i, t in enumerate(self.terms):
            own = rows.filter(F.col("term") == t).select("doc_id", "dl", "dl_q", F.explode("positions").alias(f"p{i}")).withColumn(f"p{i}", F.col(f"p{i}") - i)
            first = own if first is None else first.join(own.drop("dl", "dl_q"), "doc_id").filter(F.abs(F.col(f"p{i}") - F.col("p0")) <= self.slop)
        places = [f"p{i}" for i in range(len(self.terms))]
        spread = F.greatest(*places) - F.least(*places) if len(places) > 1 else F.lit(0)
        found = first.withColumn("moves", spread).filter(F.col("moves") <= self.slop)
        best = found.groupBy("doc_id", "dl", "dl_q", "p0").agg(F.min("moves").alias("moves"))
        freq = best.groupBy("doc_id", "dl", "dl_q").agg(F.sum(1 / (1 + F.col("moves"))).alias("tf"))
        return weighted(index, freq, self.model, ctf=F.lit(1.0))


@dataclass
class Where(Query):
    """Documents whose columns satisfy a condition: ranges, sets, points, existence; constant score."""

    condition: Column
    score: float = 1.0

    def hits(self, index: Index) -> DataFrame:
        return index.docs.filter(self.condition).select("doc_id", F.lit(float(self.score)).alias("score"))


@dataclass
class Function(Query):
    """All documents, scored by an expression."""

    value: Column

    def hits(self, index: Index) -> DataFrame:
        return index.docs.select("doc_id", self.value.cast("double").alias("score"))


@dataclass
class FunctionScore(Query):
    """Documents of ``query`` with the score ``combine(score, value)``; a document without a value keeps 0."""

    query: Query
    value: Column
    combine: Callable[[Column, Column], Column] = field(default=lambda score, value: score * value)

    def hits(self, index: Index) -> DataFrame:
        own = index.docs.select("doc_id", self.value.cast("double").alias("value"))
        return self.query.hits(index).join(own, "doc_id").select("doc_id", F.coalesce(self.combine(F.col("score"), F.col("value")), F.lit(0.0)).alias("score"))


@dataclass
class MoreLikeThis(Query):
    """The likest documents to a text: its ``most`` terms of highest tf * idf, any of which may match."""

    text_terms: Sequence[str]
    most: int = 25
    min_tf: int = 2
    min_df: int = 5

    def hits(self, index: Index) -> DataFrame:
        counts = pd.Series(list(self.text_terms)).value_counts()
        given = {str(t): int(n) for t, n in counts.items() if n >= self.min_tf}
        if not given:
            return MatchNone().hits(index)
        rows = index.terms(*given)
        stats = index.stats()
        n = stats.select("n").scalar()
        seed = index.docs.sparkSession.createDataFrame(list(given.items()), "term string, seed_tf int")
        df = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).join(F.broadcast(seed), "term").filter(F.col("df") >= self.min_df)
        best = df.withColumn("w", F.col("seed_tf") * (F.log(n / (F.col("df") + 1)) + 1)).orderBy(F.desc("w"), "term").limit(self.most)
        dl = F.col("dl_q" if index.lossy else "dl")
        s = Stats(F.col("tf"), F.col("df"), F.col("ctf"), dl, n, stats.select("avgdl").scalar(), stats.select("total").scalar())
        return rows.join(F.broadcast(best), "term").groupBy("doc_id").agg(F.sum(MODELS["bm25"](s)).alias("score"))


def search(index: Index, query: Query, k: int = 5, digits: int | None = 6) -> DataFrame:
    """The ``k`` best documents: (doc_id, score), by falling score, ties by doc_id. With ``digits`` scores are rounded first."""
    hits = query.hits(index)
    score = F.round("score", digits) if digits is not None else F.col("score")
    return hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def batch_search(index: Index, queries: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """(query_id, rank, doc_id, score): each query's ``k`` best documents, all in one plan.

    queries: query_id, terms. A document must hold all terms of the query; a
    term given twice counts twice. A query meets only the documents that hold
    its rarest term, and none if a term of it is nowhere; its terms are counted
    and scored inside the document's row. So the queries and the document
    frequencies of their terms are broadcast, and no token is shuffled.
    """
    asked = queries.select("query_id", F.size("terms").alias("slots"), F.explode("terms").alias("term"))
    asked = asked.groupBy("query_id", "slots", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    docs = index.bags(wanted)
    held = docs.select(F.explode(F.array_distinct("tokens")).alias("term")).join(F.broadcast(wanted), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    own = F.sort_array(F.collect_list(F.struct("df", "term", "times"))).alias("own")
    whole = asked.join(df, "term").groupBy("query_id", "slots").agg(own, F.sum("times").alias("met")).filter(F.col("met") == F.col("slots"))
    stats = index.stats()
    keyed = whole.select("query_id", "own", F.col("own.term").alias("all"), F.get("own", F.lit(0))["term"].alias("term"), stats.select("n").scalar().alias("n"), stats.select("avgdl").scalar().alias("avgdl"))
    pairs = docs.select("doc_id", "len", "tokens", F.explode(F.array_distinct("tokens")).alias("term")).join(F.broadcast(keyed), "term")
    # no lambda here: Spark would leave generated code and copy a document's tokens for each of its tokens
    pairs = pairs.filter(F.size(F.array_except("all", "tokens")) == 0)

    def gain(x: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda t: t == x["term"]))
        return MODELS["bm25"](Stats(tf, x["df"], F.lit(0), F.col("len"), F.col("n"), F.col("avgdl"), F.lit(0))) * x["times"]

    score = F.aggregate("own", F.lit(0.0), lambda s, x: s + gain(x))
    found = pairs.select("query_id", "doc_id", F.round(score, digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
