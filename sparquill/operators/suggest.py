"""Suggestions and spelling: candidates come from the vocabulary, which Spark has already aggregated."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import edit_distance

# --- string likeness


def levenshtein_likeness(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; two empty strings are alike."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(n, F.lit(0)))


def jaro_winkler(a: str, b: str, threshold: float = 0.7) -> float:
    """Jaro likeness, raised for a common prefix where it is at least ``threshold``."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    reach = max(len(long) // 2 - 1, 0)
    taken = [False] * len(long)
    mine = []
    for i, c in enumerate(short):
        for j in range(max(0, i - reach), min(i + reach + 1, len(long))):
            if not taken[j] and long[j] == c:
                taken[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [c for c, t in zip(long, taken) if t]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a, b):
        if x != y:
            break
        prefix += 1
    return jaro if jaro < threshold else jaro + min(0.1, 1 / max(len(a), len(b))) * prefix * (1 - jaro)


def ngram_likeness(a: str, b: str, n: int = 2) -> float:
    """1 less the n-gram distance over the longer length; beginnings weigh more, for strings are padded in front."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) < n or len(b) < n:
        return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))
    pad = "\0" * (n - 1)
    grams = lambda s: [(pad + s)[i : i + n] for i in range(len(s))]

    def cost(x: str, y: str) -> float:
        size = n - sum(p == q == "\0" for p, q in zip(x, y))
        return sum(p != q for p, q in zip(x, y)) / size

    xs, ys = grams(a), grams(b)
    row = [float(j) for j in range(len(ys) + 1)]
    for i, x in enumerate(xs, 1):
        before, row = row, [float(i)]
        for j, y in enumerate(ys, 1):
            row.append(min(row[j - 1] + 1, before[j] + 1, before[j - 1] + cost(x, y)))
    return 1 - row[-1] / max(len(a), len(b))


def likeness(to: str, how: Callable[[str, str], float]) -> Callable[[Column], Column]:
    """A vectorised column function from a likeness of two strings; each distinct word of a batch is judged once."""

    @F.pandas_udf("double")
    def run(words: pd.Series) -> pd.Series:
        known = {w: how(to, w) for w in words.unique()}
        return words.map(known)

    return run


# --- spelling


def spell_candidates(vocabulary: DataFrame, n_docs: Column, word: str, k: int = 5, max_edits: int = 2, min_prefix: int = 1, min_length: int = 4, max_share: float = 0.01, accuracy: float = 0.5, mode: str = "not_in_index", by: str = "score") -> DataFrame:
    """(term, score, df): words of the vocabulary (term, df) near ``word``.

    mode: not_in_index gives none if the word itself is known, more_popular only
    words more frequent than it, always all. A word of fewer than ``min_length``
    characters, or in more than ``max_share`` of the documents, has none.
    Filters on length and prefix run before any distance.
    """
    if len(word) < min_length:
        return vocabulary.filter(F.lit(False)).select("term", F.lit(0.0).alias("score"), "df")
    own = F.coalesce(vocabulary.filter(F.col("term") == word).agg(F.max("df")).scalar(), F.lit(0))
    near = vocabulary.filter((F.col("term") != word) & F.length("term").between(len(word) - max_edits, len(word) + max_edits) & F.col("term").startswith(word[:min_prefix]))
    near = near.withColumn("edits", edit_distance(F.col("term"), word, max_edits)).filter(F.col("edits") <= max_edits)
    near = near.filter(own <= max_share * n_docs if max_share < 1 else own <= max_share)
    if mode == "not_in_index":
        near = near.filter(own == 0)
    elif mode == "more_popular":
        near = near.filter(F.col("df") > own)
    score = 1 - F.col("edits") / F.least(F.length("term"), F.lit(len(word)))
    order = [F.desc("score"), F.desc("df"), "term"] if by == "score" else [F.desc("df"), F.desc("score"), "term"]
    return near.withColumn("score", score).filter(F.col("score") >= accuracy).select("term", "score", "df").orderBy(*order).limit(k)


def word_breaks(vocabulary: DataFrame, word: str, min_df: int = 1, min_part: int = 1) -> DataFrame:
    """(left, right, df): ways to break a word into two words of the vocabulary; df the smaller frequency."""
    spark = vocabulary.sparkSession
    cuts = spark.createDataFrame([(word[:i], word[i:]) for i in range(min_part, len(word) - min_part + 1)] or [("", "")], "left string, right string")
    known = vocabulary.filter((F.col("df") >= min_df) & F.col("term").isin([x for i in range(1, len(word)) for x in (word[:i], word[i:])] or [""])).select("term", "df")
    a, b = known.toDF("left", "a"), known.toDF("right", "b")
    return cuts.join(a, "left").join(b, "right").select("left", "right", F.least("a", "b").alias("df"))


def word_joins(vocabulary: DataFrame, words: list[str], min_df: int = 1) -> DataFrame:
    """(term, at, df): neighbouring words that together are a word of the vocabulary."""
    joined = vocabulary.sparkSession.createDataFrame([(x + y, i) for i, (x, y) in enumerate(zip(words, words[1:]))] or [("", -1)], "term string, at int")
    return vocabulary.filter((F.col("df") >= min_df) & F.col("term").isin([x + y for x, y in zip(words, words[1:])] or [""])).join(F.broadcast(joined), "term").select("term", "at", "df")


# --- completion


def complete(dictionary: DataFrame, key: str, k: int, exact_first: bool = True, contexts: dict[str, float] | None = None) -> DataFrame:
    """(term, weight): the heaviest entries that begin with ``key``; the entry itself first if asked.

    contexts: entries need one of these in their array ``contexts``; the largest factor multiplies the weight.
    """
    found = dictionary.filter(F.col("term").startswith(key))
    if contexts:
        factor = F.array_max(F.transform("contexts", lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in contexts.items() for x in kv]), c), F.lit(0.0))))
        found = found.filter(F.arrays_overlap("contexts", F.array(*map(F.lit, contexts)))).withColumn("weight", F.col("weight") * factor)
    order = [F.desc("weight"), "term"]
    return found.orderBy(*([F.desc(F.col("term") == key), *order] if exact_first else order)).select("term", "weight").limit(k)


def complete_bucketed(dictionary: DataFrame, key: str, k: int, buckets: int = 10) -> DataFrame:
    """As complete(), by weights in ``buckets`` even steps of their range, then by term."""
    ends = dictionary.agg(F.min("weight").alias("a"), F.max("weight").alias("b"))
    a, b = ends.select("a").scalar(), ends.select("b").scalar()
    step = F.when(b == a, 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("weight") - a) * buckets / F.nullif(b - a, F.lit(0)))))
    return dictionary.filter(F.col("term").startswith(key)).withColumn("bucket", step.cast("int")).orderBy(F.desc("bucket"), "term").select("term", "bucket").limit(k)


def complete_fuzzy(dictionary: DataFrame, key: str, k: int, max_edits: int = 1, exact_prefix: int = 1, min_length: int = 3) -> DataFrame:
    """(term, weight): entries with a beginning within ``max_edits`` of ``key``; shorter keys than ``min_length`` are matched exactly."""
    if len(key) < min_length:
        return complete(dictionary, key, k, exact_first=False)
    near = dictionary.filter(F.col("term").startswith(key[:exact_prefix]))
    starts = [F.levenshtein(F.left("term", F.lit(n)), F.lit(key)) for n in range(max(len(key) - max_edits, 1), len(key) + max_edits + 1)]
    return near.filter(F.least(*starts) <= max_edits).orderBy(F.desc("weight"), "term").select("term", "weight").limit(k)


def complete_regex(dictionary: DataFrame, pattern: str, k: int) -> DataFrame:
    """Entries of which a beginning matches."""
    return dictionary.filter(F.col("term").rlike(f"^(?:{pattern})")).orderBy(F.desc("weight"), "term").select("term", "weight").limit(k)


#: How an infix match at word p weighs: by its place.
BLENDS: dict[str, Callable[[Column], Column]] = {"linear": lambda p: 1 - 0.1 * p, "reciprocal": lambda p: 1 / (p + 1), "exponential": lambda p: 1 / F.pow(p + 1, 2)}


def complete_infix(dictionary: DataFrame, key: str, k: int, blend: str = "linear") -> DataFrame:
    """(term, score): entries of which a word begins with ``key``; weights fall with that word's place."""
    words = F.split("term", " ")
    at = F.array_position(F.transform(words, lambda w: w.startswith(key)), F.lit(True)) - 1
    rows = dictionary.withColumn("at", at).filter(F.col("at") >= 0)
    return rows.withColumn("score", F.floor(F.col("weight") * BLENDS[blend](F.col("at").cast("double"))).cast("long")).orderBy(F.desc("score"), "term").select("term", "score").limit(k)


def frequent_dictionary(vocabulary: DataFrame, n_docs: Column, share: float) -> DataFrame:
    """Terms in at least ``share`` of the documents."""
    return vocabulary.filter(F.col("df") >= share * n_docs)


def stop_but_last(tokens: Column, stop_words: list[str]) -> Column:
    """Without stop words, but for the last token, which may be the beginning of another word."""
    n = F.size(tokens)
    return F.filter(tokens, lambda x, i: ~x.isin(*stop_words) | (i == n - 1))
