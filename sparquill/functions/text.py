"""Tokenisers, token filters and string functions as column expressions.

Tokenisers map a string column to an array of strings, filters map arrays of
tokens to arrays of tokens. All but the stemmers and the Unicode folding run in
the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

ENGLISH_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

# --- tokenisers


def nonempty(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != "")


def _literal(sep: str) -> str:
    """A pattern for ``sep`` itself. Java splits at a single plain character without a regular expression."""
    return sep if len(sep) == 1 and sep not in ".$|()[{^?*+\\" else f"\\Q{sep}\\E"


def split_space(text: Column, sep: str = " ") -> Column:
    """Parts between ``sep``, without empty ones."""
    return nonempty(F.split(text, _literal(sep)))


def split_white(text: Column) -> Column:
    """Parts between white space, without empty ones."""
    return nonempty(F.split(text, r"\s+"))


def split_strict(text: Column, sep: str) -> Column:
    """Parts between ``sep``, empty ones too."""
    return F.split(text, _literal(sep), -1)


def lower_split(text: Column) -> Column:
    return split_white(F.lower(text))


def words(text: Column) -> Column:
    """Standard tokenisation: runs of letters and digits, with inner apostrophes and full stops between them."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"), F.lit(0))


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def pattern_split(text: Column, pattern: str) -> Column:
    return nonempty(F.split(text, pattern))


def pattern_groups(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def keyword(text: Column) -> Column:
    """The whole text as one token."""
    return F.array(text)


def path_hierarchy(path: Column, sep: str = "/") -> Column:
    """Each leading part of a path: /a, /a/b, /a/b/c."""
    parts = F.split(path, f"\\Q{sep}\\E")
    n = F.size(parts)
    return nonempty(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep)))


def reverse_path_hierarchy(path: Column, sep: str = "/") -> Column:
    """Each trailing part of a path."""
    parts = F.split(path, f"\\Q{sep}\\E")
    n = F.size(parts)
    return nonempty(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + F.lit(1)), sep)))


def ngrams(text: Column, low: int, high: int) -> Column:
    """Substrings of ``low`` to ``high`` characters, by start and then length."""
    n = F.length(text)
    starts = F.when(n >= low, F.sequence(F.lit(1), F.greatest(n - (low - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(n - i + 1, F.lit(low)))), lambda k: F.substr(text, i, k))))


def edge_ngrams(text: Column, low: int, high: int) -> Column:
    """Beginnings of ``low`` to ``high`` characters."""
    n = F.length(text)
    return F.when(n >= low, F.transform(F.sequence(F.lit(low), F.greatest(F.least(n, F.lit(high)), F.lit(low))), lambda k: F.substr(text, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


# --- token filters


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def uppercase(tokens: Column) -> Column:
    return F.transform(tokens, F.upper)


def stop(tokens: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*stop_words))


def keep(tokens: Column, kept: Sequence[str]) -> Column:
    return F.filter(tokens, lambda x: x.isin(*kept))


def length_between(tokens: Column, low: int, high: int) -> Column:
    return F.filter(tokens, lambda x: (F.length(x) >= low) & (F.length(x) <= high))


def truncate(tokens: Column, n: int) -> Column:
    return F.transform(tokens, lambda x: F.left(x, F.lit(n)))


def limit(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def unique(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def possessive(tokens: Column) -> Column:
    """Without a trailing 's."""
    some = lambda x: x.contains("'") | x.contains("’") | x.contains("＇")  # noqa: E731  # a search costs less than a pattern
    return F.transform(tokens, lambda x: F.when(some(x), F.regexp_replace(x, r"['’＇][sS]$", "")).otherwise(x))


def elision(tokens: Column, articles: Sequence[str] = ("l", "m", "t", "qu", "n", "s", "j", "d", "c", "jusqu", "quoiqu", "lorsqu", "puisqu")) -> Column:
    """Without a leading article and apostrophe."""
    return F.transform(tokens, lambda x: F.regexp_replace(x, rf"(?i)^(?:{'|'.join(articles)})['’]", ""))


def apostrophe(tokens: Column) -> Column:
    """Without the first apostrophe and what follows it."""
    return F.transform(tokens, lambda x: F.regexp_replace(x, r"['’].*$", ""))


def reverse(tokens: Column) -> Column:
    return F.transform(tokens, F.reverse)


def trim(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.btrim(x))


def pattern_replace(tokens: Column, pattern: str, to: str) -> Column:
    return F.transform(tokens, lambda x: F.regexp_replace(x, pattern, to))


def decimal_digits(tokens: Column) -> Column:
    """Arabic-Indic, extended Arabic-Indic and Devanagari digits as 0 to 9."""
    return F.transform(tokens, lambda x: F.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3))


def fingerprint(tokens: Column, sep: str = " ") -> Column:
    """One token: the distinct tokens in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), sep)


def shingles(tokens: Column, low: int = 2, high: int = 2, sep: str = " ") -> Column:
    """Runs of ``low`` to ``high`` tokens, joined, by start and then length."""
    n = F.size(tokens)
    starts = F.when(n >= low, F.sequence(F.lit(1), F.greatest(n - (low - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    if low == high:
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, low), sep))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.greatest(n - i + 1, F.lit(low)))), lambda k: F.array_join(F.slice(tokens, i, k), sep))))


def common_grams(tokens: Column, common: Sequence[str], sep: str = "_") -> Column:
    """All tokens, and each pair of neighbours of which one is common, joined."""
    n = F.size(tokens)
    pairs = F.transform(F.when(n >= 2, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(tokens, i, 2))
    return F.concat(tokens, F.transform(F.filter(pairs, lambda p: F.get(p, F.lit(0)).isin(*common) | F.get(p, F.lit(1)).isin(*common)), lambda p: F.array_join(p, sep)))


def synonyms(tokens: Column, table: dict[str, Sequence[str]]) -> Column:
    """Each token, followed by its synonyms."""
    known = F.create_map(*[y for k, v in table.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(tokens, lambda x: F.concat(F.array(x), F.coalesce(F.try_element_at(known, x), F.array().cast("array<string>")))))


def min_hash(tokens: Column, hashes: int = 16) -> Column:
    """For each of ``hashes`` hash functions, xxhash64(token, i), the smallest value over the tokens; null without tokens.

    Spark hashes the token first and mixes ``i`` into that, so a token is hashed
    once for all functions; the mixing is done with whole arrays.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def run(values: pa.Array) -> pa.Array:
        return _by_pieces(values, lambda x: _least(x, hashes), pa.int64())

    return run(F.transform(tokens, lambda x: F.xxhash64(x)))


#: Elements that a Python function over arrays takes at a time, or one array if that is longer.
PIECE = 1 << 16


def _by_pieces(lists: pa.Array, f: Callable[[pa.Array], pa.Array], element: pa.DataType) -> pa.Array:
    """``f`` of slices of an array of lists with about PIECE elements each, put together."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // PIECE)) + 1
    edges = [0, *cuts.tolist(), len(lists)]
    done = [f(lists.slice(a, b - a)) for a, b in zip(edges, edges[1:]) if b > a]
    return pa.concat_arrays(done) if done else pa.array([], pa.list_(element))


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _least(lists: pa.Array, hashes: int) -> pa.Array:
    """For each list of xxhash64(x) the smallest xxhash64(x, i) of each i below ``hashes``: XXH64 of four bytes, seeded by the value."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    some = sizes > 0
    out = np.zeros((len(lists), hashes), np.int64)
    if some.any():
        seed = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + (_P5 + np.uint64(4))
        starts = (np.cumsum(sizes) - sizes)[some]
        for i in range(hashes):
            h = seed ^ np.uint64(i * int(_P1) & (1 << 64) - 1)
            h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
            h = (h ^ h >> np.uint64(33)) * _P2
            h = (h ^ h >> np.uint64(29)) * _P3
            h ^= h >> np.uint64(32)
            out[some, i] = np.minimum.reduceat(h.view(np.int64), starts)
    values = pa.array(out.ravel(), mask=np.repeat(~some, hashes))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * hashes, pa.int32()), values)


def chain(tokens: Column, *steps: Callable[[Column], Column]) -> Column:
    return reduce(lambda t, f: f(t), steps, tokens)


# --- strings and numbers


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def running_sums(values: Column, block: int = 128) -> Column:
    """The sum of an array of integers up to each element.

    An array that grows inside a lambda is copied at each step, so it grows only
    inside blocks, and once over the blocks' totals.
    """
    none = F.array().cast("array<int>")

    def sums(xs: Column, first: Column) -> Column:
        step = lambda a, x: F.struct(F.concat(a["all"], F.array(a["last"] + x)).alias("all"), (a["last"] + x).alias("last"))
        return F.aggregate(xs, F.struct(none.alias("all"), first.alias("last")), step, lambda a: a["all"])

    def blocks(v: Column) -> Column:
        n = F.size(v)
        starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(block))).otherwise(none)
        return F.transform(starts, lambda i: F.slice(v, i, block))

    def whole(b: Column) -> Column:
        totals = F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y))
        before = F.slice(F.concat(F.array(F.lit(0)), sums(totals, F.lit(0))), F.lit(1), F.size(b))
        return F.flatten(F.zip_with(b, before, sums))

    # a lambda's variable is computed once, other parts of its body for each element
    return let(let(values, blocks), whole)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill_zeros(text: Column, width: int) -> Column:
    """Zeros before ``text`` up to ``width`` characters; longer texts stay whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def strip_tags(text: Column) -> Column:
    """Without what stands between the first < and the last > of each line."""
    return F.regexp_replace(text, "<.*>", "")


def bits(n: Column) -> Column:
    """Length of ``n`` in binary; 0 has none."""
    return F.when(n == 0, 0).otherwise(F.length(F.bin(n)))


def four_bits(n: Column) -> Column:
    """``n`` with all but its four leading bits cleared: what a one-byte length keeps."""
    # a shift by a column is a bitwise expression of its own in SQL
    drop = F.greatest(bits(n) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, drop), drop)


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Decomposed, and without what is not ASCII then."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


_VOWELS = "aeiou"
#: Porter's second and third steps, (ending, what replaces it), and the endings of the fourth, the longest first.
_RULES = [
    sorted((r.split(":") for r in rules.split(" ")), key=lambda r: -len(r[0]))
    for rules in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log",
        "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:",
    )
]
_ENDS = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm of 1980."""
    if len(word) < 3 or not word.isascii():
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = [consonant(w, i) for i in range(len(w))]
        return sum(a and not b for a, b in zip(kinds[1:], kinds))

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    def cvc(w: str) -> bool:
        return len(w) > 2 and consonant(w, len(w) - 1) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 3) and w[-1] not in "wxy"

    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + to
            break
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if vowel(stem := word[: -len(end)]):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif measure(word) == 1 and cvc(word):
                        word += "e"
                break
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in _RULES:
        for end, to in rules:
            if word.endswith(end):
                if measure(word[: len(word) - len(end)]) > 0:
                    word = word[: len(word) - len(end)] + to
                break
    for end in _ENDS:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def porter_stem(words: pd.Series) -> pd.Series:
    """Stems; each distinct word of a batch is stemmed once."""
    known = {w: None if w is None else porter(w) for w in words.unique()}
    return words.map(known)


_stem = lru_cache(1 << 16)(porter)


def _stemmed(lists: pa.Array) -> pa.Array:
    """Stems of lists of words; only distinct words become Python strings."""
    words = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else _stem(w) for w in words.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    missing = np.append(lists.is_null().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), stems.take(words.indices))


@F.arrow_udf(ArrayType(StringType()))
def porter_stems(tokens: pa.Array) -> pa.Array:
    return _by_pieces(tokens, _stemmed, pa.string())


def english(text: Column) -> Column:
    """Standard words, possessives, lower case, stop words and stems of English."""
    return porter_stems(stop(lowercase(possessive(words(F.regexp_replace(text, "<[^>]*>", " "))))))
