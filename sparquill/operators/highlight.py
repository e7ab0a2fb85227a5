"""Snippets: the best passages of a text with the query's terms marked.

Only the rows of a top-k result are highlighted, so a vectorised Python function
over them costs nothing against the search itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants of passage scores (fixed by the scoring formula).
K1, B, PIVOT = np.float32(1.2), np.float32(0.75), np.float32(87)


@dataclass
class Marks:
    """How marked words and passages are written."""

    before: str = "<b>"
    after: str = "<\\b>"
    end: str = "\n"
    between: str = ""


#: The style of formatted passages with an ellipsis between those that are apart.
ELLIPSIS = Marks("<b>", "</b>", "", "... ")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the passages of a text: each ends with a full stop, or with the text."""
    out, at = [], 0
    for hit in re.finditer(r"\.", text):
        out.append((at, hit.end()))
        at = hit.end()
    return [*out, (at, len(text))] if at < len(text) else out


def prose_sentences(text: str, short: int = 3) -> list[tuple[int, int]]:
    """(start, stop) of sentences: ``?`` and ``!`` end one, a full stop does unless it follows a short word or no capital comes next."""
    out, at = [], 0
    for hit in re.finditer(r"[.?!]", text):
        if hit[0] == ".":
            word = re.search(r"(\w*)$", text[at : hit.start()])[1]
            following = re.match(r"\s*(\S)?", text[hit.end() :])[1]
            if len(word) <= short and following is not None or following is not None and not following.isupper():
                continue
        out.append((at, hit.end()))
        at = hit.end()
    return [*out, (at, len(text))] if at < len(text) else out


def fixed_fragments(text: str, size: int = 100) -> list[tuple[int, int]]:
    """(start, stop) of fragments of about ``size`` characters that end with a word."""
    out, at = [], 0
    for hit in re.finditer(r"\S+", text):
        if hit.end() - at >= size:
            out.append((at, hit.end()))
            at = hit.end()
    return [*out, (at, len(text))] if at < len(text) else out


def whole(text: str) -> list[tuple[int, int]]:
    return [(0, len(text))] if text else []


def goal_length(base: Callable[[str], list[tuple[int, int]]], least: int) -> Callable[[str], list[tuple[int, int]]]:
    """Neighbouring passages of ``base`` joined until they have ``least`` characters."""

    def run(text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in base(text):
            if out and out[-1][1] - out[-1][0] < least:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    return run


def passage_score(start: int, length: int, counts: Sequence[int]) -> np.float32:
    """Sum of saturated frequencies, more for early passages."""
    norm = K1 * (1 - B + B * np.float32(length) / PIVOT)
    total = np.float32(sum(np.float32(n) / (np.float32(n) + norm) for n in counts if n))
    return total * np.float32(1 + 1 / math.log(float(PIVOT) + start))


def found(text: str, terms: Sequence[str], fold: bool = False) -> list[tuple[int, int, int]]:
    """(start, stop, term) of the terms in ``text``, whole words between blanks or punctuation."""
    known = {t.lower() if fold else t: i for i, t in enumerate(terms)}
    return [(h.start(), h.end(), known[w]) for h in re.finditer(r"\w+", text) if (w := h[0].lower() if fold else h[0]) in known]


def snippet(text: str, hits: Sequence[tuple[int, int, int]], passages: int = 3, split: Callable[[str], list[tuple[int, int]]] = sentences, marks: Marks | None = None) -> str:
    """The best ``passages`` passages in text order, hits marked; empty without hits."""
    marks = marks or Marks()
    if not hits or passages <= 0:
        return ""
    scored, hits = [], sorted(hits)
    at = 0
    for a, b in split(text):
        own = []
        while at < len(hits) and hits[at][0] < b:
            own.append(hits[at])
            at += 1
        if own:
            terms = [t for _, _, t in own]
            scored.append((-passage_score(a, b - a, [terms.count(t) for t in set(terms)]), a, b, own))
    out, last = [], None
    for _, a, b, own in sorted(sorted(scored, key=lambda x: x[:2])[:passages], key=lambda x: x[1]):
        while a < b and text[a].isspace():
            a += 1
        if last is not None and last != a and marks.between:
            out.append(marks.between)
        at = a
        for s, e, _ in own:
            e = min(e, b)
            out += [text[at:s], marks.before, text[s:e], marks.after]
            at = e
        out += [text[at:b], marks.end]
        last = b
    return "".join(out)


def snippets(text: Column, terms: Sequence[str], passages: int = 3, split: Callable[[str], list[tuple[int, int]]] = sentences, marks: Marks | None = None, fold: bool = False) -> Column:
    """Snippets of a text column for the given terms. A null text has the empty snippet."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: snippet(x or "", found(x or "", terms, fold), passages, split, marks))

    return run(text)


def highlight(hits: DataFrame, docs: DataFrame, terms: Sequence[str], text: str = "text", **how) -> DataFrame:
    """Top hits with their snippet: texts are fetched for the hits alone."""
    own = docs.select("doc_id", text).join(F.broadcast(hits), "doc_id")
    return own.withColumn("snippet", snippets(F.col(text), terms, **how)).drop(text)


def passages_of(text: Column) -> Column:
    """(start, passage) of each passage that ends with a full stop or the text, with built-in functions only."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"[^.]*\.?"), F.lit(0)), lambda p: p != "")
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), lambda p, s: F.struct(s.alias("start"), p.alias("passage")))
