"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its features; the document's is their
noisy-or, 1 - prod(1 - p). Trained on document labels alone, that also says
which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

#: Labelled documents to learn from, at most: those whose hashed ids come first.
MAX_LABELLED = 6_000
#: Features kept, at most, and the training documents that must hold one.
MAX_FEATURES, MIN_DOCS = 20_000, 8
PREFIXES = (4, 5, 6, 7)
SENTENCE = re.compile(r"[^.?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A word's features: the word, and its beginnings, which words of one stem share."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    known: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"bias": self.bias, "weights": self.weights, "known": {}}

    def word(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 300_000:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, stop, logit) of each sentence with a word."""
        out, word = [], self.word
        for hit in SENTENCE.finditer(text):
            if words := set(WORD.findall(hit[0].lower())):
                out.append((hit.start(), hit.end(), self.bias + sum(map(word, words))))
        return out

    def score(self, found: list[tuple[int, int, float]]) -> float:
        """Noisy-or over the sentences; 0 without any."""
        z = np.array([x for _, _, x in found])
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def _kept(words: list[str], docs: list[np.ndarray], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The features that tell the labels apart best, by the chi-squared statistic of their document counts; and for each word the numbers of its own (-1: none).

    docs: numbers of the words of each document. Features are numbered in arrays, never held as a dictionary of strings.
    """
    names: list[np.ndarray] = []
    of = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    total = 0
    for column, k in enumerate((None, *PREFIXES)):
        own = np.array([i for i, w in enumerate(words) if k is None or len(w) > k], np.int64)
        found, place = np.unique(np.array([words[i] if k is None else f"{words[i][:k]}*" for i in own], object if k is None else f"U{k + 1}"), return_inverse=True)
        of[own, column] = place + total
        names.append(found)
        total += len(found)
    counts = np.zeros((2, total), np.int64)
    for own, label in zip(docs, y):
        found = np.unique(of[own])
        counts[int(label), found[found >= 0]] += 1
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    p, q = counts.sum(0) / (n1 + n0), n1 / (n1 + n0)
    z = np.abs(counts[1] - p * n1) / np.sqrt(np.maximum(p * (1 - p) * n1 * (1 - q), 1e-12))
    chosen = np.flatnonzero((counts.sum(0) >= MIN_DOCS) & (p < 1) & (z >= 4))
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")][:MAX_FEATURES])
    number = np.full(total + 1, -1, np.int64)  # the last stands for -1
    number[chosen] = np.arange(len(chosen))
    starts = np.cumsum([0, *map(len, names)])
    which = np.searchsorted(starts, chosen, "right") - 1
    return [str(names[k][f - starts[k]]) for f, k in zip(chosen.tolist(), which.tolist())], number[of]


def fit(texts: Iterable[str | None], labels: list[int], rounds: int = 400, penalty: float = 1e-4, rate: float = 0.1) -> Model:
    """Weights that make the noisy-or of each text's sentences likely, by Adam on all texts. Same input, same model.

    Without texts of both labels the model has no weights and its bias alone follows the labels.
    Texts are taken one at a time; what is kept of them are word numbers.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(4.0 if len(y) and y.min() else -12.0, {})
    numbers: dict[str, int] = {}
    docs, cells, sizes, owners = [], [], [], []
    for d, text in enumerate(texts):
        own = []
        for hit in SENTENCE.finditer(text or ""):
            if found := set(WORD.findall(hit[0].lower())):
                own.append(np.array(sorted(numbers.setdefault(w, len(numbers)) for w in found), np.int32))
                sizes.append(len(found))
                owners.append(d)
        cells += own
        docs.append(np.unique(np.concatenate(own)) if own else np.empty(0, np.int32))
    names, of = _kept(list(numbers), docs, y)
    word, row, owner, n = np.concatenate([np.empty(0, np.int32), *cells]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(owners, np.int64), len(sizes)
    del cells, docs, numbers
    kept = np.flatnonzero((of[word] >= 0).any(1))
    own = of[word[kept]]
    pairs = np.unique((np.repeat(row[kept].astype(np.int64), own.shape[1]) << 32 | own.ravel())[own.ravel() >= 0])
    row, col = pairs >> 32, pairs & 0xFFFFFFFF
    theta = np.zeros(len(names) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(row, theta[col], n)
        clean = -np.bincount(owner, np.logaddexp(0, z), len(y))  # log of the probability that no sentence offends
        q = np.clip(np.exp(clean), 1e-12, 1 - 1e-12)
        pull = np.where(y > 0, -q / (1 - q), 1.0)
        dz = pull[owner] / (1 + np.exp(-z)) / len(y)
        grad = np.append(np.bincount(col, dz[row], len(names)) + penalty * theta[:-1], dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(float(theta[-1]), {f: float(theta[i]) for i, f in enumerate(names) if abs(theta[i]) > 1e-3})


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id's digits is a multiple of 5. Never null: without an id there is no label to learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the labelled documents that are not held out; of more than ``max_labelled``, those whose hashed ids come first.

    Labels that are null, neither 0 nor 1, or of absent documents take no part; a document with both labels is toxic.
    """
    given = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toArrow()  # at most max_labelled ids
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit((x.as_py() for x in rows["text"]), rows["toxic"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1), worst_start, worst_stop, worst_score: the likeliest sentence (null without one), offending: sentences of 0.5 or more.

    A null or empty text scores 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            out = []
            for text in texts:
                found = model.sentences(text)
                start, stop, z = max(found, key=lambda x: x[2], default=(None, None, None))
                out.append((model.score(found), start, stop, None if z is None else 1 / (1 + float(np.exp(-z))), sum(x[2] >= 0 for x in found)))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "score", "worst_start", "worst_stop", "worst_score", "offending"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, worst_start long, worst_stop long, worst_score double, offending long")


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, sentence, score) of the sentences whose own probability is ``least`` or more; start and stop in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            out = [(doc, a, b, text[a:b], p) for doc, text in zip(batch.column(0).to_pylist(), texts) for a, b, z in model.sentences(text) if (p := 1 / (1 + float(np.exp(-z)))) >= least]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)], ["doc_id", "start", "stop", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, stop long, sentence string, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. Rows are judged by their own text, so nothing is joined or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            yield batch.filter(pa.array([model.score(model.sentences(x)) < threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
