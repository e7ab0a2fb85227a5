"""Byte-level BPE encoding and decoding without a regular expression.

Texts become arrays of codepoint classes. A finite automaton over those classes
decides where tokens of the pre-tokenisation pattern start; because transition
functions compose associatively, the automaton runs over all blocks of a long
array at once: the first pass composes each block's function, a short scan over
the blocks gives every block's entry state, the second pass marks the starts.
The resulting slices feed pair merging through a cache; all slices that are new
are merged at once, in arrays.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, shipped, steps

#: Codepoint classes. The apostrophe classes say how long a contraction follows, the white-space ones what does.
LETTER, NUMBER, OTHER, SHORT, LONG, GLUE, LAST, SPACE, STOP = range(9)
#: States after a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES, CLASSES = 8, 9
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 64
#: Distinct slices whose ids are kept; the cache starts again when it is full.
CACHE_ENTRIES = 600_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the character starts a token) by state and class."""
    to, starts = np.zeros((STATES, CLASSES), np.uint8), np.ones((STATES, CLASSES), np.uint8)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for s in range(STATES):
        for c, inside in run.items():
            to[s, c], starts[s, c] = inside, s not in (inside, GLUED)
        for c, left in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            absorbed = s in (IN_OTHERS, GLUED)
            to[s, c], starts[s, c] = IN_OTHERS if absorbed else left, not absorbed
        to[s, GLUE], to[s, LAST], to[s, STOP] = GLUED, FRESH, FRESH
        to[s, SPACE], starts[s, SPACE] = IN_SPACE, s != IN_SPACE
    to[ONE_MORE, :STOP], to[TWO_MORE, :STOP] = FRESH, ONE_MORE
    starts[[ONE_MORE, TWO_MORE], :STOP] = 0
    return to, starts


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codepoint classes; the automaton; its transition monoid: element after one more class, element's map of states."""
    of = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind in "LN":
            of[cp] = LETTER if kind == "L" else NUMBER
    of[WHITE] = SPACE
    to, starts = _automaton()
    elements = {tuple(range(STATES)): 0}
    after: list[list[int]] = []
    todo = [tuple(range(STATES))]
    for f in todo:
        row = []
        for c in range(CLASSES):
            g = tuple(int(to[s, c]) for s in f)
            if g not in elements:
                elements[g] = len(elements)
                todo.append(g)
            row.append(elements[g])
        after.append(row)
    return of, to, starts, np.array(after, np.uint16), np.array(todo, np.uint8)


def classify(points: np.ndarray) -> np.ndarray:
    """Classes of codepoints, where 0 ends a text if ``ends`` marks it so (see token_starts)."""
    return _tables()[0][points]


def token_starts(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Positions where tokens start in ``points``; ``stops``: positions of separators between texts, each a token."""
    _, to, starts, after, maps = _tables()
    n = len(points)
    kinds = classify(points)
    kinds[stops] = STOP
    white = kinds == SPACE
    solid = np.zeros(n, bool)  # followed by a character of the text that is not white space
    solid[:-1] = ~white[1:] & (kinds[1:] != STOP)
    last = np.flatnonzero(white & solid)
    kinds[last] = np.where(points[last] == 32, GLUE, LAST)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        near = np.append(points, [0, 0])
        near_kinds = np.append(kinds, [STOP, STOP])
        a, b = near[quotes + 1], near[quotes + 2]
        inside = near_kinds[quotes + 1] != STOP
        kinds[quotes[inside & np.isin(a, [ord(x) for x in "stmd"])]] = SHORT
        two = (near_kinds[quotes + 2] != STOP) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        kinds[quotes[inside & two]] = LONG
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, STOP, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = after.ravel()
    element = np.zeros(blocks, np.uint16)
    for column in grid:
        element = flat.take(element * np.uint16(CLASSES) + column)
    entry, state = np.zeros(blocks, np.uint8), FRESH
    rows = maps.tolist()
    for i, e in enumerate(element.tolist()):
        entry[i] = state
        state = rows[e][state]
    step = (to | starts << 7).ravel()
    found = np.empty((BLOCK, blocks), np.uint8)
    for i, column in enumerate(grid):
        out = step.take(entry * np.uint8(CLASSES) + column)
        found[i] = out >> 7
        entry = out & 127
    return np.flatnonzero(found.T.ravel()[:n])


def split(texts: list[str]) -> list[list[str]]:
    """The matches of the pre-tokenisation pattern in each text, in order; together they are the text."""
    if not texts:
        return []
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    stops = np.cumsum([len(x) + 1 for x in texts]) - 1
    at = token_starts(points, stops)
    ends = np.searchsorted(at, stops).tolist()
    at = at.tolist()
    cut = [joined[a:b] for a, b in zip(at, at[1:])]
    out, begin = [], 0
    for end in ends:
        out.append(cut[begin:end])
        begin = end + 1
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: again and again the adjacent pair of lowest rank, the leftmost of equals, becomes one part."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < n and (r := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if ends[i] < 0 or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        ends[i], ends[j], after[i] = end, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class Merger:
    """Pair merging of many slices at once: a row of ids a slice, in each step every row merges its pair of lowest rank, the leftmost of equals."""

    #: Slices of more bytes are merged one by one, with a heap; rows of one array.
    LONGEST, ROWS = 40, 8_192
    _NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        found = {(a << 32 | b): r for word, r in ranks.items() for k in range(1, len(word)) if (a := ranks.get(word[:k])) is not None and (b := ranks.get(word[k:])) is not None}
        keys = np.array([*found, np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        #: Pairs of ids, sorted, and what they become.
        self.keys, self.made = keys[order], np.array([*found.values(), -1], np.int32)[order]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], self._NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice, four little-endian bytes an id."""
        out: list[bytes] = [b""] * len(pieces)
        rows = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) <= self.LONGEST:
                rows.append(i)
            else:
                ids = merge(piece, self.ranks)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        rows.sort(key=lambda i: len(pieces[i]))
        for k in range(0, len(rows), self.ROWS):
            part = rows[k : k + self.ROWS]
            for i, ids in zip(part, self._rows([pieces[i] for i in part])):
                out[i] = ids
        return out

    def _rows(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.array([len(x) for x in pieces], np.int32)
        width = int(sizes.max()) + 1
        raw = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8).reshape(len(pieces), width)
        ids = self.bytes[raw]
        place = np.arange(width, dtype=np.int32)
        alive = place < sizes[:, None]
        if (ids[alive] < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        rank = np.full(ids.shape, self._NONE, np.int32)
        rank[:, :-1] = np.where(alive[:, 1:], self._pair(ids[:, :-1], ids[:, 1:]), self._NONE)
        after = np.broadcast_to(place + 1, ids.shape).copy()
        before = np.broadcast_to(place - 1, ids.shape).copy()
        on = np.arange(len(pieces))
        while True:
            at = rank[on].argmin(1)
            best = rank[on, at]
            going = best < self._NONE
            on, at, best = on[going], at[going], best[going]
            if not len(on):
                break
            right = after[on, at]
            beyond = after[on, right]
            ids[on, at] = best
            rank[on, at] = self._NONE
            rank[on, right] = self._NONE
            alive[on, right] = False
            after[on, at] = beyond
            some = beyond < sizes[on]
            row, i, j = on[some], at[some], beyond[some]
            before[row, j] = i
            rank[row, i] = self._pair(ids[row, i], ids[row, j])
            some = before[on, at] >= 0
            row, j = on[some], at[some]
            i = before[row, j]
            rank[row, i] = self._pair(ids[row, i], ids[row, j])
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """Encodes texts to ids and decodes ids to bytes. ``special``: strings that are one id wherever they stand."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.ranks, self.special = ranks, special or {}
        self.words = [b""] * (max([*ranks.values(), *self.special.values()], default=-1) + 1)
        for word, i in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.words[i] = word
        #: Ids of slices seen, as little-endian unsigned 32-bit numbers: joining bytes makes a text's ids.
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, special: dict[str, int] | None = None) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, special)

    def _learn(self, cuts: list[list[str]]) -> None:
        fresh = set(chain.from_iterable(cuts)).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known.clear()
            fresh = set(chain.from_iterable(cuts))
        names = list(fresh)
        self.known.update(zip(names, self._merger.merge([x.encode("utf-8", "surrogatepass") for x in names])))

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four little-endian bytes an id."""
        if any(k in x for k in self.special for x in texts):
            return [self._with_special(x) for x in texts]
        cuts = split(texts)
        self._learn(cuts)
        known = self.known
        return [b"".join([known[x] for x in cut]) for cut in cuts]

    def _with_special(self, text: str) -> bytes:
        out, at = [], 0
        names = "|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True))
        for hit in re.finditer(names, text):
            out += [text[at : hit.start()], hit[0]]
            at = hit.end()
        out.append(text[at:])
        cuts = split(out[::2])
        self._learn(cuts)
        own = [b"".join([self.known[x] for x in cut]) for cut in cuts]
        marks = [struct.pack("<I", self.special[x]) for x in out[1::2]] + [b""]
        return b"".join(chain.from_iterable(zip(own, marks)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in self.encode_bytes(texts)]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        words = self.words
        return b"".join([words[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each id's start in the decoded text, and its length at the end."""
        return np.concatenate([[0], np.cumsum(self._lengths[ids])]).astype(np.int64)

    @cached_property
    def _merger(self) -> Merger:
        return Merger(self.ranks)

    @cached_property
    def _lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.words], np.int64)


@cache
def codec(path: str, special: tuple[tuple[str, int], ...] = ()) -> Codec:
    """One codec for each vocabulary in a worker process."""
    return Codec.from_file(shipped(path), dict(special))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", offsets: str = "token_offsets") -> DataFrame:
    """``docs`` with the ids of ``text`` and the byte offset of each id (and the length, last).

    Nulls and empty texts give no ids and the offsets [0]. Columns named
    ``ids`` or ``offsets`` that ``docs`` already has are replaced.
    """
    ship(docs.sparkSession, path)
    kept = docs.drop(ids, offsets)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(offsets, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, texts in steps(batches, text):
            found = own.encode(texts)
            columns = [*batch.columns, pa.array(found, pa.list_(pa.uint32())).cast(pa.list_(pa.int32())), pa.array([own.offsets(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, ids, offsets])

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids`` (null: no bytes)."""
    ship(rows.sparkSession, path)
    kept = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            found = [own.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes the ids decode to).

    The ids of a text stay inside its worker: only their digests travel.
    A null or empty text has 0 tokens and the digests of nothing.
    """
    ship(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = [str(i) for i in range(len(own.words))]
        for batch, texts in steps(batches, "text"):
            n, ids_hash, text_hash = [], [], []
            for ids in own.encode(texts):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
