"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task packs its share online: a fixed number of bins stay open, a bitset
keyed by free space finds the tightest bin that an item fits, and when another
bin is needed the fullest one closes. What the open bins hold at the end of a
task is packed again with that of other tasks, ``FAN_IN`` tasks at a time, the
longest first, until one task is left; so only the very last bins of all can stay
half empty. Whatever the level, a task hands on at most ``OPEN_BINS`` bins, the
emptiest, so none ever reads or holds more than ``FAN_IN`` times that.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import materialize, ship, steps

LENGTH = 2048
#: Bins that a task of the first level keeps open, and that a task of any level hands on.
OPEN_BINS = 512
#: Tasks whose open bins are packed again by one task of the next level.
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, special: dict[str, int] | None = None, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Token pieces of each document: its ids, then ``end_id``; over ``length`` tokens, all pieces but the first have ``length``.

    A null or empty text is one piece of one token. Repeated rows give repeated pieces.
    """
    names = tuple((special or {}).items())
    ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(vocabulary, names), end_id.to_bytes(4, "little")
        for batch, texts in steps(batches, "text"):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode_bytes(texts)):
                ids += end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % length + 1
                for k in range(-(-n // length)):
                    out.append((doc, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + length
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Packer:
    """Bounded-space best fit. ``put`` gives the bins that close, each a list of items; an item is (size, row)."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit, self.open, self.mask = length, limit, 0, 0
        #: Open bins by free space; bit f of ``mask`` is set where there are any.
        self.bins: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        found = self.bins[free]
        own = found.pop()
        if not found:
            self.mask &= ~(1 << free)
        self.open -= 1
        return own

    def put(self, size: int, row: tuple) -> list[list]:
        if not 0 < size <= self.length:
            raise ValueError(f"an item of {size} tokens does not fit a sequence of {self.length}")
        closed = []
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.limit:
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, own = self.length, []
        own.append((size, row))
        if free == size:
            closed.append(own)
        else:
            self.bins.setdefault(free - size, []).append(own)
            self.mask |= 1 << (free - size)
            self.open += 1
        return closed

    def rest(self) -> list[list]:
        out = [own for free in sorted(self.bins) for own in self.bins[free]]
        self.bins, self.mask, self.open = {}, 0, 0
        return out


def _level(length: int, limit: int, level: int, handed_on: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(length, limit), (level << 27 | TaskContext.get().partitionId()) << 32
        made = 0

        def rows(bins: list[list], done: bool) -> pa.RecordBatch:
            nonlocal made
            out = []
            for own in bins:
                at = 0
                for size, row in own:
                    out.append((*row, first + made, at, done))
                    at += size
                made += 1
            columns = zip(*out) if out else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])

        def items() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)))

        closed: list[list] = []
        for row in items():
            closed += packer.put(row[3], row)
            if len(closed) >= 2000:
                yield rows(closed, True)
                closed = []
        yield rows(closed, True)
        rest = packer.rest()  # the fullest first
        full = max(0, len(rest) - handed_on)
        yield rows(rest[:full], True)
        yield rows(rest[full:], False)

    return run


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (the columns of pieces()) with sequence_id and offset, gapless in each sequence.

    ``items`` should be a table, so that a task which runs again sees the same rows in the same order.
    An empty table gives an empty table. Items longer than ``length`` are an error (ValueError in the task).
    Rows with null ids and repeated rows are items like all others.
    """
    names, schema = items.columns, f"{PIECES}, sequence_id long, offset long, done boolean"
    done, level, parts = [], 0, items.rdd.getNumPartitions()
    while True:
        last = level > 0 and parts <= 1
        limit, handed_on = (open_bins * fan_in if level else open_bins), (0 if last else open_bins)
        rows = materialize(items.mapInArrow(_level(length, limit, level, handed_on), schema))
        done.append(rows.filter("done"))
        if last:
            break
        parts = -(-parts // fan_in)
        items, level = rows.filter("not done").select(*names).coalesce(parts).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("done")


def pack_documents(docs: DataFrame, vocabulary: str, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents packed into sequences of ``LENGTH`` tokens; other columns of ``docs`` are not kept."""
    return pack(materialize(pieces(docs, vocabulary, special)))
