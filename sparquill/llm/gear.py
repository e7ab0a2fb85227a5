"""Substring deduplication by content-defined chunking with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, steps, unused

#: Bytes on either side among which a boundary's hash is the largest; chunks are longer than this.
REACH = 24
#: Bytes after which a chunk ends anyway.
LONGEST = 512
#: Words that a run of repeated chunks must have to be cut.
MIN_WORDS = 25
_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 32, 256, dtype=np.uint32)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes up to each position: sum of gear[byte] << age, made by doubling the window."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        wide = h.copy()
        wide[k:] += h[:-k] << np.uint32(k)
        h = wide
    return h * np.uint32(2654435761)


def _largest(v: np.ndarray) -> np.ndarray:
    """Largest of the REACH values from each position on (fewer at the end)."""
    width, m = 1, v
    while width * 2 <= REACH:
        wide = m.copy()
        np.maximum(wide[:-width], m[width:], out=wide[:-width])
        m, width = wide, width * 2
    if rest := REACH - width:
        wide = m.copy()
        np.maximum(wide[:-rest], m[rest:], out=wide[:-rest])
        m = wide
    return m


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data`` (UTF-8), the last is its length.

    A chunk ends after a white-space byte whose hash is the largest within REACH
    bytes on both sides. That depends on nearby bytes only, so after an insertion
    the same chunks follow again at once. Without such a place for LONGEST bytes
    the chunk is cut there, between characters.
    """
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    found = np.empty(0, np.int64)
    if n > 2 * REACH:
        v = rolling(raw)
        v[~_WHITE[raw]] = 0
        v[:-1][_WHITE[raw[1:]]] = 0  # a run of white space stays whole
        ahead = np.zeros(n, np.uint32)
        ahead[:-1] = _largest(v)[1:]
        behind = np.zeros(n, np.uint32)
        behind[1:] = _largest(v[::-1])[::-1][:-1]
        found = np.flatnonzero((v > behind) & (v >= ahead) & (v > 0)) + 1
    ends, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > LONGEST:
            cut = last + LONGEST
            while cut > last + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if end > last:
            ends.append(end)
            last = end
    return ends


def chunks(data: bytes) -> tuple[list[int], list[int]]:
    """Ends and digests (signed longs) of the chunks; white space around a chunk does not count in its digest."""
    ends, out, last = boundaries(data), [], 0
    for end in ends:
        out.append(_signed(xxhash.xxh3_64_intdigest(data[last:end].strip())))
        last = end
    return ends, out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the different chunks of each document. A null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            ids, out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                own = set(chunks(text.encode("utf-8", "surrogatepass"))[1])
                ids += [doc] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, digest long")


def repeats(text: str, known: set[int], min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without its repeats, and their (start, stop) in code points.

    A repeat is a run of chunks, of ``min_words`` words or more together, each of
    which is in ``known`` or stands earlier in the text.
    """
    data = text.encode("utf-8", "surrogatepass")
    ends, own = chunks(data)
    seen: set[int] = set()
    cut: list[list[int]] = []
    last = 0
    for end, digest in zip(ends, own):
        if digest in known or digest in seen:
            if cut and cut[-1][1] == last:
                cut[-1][1] = end
            else:
                cut.append([last, end])
        seen.add(digest)
        last = end
    cut = [x for x in cut if len(data[x[0] : x[1]].split()) >= min_words]
    if not cut:
        return text, []
    kept, spans, last, at = [], [], 0, 0
    for a, b in cut:
        kept.append(data[last:a])
        at += len(data[last:a].decode("utf-8", "surrogatepass"))
        size = len(data[a:b].decode("utf-8", "surrogatepass"))
        spans.append((at, at + size))
        at, last = at + size, b
    kept.append(data[last:])
    return b"".join(kept).decode("utf-8", "surrogatepass"), spans


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", spans: str = "repeat_spans") -> DataFrame:
    """``docs`` with ``text`` rid of what an earlier document (smaller doc_id), or the same one before, has already.

    spans: array of (start, stop), in code points of the text given. All other
    columns stay. Every document stays, a copy of an earlier one with little or
    no text. A null text stays null. Rows with one doc_id count as one document;
    rows with a null doc_id are compared with themselves only.

    Digests are first reduced to those that two documents share, with partial
    aggregation; only these join the chunk table again, where Spark can split a
    frequent digest, and what gathers by document is bounded by its own length.
    64-bit digests do: a false cut would take several collisions in a row.
    """
    base = docs.drop(spans)
    id_type = base.schema["doc_id"].dataType
    own = materialize(digests(base.select("doc_id", F.col(text).alias("text"))))
    shared = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).filter("first < final").select("digest", "first")
    later = own.join(shared, "digest").filter("doc_id > first").select("doc_id", "digest")
    mark = unused(base, "known")
    known = later.groupBy("doc_id").agg(F.struct(F.collect_set("digest").alias("all"), F.col("doc_id").cast(id_type).alias("doc")).alias(mark)).select(mark)
    joined = base.join(known, base["doc_id"] == known[mark]["doc"], "left").withColumn(mark, F.col(f"`{mark}`")["all"])
    schema = T.StructType([*base.schema.fields, T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, text):
            at, sets = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(mark)).to_pylist()
            given = batch.column(at)
            out = [repeats(x, set(k or ()), min_words) for x, k in zip(texts, sets)]
            fresh = pa.array([None if null else x for (x, _), null in zip(out, given.is_null().to_pylist())], given.type)
            columns = [fresh if i == at else batch.column(i) for i, name in enumerate(batch.schema.names) if name != mark]
            found = pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in out], kind)
            yield pa.RecordBatch.from_arrays([*columns, found], [*[x for x in batch.schema.names if x != mark], spans])

    return joined.mapInArrow(run, schema)
