"""Streams: queries answered as they come, documents indexed as they come, windowed counts of events.

The state of a stream is its checkpoint and the tables it has written; after the
loss of an executor or the driver it goes on from there. A batch that runs twice
writes the same folder twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import Index
from ..operators.query import batch_search


def search_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 5, once: bool = False) -> StreamingQuery:
    """Answers a stream of queries (query_id, terms): each micro-batch is one batch_search against the index.

    sink(hits, batch) takes what the batch found.
    """

    def each(rows: DataFrame, batch: int) -> None:
        sink(batch_search(index, rows, k), batch)

    writer = queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def index_stream(documents: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Indexes a stream of documents (doc_id, text): each micro-batch becomes a generation of postings and lengths below ``path``."""

    def each(rows: DataFrame, batch: int) -> None:
        own = Index.build(rows)
        own.postings().sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/generation={batch}")
        own.docs.drop("tokens").write.mode("overwrite").parquet(f"{path}/docs/generation={batch}")

    writer = documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def open_generations(spark: SparkSession, path: str, upto: int | None = None) -> Index:
    """The index that index_stream() has written, all generations or those up to one: a snapshot."""
    docs, postings = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    if upto is not None:
        docs, postings = docs.filter(F.col("generation") <= upto), postings.filter(F.col("generation") <= upto)
    return Index(docs.drop("generation"), postings.drop("generation"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): counts in tumbling windows; rows later than ``late`` are dropped from a stream. Works on tables too."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, n): sessions that end after ``gap`` without an event."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
