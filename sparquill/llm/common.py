"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one step of a Python operator handles at once.
STEP_CHARS = 1_000_000
#: Bytes of rows from which Spark ends an Arrow batch for a Python operator, after small_batches().
BATCH_BYTES = 1 << 20
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset,
    a local master uses a temporary folder; on a cluster, where executors could
    not see each other's files, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}/sparquill-checkpoints"
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back: lineage ends here.

    A lost executor then costs a re-read instead of a recomputation, and rows
    can no longer change between two uses. The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sparquill-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() gave and that nothing will read again. Other frames stay untouched."""
    for table in tables:
        if path := _PLACES.pop(table, None):
            system, place = _file_system(table.sparkSession, path)
            system.delete(place, True)
            system.cancelDeleteOnExit(place)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no column of that name, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ship(spark: SparkSession, path: str) -> str:
    """Send a file that lies on the driver's machine to the executors; see shipped()."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def shipped(path: str) -> str:
    """Where a task finds a file that ship() sent: at its own path where that exists, else in the folder of sent files."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def small_batches(spark: SparkSession) -> None:
    """Have Spark end Arrow batches at BATCH_BYTES, not at 10,000 rows alone, from here on in this session; a limit that the session names itself stays.

    A batch lies in the JVM, beside its heap, and in the Python worker, there also as
    texts and as what is returned; with long texts, 10,000 rows of it are what a task holds most of.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def steps(batches: Iterator[pa.RecordBatch], column: str, chars: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of ``column`` each, with its texts (null: empty)."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text) + 1
            if size >= chars or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
