"""What the text operators share: staging in the shared folder, and small helpers for Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \t \n \v \f \r. bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local session gets a temporary folder; a cluster gets an error,
    since a machine-local folder would hold only a part of what is written there.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="heapscope-")
        _OWN[app] = f"{base.rstrip('/')}/heapscope-{app}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lost executors don't undo it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(spark: SparkSession) -> int:
    """Partitions for what is dealt out by our own keys; follows the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Arrow batches of at most `most` rows from now on: a batch of whole texts is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def text_only(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and what else is asked for; other columns go."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def batches_of(sizes: list[int], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Slices of about `most` in size."""
    out, a, total = [], 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            out.append((a, i))
            a, total = i, 0
        total += s
    return [*out, (a, len(sizes))] if sizes else out


#: What workers keep between tasks, by operator, and how it is let go.
STORES: dict[str, Callable[[], None]] = {}


def tidied(run, keep: str = ""):
    """run over Arrow batches. Before it, a worker lets go what other operators' tasks have left in it (all stores but `keep`);
    after it, memory that is free goes back to the system."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from heapscope.llm import common  # the worker's own module, not what was sent with this function

        for name, clear in common.STORES.items():
            if name != keep:
                clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def counter_slices(counts: np.ndarray, slices: int) -> list[bytes]:
    """A task's counters (64-bit) in compressed slices, for summed_counters; none if all are 0."""
    zstd = zstandard.ZstdCompressor(level=1)
    return [zstd.compress(x.tobytes()) for x in counts.reshape(slices, -1)] if counts.any() else []


def summed_counters(parts: DataFrame, size: int, slices: int) -> np.ndarray:
    """The sum of all tasks' counters; parts: slice and counts, a row for each slice of each task.

    Slices are added in two steps, so a task reads few tasks' slices at any number of tasks. The driver gets the sums of a
    fixed number of counters.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        unzip, zstd = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i, x in rows(batch, "slice", "counts"):
                c = np.frombuffer(unzip.decompress(x), np.int64)
                totals[i] = totals[i] + c if i in totals else c
        for i, c in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zstd.compress(c.tobytes())], pa.binary())], ["slice", "counts"])

    blocks = spread(parts.sparkSession)
    some = parts.select("slice", "counts", (F.spark_partition_id() % 16).alias("some")).repartition(blocks, "slice", "some").select("slice", "counts")
    summed = some.mapInArrow(tidied(add), "slice int, counts binary").repartition(blocks, "slice").mapInArrow(tidied(add), "slice int, counts binary")
    total, unzip = np.zeros((slices, size // slices), np.int64), zstandard.ZstdDecompressor()
    for r in summed.toLocalIterator():
        total[r["slice"]] += np.frombuffer(unzip.decompress(bytes(r["counts"])), np.int64)
    return total.ravel()
