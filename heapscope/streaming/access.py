"""Access logs as streams: the batch transforms on event-time windows, and a table of versions kept by micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.operators.history import appended
from heapscope.functions.scalars import OPEN


def source(spark: SparkSession, folder: str, like: DataFrame, glob: str | None = None, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder, oldest first."""
    r = spark.readStream.schema(like.schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.parquet(folder)


def deduplicated(stream: DataFrame, ts: str, lag: str = "6 hours") -> DataFrame:
    """Each whole record once, as long as its copies come within the lag."""
    return stream.withWatermark(ts, lag).dropDuplicatesWithinWatermark(stream.columns)


def rolled(stream: DataFrame, ts: str, keys: list[str], width: str = "1 hour", lag: str | None = "6 hours", slide: str | None = None) -> DataFrame:
    """n and bytes of each window and key. With a lag, windows end for good once the watermark has passed them."""
    s = stream.withWatermark(ts, lag) if lag else stream
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return s.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out")).select(F.col("w.start").alias("hour"), *keys, "n", "bytes_out")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", lag: str | None = "6 hours") -> DataFrame:
    s = stream.withWatermark(ts, lag) if lag else stream
    return s.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def run_once(stream: DataFrame, checkpoint: str, mode: str, put: Callable[[DataFrame, int], None]) -> None:
    """Works through all that is there, in micro-batches, and ends."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def to_table(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number, so a batch that runs again replaces itself; "complete" keeps the last only."""

    def put(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return put


def version_keeper(path: str, key: list[str], change: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps versions of scans that come in order of t, a batch holding whole scans.

    Versions that a batch closes go to files of their own (closed/batch=k) and aren't touched again; only the open ones are
    written anew (open/batch=k, from those of batch k - 1). A batch that runs again replaces its own files.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("t", *key, *change).persist()
        times = [r.t for r in rows.select("t").distinct().orderBy("t").collect()]  # one row for each scan of the batch
        open_ = spark.read.parquet(f"{path}/open/batch={number - 1}") if number else None
        closed = []
        for t in times:
            scan = rows.filter(F.col("t") == t)
            if open_ is None:
                open_ = scan.select(*key, *change, F.col("t").alias("vf"), F.lit(OPEN).cast("long").alias("vt"))
                continue
            step = appended(open_, scan, key, change, t).drop("op")
            closed.append(step.filter(F.col("vt") != OPEN))
            open_ = step.filter(F.col("vt") == OPEN)
        if open_ is not None:
            open_.write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        if closed:
            reduce(DataFrame.unionByName, closed).write.mode("overwrite").parquet(f"{path}/closed/batch={number}")
        rows.unpersist()

    return put


def kept_versions(spark: SparkSession, path: str, batches: int, columns: list[str]) -> DataFrame:
    """All versions after so many batches."""
    return spark.read.parquet(f"{path}/closed").select(columns).unionByName(spark.read.parquet(f"{path}/open/batch={batches - 1}").select(columns))


def capture_kind(records: DataFrame) -> DataFrame:
    """hour, kind by count against weighted count: unsampled if equal, sampled if weights count more, inconsistent else."""
    c = records.groupBy("hour").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return c.select("hour", "n", "w", F.when(F.col("n") == F.col("w"), "unsampled").when(F.col("w") > F.col("n"), "sampled").otherwise("inconsistent").alias("kind"))
