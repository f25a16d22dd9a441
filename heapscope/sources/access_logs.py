"""Access logs as they are delivered: usage CSV files, and JSON hour files in three versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.functions.scalars import action_op, usage_op

#: Columns of the usage log, all text (fixed names of the format).
USAGE = ["time_micros", "c_ip", "c_ip_type", "c_ip_region", "cs_method", "cs_uri", "sc_status", "cs_bytes", "sc_bytes", "time_taken_micros", "cs_host", "cs_referer", "cs_user_agent", "s_request_id", "cs_operation", "cs_bucket", "cs_object"]
VERSIONS = (1, 3, 4)


#: Captures whose counts may be too low. Fixed values.
SAMPLED = ("sampled", "inconsistent")


class BadHours(ValueError):
    """An unknown version, or two files for one hour that differ."""


def read_usage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in USAGE)).csv(path)


def usage(rows: DataFrame) -> DataFrame:
    """Requests of usage rows: whole records once, rows without a bucket dropped, empty numbers null."""
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    r = rows.select(*USAGE).distinct().filter(F.col("cs_bucket").isNotNull() & (F.col("cs_bucket") != ""))
    return r.select(
        F.expr("try_cast(time_micros as bigint) div 1000000").alias("ts_s"), F.col("cs_bucket").alias("bucket"), F.coalesce("cs_object", F.lit("")).alias("path"), usage_op(F.col("cs_operation"), F.col("cs_method")).alias("op"),
        F.col("cs_operation").alias("op_raw"), number("sc_status").alias("status"), number("sc_bytes").alias("bytes_out"), number("cs_bytes").alias("bytes_in"), F.col("c_ip").alias("requester"), F.col("cs_user_agent").alias("user_agent"), F.col("s_request_id").alias("request_id"),
    )


def dropped_share(rows: DataFrame) -> DataFrame:
    """n and the share of records that are repeated deliveries."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).agg(F.sum("_n").alias("n"), (1 - F.count("*") / F.sum("_n")).alias("dropped"))


def hours(texts: DataFrame) -> DataFrame:
    """bucket, hour, path, op, n, first_ts, last_ts, sampled of JSON hour files (column value, one file each).

    Version 1 has rows as objects, 3 and 4 as arrays [key, action, n, first_ts, last_ts]; a null key is the bucket's root.
    A file that is delivered again counts once. Stamps of the rows are as the file has them.
    """
    of = lambda p: F.get_json_object("value", p)
    start = F.coalesce(F.expr("try_cast(get_json_object(value, '$.hour') as bigint)"), F.unix_seconds(F.try_to_timestamp(of("$.hour"))))
    f = texts.select(of("$.schema_version").cast("int").alias("v"), of("$.bucket").alias("bucket"), start.alias("hour"), F.coalesce(of("$.capture"), of("$.sampling.capture")).alias("capture"), of("$.rows").alias("text")).distinct()
    # A few numbers for each file are checked before any row is read.
    known = F.coalesce(F.col("v").isin(*VERSIONS), F.lit(False))
    odd = f.groupBy("bucket", "hour").agg(F.count("*").alias("n"), F.bool_and(known).alias("known")).filter("n > 1 or not known").limit(1).collect()
    if odd:
        raise BadHours(f"{odd[0]['bucket']} {odd[0]['hour']}")
    r = f.select("v", "bucket", "hour", "capture", F.explode(F.from_json("text", "array<string>")).alias("x")).withColumn("l", F.when(F.col("v") > 1, F.from_json("x", "array<string>")))
    get = lambda name, i: F.when(F.col("v") == 1, F.get_json_object("x", f"$.{name}")).otherwise(F.get(F.col("l"), F.lit(i)))
    return r.select("bucket", "hour", F.coalesce(get("key", 0), F.lit("")).alias("path"), action_op(get("action", 1)).alias("op"), get("n", 2).cast("long").alias("n"), F.when(F.col("v") > 1, F.get(F.col("l"), F.lit(3))).cast("long").alias("first_ts"), get("last_ts", 4).cast("long").alias("last_ts"), F.coalesce("capture", F.lit("")).isin(*SAMPLED).alias("sampled"))
