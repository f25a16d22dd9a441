"""Queries over delivered logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.scalars import epoch
from heapscope.operators.access import hour
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import LISTING, REQUESTS, SCANS, VERSIONS, with_
from heapscope.plans.registry import query
from heapscope.sources import access_logs as A
from heapscope.sources.scratch import scratch
from heapscope.streaming import access as T


def _usage(spark, sf):
    r = X.requests(spark, sf)
    kinds = {"GET": "storage.objects.get", "HEAD": "HEAD_Object", "PUT": "PUT_Object", "LIST": "GET_Bucket", "DELETE": "DELETE_Object"}
    value = {"time_micros": (F.col("ts_s") * 1000000).cast("string"), "c_ip": F.concat(F.lit("10.0.0."), F.col("requester") % 250), "sc_status": F.lit("200"), "sc_bytes": F.when(F.col("event_id") % 10 != 0, F.col("bytes_out").cast("string")).otherwise(""), "s_request_id": F.concat(F.lit("r"), F.col("event_id")), "cs_operation": F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("op")], "cs_bucket": F.when(F.col("event_id") % 50 != 0, F.col("bucket")), "cs_object": F.col("path")}
    rows = r.select(*[value.get(c, F.lit("x")).alias(c) for c in A.USAGE])
    return rows.unionByName(rows.filter("s_request_id like '%7'"))


@query("s06_usage_csv", with_(LISTING, REQUESTS, then="SELECT bucket, op, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 <> 0 THEN bytes_out END) AS BIGINT) AS bytes_out FROM requests WHERE event_id % 50 <> 0 GROUP BY ALL"))
def s06(spark, sf):
    path = scratch(spark, "usage")
    _usage(spark, sf).write.option("header", True).csv(path)
    return A.usage(A.read_usage(spark, path)).groupBy("bucket", "op").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes_out"))


@query("t04_dropped_share", with_(LISTING, REQUESTS, then="SELECT count(*) + count(*) FILTER (WHERE event_id % 10 = 7) AS n, round(1 - count(*) / (count(*) + count(*) FILTER (WHERE event_id % 10 = 7)), 9) AS dropped FROM requests"))
def t04s(spark, sf):
    return A.dropped_share(_usage(spark, sf)).select("n", F.round("dropped", 9).alias("dropped"))


def staged_texts(spark, texts):
    """Files as they would lie in a store: their text doesn't change from one read to the next."""
    path = scratch(spark, "hours")
    texts.write.parquet(path)
    return spark.read.parquet(path)


@query("s08_hour_files", with_(LISTING, REQUESTS, then="SELECT bucket, CAST(ts_s - ts_s % 3600 AS BIGINT) AS hour, path, op, count(*) AS n, max(ts_s) AS last_ts, CAST(ts_s - ts_s % 3600 AS BIGINT) % 7200 = 0 AS sampled FROM requests GROUP BY ALL"))
def s08(spark, sf):
    g = X.requests(spark, sf).groupBy("bucket", hour(F.col("ts_s")).alias("hour"), "path", "op").agg(F.count("*").alias("n"), F.min("ts_s").alias("a"), F.max("ts_s").alias("b"))
    """Files of two versions, with the actions' own names; every third file is delivered twice."""
    names = {"GET": "GetObject", "HEAD": "HeadObject", "PUT": "UploadPart", "LIST": "ListObjectsV2", "DELETE": "DeleteObjects"}
    action = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("op")]
    g, old = g.withColumn("op", action), F.col("hour") % 10800 == 0
    row = F.when(old, F.to_json(F.struct(F.col("path").alias("key"), F.col("op").alias("action"), "n", F.col("b").alias("last_ts")))).otherwise(F.concat(F.lit("["), F.concat_ws(",", F.to_json(F.struct(F.col("path").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("path").alias("k")))) - 6), F.concat(F.lit('"'), "op", F.lit('"')), "n", "a", "b"), F.lit("]")))
    f = g.select("bucket", "hour", row.alias("row")).groupBy("bucket", "hour").agg(F.array_join(F.collect_list("row"), ",").alias("rows"))
    kind = F.when(F.col("hour") % 14400 == 0, '"sampled"').when(F.col("hour") % 7200 == 0, '"inconsistent"').otherwise('"unsampled"')
    texts = f.select(F.concat(F.lit('{"schema_version":'), F.when(old, "1").otherwise("4"), F.lit(',"bucket":"'), "bucket", F.lit('","hour":'), "hour", F.lit(',"capture":'), kind, F.lit(',"rows":['), "rows", F.lit("]}")).alias("value"))
    again = F.explode(F.when(F.crc32(F.substring("value", 1, 60).cast("binary")) % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    texts = staged_texts(spark, texts).select("value", again.alias("_k")).select("value")
    return A.hours(texts).select("bucket", "hour", "path", "op", "n", "last_ts", "sampled")


#: Windows that end by the watermark, an hour before the newest event, are given out; later ones stay open.
@query("t02_hourly_stream", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes_out FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def t02(spark, sf):
    like = X.table(spark, sf, "events")
    s = T.source(spark, sf, like, "events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("long").alias("bytes_out"))
    out = scratch(spark, "hourly")
    T.run_once(T.rolled(s, "ts", ["event_type"], lag="1 hour"), scratch(spark, "ck"), "append", T.to_table(out))
    return spark.read.parquet(out).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", "bytes_out")


@query("t04_dedupe_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def t04(spark, sf):
    like = X.table(spark, sf, "events")
    s = T.source(spark, sf, like, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = s.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_k")
    out = scratch(spark, "once")
    T.run_once(T.deduplicated(twice, "ts", "365 days"), scratch(spark, "ck"), "append", T.to_table(out))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("t07_upsert", with_(LISTING, SCANS, VERSIONS, then="SELECT path, size, vf, vt FROM versions"))
def t07(spark, sf):
    scans, folder, state = X.scans(spark, sf).select("t", "path", "size"), scratch(spark, "scans"), scratch(spark, "state")
    for t in X.cut_seconds():  # a delivery of one file for each scan
        scans.filter(F.col("t") == t).write.parquet(f"{folder}/{t}")
    keep = T.version_keeper(state, ["path"], ["size"])
    for k, t in enumerate(X.cut_seconds()):  # a delivery's files come together, in one batch
        keep(spark.read.parquet(f"{folder}/{t}"), k)
    return T.kept_versions(spark, state, len(X.CUTS), ["path", "size", "vf", "vt"])


@query("e12_capture_kind", "SELECT CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS hour, count(*) AS n, CAST(sum(1 + event_id % 2 * (CAST(floor(epoch(ts)) AS BIGINT) // 3600 % 2)) AS BIGINT) AS w, CASE WHEN count(*) = sum(1 + event_id % 2 * (CAST(floor(epoch(ts)) AS BIGINT) // 3600 % 2)) THEN 'unsampled' ELSE 'sampled' END AS kind FROM events GROUP BY 1")
def e12(spark, sf):
    e = X.table(spark, sf, "events").withColumn("s", epoch(F.col("ts")))
    return T.capture_kind(e.select(hour(F.col("s")).alias("hour"), (1 + F.col("event_id") % 2 * F.expr("s div 3600 % 2")).alias("weight")))
