"""The test tables as inputs of the operators: a listing, scans of it, labels, an access log. With the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.functions.scalars import OPEN, epoch

CUTS = ("1996-06-01", "1997-06-01", "1998-06-01", "1999-06-01", "2000-06-01", "2001-08-01")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """bucket, name, size_bytes, created, created_s, storage_class_id, key, cust; nations and regions are fixed lists of a few rows."""
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    place = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    ext = F.element_at(F.array(F.lit("parquet"), F.lit("csv"), F.lit("log")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    name = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("/c"), "c_custkey", F.lit("/"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_"))), F.lit("/o"), "o_orderkey", F.lit("."), ext)
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return j.select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("bucket"), name.alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"), F.col("o_orderdate").alias("created"),
        epoch(F.col("o_orderdate")).alias("created_s"), kind.alias("storage_class_id"), F.col("o_orderkey").alias("key"), F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("n_nationkey").cast("long").alias("nation"),
    )


LISTING = """listing AS (
  SELECT lower(replace(r_name, ' ', '-')) AS bucket,
    lower(replace(n_name, ' ', '_')) || '/c' || c_custkey || '/' || lower(replace(o_orderpriority, ' ', '_')) || '/o' || o_orderkey || '.' ||
      CASE o_orderkey % 3 WHEN 0 THEN 'parquet' WHEN 1 THEN 'csv' ELSE 'log' END AS name,
    CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_orderdate AS created, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_s,
    CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS INTEGER) AS storage_class_id,
    o_orderkey AS key, c_custkey AS cust, c_mktsegment AS segment, CAST(n_nationkey AS BIGINT) AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT bucket || '/' || name AS path, size_bytes AS size, created_s AS mtime, storage_class_id, key, cust, segment, nation FROM listing)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    x = listing(spark, sf)
    return x.select(F.concat_ws("/", "bucket", "name").alias("path"), F.col("size_bytes").alias("size"), F.col("created_s").alias("mtime"), "storage_class_id", "key", "cust", "segment", "nation")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """prefix, usr: a third of the customers, even nations, one bucket."""
    x = listing(spark, sf).select("bucket", F.substring_index("name", "/", 1).alias("country"), "cust", "segment", "nation").distinct()
    own = x.filter("cust % 3 = 0").select(F.concat("bucket", F.lit("/"), "country", F.lit("/c"), "cust").alias("prefix"), F.lower("segment").alias("usr"))
    team = x.filter("nation % 2 = 0").select(F.concat("bucket", F.lit("/"), "country").alias("prefix"), F.concat(F.lit("team-"), "nation").alias("usr")).distinct()
    return own.unionByName(team).unionByName(x.filter("bucket = 'asia'").select(F.col("bucket").alias("prefix"), F.lit("default").alias("usr")).distinct())


LABELS = """labels_ AS (
  SELECT DISTINCT bucket || '/' || split_part(name, '/', 1) || '/c' || cust AS prefix, lower(segment) AS usr FROM listing WHERE cust % 3 = 0
  UNION ALL SELECT DISTINCT bucket || '/' || split_part(name, '/', 1), 'team-' || nation FROM listing WHERE nation % 2 = 0
  UNION ALL SELECT DISTINCT bucket, 'default' FROM listing WHERE bucket = 'asia')"""


def cut_seconds() -> list[int]:
    import datetime as dt

    return [int(dt.datetime.fromisoformat(c).replace(tzinfo=dt.UTC).timestamp()) for c in CUTS]


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """scan (ordinal), t (epoch seconds), path, size, mtime: six cuts of the listing, with gaps and growth."""
    cuts = spark.createDataFrame(list(enumerate(cut_seconds())), "scan int, t long")
    return files(spark, sf).crossJoin(F.broadcast(cuts)).filter("mtime <= t and key % 11 != scan").select("scan", "t", "path", (F.col("size") + F.when(F.col("key") % 5 == 0, F.col("scan")).otherwise(0)).alias("size"), "mtime")


SCANS = f"""cuts AS (SELECT CAST(i - 1 AS INTEGER) AS scan, CAST(epoch(CAST(c AS TIMESTAMP)) AS BIGINT) AS t FROM (SELECT unnest({list(CUTS)}) AS c, unnest(range(1, {len(CUTS) + 1})) AS i)),
scans AS (SELECT scan, t, path, size + CASE WHEN key % 5 = 0 THEN scan ELSE 0 END AS size, mtime FROM files, cuts WHERE mtime <= t AND key % 11 <> scan)"""

VERSIONS = f"""steps AS (SELECT *, CASE WHEN lag(size) OVER w IS NOT DISTINCT FROM size AND lag(scan) OVER w = scan - 1 THEN 0 ELSE 1 END AS fresh FROM scans WINDOW w AS (PARTITION BY path ORDER BY scan)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY scan) AS run FROM steps),
ranges AS (SELECT path, min(size) AS size, min(t) AS vf, max(scan) + 1 AS after FROM runs GROUP BY path, run),
versions AS (SELECT path, size, vf, CAST(coalesce(c.t, {OPEN}) AS BIGINT) AS vt FROM ranges LEFT JOIN cuts c ON c.scan = after)"""

OPS = {"view": "GET", "click": "HEAD", "purchase": "PUT", "signup": "LIST", "error": "DELETE"}


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """An access log: ts_s, bucket, path (with the bucket), op, op_raw, requester, bytes_out of each event on some object."""
    e, x = table(spark, sf, "events"), listing(spark, sf)
    n = F.broadcast(table(spark, sf, "orders").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_key")))
    op = F.create_map(*[F.lit(v) for kv in OPS.items() for v in kv])[F.col("event_type")]
    e = e.crossJoin(n).select("event_id", epoch(F.col("ts")).alias("ts_s"), op.alias("op"), F.col("event_type").alias("op_raw"), F.col("user_id").alias("requester"), F.round(F.col("value") * 100).cast("long").alias("bytes_out"), (F.col("event_id") % F.col("n_orders") + F.col("first_key")).alias("key"))
    return e.join(x.select("key", "bucket", F.concat_ws("/", "bucket", "name").alias("path")), "key")


REQUESTS = """requests AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'HEAD' WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'LIST' ELSE 'DELETE' END AS op,
    event_type AS op_raw, user_id AS requester, CAST(round(value * 100) AS BIGINT) AS bytes_out, listing.key, bucket, bucket || '/' || name AS path
  FROM events, (SELECT count(*) AS n_orders, min(o_orderkey) AS first_key FROM orders), listing WHERE listing.key = event_id % n_orders + first_key)"""

#: Ancestors of a path as a list, shortest first: the root '' and, at the end, the path itself.
ANC = "list_prepend('', list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))"
DIRS = f"""dir_up AS (SELECT path, size, mtime, storage_class_id, unnest(({ANC})[1:-2]) AS dir FROM files),
dirs AS (SELECT dir AS path, CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime, count(*) AS n_files FROM dir_up GROUP BY dir)"""


def with_(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then
