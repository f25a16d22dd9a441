"""Queries over the remaining shapes of the inventory: set operations, windows, sources and incremental forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heapscope.functions.paths import basename, depth, parent
from heapscope.functions.scalars import OPEN
from heapscope.operators import access as A
from heapscope.operators import history as H
from heapscope.operators import joins as J
from heapscope.operators import search as S
from heapscope.operators import views as V
from heapscope.operators.rollup import directories
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, REQUESTS, SCANS, VERSIONS, with_
from heapscope.plans.q_history import LEVEL, versions
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.q_search import COPIED, _copied, _dirs, _dup
from heapscope.plans.registry import query
from heapscope.sources import listing as L
from heapscope.sources import stores
from heapscope.sources.scratch import scratch
from heapscope.streaming import access as T

VERS = (LISTING, SCANS, VERSIONS)
CUT = X.cut_seconds()
PAR = "array_to_string(string_split(path, '/')[:-2], '/')"


@query("s07_daily_storage", with_(LISTING, then="SELECT bucket, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM listing GROUP BY bucket"))
def s07(spark, sf):
    path = scratch(spark, "daily")
    X.listing(spark, sf).groupBy("bucket").agg(F.sum("size_bytes").alias("bytes")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("bucket string, bytes long").csv(path)


@query("s11_ranged_listing", with_(LISTING, then="SELECT bucket, name, size_bytes FROM listing"))
def s11(spark, sf):
    return L.ranged(X.listing(spark, sf), 8).select("bucket", "name", "size_bytes")


@query("s15_chunked_store", with_(LISTING, DIRS, then="SELECT path, size, n_files FROM dirs WHERE path = 'asia' OR starts_with(path, 'asia/')"))
def s15(spark, sf):
    path = scratch(spark, "chunks")
    stores.write_chunked(_dirs(spark, sf).filter("path != ''"), path)
    return spark.read.parquet(path).filter("chunk = 'asia'").select("path", "size", "n_files")


@query("s18_sorted_store", with_(LISTING, DIRS, then="SELECT path, size, n_files FROM dirs WHERE path = 'asia/nation_2' OR starts_with(path, 'asia/nation_2/')"))
def s18(spark, sf):
    path = scratch(spark, "sorted")
    stores.write_by_path(_dirs(spark, sf).withColumn("depth", depth(F.col("path"))), path, 4)
    return stores.read_subtree(spark, path, "asia/nation_2").select("path", "size", "n_files")


@query("s23_retired_scan", with_(LISTING, SCANS, then="SELECT split_part(path, '/', 1) AS bucket, array_to_string(string_split(path, '/')[2:], '/') AS name, size AS size_bytes FROM scans WHERE scan = 1"))
def s23(spark, sf):
    v = H.live(versions(spark, sf), CUT[1]).select("path", "size", F.lit(0).cast("long").alias("mtime"), F.lit("file").alias("kind"))
    return L.from_rollup(v).select("bucket", "name", "size_bytes")


@query("j05_null_safe", with_(LISTING, LABELS, LAB, OWNED, then="SELECT a.path, a.usr, n FROM (SELECT DISTINCT split_part(path, '/', 1) AS path, usr FROM owned) a JOIN (SELECT usr, count(*) AS n FROM owned GROUP BY usr) b ON a.usr IS NOT DISTINCT FROM b.usr"))
def j05(spark, sf):
    o = owned(spark, sf)
    a = o.select(F.substring_index("path", "/", 1).alias("path"), "usr").distinct()
    b = o.groupBy(F.col("usr").alias("u")).agg(F.count("*").alias("n"))
    return a.join(b, a["usr"].eqNullSafe(b["u"])).select("path", "usr", "n")


@query("j06_anti", with_(LISTING, REQUESTS, then="SELECT path FROM files WHERE path NOT IN (SELECT path FROM requests)"))
def j06(spark, sf):
    return X.files(spark, sf).join(X.requests(spark, sf).select("path"), "path", "left_anti").select("path")


@query("j14_semi", with_(LISTING, REQUESTS, then="SELECT path FROM files WHERE path IN (SELECT path FROM requests WHERE op = 'GET')"))
def j14(spark, sf):
    return X.files(spark, sf).join(X.requests(spark, sf).filter("op = 'GET'").select("path"), "path", "left_semi").select("path")


@query("j16_copy_digests", with_(LISTING, COPIED, then="SELECT d.path, count(*) AS n, CAST(sum(c.size) AS BIGINT) AS size FROM dup d JOIN cop c ON starts_with(c.path, d.path || '/') GROUP BY d.path"))
def j16(spark, sf):
    from heapscope.functions.paths import ancestors

    up = _copied(spark, sf).select("size", F.explode(ancestors(F.col("path"), own=False, root=False)).alias("top"))
    return up.join(_dup(spark, sf).select(F.col("path").alias("top")), "top").groupBy(F.col("top").alias("path")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("j22_dictionary", with_(LISTING, "nm AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT string_split(path, '/')[3] AS name FROM files))", then="SELECT path, id FROM files JOIN nm ON name = string_split(path, '/')[3]"))
def j22(spark, sf):
    f = X.files(spark, sf).select("path", F.split_part("path", F.lit("/"), F.lit(3)).alias("name"))
    return J.dictionary(f, J.numbered(f, "name"), "name").select("path", "id")


@query("w04_best_version", with_(*VERS, then=f"SELECT path, vf, min(vt) AS vt FROM (SELECT path, vf, vt FROM versions UNION ALL SELECT path, vf, {OPEN} FROM versions) GROUP BY ALL"))
def w04(spark, sf):
    v = versions(spark, sf).select("path", "vf", "vt")
    return H.best(v.unionByName(v.withColumn("vt", F.lit(OPEN).cast("long"))), ["path", "vf"])


@query("w14_slice_total", with_(LISTING, LABELS, LAB, OWNED, then="SELECT path, usr, size, CAST(sum(size) OVER (PARTITION BY path) AS BIGINT) AS tot FROM (SELECT split_part(path, '/', 1) AS path, usr, CAST(sum(size) AS BIGINT) AS size FROM owned GROUP BY ALL)"))
def w14(spark, sf):
    s = owned(spark, sf).groupBy(F.substring_index("path", "/", 1).alias("path"), "usr").agg(F.sum("size").alias("size"))
    return s.withColumn("tot", F.sum("size").over(Window.partitionBy("path")))


@query("w11_distinct_in_window", with_(LISTING, then="SELECT bucket, segment, n FROM (SELECT DISTINCT bucket, segment FROM listing) JOIN (SELECT bucket, count(DISTINCT segment) AS n FROM listing GROUP BY bucket) USING (bucket)"))
def w11(spark, sf):
    x = X.listing(spark, sf).select("bucket", "segment").distinct()
    return x.withColumn("n", F.count("*").over(Window.partitionBy("bucket")))


@query("o04_ranged_sort", with_(LISTING, DIRS, then="SELECT path, size FROM dirs"))
def o04(spark, sf):
    d = _dirs(spark, sf).withColumn("depth", depth(F.col("path")))
    return d.repartitionByRange(8, "depth", "path").sortWithinPartitions("depth", "path").select("path", "size")


@query("o08_capped_diff", with_(LISTING, SCANS, LEVEL, f"x AS (SELECT split_part(up, '/', 2) AS nation, CAST(sum(coalesce(size, 0) - coalesce(size_prev, 0)) AS BIGINT) AS delta FROM level WHERE t > {CUT[1]} AND t <= {CUT[3]} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, nation) AS rn FROM x)", then="SELECT CASE WHEN rn <= 6 THEN nation ELSE '(other)' END AS nation, CAST(sum(delta) AS BIGINT) AS delta FROM r GROUP BY 1"))
def o08(spark, sf):
    x = H.level_transitions(versions(spark, sf)).filter((F.col("t") > CUT[1]) & (F.col("t") <= CUT[3]))
    d = x.groupBy(F.split_part("up", F.lit("/"), F.lit(2)).alias("nation")).agg(F.sum(F.coalesce("size", F.lit(0)) - F.coalesce("size_prev", F.lit(0))).alias("delta"))
    return V.top_with_other(d, "delta", "nation", 6)


@query("o09_tile_budget", with_(LISTING, DIRS, then="SELECT path, size FROM dirs WHERE path <> '' ORDER BY size DESC, path LIMIT 200"))
def o09(spark, sf):
    return J.page(_dirs(spark, sf).filter("path != ''"), 200).select("path", "size")


@query("u01_union_stores", with_(LISTING, then="SELECT path, size, CASE WHEN split_part(path, '/', 1) = 'asia' THEN storage_class_id END AS storage_class_id FROM files"))
def u01(spark, sf):
    f = X.files(spark, sf).select("path", "size", "storage_class_id")
    return f.filter("path like 'asia/%'").unionByName(f.filter("path not like 'asia/%'").drop("storage_class_id"), allowMissingColumns=True)


@query("u02_union_distinct", with_(*VERS, then="SELECT path, vf AS t FROM versions UNION SELECT path, vt FROM versions"))
def u02(spark, sf):
    v = versions(spark, sf)
    return v.select("path", F.col("vf").alias("t")).union(v.select("path", F.col("vt"))).distinct()


@query("v09_level_of_a_parent", with_(LISTING, SCANS, LEVEL, then="SELECT up, count(*) AS n, CAST(sum(CASE op WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS added FROM level GROUP BY up"))
def v09(spark, sf):
    return H.level_transitions(versions(spark, sf)).groupBy("up").agg(F.count("*").alias("n"), F.sum((F.col("op") == 1).cast("long")).alias("added"))


@query("t03_any_grain", with_(LISTING, REQUESTS, then="SELECT CAST(ts_s - ts_s % 900 AS BIGINT) AS hour, op, count(*) AS n FROM requests GROUP BY ALL"))
def t03(spark, sf):
    return X.requests(spark, sf).groupBy(A.hour(F.col("ts_s"), 900).alias("hour"), "op").agg(F.count("*").alias("n"))


@query("t08_sampled_flag", with_(LISTING, REQUESTS, then="SELECT bucket, CAST(ts_s - ts_s % 3600 AS BIGINT) AS hour, bool_or(event_id % 97 = 0) AS sampled FROM requests GROUP BY ALL"))
def t08(spark, sf):
    return X.requests(spark, sf).groupBy("bucket", A.hour(F.col("ts_s")).alias("hour")).agg(F.bool_or(F.col("event_id") % 97 == 0).alias("sampled"))


#: Sessions that have ended by the watermark, six hours before the newest event.
@query("t05_session_stream", "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS n FROM events), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, count(*) AS n, min(ts) AS start FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 6 HOUR")
def t05(spark, sf):
    like = X.table(spark, sf, "events")
    s = T.source(spark, sf, like, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "sessions")
    T.run_once(T.sessions(s, "ts", "user_id", "12 hours"), scratch(spark, "ck"), "append", T.to_table(out))
    return spark.read.parquet(out).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))


#: A minute-grained row counts at a cut if its whole minute lies before it, and summaries can't be asked for earlier cuts than they hold.
@query("t05_late_rows", with_(LISTING, REQUESTS, then="SELECT cut, count(*) AS n FROM (SELECT unnest([1705276800, 1705276830, 1705276860]) AS cut), (SELECT ts_s - ts_s % 60 AS m FROM requests) WHERE m + 60 <= cut GROUP BY cut"))
def t05l(spark, sf):
    r = X.requests(spark, sf).select((F.col("ts_s") - F.col("ts_s") % 60).alias("ts_s"))
    parts = [A.as_of(r, cut, 60).agg(F.lit(cut).cast("int").alias("cut"), F.count("*").alias("n")) for cut in (1705276800, 1705276830, 1705276860)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f03_globs", with_(LISTING, DIRS, then="SELECT path FROM dirs WHERE regexp_matches(path, '^asia/nation_[^/]*/c1[^/]*$')"))
def f03(spark, sf):
    return _dirs(spark, sf).filter(F.col("path").rlike("^asia/nation_[^/]*/c1[^/]*$")).select("path")
