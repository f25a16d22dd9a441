"""Queries over histories of scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.paths import in_subtree
from heapscope.functions.scalars import OPEN
from heapscope.operators import history as H
from heapscope.operators.rollup import directories
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, LABELS, LISTING, SCANS, VERSIONS, with_
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.registry import query

T = X.cut_seconds()
BASE = (LISTING, SCANS)
VERS = (LISTING, SCANS, VERSIONS)


def versions(spark, sf):
    return H.versions(X.scans(spark, sf), ["path"], ["size"], times=T)


@query("w01_versions", with_(*VERS, then="SELECT path, size, vf, vt FROM versions"))
def w01(spark, sf):
    return versions(spark, sf)


@query("w01_carried", with_(*VERS, "firsts AS (SELECT path, run, min(size) AS size, min(t) AS vf, arg_min(mtime, scan) AS mtime FROM runs GROUP BY path, run)", then="SELECT path, size, vf, mtime FROM firsts"))
def w01c(spark, sf):
    return H.versions(X.scans(spark, sf), ["path"], ["size"], ["mtime"]).select("path", "size", "vf", "mtime")


@query("w02_coalesce", with_(*VERS, then="SELECT path, size, vf, vt FROM versions"))
def w02(spark, sf):
    v = versions(spark, sf)
    mid = T[2]
    cut = v.filter((F.col("vf") < mid) & (F.col("vt") > mid))
    halves = cut.withColumn("vt", F.lit(mid).cast("long")).unionByName(cut.withColumn("vf", F.lit(mid).cast("long")))
    return H.coalesced(v.filter(~((F.col("vf") < mid) & (F.col("vt") > mid))).unionByName(halves), ["path"], ["size"])


READS = f"reads AS (SELECT path, vf, vt, CAST(vf % 7 AS BIGINT) AS last_read FROM (SELECT DISTINCT path, {T[1]} AS vf, {T[3]} AS vt FROM versions) UNION ALL SELECT path, {T[3]}, {OPEN}, 9 FROM (SELECT DISTINCT path FROM versions))"


@query("w03_fold_reads", with_(*VERS, READS, f"""edge AS (SELECT path, unnest([vf, vt]) AS t FROM versions UNION SELECT path, unnest([vf, vt]) FROM reads), piece AS (SELECT path, t AS lo, lead(t) OVER (PARTITION BY path ORDER BY t) AS hi FROM edge),
 ins AS (SELECT p.path, lo, hi, size, last_read FROM piece p JOIN versions v ON p.path = v.path AND v.vf <= lo AND hi <= v.vt LEFT JOIN reads r ON r.path = p.path AND r.vf <= lo AND hi <= r.vt),
 st AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(size) OVER w IS NOT DISTINCT FROM size AND lag(last_read) OVER w IS NOT DISTINCT FROM last_read THEN 0 ELSE 1 END AS n FROM ins WINDOW w AS (PARTITION BY path ORDER BY lo)),
 ru AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY lo) AS run FROM st)""", then="SELECT path, size, last_read, min(lo) AS vf, max(hi) AS vt FROM ru GROUP BY path, size, last_read, run"))
def w03(spark, sf):
    v = versions(spark, sf)
    p = v.select("path").distinct()
    row = lambda a, b, r: p.select("path", F.lit(a).cast("long").alias("vf"), F.lit(b).cast("long").alias("vt"), F.lit(r).cast("long").alias("last_read"))
    return H.folded_reads(v, row(T[1], T[3], T[1] % 7).unionByName(row(T[3], OPEN, 9)))


@query("v02_as_of", with_(*BASE, then="SELECT path, size FROM scans WHERE scan = 3"))
def v02(spark, sf):
    v = versions(spark, sf)
    base, runs = v.filter(F.col("vf") <= T[2]), v
    still_open = base.withColumn("vt", F.when(F.col("vt") > T[2], F.lit(OPEN)).otherwise(F.col("vt")).cast("long"))
    return H.as_of(still_open, runs, ["path", "vf"], T[3]).select("path", "size")


@query("j17_append", with_(*BASE, f"a AS (SELECT path, size FROM scans WHERE scan = 3), b AS (SELECT path, size FROM scans WHERE scan = 4)", then=f"""SELECT a.path, -1 AS op, a.size, CAST({T[3]} AS BIGINT) AS vf, CAST({T[4]} AS BIGINT) AS vt FROM a LEFT JOIN b USING (path) WHERE b.size IS DISTINCT FROM a.size
 UNION ALL SELECT b.path, 1, b.size, {T[4]}, {OPEN} FROM b LEFT JOIN a USING (path) WHERE a.size IS DISTINCT FROM b.size UNION ALL SELECT a.path, 0, a.size, {T[3]}, {OPEN} FROM a JOIN b USING (path) WHERE a.size = b.size"""))
def j17(spark, sf):
    s = X.scans(spark, sf)
    opened = s.filter("scan = 3").select("path", "size", F.col("t").alias("vf"))
    return H.appended(opened, s.filter("scan = 4"), ["path"], ["size"], T[4])


@query("v06_append_equals_rebuild", "SELECT CAST(0 AS BIGINT) AS differs")
def v06(spark, sf):
    s = X.scans(spark, sf)
    first = H.versions(s.filter("scan <= 4"), ["path"], ["size"])
    step = H.appended(first.filter(F.col("vt") == OPEN), s.filter("scan = 5"), ["path"], ["size"], T[5])
    mine = first.filter(F.col("vt") != OPEN).unionByName(step.select("path", "size", "vf", "vt"))
    whole = versions(spark, sf)
    return mine.exceptAll(whole).unionByName(whole.exceptAll(mine)).agg(F.count("*").alias("differs"))


OWNER_SCANS = "oscans AS (SELECT scan, t, o.usr, s.path, s.size FROM scans s JOIN owned o ON o.path = s.path), sl AS (SELECT scan, t, split_part(path, '/', 1) AS path, coalesce(usr, '') AS usr, CAST(sum(size) AS BIGINT) AS size FROM oscans GROUP BY ALL)"


def _slices(spark, sf):
    o = owned(spark, sf).select("path", F.coalesce("usr", F.lit("")).alias("usr"))
    return X.scans(spark, sf).join(o, "path").groupBy("scan", "t", F.substring_index("path", "/", 1).alias("path"), "usr").agg(F.sum("size").alias("size"))


@query("a16_owner_maps", with_(LISTING, LABELS, LAB, OWNED, SCANS, OWNER_SCANS, then="SELECT scan, path, CAST(sum(size) AS BIGINT) AS size, string_agg(usr || '=' || size, ',' ORDER BY usr) AS us FROM sl GROUP BY scan, path"))
def a16(spark, sf):
    s = _slices(spark, sf).groupBy("scan", "path").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("usr", "size"))).alias("us"))
    return s.select("scan", "path", "size", F.array_join(F.transform("us", lambda x: F.concat(x["usr"], F.lit("="), x["size"].cast("string"))), ",").alias("us"))


@query("v04_slice_totals", with_(LISTING, LABELS, LAB, OWNED, SCANS, OWNER_SCANS, f"""tot AS (SELECT scan, path, CAST(sum(size) AS BIGINT) AS tot FROM sl GROUP BY ALL), j AS (SELECT sl.*, tot FROM sl JOIN tot USING (scan, path)),
 st AS (SELECT *, CASE WHEN lag(size) OVER w = size AND lag(tot) OVER w = tot AND lag(scan) OVER w = scan - 1 THEN 0 ELSE 1 END AS n FROM j WINDOW w AS (PARTITION BY path, usr ORDER BY scan)),
 ru AS (SELECT *, sum(n) OVER (PARTITION BY path, usr ORDER BY scan) AS run FROM st), r2 AS (SELECT path, usr, min(size) AS size, min(tot) AS tot, min(t) AS vf, max(scan) + 1 AS a FROM ru GROUP BY path, usr, run)""", then=f"SELECT path, usr, size, tot, vf, CAST(coalesce(c.t, {OPEN}) AS BIGINT) AS vt FROM r2 LEFT JOIN cuts c ON c.scan = a"))
def v04(spark, sf):
    sl = _slices(spark, sf)
    slices = H.versions(sl, ["path", "usr"], ["size"])
    totals = H.versions(sl.groupBy("scan", "t", "path").agg(F.sum("size").alias("size")), ["path"], ["size"])
    return H.slice_totals(slices, totals)


@query("v10_changed", with_(*VERS, then=f"SELECT path, size, vf, vt FROM versions WHERE (vf > {T[1]} AND vf <= {T[3]}) OR (vt > {T[1]} AND vt <= {T[3]})"))
def v10(spark, sf):
    return H.changed(versions(spark, sf), T[1], T[3])


KEEP = [0, 2, 5]
_THIN = f"cuts2 AS (SELECT row_number() OVER (ORDER BY scan) - 1 AS ord, scan, t FROM cuts WHERE scan IN (0, 2, 5)), s2 AS (SELECT s.path, s.size, c.ord, s.t FROM scans s JOIN cuts2 c ON c.scan = s.scan), st2 AS (SELECT *, CASE WHEN lag(size) OVER w = size AND lag(ord) OVER w = ord - 1 THEN 0 ELSE 1 END AS n FROM s2 WINDOW w AS (PARTITION BY path ORDER BY ord)), ru2 AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY ord) AS run FROM st2), r3 AS (SELECT path, min(size) AS size, min(t) AS vf, max(ord) + 1 AS a FROM ru2 GROUP BY path, run)"


@query("v12_thin", with_(*BASE, _THIN, then=f"SELECT path, size, vf, CAST(coalesce(c.t, {OPEN}) AS BIGINT) AS vt FROM r3 LEFT JOIN cuts2 c ON c.ord = a"))
def v12(spark, sf):
    return H.retained(versions(spark, sf), ["path"], ["size"], [T[k] for k in KEEP])


OT = f"""ob AS (SELECT scan, t, p AS path, CAST(sum(size) AS BIGINT) AS b, count(*) AS o FROM (SELECT scan, t, size, unnest(({ANC})[1:-2]) AS p FROM scans) GROUP BY ALL),
 os AS (SELECT *, CASE WHEN lag(b) OVER w = b AND lag(o) OVER w = o AND lag(scan) OVER w = scan - 1 THEN 0 ELSE 1 END AS n FROM ob WINDOW w AS (PARTITION BY path ORDER BY scan)), orr AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY scan) AS run FROM os),
 ov AS (SELECT path, min(b) AS b, min(o) AS o, min(t) AS vf, max(scan) + 1 AS a FROM orr GROUP BY path, run), over_time AS (SELECT path, b, o, vf, CAST(coalesce(c.t, {OPEN}) AS BIGINT) AS vt FROM ov LEFT JOIN cuts c ON c.scan = a)"""


@query("v14_over_time", with_(*BASE, OT, then="SELECT path, b, o, vf, vt FROM over_time"))
def v14(spark, sf):
    return H.over_time(X.scans(spark, sf))


@query("x05_series", with_(*BASE, then="SELECT t, CAST(sum(size) AS BIGINT) AS b, count(*) AS o FROM scans WHERE starts_with(path, 'asia/') GROUP BY t"))
def x05(spark, sf):
    times = spark.createDataFrame([(t,) for t in T], "t long")
    return H.series(H.over_time(X.scans(spark, sf)).filter("path = 'asia'"), times, ["b", "o"], ["path"]).select("t", "b", "o")


@query("x06_step_union", with_(*BASE, OT, "pts AS (SELECT path AS series, vf AS t, b AS v FROM over_time WHERE path IN ('asia', 'europe', 'africa') OR path LIKE 'america/%'), ts AS (SELECT DISTINCT t FROM pts)", then="SELECT ts.t, s.series, (SELECT arg_max(p.v, p.t) FROM pts p WHERE p.series = s.series AND p.t <= ts.t) AS v FROM ts, (SELECT DISTINCT series FROM pts) s"))
def x06(spark, sf):
    from heapscope.operators.views import step_union

    o = H.over_time(X.scans(spark, sf)).filter("path in ('asia', 'europe', 'africa') or path like 'america/%'")
    return step_union(o.select(F.col("path").alias("series"), F.col("vf").alias("t"), F.col("b").alias("v")))


@query("v16_delta", with_(*BASE, "a AS (SELECT path, size FROM scans WHERE scan = 2), b AS (SELECT path, size FROM scans WHERE scan = 3)", then="SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'a' WHEN b.path IS NULL THEN 'd' ELSE 'c' END AS op, b.size AS size FROM a FULL JOIN b ON a.path = b.path WHERE a.size IS DISTINCT FROM b.size"))
def v16(spark, sf):
    s = X.scans(spark, sf)
    return H.delta(s.filter("scan = 2"), s.filter("scan = 3"), ["path"], ["size"])


@query("v17_parity", with_(*BASE, then="SELECT path, size, 'versions' AS side FROM scans WHERE false"))
def v17(spark, sf):
    s = X.scans(spark, sf)
    return H.parity(versions(spark, sf), s.filter("scan = 3"), T[3], ["path", "size"])


@query("j07_scan_compare", with_(*BASE, "a AS (SELECT path, size, mtime FROM scans WHERE scan = 2), b AS (SELECT path, size, mtime FROM scans WHERE scan = 3)", then="SELECT count(*) FILTER (WHERE a.path IS NULL) AS added, count(*) FILTER (WHERE b.path IS NULL) AS removed, count(*) FILTER (WHERE a.size = b.size AND a.mtime = b.mtime) AS same, count(*) FILTER (WHERE a.path IS NOT NULL AND b.path IS NOT NULL AND (a.size <> b.size OR a.mtime <> b.mtime)) AS changed, count(*) FILTER (WHERE a.size <> b.size) AS changed_size, count(*) FILTER (WHERE a.mtime <> b.mtime) AS changed_mtime FROM a FULL JOIN b ON a.path = b.path"))
def j07(spark, sf):
    s = X.scans(spark, sf)
    return H.compare(s.filter("scan = 2"), s.filter("scan = 3"), ["path"], ["size", "mtime"])


@query("a28_open_close", with_(*VERS, then=f"SELECT coalesce(a.t, b.t) AS t, coalesce(o, 0) AS opened, coalesce(c, 0) AS closed FROM (SELECT vf AS t, count(*) AS o FROM versions GROUP BY vf) a FULL JOIN (SELECT vt AS t, count(*) AS c FROM versions WHERE vt <> {OPEN} GROUP BY vt) b ON a.t = b.t"))
def a28(spark, sf):
    return H.scan_counts(versions(spark, sf))


@query("a17_version_digest", with_(*BASE, then="SELECT t, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM scans GROUP BY t"))
def a17(spark, sf):
    return H.running_totals(versions(spark, sf), [])


@query("a18_running_cells", with_(*VERS, f"e AS (SELECT split_part(path, '/', 1) AS bucket, vf AS t, size AS b, 1 AS o FROM versions UNION ALL SELECT split_part(path, '/', 1), vt, -size, -1 FROM versions WHERE vt <> {OPEN}), g AS (SELECT bucket, t, sum(b) AS b, sum(o) AS o FROM e GROUP BY ALL)", then="SELECT bucket, t, CAST(sum(b) OVER w AS BIGINT) AS bytes, CAST(sum(o) OVER w AS BIGINT) AS objects FROM g WINDOW w AS (PARTITION BY bucket ORDER BY t)"))
def a18(spark, sf):
    return H.running_totals(versions(spark, sf).withColumn("bucket", F.substring_index("path", "/", 1)), ["bucket"])


CHURN = f"""grid AS (SELECT p.path, c.scan, c.t FROM (SELECT DISTINCT path FROM scans) p, cuts c), filled AS (SELECT g.path, g.scan, g.t, coalesce(s.size, 0) AS size, lag(coalesce(s.size, 0)) OVER (PARTITION BY g.path ORDER BY g.scan) AS prev FROM grid g LEFT JOIN scans s ON s.path = g.path AND s.scan = g.scan),
 fchurn AS (SELECT path, t, abs(size - prev) AS churn FROM filled WHERE prev IS NOT NULL AND size <> prev)"""


@query("w05_churn_events", with_(*BASE, CHURN, then="SELECT path, t, churn FROM fchurn"))
def w05(spark, sf):
    return H.file_churn(versions(spark, sf), T[0])


@query("w06_churn_cum", with_(*BASE, CHURN, f"cd AS (SELECT p AS path, t, CAST(sum(churn) AS BIGINT) AS churn FROM (SELECT t, churn, unnest(({ANC})[1:-2]) AS p FROM fchurn) GROUP BY ALL)", then="SELECT path, t, churn, CAST(sum(churn) OVER (PARTITION BY path ORDER BY t) AS BIGINT) AS cumulated FROM cd"))
def w06(spark, sf):
    return H.churn(versions(spark, sf), T[0])


LEVEL = f"""grid AS (SELECT p.path, c.scan, c.t FROM (SELECT DISTINCT path FROM scans) p, cuts c), filled AS (SELECT g.path, g.scan, g.t, s.size, lag(s.size) OVER (PARTITION BY g.path ORDER BY g.scan) AS prev FROM grid g LEFT JOIN scans s ON s.path = g.path AND s.scan = g.scan),
 level AS (SELECT array_to_string(string_split(path, '/')[:-2], '/') AS up, t, string_split(path, '/')[-1] AS name, CAST(CASE WHEN prev IS NULL THEN 1 WHEN size IS NULL THEN 2 ELSE 0 END AS INTEGER) AS op, size, prev AS size_prev FROM filled WHERE size IS DISTINCT FROM prev)"""


@query("w07_level", with_(*BASE, LEVEL, then="SELECT * FROM level"))
def w07(spark, sf):
    return H.level_transitions(versions(spark, sf))


@query("a26_churn", with_(*BASE, LEVEL, then="SELECT t, op, count(*) AS n FROM level GROUP BY ALL"))
def a26(spark, sf):
    return H.level_transitions(versions(spark, sf)).groupBy("t", "op").agg(F.count("*").alias("n"))


@query("a27_group_churn", with_(*BASE, LEVEL, then="SELECT split_part(up, '/', 1) AS bucket, t, count(*) AS n, CAST(sum(coalesce(size, 0) - coalesce(size_prev, 0)) AS BIGINT) AS delta FROM level GROUP BY ALL"))
def a27(spark, sf):
    x = H.level_transitions(versions(spark, sf))
    return x.groupBy(F.substring_index("up", "/", 1).alias("bucket"), "t").agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0)) - F.coalesce("size_prev", F.lit(0))).alias("delta"))


@query("v05_attribution_versions", with_(LISTING, LABELS, LAB, OWNED, SCANS, "sx AS (SELECT o.path, o.usr, s.scan, s.t FROM scans s JOIN owned o ON o.path = s.path WHERE s.scan >= 2), st9 AS (SELECT *, CASE WHEN lag(scan) OVER (PARTITION BY path ORDER BY scan) = scan - 1 THEN 0 ELSE 1 END AS n FROM sx), ru9 AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY scan) AS run FROM st9)", then=f"SELECT path, any_value(usr) AS usr, min(ru9.t) AS vf, CAST(coalesce(max(c.t), {OPEN}) AS BIGINT) AS vt FROM (SELECT path, usr, t, run, max(scan) OVER (PARTITION BY path, run) + 1 AS a FROM ru9) ru9 LEFT JOIN cuts c ON c.scan = a GROUP BY path, run"))
def v05(spark, sf):
    o = owned(spark, sf).select("path", "usr")
    return H.versions(X.scans(spark, sf).filter("scan >= 2").join(o, "path").select("path", "usr", "scan", "t"), ["path"], ["usr"])
