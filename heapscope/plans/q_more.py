"""Queries over as-of joins, name matches, checks and cell rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions import cells as C
from heapscope.functions.paths import ancestors, parent
from heapscope.operators import joins as J
from heapscope.operators import ownership as O
from heapscope.operators.layout import rectangles
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, REQUESTS, SCANS, VERSIONS, with_
from heapscope.plans.q_history import versions
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.q_search import _dirs
from heapscope.plans.registry import query

T = X.cut_seconds()
VERS = (LISTING, SCANS, VERSIONS)


@query("j10_as_of_backward", with_(LISTING, REQUESTS, "r AS (SELECT path, ts_s, max(bytes_out) AS v FROM requests WHERE op = 'PUT' GROUP BY ALL)", then="SELECT g.event_id, r.v FROM requests g ASOF LEFT JOIN r ON g.path = r.path AND g.ts_s >= r.ts_s WHERE g.op = 'GET'"))
def j10(spark, sf):
    r = X.requests(spark, sf)
    put = r.filter("op = 'PUT'").groupBy("path", "ts_s").agg(F.max("bytes_out").alias("v"))
    return J.as_of_backward(r.filter("op = 'GET'").select("event_id", "path", "ts_s"), put, ["path"], "ts_s", "v").select("event_id", "v")


@query("j11_as_of_forward", with_(*VERS, then=f"SELECT path, vf, (SELECT CAST(min(s) AS BIGINT) FROM (SELECT unnest([{T[1]}, {T[3]}]) AS s) WHERE s >= vf) AS stamp FROM versions"))
def j11(spark, sf):
    return J.as_of_forward(versions(spark, sf).select("path", "vf"), [T[1], T[3]], "vf")


@query("j24_counts_below", with_(LISTING, then=f"SELECT storage_class_id, p AS dir, count(*) AS n FROM (SELECT storage_class_id, unnest({ANC}) AS p FROM files) GROUP BY ALL"))
def j24(spark, sf):
    return J.counts_below(X.files(spark, sf).select("path", "storage_class_id"), ["storage_class_id"])


@query("j25_changed_items", with_(LISTING, SCANS, "a AS (SELECT path, size FROM scans WHERE scan = 1), b AS (SELECT path, size FROM scans WHERE scan = 4)", then="SELECT count(*) AS n FROM a FULL JOIN b ON a.path = b.path WHERE a.size IS DISTINCT FROM b.size"))
def j25(spark, sf):
    from heapscope.operators.history import delta

    s = X.scans(spark, sf)
    return delta(s.filter("scan = 1"), s.filter("scan = 4"), ["path"], ["size"]).agg(F.count("*").alias("n"))


@query("j26_transitions", with_(*VERS, then=f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'opens' WHEN b.path IS NULL THEN 'closes' ELSE 'continues' END AS state FROM (SELECT DISTINCT path FROM versions WHERE vt = {T[3]}) a FULL JOIN (SELECT DISTINCT path FROM versions WHERE vf = {T[3]}) b ON a.path = b.path"))
def j26(spark, sf):
    v = versions(spark, sf)
    return J.transitions(v.filter(F.col("vt") == T[3]), v.filter(F.col("vf") == T[3]), ["path"])


#: Directories that match by whole name, without a hash, by stem, by a common beginning, and not at all; the users by hand.
@query("j18_run_names", """WITH k AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '-experiment-run' AS run FROM customer)
 SELECT CASE k % 7 WHEN 0 THEN run WHEN 1 THEN run || '-abcdef12' WHEN 2 THEN run || '_resume3-b' WHEN 3 THEN run || '-final' WHEN 4 THEN run || '-abcdef12345' ELSE upper(run) END AS name,
  CASE WHEN k % 7 = 3 AND k % 2 = 0 THEN 'longer' ELSE 'u' || (k % 5) END AS usr FROM k WHERE k % 7 < 5 AND (k % 10 <> 0 OR k % 7 = 3)
 UNION ALL SELECT 'short-' || k, 'u' || (k % 5) FROM k WHERE k % 7 = 6 AND k < 100""")
def j18(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("-experiment-run")).alias("run"))
    k = F.col("k") % 7
    ends = {0: "", 1: "-abcdef12", 2: "_resume3-b", 3: "-final", 4: "-abcdef12345"}
    name = F.upper("run")
    for i, end in ends.items():
        name = F.when(k == i, F.concat("run", F.lit(end))).otherwise(name)
    # A name of under 16 characters matches as a whole only.
    short = c.filter((k >= 5) & (F.col("k") < 100)).select(F.concat(F.lit("short-"), F.when(k == 6, F.col("k").cast("string")).otherwise(F.concat("k", F.lit("-more")))).alias("name"))
    usr = F.concat(F.lit("u"), F.col("k") % 5)
    runs = c.select("run", usr.alias("usr")).unionByName(c.filter("k < 100").select(F.concat(F.lit("short-"), "k").alias("run"), usr.alias("usr")))
    runs = runs.unionByName(c.filter("k % 10 = 0").select("run", F.lit("second").alias("usr"))).unionByName(c.filter("k % 2 = 0").select(F.concat("run", F.lit("-fin-0badc0de")).alias("run"), F.lit("longer").alias("usr")))
    return J.run_names(c.select(name.alias("name")).unionByName(short), runs)


@query("x12_attribution_as_of", with_(LISTING, LABELS, LAB, then="SELECT path, usr FROM deep WHERE usr IS NOT NULL"))
def x12(spark, sf):
    lab = X.labels(spark, sf).select(F.col("prefix").alias("path"), "usr", F.lit(T[1]).alias("vf"), F.lit(T[4]).alias("vt"))
    old = lab.select("path", F.lit("gone").alias("usr"), F.lit(0).alias("vf"), F.lit(T[1]).alias("vt"))
    paths = X.files(spark, sf).select(parent(F.col("path")).alias("path")).distinct()
    return J.attributed_as_of(paths, lab.unionByName(old), T[2])


@query("v11_back_fill", with_(*VERS, then=f"SELECT path, vf, CASE WHEN vf <= {T[2]} AND vt > {T[2]} THEN md5(path) END AS identity FROM versions"))
def v11(spark, sf):
    seen = X.scans(spark, sf).filter("scan = 2").select("path", "t", F.md5(F.col("path").cast("binary")).alias("identity"))
    return J.back_filled(versions(spark, sf), seen).select("path", "vf", "identity")


@query("e07_settled", with_(LISTING, then="SELECT bucket, name FROM listing WHERE key % 4 <> 0"))
def e07(spark, sf):
    x = X.listing(spark, sf).select("bucket", "name", "key")
    return J.settled(x, x.filter("key % 4 = 0"), ["bucket", "name"]).select("bucket", "name")


@query("e09_keyed_diff", with_(LISTING, LABELS, then="SELECT prefix, CASE WHEN length(prefix) % 3 = 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN length(prefix) % 3 <> 0 THEN usr || '!' END AS usr FROM labels_ WHERE length(prefix) % 3 <> 1"))
def e09(spark, sf):
    lab = X.labels(spark, sf)
    new = lab.filter("length(prefix) % 3 != 0").withColumn("usr", F.when(F.length("prefix") % 3 == 2, F.concat("usr", F.lit("!"))).otherwise(F.col("usr")))
    return J.keyed_diff(lab, new, "prefix", "usr")


@query("e14_newest_layout", "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS scan_id, max(o_orderkey) AS gen FROM orders GROUP BY 1")
def e14(spark, sf):
    return J.newest_layout(X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("scan_id"), F.col("o_orderkey").alias("gen")))


@query("a38_eligibility", with_(LISTING, LABELS, LAB, OWNED, f"ev AS (SELECT unnest(({ANC})[1:-2]) AS dir, coalesce(usr, '-') AS usr, storage_class_id, mtime - mtime % 31536000 AS t, size FROM owned), g AS (SELECT dir, usr, storage_class_id, t, sum(size) AS db, count(*) AS n FROM ev GROUP BY ALL)", then="SELECT dir, usr, storage_class_id, t, CAST(sum(db) OVER w AS BIGINT) AS bytes, CAST(sum(n) OVER w AS BIGINT) AS objects FROM g WINDOW w AS (PARTITION BY dir, usr, storage_class_id ORDER BY t)"))
def a38(spark, sf):
    e = owned(spark, sf).select("path", F.coalesce("usr", F.lit("-")).alias("usr"), "storage_class_id", (F.col("mtime") - F.col("mtime") % 31536000).alias("t"), F.col("size").alias("db"), F.lit(1).cast("long").alias("do"))
    return J.eligibility(e, ["usr", "storage_class_id"])


@query("o11_page", with_(LISTING, "r AS (SELECT path, size, row_number() OVER (ORDER BY size DESC, path) AS rn FROM files)", then="SELECT path, size FROM r WHERE rn BETWEEN 101 AND 150"))
def o11(spark, sf):
    f = X.files(spark, sf).select("path", "size")
    last = J.page(f, 100).orderBy("size", F.desc("path")).first()
    return J.page(f, 50, (last["size"], last["path"]))


@query("u05_federated", with_(LISTING, then="SELECT path, size FROM files"))
def u05(spark, sf):
    f = X.files(spark, sf).select("path", "size")
    roots = ["africa", "america", "asia", "europe", "middle-east"]
    return J.federated([f.filter(F.substring_index("path", "/", 1) == r) for r in roots], roots)


@query("e04_index_check", with_(LISTING, then="SELECT bucket, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) AS objects, true AS ok FROM listing GROUP BY bucket"))
def e04(spark, sf):
    a = X.listing(spark, sf).groupBy("bucket").agg(F.sum("size_bytes").alias("bytes"), F.count("*").alias("objects"))
    b = _dirs(spark, sf).filter("path != '' and path not like '%/%'").select(F.col("path").alias("bucket"), F.col("size").alias("b"), F.col("n_files").alias("o"))
    return a.join(b, "bucket", "full_outer").select("bucket", "bytes", "objects", ((F.col("bytes") == F.col("b")) & (F.col("objects") == F.col("o"))).alias("ok"))


@query("p06_band_threshold", with_(LISTING, DIRS, then="SELECT path FROM dirs WHERE path <> '' AND size >= 3000000 * pow(2.0, greatest(len(string_split(path, '/')) - 1, 0))"))
def p06(spark, sf):
    return _dirs(spark, sf).filter("path != ''").filter(C.over_band(F.col("size"), F.col("path"), "", 3_000_000, 2.0)).select("path")


@query("p07_cell_rule", with_(LISTING, DIRS, then="SELECT path FROM dirs WHERE CAST(size AS HUGEINT) * 1024 >= CAST(1000000 AS HUGEINT) * pow(2, 2 * (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END))::HUGEINT"))
def p07(spark, sf):
    return _dirs(spark, sf).filter(C.over_cell(F.col("size"), F.col("path"), 1_000_000, scale_bits=10, step=2)).select("path")


@query("x11_scaled", with_(LISTING, DIRS, then="SELECT path, CAST(CAST(size AS HUGEINT) * 3 // 7 AS BIGINT) AS size FROM dirs"))
def x11(spark, sf):
    return _dirs(spark, sf).select("path", C.scaled(F.col("size"), F.lit(3), F.lit(7)).alias("size"))


@query("f17_rectangles")
def f17(spark, sf):
    d = _dirs(spark, sf).filter("path != ''").select(parent(F.col("path")).alias("up"), "path", "size").filter("up = '' or up = 'asia'")
    r = rectangles(d)
    return r.select("up", "path", *[F.round(c, 3).alias(c) for c in ("x", "y", "w", "h")])


@query("x15_plan_coverage", with_(LISTING, LABELS, "it AS (SELECT prefix FROM labels_ WHERE prefix LIKE '%/c%')", then="SELECT prefix, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM it JOIN files ON starts_with(path, prefix || '/') GROUP BY prefix"))
def x15(spark, sf):
    it = X.labels(spark, sf).filter("prefix like '%/c%'").select("prefix")
    covered = O.under_any(X.files(spark, sf).select("path", "size"), it)
    up = covered.select("size", F.explode(ancestors(F.col("path"), own=False)).alias("prefix")).join(it, "prefix", "left_semi")
    return up.groupBy("prefix").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


@query("v07_merge_runs", with_(*VERS, then="SELECT path, size, vf, vt FROM versions"))
def v07(spark, sf):
    from heapscope.functions.scalars import OPEN
    from heapscope.operators.history import best, coalesced

    v = versions(spark, sf)
    base = v.filter(F.col("vf") <= T[2]).withColumn("vt", F.when(F.col("vt") > T[2], F.lit(OPEN)).otherwise(F.col("vt")).cast("long"))
    runs = v.filter((F.col("vf") > T[2]) | (F.col("vt") > T[2]))
    return coalesced(best(base.unionByName(runs), ["path", "vf"]), ["path"], ["size"]).select("path", "size", "vf", "vt")


@query("v15_age_history", with_(LISTING, SCANS, "c AS (SELECT scan, t, split_part(path, '/', 1) || '#' || (mtime - mtime % 31536000) AS cell, CAST(sum(size) AS BIGINT) AS b, count(*) AS o FROM scans GROUP BY ALL), st AS (SELECT *, CASE WHEN lag(b) OVER w = b AND lag(o) OVER w = o AND lag(scan) OVER w = scan - 1 THEN 0 ELSE 1 END AS n FROM c WINDOW w AS (PARTITION BY cell ORDER BY scan)), ru AS (SELECT *, sum(n) OVER (PARTITION BY cell ORDER BY scan) AS run FROM st)", then="SELECT cell, min(b) AS b, min(o) AS o, min(t) AS vf FROM ru GROUP BY cell, run"))
def v15(spark, sf):
    from heapscope.operators.history import versions as of

    s = X.scans(spark, sf).withColumn("cell", F.concat(F.substring_index("path", "/", 1), F.lit("#"), F.col("mtime") - F.col("mtime") % 31536000))
    return of(s.groupBy("scan", "t", "cell").agg(F.sum("size").alias("b"), F.count("*").alias("o")), ["cell"], ["b", "o"]).select("cell", "b", "o", "vf")
