"""Queries over views, diffs, levels, full scans, drill rollups and thinning plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.scalars import OPEN
from heapscope.operators import drill as DR
from heapscope.operators import history as H
from heapscope.operators import ownership as O
from heapscope.operators import search as S
from heapscope.operators import thinning as TH
from heapscope.operators import views as V
from heapscope.operators.rollup import directories, rollup
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, SCANS, VERSIONS, with_
from heapscope.plans.q_history import versions
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.registry import query
from heapscope.sources.scratch import scratch

T = X.cut_seconds()
VERS = (LISTING, SCANS, VERSIONS)
PAR = "array_to_string(string_split({0}, '/')[:-2], '/')"
DEPTH = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '/')) END"


def nodes(file_rows):
    """path, kind, size, n_files, n_children of every file and directory, the root as '': a rollup at rest, as views are read from."""
    r = rollup(file_rows)
    rows = r.select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("path"), "kind", "size", "n_files", "n_children")
    path = scratch(file_rows.sparkSession, "nodes")
    rows.write.parquet(path)
    return file_rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Files f (path, size) to nodes, as the rows of a view.
NODES = f"""up_{{0}} AS (SELECT size, unnest(({ANC})[1:-2]) AS path FROM {{0}}),
 nodes_{{0}} AS (SELECT path, 'dir' AS kind, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM up_{{0}} GROUP BY path UNION ALL SELECT path, 'file', size, 1 FROM {{0}}),
 kids_{{0}} AS (SELECT {PAR.format('path')} AS path, count(*) AS n_children FROM nodes_{{0}} WHERE path <> '' GROUP BY 1)"""
#: A view of the root of nodes_f on a canvas of 400 x 300.
VIEW = f"""thr AS (SELECT size * 12.0 / 120000 AS least FROM nodes_{{0}} WHERE path = ''),
 kept AS (SELECT n.*, {DEPTH.format('path')} AS d, CASE WHEN path <> '' THEN {PAR.format('path')} END AS up, least FROM nodes_{{0}} n, thr WHERE path = '' OR size >= least * pow(2.0, {DEPTH.format('path')} - 1)),
 inside AS (SELECT up, sum(size) AS s, sum(n_files) AS n, count(*) AS c FROM kept WHERE up IS NOT NULL GROUP BY up),
 seen AS (SELECT path, kind, size, n_files, up, CAST(NULL AS BIGINT) AS folded FROM kept
  UNION ALL SELECT CASE WHEN k.path = '' THEN '(other)' ELSE k.path || '/(other)' END, 'dir', CAST(size - s AS BIGINT), CAST(greatest(0, n_files - n) AS BIGINT), k.path, CAST(greatest(0, n_children - c) AS BIGINT)
  FROM kept k JOIN inside i ON i.up = k.path JOIN kids_{{0}} h ON h.path = k.path WHERE size - s > least * pow(2.0, d))"""


@query("x01_view", with_(LISTING, NODES.format("files"), VIEW.format("files"), then="SELECT * FROM seen"))
def x01(spark, sf):
    return V.view(nodes(X.files(spark, sf)), "", 400, 300)


SLICE = "mine AS (SELECT path, size FROM owned WHERE storage_class_id IN (1, 3) AND usr IN ('building', 'team-4', 'default'))"


@query("x01_view_slice", with_(LISTING, LABELS, LAB, OWNED, SLICE, NODES.format("mine"), VIEW.format("mine"), then="SELECT * FROM seen"))
def x01s(spark, sf):
    """Of two classes and three owners together: their own files, rolled up."""
    mine = owned(spark, sf).filter("storage_class_id in (1, 3) and usr in ('building', 'team-4', 'default')")
    return V.view(nodes(mine), "", 400, 300)


SIDE = "s2 AS (SELECT path, size FROM scans WHERE scan = 2 AND starts_with(path, 'asia/')), s4 AS (SELECT path, size FROM scans WHERE scan = 4 AND starts_with(path, 'asia/'))"
DIFF = f"""thr AS (SELECT greatest((SELECT size FROM nodes_s2 WHERE path = 'asia'), (SELECT size FROM nodes_s4 WHERE path = 'asia')) * 12.0 / 120000 AS least),
 j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(b.kind, a.kind) AS kind, a.path IS NULL AS fresh, b.path IS NULL AS gone, coalesce(a.size, 0) AS before, coalesce(b.size, 0) AS after, coalesce(a.n_files, 0) AS n_before, coalesce(b.n_files, 0) AS n_after FROM nodes_s2 a FULL JOIN nodes_s4 b ON a.path = b.path),
 k AS (SELECT j.*, least, len(string_split(path, '/')) - 1 AS d FROM j, thr WHERE path = 'asia' OR path <> '' AND greatest(before, after) >= least * pow(2.0, len(string_split(path, '/')) - 2)),
 c AS (SELECT {PAR.format('path')} AS path, sum(before) AS b, sum(after) AS a, sum(n_before) AS nb, sum(n_after) AS na FROM k WHERE d > 0 GROUP BY 1),
 r AS (SELECT k.path, CAST(before - b AS BIGINT) AS before, CAST(after - a AS BIGINT) AS after, CAST(n_before - nb AS BIGINT) AS n_before, CAST(n_after - na AS BIGINT) AS n_after FROM k JOIN c USING (path) WHERE greatest(before - b, after - a) > least * pow(2.0, d))"""


@query("x02_diff", with_(*VERS, SIDE, NODES.format("s2"), NODES.format("s4"), DIFF, then="""SELECT k.path, kind, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN before = after AND n_before = n_after THEN 'unchanged' ELSE 'changed' END AS status, before, after, n_before, n_after, c.path IS NOT NULL AS expanded FROM k LEFT JOIN c ON c.path = k.path
 UNION ALL SELECT path || '/(other)', 'dir', CASE WHEN before = after AND n_before = n_after THEN 'unchanged' ELSE 'changed' END, before, after, n_before, n_after, false FROM r"""))
def x02(spark, sf):
    s = X.scans(spark, sf).filter("path like 'asia/%'")
    side = lambda k: nodes(s.filter(F.col("scan") == k))
    return V.diff(side(2), side(4), "asia", 400, 300)


@query("x03_descent", with_(*VERS, SIDE, NODES.format("s2"), NODES.format("s4"), DIFF, then="SELECT path, kind, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN before = after AND n_before = n_after THEN 'unchanged' ELSE 'changed' END AS status, before, after, n_before, n_after FROM k WHERE d <= 3"))
def x03(spark, sf):
    s = X.scans(spark, sf).filter("path like 'asia/%'")
    return V.descent(s.filter("scan = 2"), s.filter("scan = 4"), "asia", 3, 400, 300)


#: Of asia's countries over the scans 1 to 4: bytes and files before and after, and bytes moved, by brute force from the scans.
LEVEL = f"""g AS (SELECT DISTINCT path, string_split(path, '/')[2] AS child FROM scans WHERE starts_with(path, 'asia/')),
 sz AS (SELECT g.path, g.child, c.scan, c.t, s.size, lag(s.size) OVER (PARTITION BY g.path ORDER BY c.scan) AS prev FROM g CROSS JOIN cuts c LEFT JOIN scans s ON s.path = g.path AND s.scan = c.scan),
 e AS (SELECT child, CAST(sum(CASE WHEN scan = 1 THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN scan = 4 THEN coalesce(size, 0) ELSE 0 END) AS BIGINT) AS after, count(*) FILTER (scan = 1 AND size IS NOT NULL) AS n_before, count(*) FILTER (scan = 4 AND size IS NOT NULL) AS n_after,
  CAST(coalesce(sum(CASE WHEN prev IS NULL THEN coalesce(size, 0) WHEN size IS NULL THEN prev ELSE abs(size - prev) END) FILTER (scan BETWEEN 2 AND 4), 0) AS BIGINT) AS churn FROM sz GROUP BY child),
 ch AS (SELECT *, row_number() OVER (ORDER BY {{m}} DESC, child) AS rn FROM e WHERE churn <> 0 OR before <> after OR n_before <> n_after)"""
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("before", "after", "n_before", "n_after", "churn"))
_LEVEL = f"""SELECT 'own' AS role, 'asia' AS name, 'dir' AS kind, NULL AS status, CAST(1 AS BIGINT) AS count, {_SUMS} FROM e
 UNION ALL SELECT 'row', child, 'dir', CASE WHEN n_before = 0 AND n_after > 0 THEN 'added' WHEN n_before > 0 AND n_after = 0 THEN 'removed' ELSE 'changed' END, 1, before, after, n_before, n_after, churn FROM ch WHERE rn <= 2
 UNION ALL SELECT 'other', NULL, NULL, NULL, count(*), {_SUMS} FROM ch WHERE rn > 2 HAVING count(*) > 0
 UNION ALL SELECT 'unchanged', NULL, NULL, NULL, NULL, {_SUMS.replace('sum(churn)', 'sum(0)')} FROM (SELECT * FROM e ANTI JOIN ch USING (child))"""


@query("x04_level_diff", with_(*VERS, LEVEL.format(m="churn"), then=_LEVEL))
def x04(spark, sf):
    return V.level(versions(spark, sf), "asia", T[1], T[4], 2, T[0])


@query("x04_level_delta", with_(*VERS, LEVEL.format(m="abs(after - before)"), then=_LEVEL))
def x04d(spark, sf):
    return V.level(versions(spark, sf), "asia", T[1], T[4], 2, T[0], by="delta")


#: Nodes of the versions that a filter picks, at both sides, with the drawing rule and what kept nodes leave.
SCAN = f"""sel AS (SELECT v.path, v.size AS b, v.vf <= {T[2]} AND {T[2]} < v.vt AS la, v.vf <= {T[4]} AND {T[4]} < v.vt AS lb FROM versions v JOIN owned o ON o.path = v.path WHERE {{f}}),
 tot AS (SELECT coalesce(sum(b) FILTER (la), 0) AS before, count(*) FILTER (la) AS n_before, coalesce(sum(b) FILTER (lb), 0) AS after, count(*) FILTER (lb) AS n_after FROM sel),
 nd AS (SELECT array_to_string(string_split(path, '/')[1:k], '/') AS node, k, coalesce(sum(b) FILTER (la), 0) AS before, count(*) FILTER (la) AS n_before, coalesce(sum(b) FILTER (lb), 0) AS after, count(*) FILTER (lb) AS n_after FROM sel, range(1, 5) t(k) WHERE k <= len(string_split(path, '/')) AND (la OR lb) GROUP BY ALL),
 kept AS (SELECT nd.* FROM nd, tot WHERE {{r}}),
 every AS (SELECT '' AS node, 0 AS k, * FROM tot UNION ALL SELECT * FROM kept),
 below AS (SELECT {PAR.format('node')} AS node, sum(before) AS before, sum(n_before) AS n_before, sum(after) AS after, sum(n_after) AS n_after FROM kept GROUP BY 1),
 rest AS (SELECT e.node, e.before - coalesce(x.before, 0) AS before, e.n_before - coalesce(x.n_before, 0) AS n_before, e.after - coalesce(x.after, 0) AS after, e.n_after - coalesce(x.n_after, 0) AS n_after FROM every e LEFT JOIN below x ON x.node = e.node WHERE e.k < 4),
 answer AS (SELECT 'total' AS role, '' AS node, * FROM tot UNION ALL SELECT 'node', node, before, n_before, after, n_after FROM kept UNION ALL SELECT 'rest', * FROM rest WHERE before <> 0 OR n_before <> 0 OR after <> 0 OR n_after <> 0)"""
_ANSWER = "SELECT role, node AS path, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("before", "n_before", "after", "n_after")) + " FROM answer"
_WHOLE = "greatest(tot.before, tot.after)"
_CELL = f"CAST(greatest(nd.before, nd.after) AS HUGEINT) * 512 >= CAST({_WHOLE} AS HUGEINT) * CAST(pow(2, k - 1) AS HUGEINT) AND greatest(nd.before, nd.after) >= 100000 * CAST(pow(2, k - 1) AS HUGEINT)"


@query("x13_full_scan", with_(*VERS, LABELS, LAB, OWNED, SCAN.format(f="contains(v.path, 'urgent') AND o.storage_class_id IN (1, 2) AND o.usr IN ('building', 'team-4', 'default', 'machinery')", r=_CELL), then=_ANSWER))
def x13(spark, sf):
    o = owned(spark, sf).filter("storage_class_id in (1, 2) and usr in ('building', 'team-4', 'default', 'machinery')").select("path")
    v = versions(spark, sf).filter(S.parse("urgent").column(F.col("path"))).join(o, "path")
    return V.full_scan(v, "", T[2], T[4], 4, share_log2=9, atten_log2=1, floor_bytes=100_000)


_PPM = f"CAST(greatest(nd.before, nd.after) AS HUGEINT) * 1000000 >= 400 * CAST({_WHOLE} AS HUGEINT)"


@query("x13_full_scan_ppm", with_(*VERS, LABELS, LAB, OWNED, SCAN.format(f="true", r=_PPM), then=_ANSWER))
def x13p(spark, sf):
    return V.full_scan(versions(spark, sf), "", T[2], T[4], 4, min_ppm=400)


@query("x14_dirs_view", with_(*VERS, LABELS, LAB, OWNED, SCAN.format(f="true", r=_PPM), then=_ANSWER))
def x14(spark, sf):
    """From directories' own rows; the SQL is that of the full scan, which it must equal."""
    s = X.scans(spark, sf)

    def side(k):
        f = s.filter(F.col("scan") == k).select("path", "size", F.lit(1).cast("long").alias("n_files"))
        return directories(f, {"size": (F.col("size"), "sum"), "n_files": (F.col("n_files"), "sum")}).unionByName(f)

    return V.dirs_scan(side(2), side(4), "", 4, min_ppm=400)


#: Versions whose path holds a literal, as roots of two queries; directories with over 40 of them, the 2 greatest children.
HEAVY = f"""rt AS (SELECT q, path, vf, vt, size, 1 AS n_files FROM versions, (SELECT unnest(['urgent', 'c7']) AS q) WHERE contains(path, q)),
 rx AS (SELECT *, unnest(({ANC})[2:-2]) AS dir FROM rt), ry AS (SELECT *, array_to_string(string_split(path, '/')[1:len(string_split(dir, '/')) + 1], '/') AS child FROM rx),
 hv AS (SELECT q, dir, count(*) AS n, count(DISTINCT child) AS children FROM ry GROUP BY ALL HAVING count(*) > 40),
 ev AS (SELECT q, dir, child, t, sum(db) AS db, sum(dn) AS dn FROM (SELECT q, dir, child, vf AS t, size AS db, 1 AS dn FROM ry UNION ALL SELECT q, dir, child, vt, -size, -1 FROM ry WHERE vt <> {OPEN}) GROUP BY ALL)"""


@query("a21_heavy_dirs", with_(*VERS, HEAVY, """run AS (SELECT ev.*, sum(db) OVER (PARTITION BY q, dir, child ORDER BY t) AS b FROM ev SEMI JOIN hv USING (q, dir)),
 pk AS (SELECT q, dir, child, row_number() OVER (PARTITION BY q, dir ORDER BY max(b) DESC, child) AS rn FROM run GROUP BY q, dir, child),
 mv AS (SELECT q, dir, CASE WHEN rn <= 2 THEN 1 ELSE 2 END AS kind, CASE WHEN rn <= 2 THEN child ELSE '' END AS child, t, sum(db) AS db, sum(dn) AS dn FROM run JOIN pk USING (q, dir, child) GROUP BY ALL HAVING sum(db) <> 0 OR sum(dn) <> 0)""",
 then="""SELECT q, dir, CAST(0 AS INTEGER) AS kind, '' AS child, least(children, 2) AS vf, n AS b, children AS o FROM hv
 UNION ALL SELECT q, dir, CAST(kind AS INTEGER), child, t, CAST(sum(db) OVER w AS BIGINT), CAST(sum(dn) OVER w AS BIGINT) FROM mv WINDOW w AS (PARTITION BY q, dir, kind, child ORDER BY t)"""))
def a21(spark, sf):
    return DR.rollups(_roots(spark, sf), 40, 2)


def _roots(spark, sf):
    hit = F.explode(F.filter(F.array(F.lit("urgent"), F.lit("c7")), lambda q: F.col("path").contains(q))).alias("q")
    return versions(spark, sf).select(hit, "path", "vf", "vt", "size", F.lit(1).cast("long").alias("n_files"))


OLD = f"old AS (SELECT q, dir FROM ry WHERE vf <= {T[3]} GROUP BY ALL HAVING count(*) > 40)"


@query("q10_run_deltas", with_(*VERS, HEAVY, OLD, then=f"SELECT ev.q, ev.dir, child, t, CAST(db AS BIGINT) AS db, CAST(dn AS BIGINT) AS dn, old.q IS NULL AS fresh FROM ev JOIN hv ON hv.q = ev.q AND hv.dir = ev.dir LEFT JOIN old ON old.q = ev.q AND old.dir = ev.dir WHERE old.q IS NULL OR t > {T[3]}"))
def q10(spark, sf):
    return DR.run_deltas(_roots(spark, sf), T[3], 40)


#: All pairs' counts of changed paths; then steps of the greedy plan, written out.
_M = " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b, (SELECT count(*) FROM (SELECT path, size FROM scans WHERE scan = {a}) x FULL JOIN (SELECT path, size FROM scans WHERE scan = {b}) y ON x.path = y.path WHERE x.size IS DISTINCT FROM y.size) AS n" for a in range(6) for b in range(a + 1, 6))
_PICK = """nb{i} AS (SELECT * FROM (SELECT scan, lag(scan) OVER (ORDER BY scan) AS a, lead(scan) OVER (ORDER BY scan) AS c FROM cuts WHERE scan NOT IN ({gone})) WHERE a IS NOT NULL AND c IS NOT NULL),
 st{i} AS (SELECT {i} AS step, nb{i}.scan, nb{i}.a AS before, c AS after, l.n AS left_n, r.n AS right_n, g.n AS merged, greatest(l.n, r.n) AS score FROM nb{i} JOIN m l ON l.a = nb{i}.a AND l.b = scan JOIN m r ON r.a = scan AND r.b = c JOIN m g ON g.a = nb{i}.a AND g.b = c ORDER BY score, scan LIMIT 1)"""


def _plan(spark, steps):
    """Steps by times as a table of scans' ordinals."""
    at = {t: i for i, t in enumerate(T)}
    rows = [(i + 1, at[s], at[a], at[c], *n) for i, (s, a, c, *n) in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, scan int, before int, after int, left_n long, right_n long, merged long, score long")


_STEPS = "SELECT CAST(step AS INTEGER) AS step, CAST(scan AS INTEGER) AS scan, CAST(before AS INTEGER) AS before, CAST(after AS INTEGER) AS after, left_n, right_n, merged, score FROM "


@query("v13_thin_plan", with_(LISTING, SCANS, f"m AS ({_M})", _PICK.format(i=1, gone="-1"), _PICK.format(i=2, gone="SELECT scan FROM st1"), _PICK.format(i=3, gone="SELECT scan FROM st1 UNION ALL SELECT scan FROM st2"), then=" UNION ALL ".join(f"{_STEPS} st{i}" for i in (1, 2, 3))))
def v13(spark, sf):
    return _plan(spark, TH.low_change(T, TH.changes_of(versions(spark, sf), ["path"], ["size"]), 3))


_N = "(SELECT n FROM m WHERE a = {0} AND b = {1})"
_MANUAL = "SELECT {0} AS step, {2} AS scan, {1} AS before, {3} AS after, " + _N.format("{1}", "{2}") + " AS left_n, " + _N.format("{2}", "{3}") + " AS right_n, " + _N.format("{1}", "{3}") + " AS merged"


@query("v13_thin_manual", with_(LISTING, SCANS, f"m AS ({_M})", f"p AS ({_MANUAL.format(1, 1, 2, 3)} UNION ALL {_MANUAL.format(2, 1, 3, 4)})", then=_STEPS + "(SELECT *, greatest(left_n, right_n) AS score FROM p)"))
def v13m(spark, sf):
    return _plan(spark, TH.manual(T, TH.changes_of(versions(spark, sf), ["path"], ["size"]), [T[3], T[2]]))


@query("v13_thin_bands", "WITH t AS (SELECT DISTINCT CAST(floor(epoch(o_orderdate) / 86400) * 86400 AS BIGINT) AS t FROM orders), a AS (SELECT t, (SELECT max(t) FROM t) - t AS age FROM t), k AS (SELECT t, age, CASE WHEN age >= 864000 THEN CAST(floor(log2(age / 864000)) AS INTEGER) END AS band FROM a) SELECT max(t) AS t FROM k WHERE band IS NOT NULL GROUP BY band UNION SELECT t FROM k WHERE band IS NULL UNION SELECT min(t) FROM t")
def v13b(spark, sf):
    """Of the days with orders, as if each had a scan: a list of a bounded number of days."""
    from heapscope.functions.scalars import epoch

    days = X.table(spark, sf, "orders").select((epoch(F.col("o_orderdate")) / 86400).cast("long").alias("d")).select((F.col("d") * 86400).alias("t")).distinct()
    kept = TH.geometric([r.t for r in days.collect()], 864_000)
    return spark.createDataFrame([(t,) for t in kept], "t long")
