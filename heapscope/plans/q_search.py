"""Queries over search, views, ownership and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.paths import in_subtree
from heapscope.operators import dups as D
from heapscope.operators import ownership as O
from heapscope.operators import search as S
from heapscope.operators import views as V
from heapscope.operators.rollup import directories
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, SCANS, VERSIONS, with_
from heapscope.plans.q_history import versions
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.registry import query

SIZES = {"size": (F.col, "sum")}
PAR = "array_to_string(string_split({0}, '/')[:-2], '/')"


def _dirs(spark, sf):
    return directories(X.files(spark, sf), {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")})


def _rows(spark, sf):
    """Directories and files, without the root."""
    return _dirs(spark, sf).filter("path != ''").unionByName(X.files(spark, sf).select("path", "size", F.lit(1).cast("long").alias("n_files")))


ROWS = "rows_ AS (SELECT path, size, n_files FROM dirs WHERE path <> '' UNION ALL SELECT path, size, 1 FROM files)"
ROOTS = "hit AS (SELECT * FROM rows_ WHERE {p}), roots AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit a WHERE starts_with(h.path, a.path || '/')))"
#: The same without a join of all pairs: no ancestor is a hit.
ROOTS = f"hit AS (SELECT * FROM rows_ WHERE {{p}}), roots AS (SELECT * FROM hit h WHERE path NOT IN (SELECT u.path FROM (SELECT path, unnest(({ANC})[2:-2]) AS up FROM hit) u JOIN hit a ON a.path = u.up))"
BASE = (LISTING, DIRS, ROWS)


@query("p09_terms", with_(*BASE, then="SELECT path FROM rows_ WHERE ((contains(lower(path), 'urgent') AND contains(lower(path), 'c12')) OR contains(lower(path), 'nation_7')) AND NOT regexp_matches(lower(path), '[.]csv(/|$)')"))
def p09(spark, sf):
    return _rows(spark, sf).filter(S.parse("urgent c12|nation_7 -.csv$").column(F.col("path"))).select("path")


@query("p09_glob", with_(*BASE, then="SELECT path FROM rows_ WHERE regexp_matches(lower(path), '(^|/)o1[^/]*log(/|$)')"))
def p09g(spark, sf):
    return _rows(spark, sf).filter(S.parse("^o1*log$").column(F.col("path"))).select("path")


@query("p09_regex", with_(*BASE, then="SELECT path FROM rows_ WHERE regexp_matches(path, 'o[0-9]+5[.](csv|log)$', 'i')"))
def p09r(spark, sf):
    return _rows(spark, sf).filter(S.parse("/o[0-9]+5[.](csv|log)$/").column(F.col("path"))).select("path")


@query("p11_segments", with_(*BASE, then="SELECT path FROM rows_ WHERE len(list_filter(string_split(lower(path), '/'), lambda s: contains(s, 'c77'))) > 0"))
def p11(spark, sf):
    return S.segment_search(_rows(spark, sf), "c77").select("path")


@query("q01_match_roots", with_(*BASE, ROOTS.format(p="contains(lower(path), 'c7') OR contains(lower(path), 'high')"), then="SELECT path, size FROM roots"))
def q01(spark, sf):
    return S.match_roots(_rows(spark, sf), S.Query(((S.Term(("c7",)),), (S.Term(("high",)),)))).select("path", "size")


EXCL = f"bad AS (SELECT * FROM rows_ WHERE contains(lower(path), '.csv')), minus AS (SELECT r.path, CAST(sum(b.size) AS BIGINT) AS ms, CAST(sum(b.n_files) AS BIGINT) AS mn FROM (SELECT size, n_files, unnest({ANC}) AS up FROM bad) b JOIN roots r ON r.path = b.up GROUP BY r.path)"


@query("q02_excluded", with_(*BASE, ROOTS.format(p="contains(lower(path), 'urgent')"), EXCL, then="SELECT path, size - coalesce(ms, 0) AS size, n_files - coalesce(mn, 0) AS n_files FROM roots LEFT JOIN minus USING (path) WHERE size > coalesce(ms, 0) OR n_files > coalesce(mn, 0)"))
def q02(spark, sf):
    return S.net_totals(_rows(spark, sf), S.parse("urgent -.csv"))


@query("q03_first_true", with_(*BASE, then=f"SELECT path FROM rows_ WHERE contains(lower(path), 'c3') AND NOT contains(lower({PAR.format('path')}), 'c3')"))
def q03(spark, sf):
    return S.first_true(_rows(spark, sf), S.parse("c3")).select("path")


@query("q04_by_names", with_(*BASE, then="SELECT path FROM rows_ WHERE contains(lower(string_split(path, '/')[-1]), 'low')"))
def q04(spark, sf):
    return S.by_names(_rows(spark, sf), "low").select("path")


CAT = f"m AS (SELECT q, split_part(path, '/', 1) AS bucket, size, vf, vt FROM versions, (SELECT unnest(['urgent', 'c7', '.csv']) AS q) WHERE contains(path, q)), e AS (SELECT q, bucket, vf AS t, size AS b, 1 AS o FROM m UNION ALL SELECT q, bucket, vt, -size, -1 FROM m WHERE vt <> 4291747200), g AS (SELECT q, bucket, t, sum(b) AS b, sum(o) AS o FROM e GROUP BY ALL), cells AS (SELECT q, bucket, t, CAST(sum(b) OVER w AS BIGINT) AS bytes, CAST(sum(o) OVER w AS BIGINT) AS objects FROM g WINDOW w AS (PARTITION BY q, bucket ORDER BY t))"


@query("q07_catalog", with_(LISTING, SCANS, VERSIONS, CAT, then="SELECT q, bucket, t, bytes, objects FROM cells"))
def q07(spark, sf):
    return S.catalog(versions(spark, sf), ["urgent", "c7", ".csv"])


@query("q13_name_summary", with_(LISTING, SCANS, then="SELECT q, t, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM scans, (SELECT unnest(['urgent', 'c7', '.csv']) AS q) WHERE contains(path, q) GROUP BY ALL"))
def q13(spark, sf):
    times = spark.createDataFrame([(t,) for t in X.cut_seconds()], "t long")
    return S.name_summary(S.catalog(versions(spark, sf), ["urgent", "c7", ".csv"]), times)


@query("q08_drill", with_(*BASE, ROOTS.format(p="contains(lower(path), 'c7')"), f"u AS (SELECT path, size, unnest(({ANC})[1:-2]) AS dir FROM roots), k AS (SELECT dir, array_to_string(string_split(path, '/')[1:(CASE WHEN dir = '' THEN 1 ELSE len(string_split(dir, '/')) + 1 END)], '/') AS child, sum(size) AS size FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY size DESC, child) AS rn FROM k)", then="SELECT dir, CASE WHEN rn <= 3 THEN child ELSE '(other)' END AS child, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY ALL"))
def q08(spark, sf):
    return S.drill(S.match_roots(_rows(spark, sf), S.parse("c7")), 3)


@query("a20_root_dirs", with_(*BASE, ROOTS.format(p="contains(lower(path), 'c7')"), then=f"SELECT dir, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, max(size) AS max_child FROM (SELECT size, unnest(({ANC})[1:-2]) AS dir FROM roots) GROUP BY dir"))
def a20(spark, sf):
    from heapscope.functions.paths import ancestors

    r = S.match_roots(_rows(spark, sf), S.parse("c7"))
    return r.select("size", F.explode(ancestors(F.col("path"), own=False)).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("max_child"))


@query("q09_anchored", with_(*BASE, ROOTS.format(p="regexp_matches(lower(path), '(^|/)c77(/|$)')"), then="SELECT path, size FROM roots"))
def q09(spark, sf):
    return S.match_roots(_rows(spark, sf), S.parse("^c77$")).select("path", "size")


@query("q11_compound", with_(*BASE, ROOTS.format(p="(contains(lower(path), 'nation_1') AND contains(lower(path), 'low')) OR contains(lower(path), 'c999')"), then="SELECT path, size FROM roots"))
def q11(spark, sf):
    return S.match_roots(_rows(spark, sf), S.parse("nation_1 low|c999")).select("path", "size")


@query("q12_filtered", with_(*BASE, ROOTS.format(p="contains(lower(path), 'urgent')"), then=f"SELECT p AS path, CAST(sum(size) AS BIGINT) AS size, CAST(sum(n_files) AS BIGINT) AS n_files FROM (SELECT size, n_files, unnest({ANC}) AS p FROM roots) GROUP BY p"))
def q12(spark, sf):
    return S.filtered(S.match_roots(_rows(spark, sf), S.parse("urgent")))


@query("u06_cover", with_(*BASE, "m AS (SELECT * FROM files WHERE contains(path, 'urgent') OR contains(path, '/c7')), tot AS (SELECT path, size, n_files FROM rows_), up AS (SELECT p, CAST(sum(size) AS BIGINT) AS ms, count(*) AS mn FROM (SELECT size, unnest(" + ANC + ") AS p FROM m) GROUP BY p), hit AS (SELECT tot.* FROM tot JOIN up ON p = path WHERE size = ms AND n_files = mn), roots AS (SELECT * FROM hit WHERE path NOT IN (SELECT u.path FROM (SELECT path, unnest((" + ANC + ")[2:-2]) AS up FROM hit) u JOIN hit a ON a.path = u.up))", then="SELECT path, size, n_files FROM roots"))
def u06(spark, sf):
    f = X.files(spark, sf)
    m = f.filter(F.col("path").contains("urgent") | F.col("path").contains("/c7")).select("path", "size", F.lit(1).cast("long").alias("n_files"))
    return S.cover(f, m)


@query("o07_top_children", with_(LISTING, DIRS, f"k AS (SELECT {PAR.format('path')} AS up, path, size, row_number() OVER (PARTITION BY {PAR.format('path')} ORDER BY size DESC, path) AS rn FROM dirs WHERE path <> '')", then="SELECT up, CASE WHEN rn <= 4 THEN path ELSE '(other)' END AS path, CAST(sum(size) AS BIGINT) AS size FROM k GROUP BY ALL"))
def o07(spark, sf):
    from heapscope.functions.paths import parent

    d = _dirs(spark, sf).filter("path != ''").select(parent(F.col("path")).alias("up"), "path", "size")
    return V.top_with_other(d, "size", "path", 4, ["up"])


LEDGER = """ledger AS (SELECT prefix, owner, ts, CAST(row_number() OVER (ORDER BY ts, prefix) AS BIGINT) AS action_id, who FROM (
 SELECT DISTINCT bucket AS prefix, 'team-' || bucket AS owner, CAST(500 AS BIGINT) AS ts, 'admin' AS who FROM listing WHERE bucket IN ('asia', 'africa')
 UNION ALL SELECT DISTINCT bucket || '/' || split_part(name, '/', 1), CASE WHEN nation % 3 = 0 THEN NULL ELSE 'n' || nation END, 100 + nation * 50, 'lead' FROM listing
 UNION ALL SELECT DISTINCT bucket || '/' || split_part(name, '/', 1) || '/c' || cust, 'cust' || (cust % 9), cust % 1000, 'self' FROM listing WHERE cust % 4 = 0
 UNION ALL SELECT bucket || '/' || name, 'object-owner', 2000, 'self' FROM listing WHERE key % 500 = 1)),
 fold AS (SELECT prefix, arg_max(owner, ts * 1000000 + action_id) FILTER (WHERE true) AS o1, max(ts * 1000000 + action_id) AS k FROM ledger GROUP BY prefix),
 folded AS (SELECT l.* FROM ledger l JOIN fold f ON f.prefix = l.prefix AND l.ts * 1000000 + l.action_id = f.k)"""


def _ledger(spark, sf):
    from pyspark.sql import Window

    x = X.listing(spark, sf).select("bucket", F.substring_index("name", "/", 1).alias("country"), "name", "cust", "nation", "key")
    top = x.filter("bucket in ('asia', 'africa')").select(F.col("bucket").alias("prefix"), F.concat(F.lit("team-"), "bucket").alias("owner"), F.lit(500).cast("long").alias("ts"), F.lit("admin").alias("who")).distinct()
    lead = x.select(F.concat_ws("/", "bucket", "country").alias("prefix"), F.when(F.col("nation") % 3 != 0, F.concat(F.lit("n"), "nation")).alias("owner"), (F.col("nation") * 50 + 100).alias("ts"), F.lit("lead").alias("who")).distinct()
    own = x.filter("cust % 4 = 0").select(F.concat(F.concat_ws("/", "bucket", "country"), F.lit("/c"), "cust").alias("prefix"), F.concat(F.lit("cust"), F.col("cust") % 9).alias("owner"), (F.col("cust") % 1000).alias("ts"), F.lit("self").alias("who")).distinct()
    one = x.filter("key % 500 = 1").select(F.concat_ws("/", "bucket", "name").alias("prefix"), F.lit("object-owner").alias("owner"), F.lit(2000).cast("long").alias("ts"), F.lit("self").alias("who"))
    every = top.unionByName(lead).unionByName(own).unionByName(one)
    # Ids of the ledger are given in its order when it is written; here the fixture numbers a few hundred rows.
    return every.withColumn("action_id", F.row_number().over(Window.orderBy("ts", "prefix")).cast("long"))


WHO = f"upw AS (SELECT path, unnest({ANC}) AS prefix FROM files), bestw AS (SELECT u.path, max(ts * 1000000 + action_id) AS k FROM upw u JOIN folded f USING (prefix) GROUP BY u.path), who AS (SELECT o.path, o.size, coalesce(f.owner, o.usr) AS who FROM owned o LEFT JOIN bestw b ON b.path = o.path LEFT JOIN folded f ON f.ts * 1000000 + f.action_id = b.k)"


@query("x08_ledger", with_(LISTING, LABELS, LAB, OWNED, LEDGER, WHO, then="SELECT path, who FROM who"))
def x08(spark, sf):
    return O.effective(owned(spark, sf), _ledger(spark, sf)).select("path", "who")


@query("x09_lens", with_(LISTING, LABELS, LAB, OWNED, LEDGER, WHO, then=f"SELECT p AS path, who, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM (SELECT size, who, unnest(({ANC})[1:-2]) AS p FROM who) GROUP BY ALL"))
def x09(spark, sf):
    return O.lens(owned(spark, sf), _ledger(spark, sf))


@query("x10_estate", with_(LISTING, DIRS, LEDGER, f"pu AS (SELECT prefix AS path, unnest({ANC.replace('path', 'prefix')}) AS up FROM folded), pb AS (SELECT pu.path, max(ts * 1000000 + action_id) AS k FROM pu JOIN folded f ON f.prefix = pu.up GROUP BY pu.path), mine AS (SELECT pb.path FROM pb JOIN folded f ON f.ts * 1000000 + f.action_id = k WHERE owner = 'cust4')", then=f"SELECT d.path, d.size, d.n_files FROM dirs d JOIN mine USING (path) WHERE d.path NOT IN (SELECT u.path FROM (SELECT path, unnest(({ANC})[1:-2]) AS up FROM mine) u JOIN mine a ON a.path = u.up)"))
def x10(spark, sf):
    return O.estate(_ledger(spark, sf), X.files(spark, sf), "cust4")


@query("x10_matrix", with_(LISTING, LEDGER, then="SELECT who, owner, count(*) AS n FROM folded WHERE owner IS NOT NULL GROUP BY ALL"))
def x10m(spark, sf):
    return O.matrix(_ledger(spark, sf))


#: The ledger with objects' rows, rows on the same prefix that are newer, of either kind, and tombstones on some of all.
AUDIT = """audit AS (SELECT prefix, CASE WHEN owner = 'object-owner' THEN 'object' END AS kind, ts, action_id, CASE WHEN action_id % 7 = 3 THEN ts + 1 END AS tombstoned FROM ledger
 UNION ALL SELECT prefix, CASE WHEN action_id % 8 = 1 THEN 'object' END, ts, action_id + 1000000, CASE WHEN action_id % 12 = 5 THEN ts + 1 END FROM ledger WHERE action_id % 4 = 1)"""


@query("e15_action_status", with_(LISTING, LEDGER, AUDIT, then="""SELECT o.action_id, CASE WHEN o.tombstoned IS NOT NULL THEN 'retracted'
 WHEN EXISTS (SELECT 1 FROM audit n WHERE n.prefix = o.prefix AND n.kind IS NOT DISTINCT FROM o.kind AND n.tombstoned IS NULL AND (n.ts, n.action_id) > (o.ts, o.action_id)) THEN 'superseded'
 WHEN EXISTS (SELECT 1 FROM audit n WHERE n.kind IS NULL AND n.tombstoned IS NULL AND starts_with(o.prefix, n.prefix || '/') AND (n.ts, n.action_id) > (o.ts, o.action_id)) THEN 'overridden' ELSE 'live' END AS status FROM audit o"""))
def e15(spark, sf):
    x, i = _ledger(spark, sf), F.col("action_id")
    first = x.select("prefix", F.when(F.col("owner") == "object-owner", "object").alias("kind"), "ts", "action_id", F.when(i % 7 == 3, F.col("ts") + 1).alias("tombstoned"))
    more = x.filter(i % 4 == 1).select("prefix", F.when(i % 8 == 1, "object").alias("kind"), "ts", (i + 1000000).alias("action_id"), F.when(i % 12 == 5, F.col("ts") + 1).alias("tombstoned"))
    return O.action_status(first.unionByName(more))


@query("p12_pools", with_(LISTING, LABELS, LAB, OWNED, then="SELECT CASE WHEN usr IS NULL OR usr = '' THEN 'unowned' ELSE 'owned' END AS pool, CAST(sum(size) AS BIGINT) AS size FROM owned GROUP BY 1 UNION ALL SELECT 'others', CAST(sum(size) AS BIGINT) FROM owned WHERE usr IS NULL OR usr NOT IN ('building', 'default')"))
def p12(spark, sf):
    o = owned(spark, sf)
    one = lambda name, c: o.filter(c).agg(F.sum("size").alias("size")).select(F.lit(name).alias("pool"), "size")
    u = F.col("usr")
    return one("owned", O.pool(u, "owned")).unionByName(one("unowned", O.pool(u, "unowned"))).unionByName(one("others", O.pool(u, "not", ["building", "default"])))


@query("p13_class_scope", with_(LISTING, DIRS, "c AS (SELECT dir AS path, sum(size) AS size, count(*) AS n, sum(CASE WHEN storage_class_id IN (1, 3) THEN size ELSE 0 END) AS kept FROM dir_up GROUP BY dir)", then="SELECT path, CAST(kept AS BIGINT) AS size, CAST(CASE WHEN size > 0 THEN (2 * CAST(n AS HUGEINT) * kept + size) // (2 * size) ELSE 0 END AS BIGINT) AS n_files FROM c"))
def p13(spark, sf):
    m = {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")} | {f"c{k}": (F.when(F.col("storage_class_id") == k, F.col("size")).otherwise(0), "sum") for k in (1, 2, 3)}
    return O.class_scope(directories(X.files(spark, sf), m), [1, 3])


@query("p14_exact_scope", with_(LISTING, LABELS, LAB, OWNED, then=f"SELECT p AS path, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM (SELECT size, unnest(({ANC})[1:-2]) AS p FROM owned WHERE storage_class_id IN (2, 3) AND usr IN ('building', 'team-2')) GROUP BY p"))
def p14(spark, sf):
    return O.exact_scope(owned(spark, sf), [2, 3], ["building", "team-2"])


def _staged(spark, sf):
    return X.labels(spark, sf).filter("prefix like '%/c%'").select("prefix")


@query("p15_eligible", with_(LISTING, LABELS, then="SELECT path, size FROM files WHERE EXISTS (SELECT 1 FROM labels_ WHERE prefix LIKE '%/c%' AND prefix = array_to_string(string_split(path, '/')[1:3], '/'))"))
def p15(spark, sf):
    return O.under_any(X.files(spark, sf).select("path", "size"), _staged(spark, sf))


@query("p16_hidden", with_(LISTING, LABELS, then="SELECT path, size FROM files WHERE NOT EXISTS (SELECT 1 FROM labels_ WHERE prefix LIKE '%/c%' AND prefix = array_to_string(string_split(path, '/')[1:3], '/'))"))
def p16(spark, sf):
    return O.under_any(X.files(spark, sf).select("path", "size"), _staged(spark, sf), hit=False)


@query("j21_held", with_(LISTING, SCANS, "a AS (SELECT path, size, mtime FROM scans WHERE scan = 4), b AS (SELECT path, size, mtime FROM scans WHERE scan = 2)", then="SELECT a.path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.size <> b.size OR a.mtime <> b.mtime THEN 'changed' ELSE 'ok' END AS reason FROM a LEFT JOIN b ON a.path = b.path"))
def j21(spark, sf):
    s = X.scans(spark, sf)
    return O.held(s.filter("scan = 4").select("path", "size", "mtime"), s.filter("scan = 2")).select("path", "reason")


@query("u07_staging", with_(LISTING, DIRS, LABELS, "it AS (SELECT DISTINCT prefix FROM labels_ WHERE prefix LIKE '%nation_2%'), wa AS (SELECT DISTINCT prefix FROM labels_ UNION SELECT 'no/such')", then=f"SELECT prefix, CASE WHEN prefix NOT IN (SELECT path FROM dirs UNION SELECT path FROM files) THEN 'gone' WHEN EXISTS (SELECT 1 FROM it i WHERE i.prefix = wa.prefix OR starts_with(wa.prefix, i.prefix || '/')) THEN 'covered' WHEN EXISTS (SELECT 1 FROM it i WHERE starts_with(i.prefix, wa.prefix || '/')) THEN 'absorbs' ELSE 'new' END AS state FROM wa"))
def u07(spark, sf):
    lab = X.labels(spark, sf)
    wanted = lab.select("prefix").unionByName(spark.createDataFrame([("no/such",)], "prefix string"))
    return O.staging(lab.filter("prefix like '%nation_2%'"), wanted, X.files(spark, sf))


@query("e06_history", with_(LISTING, LABELS, "it AS (SELECT prefix, CAST(length(prefix) * 10 AS BIGINT) AS added FROM labels_), ru AS (SELECT CAST(i AS BIGINT) AS run, CAST(i * 50 AS BIGINT) AS started FROM (SELECT unnest(range(0, 10)) AS i))", then="SELECT prefix, run, started FROM it, ru WHERE started >= added AND length(prefix) % 2 = run % 2"))
def e06(spark, sf):
    items = X.labels(spark, sf).select("prefix", (F.length("prefix") * 10).cast("long").alias("added"))
    runs = spark.range(10).select(F.col("id").alias("run"), (F.col("id") * 50).alias("started"))
    bands = items.select("prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("run")).filter("length(prefix) % 2 = run % 2")
    return O.run_history(items, bands, runs)


@query("e08_rule_findings", with_(LISTING, LABELS, then="SELECT prefix, 'unknown user' AS finding FROM labels_ WHERE usr <> 'building' UNION ALL SELECT prefix, 'duplicate' FROM (SELECT prefix FROM labels_ UNION ALL SELECT prefix FROM labels_ WHERE usr = 'default') GROUP BY prefix HAVING count(*) > 1 UNION ALL SELECT prefix, 'unknown user' FROM labels_ WHERE usr = 'default'"))
def e08(spark, sf):
    lab = X.labels(spark, sf)
    return O.rule_findings(lab.unionByName(lab.filter("usr = 'default'")), spark.createDataFrame([("building",)], "usr string"))


@query("e11_precedence", with_(LISTING, LABELS, then="SELECT prefix, usr FROM labels_ WHERE prefix NOT LIKE '%nation_2%' UNION ALL SELECT prefix, 'manual' FROM labels_ WHERE prefix LIKE '%nation_2%'"))
def e11(spark, sf):
    lab = X.labels(spark, sf)
    manual = lab.filter("prefix like '%nation_2%'").withColumn("usr", F.lit("manual")).withColumns({"priority": F.lit(0), "seq": F.lit(0)})
    return O.by_precedence(lab.withColumns({"priority": F.lit(1), "seq": F.lit(0)}).unionByName(manual)).select("prefix", "usr")


@query("u03_except_all", with_(LISTING, then="SELECT bucket, storage_class_id, 1 AS n FROM listing WHERE key % 2 = 0 EXCEPT ALL SELECT bucket, storage_class_id, 1 FROM listing WHERE key % 3 = 0"))
def u03(spark, sf):
    x = X.listing(spark, sf)
    pick = lambda c: x.filter(c).select("bucket", "storage_class_id", F.lit(1).alias("n"))
    return pick("key % 2 = 0").exceptAll(pick("key % 3 = 0"))


@query("u04_union_by_name", with_(LISTING, then="SELECT bucket, name, CAST(NULL AS VARCHAR) AS op FROM listing WHERE key % 2 = 0 UNION ALL SELECT bucket, NULL, 'd' FROM listing WHERE key % 2 = 1"))
def u04(spark, sf):
    x = X.listing(spark, sf)
    return x.filter("key % 2 = 0").select("bucket", "name").unionByName(x.filter("key % 2 = 1").select("bucket", F.lit("d").alias("op")), allowMissingColumns=True)


@query("g01_grouping_sets", with_(LISTING, then="SELECT bucket, count(DISTINCT cust) AS n FROM listing GROUP BY GROUPING SETS ((bucket), ())"))
def g01(spark, sf):
    return X.listing(spark, sf).rollup("bucket").agg(F.count_distinct("cust").alias("n"))


def _copied(spark, sf):
    """Files of a nation, and the same again under another bucket."""
    f = X.files(spark, sf).select("path", "size", "mtime")
    return f.unionByName(f.filter(in_subtree(F.col("path"), "asia/nation_2")).withColumn("path", F.concat(F.lit("backup/"), F.regexp_replace("path", "^asia/", ""))))


COPIED = f"cop AS (SELECT path, size, mtime FROM files UNION ALL SELECT 'backup/' || path[6:], size, mtime FROM files WHERE starts_with(path, 'asia/nation_2/')), cd AS (SELECT p AS path, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM (SELECT size, unnest(({ANC})[1:-2]) AS p FROM cop) GROUP BY p), cx AS (SELECT path, split_part(path, '/', 1) AS bucket, array_to_string(string_split(path, '/')[2:], '/') AS rel, size, n_files, md5(array_to_string(string_split(path, '/')[2:], '/') || '|' || size || '|' || n_files) AS grp FROM cd WHERE path LIKE '%/%' AND size >= 10000000), dup AS (SELECT * FROM cx WHERE grp IN (SELECT grp FROM cx GROUP BY grp HAVING count(DISTINCT bucket) > 1))"


def _dup(spark, sf):
    d = directories(_copied(spark, sf), {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")})
    return D.groups(d, 10_000_000)


@query("a22_dups", with_(LISTING, COPIED, then="SELECT grp, path, bucket, size, n_files FROM dup"))
def a22(spark, sf):
    return _dup(spark, sf).select("grp", "path", "bucket", "size", "n_files")


@query("a22_moved", with_(LISTING, COPIED, "mv AS (SELECT *, md5(string_split(path, '/')[-1] || '|' || size || '|' || n_files) AS g2 FROM cx)", then="SELECT g2 AS grp, path FROM mv WHERE g2 IN (SELECT g2 FROM mv GROUP BY g2 HAVING count(DISTINCT rel) > 1)"))
def a22m(spark, sf):
    f = _copied(spark, sf)
    d = directories(f, {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")})
    return D.moved(d, 10_000_000).select("grp", "path")


@query("a23_maximal", with_(LISTING, COPIED, f"g AS (SELECT grp, list_sort(list(path)) AS own, list_sort(list({PAR.format('path')})) AS up FROM dup GROUP BY grp)", then="SELECT grp, path FROM dup WHERE grp IN (SELECT grp FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.own = g.up))"))
def a23(spark, sf):
    return D.maximal(_dup(spark, sf)).select("grp", "path")


@query("a24_exact", with_(LISTING, COPIED, then="SELECT grp, count(*) AS copies, true AS exact FROM dup GROUP BY grp"))
def a24(spark, sf):
    return D.exact(_dup(spark, sf), _copied(spark, sf).withColumn("check", F.col("mtime")))


@query("w10_keepers", with_(LISTING, COPIED, then="SELECT path, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN length(path) % 2 = 0 THEN length(path) END DESC NULLS LAST, size ASC NULLS LAST, path) = 1 AS keep FROM dup"))
def w10(spark, sf):
    c = _dup(spark, sf).withColumns({"last_read": F.when(F.length("path") % 2 == 0, F.length("path")), "created": F.col("size")})
    return D.keepers(c).select("path", "keep")


@query("j15_nested", with_(LISTING, COPIED, then=f"SELECT path, path IN (SELECT u.path FROM (SELECT path, unnest(({ANC})[1:-2]) AS up FROM dup) u JOIN dup a ON a.path = u.up) AS nested FROM dup"))
def j15(spark, sf):
    return D.nested(_dup(spark, sf)).select("path", "nested")


@query("a25_summary", with_(LISTING, COPIED, f"ne AS (SELECT *, path IN (SELECT u.path FROM (SELECT path, unnest(({ANC})[1:-2]) AS up FROM dup) u JOIN dup a ON a.path = u.up) AS nested FROM dup), gg AS (SELECT grp, count(*) AS c, min(size) AS s FROM ne GROUP BY grp HAVING NOT bool_and(nested))", then="SELECT count(*) AS groups, CAST(sum(c) AS BIGINT) AS copies, CAST(sum(s * (c - 1)) AS BIGINT) AS reclaimable FROM gg"))
def a25(spark, sf):
    return D.summary(_dup(spark, sf))


@query("j19_bucket_pairs", with_(LISTING, COPIED, "b AS (SELECT grp, bucket, min(size) AS size FROM dup GROUP BY ALL)", then="SELECT x.bucket AS a, y.bucket AS b, count(*) AS groups, CAST(sum(x.size) AS BIGINT) AS bytes FROM b x JOIN b y ON x.grp = y.grp AND x.bucket < y.bucket GROUP BY ALL"))
def j19(spark, sf):
    return D.pairs(_dup(spark, sf))


@query("a24_equal_texts", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a24t(spark, sf):
    return D.equal_texts(X.table(spark, sf, "documents").filter("text is not null"), "doc_id", "text")


@query("e01_compare_stores", with_(LISTING, DIRS, then="SELECT 'size' AS \"column\", (SELECT count(*) FROM dirs WHERE n_files % 2 = 0) AS mismatches, 1.0::DOUBLE AS worst UNION ALL SELECT 'n_files', 0, 0.0"))
def e01(spark, sf):
    from heapscope.operators.reports import compared

    d = _dirs(spark, sf)
    return compared(d, d.withColumn("size", F.col("size") + F.when(F.col("n_files") % 2 == 0, 1).otherwise(0)), ["path"], ["size", "n_files"])


@query("a37_merge_parts", with_(LISTING, then="SELECT bucket, CAST(sum(size_bytes) AS BIGINT) AS size, max(created_s) AS mtime, count(DISTINCT key % 3) AS parts FROM listing GROUP BY bucket"))
def a37(spark, sf):
    from heapscope.operators.reports import merged_parts

    x = X.listing(spark, sf).select("bucket", (F.col("key") % 3).alias("part"), F.col("size_bytes").alias("size"), F.col("created_s").alias("mtime"), F.lit(1).cast("long").alias("parts"))
    return merged_parts(x, ["bucket"], ["size"], ["mtime"], ["parts"])
