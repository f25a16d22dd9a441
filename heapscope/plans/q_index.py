"""Queries over prefixes, search indexes, duplicates' filters, deliveries, stores at rest and partial answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.paths import basename, parent
from heapscope.functions.scalars import OPEN, size_rank
from heapscope.operators import dups as D
from heapscope.operators import history as H
from heapscope.operators import joins as J
from heapscope.operators import search as S
from heapscope.operators.rollup import directories
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LISTING, SCANS, VERSIONS, with_
from heapscope.plans.q_history import versions
from heapscope.plans.q_search import BASE, PAR, ROOTS, _rows
from heapscope.plans.registry import query
from heapscope.sources import deliveries as DL
from heapscope.sources import listing as L
from heapscope.sources import stores as ST
from heapscope.sources.scratch import scratch

T = X.cut_seconds()
VERS = (LISTING, SCANS, VERSIONS)

WEIGHTS = "weights AS (SELECT split_part(name, '/', 1) || '/' AS prefix, count(*) AS n FROM listing WHERE contains(name, '/') GROUP BY 1 UNION ALL SELECT split_part(name, '/', 1) || '/' || split_part(name, '/', 2) || '/', count(*) FROM listing WHERE contains(name, '/') GROUP BY 1)"


@query("s12_prefix_weights", with_(LISTING, WEIGHTS, then="SELECT * FROM weights"))
def s12(spark, sf):
    return L.prefix_weights(X.listing(spark, sf))


@query("s12_hot_prefixes", with_(LISTING, WEIGHTS, """one AS (SELECT * FROM weights WHERE length(prefix) - length(replace(prefix, '/', '')) = 1), cutk AS (SELECT prefix, n, CAST(least(ceil(n / greatest((SELECT sum(n) FROM one) // 40, 1)), 40) AS INTEGER) AS k FROM one),
 names AS (SELECT prefix, n, k, name, row_number() OVER (PARTITION BY prefix ORDER BY name) AS rn, count(*) OVER (PARTITION BY prefix) AS m FROM cutk JOIN listing ON starts_with(name, prefix) WHERE k >= 2),
 edge AS (SELECT prefix, n, k, i, (SELECT name FROM names x WHERE x.prefix = c.prefix AND x.rn = CAST(ceil(CAST(i AS DOUBLE) / k * x.m) AS BIGINT)) AS name FROM cutk c, LATERAL (SELECT unnest(range(1, k)) AS i) WHERE k >= 2)""",
 then="""SELECT prefix, NULL AS start, NULL AS "end", n FROM cutk WHERE k < 2 UNION ALL SELECT prefix, lag(name) OVER w, name, n // k FROM edge WINDOW w AS (PARTITION BY prefix ORDER BY i) UNION ALL SELECT prefix, max(name), NULL, max(n // k) FROM edge GROUP BY prefix"""))
def s12h(spark, sf):
    x = X.listing(spark, sf)
    w = L.prefix_weights(x).filter(F.length("prefix") - F.length(F.replace("prefix", F.lit("/"), F.lit(""))) == 1)
    return L.split_hot_prefixes(x, w, 40)


@query("s11_split_ranges", with_(LISTING, then="SELECT count(*) AS names, true AS small, true AS gapless FROM (SELECT DISTINCT name FROM listing WHERE bucket = 'asia')"))
def s11s(spark, sf):
    """Ranges of at most 50 names: that they hold all names, that none holds more, and that each begins where the one before ends."""
    names = X.listing(spark, sf).filter("bucket = 'asia'").select("name").distinct()
    path = scratch(spark, "names")
    names.write.parquet(path)
    to = scratch(spark, "ranges")
    L.cut_ranges(spark.read.parquet(path), 50).write.parquet(to)
    r = spark.read.parquet(to)
    # Where each range ends after it begins, and each end, '' too, is the begin of one range and the end of one, nothing is left out or there twice.
    ends = r.select(F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("b")), F.struct(F.col("hi").alias("at"), F.lit(0).alias("b")))).alias("x")).groupBy("x.at").agg(F.count("*").alias("n"), F.sum("x.b").alias("b"))
    all_ = r.agg(F.sum("n").alias("names"), (F.max("n") <= 50).alias("small"), F.expr("bool_and(hi = '' or lo < hi)").alias("forward"))
    return all_.crossJoin(ends.agg(F.expr("bool_and(n = 2 and b = 1)").alias("met"))).select("names", "small", (F.col("forward") & F.col("met")).alias("gapless"))


@query("s12_deduped", with_(LISTING, WEIGHTS, "p AS (SELECT prefix FROM weights WHERE length(prefix) % 3 <> 0)", then="SELECT prefix, NOT EXISTS (SELECT 1 FROM p a WHERE a.prefix <> p.prefix AND starts_with(p.prefix, a.prefix)) AS kept FROM p"))
def s12d(spark, sf):
    return L.dedupe_prefixes(L.prefix_weights(X.listing(spark, sf)).filter(F.length("prefix") % 3 != 0))


NAME = "lower(string_split(path, '/')[-1])"


@query("p10_name_terms", with_(LISTING, then=f"SELECT term, path FROM (SELECT 'low' AS term, path FROM files WHERE contains({NAME}, 'low') UNION ALL SELECT '^o1', path FROM files WHERE starts_with({NAME}, 'o1') UNION ALL SELECT '7.csv$', path FROM files WHERE ends_with({NAME}, '7.csv') UNION ALL SELECT 'o1*77.', path FROM files WHERE regexp_matches({NAME}, 'o1[^/]*77\\.') UNION ALL SELECT 'urgent/o2', path FROM files WHERE starts_with({NAME}, 'o2') UNION ALL SELECT '^o77.log$', path FROM files WHERE {NAME} = 'o77.log')"))
def p10(spark, sf):
    """What the last name must be where a term becomes true; a term with a slash is about what follows it."""
    f, out = X.files(spark, sf), None
    for text in ("low", "^o1", "7.csv$", "o1*77.", "urgent/o2", "^o77.log$"):
        term = S.parse(text).alts[0][0]
        own = f.filter(S.branch_column(S.name_branch(term), basename(F.col("path")))).select(F.lit(text).alias("term"), "path")
        out = own if out is None else out.unionByName(own)
    return out


@query("q05_trigrams", with_(*BASE, then=f"SELECT path FROM rows_ WHERE (contains(lower(path), 'urgent') OR contains(lower(path), 'c77') AND contains(lower(path), 'asia') OR contains(lower(path), 'urgent/o1') OR regexp_matches(lower(path), 'o1[^/]*77\\.')) AND NOT (contains(lower({PAR.format('path')}), 'urgent') OR contains(lower({PAR.format('path')}), 'c77') AND contains(lower({PAR.format('path')}), 'asia') OR contains(lower({PAR.format('path')}), 'urgent/o1') OR regexp_matches(lower({PAR.format('path')}), 'o1[^/]*77\\.'))"))
def q05(spark, sf):
    """The formula has a set for each term; the set of 'urgent/o1' is that of a name that begins with 'o1', which has no trigram, so the query
    is widened to all names; the second search has sets for all terms."""
    rows = _rows(spark, sf)
    q = S.parse("urgent | c77 asia | urgent/o1 | o1*77.")
    return S.trigram_search(rows, S.trigram_index(rows), q).select("path")


@query("q05_formula", with_(*BASE, then=f"SELECT path FROM rows_ WHERE regexp_matches(lower(path), 'urgent|urgently|(^|/)c77(/|$)|\\.csv') AND NOT regexp_matches(lower({PAR.format('path')}), 'urgent|urgently|(^|/)c77(/|$)|\\.csv')"))
def q05f(spark, sf):
    rows, q = _rows(spark, sf), S.parse("urgent | urgently | ^c77$ | .csv")
    assert len(S.formula(q)) == 3  # 'urgently' needs all that 'urgent' needs
    return S.trigram_search(rows, S.trigram_index(rows), q).select("path")


@query("q06_literal", with_(*BASE, then=f"SELECT path FROM rows_ WHERE contains({NAME}, '77.')"))
def q06(spark, sf):
    return S.suffix_lookup(S.suffix_table(_rows(spark, sf).select("path")), "77.")


@query("q06_first_hits", with_(LISTING, SCANS, then=f"SELECT split_part(path, '/', 1) AS bucket, t, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM scans WHERE scan IN (2, 4) AND contains({NAME}, '77') AND NOT contains(lower({PAR.format('path')}), '77') GROUP BY ALL"))
def q06h(spark, sf):
    return S.first_hits(versions(spark, sf), "77", [T[2], T[4]])


@query("a19_prefix_census", with_(LISTING, f"s AS (SELECT substr(nm, i) AS s FROM (SELECT nm, unnest(range(1, length(nm) - 1)) AS i FROM (SELECT {NAME} AS nm FROM files))), p AS (SELECT s[1:k] AS prefix FROM (SELECT s, unnest(range(3, length(s) + 1)) AS k FROM s))", then="SELECT prefix, count(*) AS n FROM p GROUP BY prefix HAVING count(*) >= 30"))
def a19(spark, sf):
    return S.prefix_census(S.suffix_table(X.files(spark, sf).select("path")).select("s"), 30)


TRUTH = """part AS (SELECT array_to_string(string_split(path, '/')[1:2], '/') AS part, count(*) AS n, md5(string_agg(path, chr(10) ORDER BY path)) AS d, sum(size) AS size, sum(n_files) AS n_files FROM roots GROUP BY 1),
 truth AS (SELECT split_part(part, '/', 1) AS bucket, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(part || ' ' || d, chr(10) ORDER BY part, d)) AS digest, CAST(sum(size) AS BIGINT) AS size, CAST(sum(n_files) AS BIGINT) AS n_files FROM part GROUP BY 1)"""
URGENT = ROOTS.format(p="contains(lower(path), 'urgent')")


@query("a39_truth", with_(*BASE, URGENT, TRUTH, then="SELECT * FROM truth"))
def a39(spark, sf):
    return S.truth(S.match_roots(_rows(spark, sf), S.parse("urgent")))


#: Answers of every kind, by hand: which bucket's is exact, flagged, capped, wrong, refused or missing.
KINDS = {"africa": "exact", "america": "exact*", "asia": "totals", "europe": "flagged", "middle-east": "FAIL"}


@query("q14_verdicts", with_(LISTING, then="SELECT DISTINCT bucket, CASE bucket WHEN 'africa' THEN 'exact' WHEN 'america' THEN 'exact*' WHEN 'asia' THEN 'totals' WHEN 'europe' THEN 'flagged' ELSE 'FAIL' END AS verdict FROM listing UNION ALL SELECT 'x-refused', 'refused' UNION ALL SELECT 'y-error', 'error'"))
def q14(spark, sf):
    right = S.truth(S.match_roots(_rows(spark, sf), S.parse("urgent")))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("bucket")]
    wrong = F.when(kind.isin("flagged", "FAIL"), 1).otherwise(0)
    given = right.select("bucket", F.lit(200).alias("status"), (F.col("n") - wrong).alias("n"), F.when(kind == "totals", "cut").otherwise(F.col("digest")).alias("digest"), "size", "n_files", (kind == "exact*").alias("partial"), (kind == "flagged").alias("approximate"), (kind == "totals").alias("capped"))
    none = spark.createDataFrame([("x-refused", 413), ("y-error", 500)], "bucket string, status int")
    blank = none.select("bucket", "status", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("digest", "string"), ("size", "long"), ("n_files", "long"), ("partial", "boolean"), ("approximate", "boolean"), ("capped", "boolean"))])
    return S.verdict(given.unionByName(blank), right)


GROUPS = "copies AS (SELECT cust % 200 AS grp, bucket, name AS path, key % 4 = 0 AS nested, size_bytes, cust FROM listing), groups AS (SELECT grp, CASE grp % 3 WHEN 0 THEN 'tree' WHEN 1 THEN 'moved' ELSE 'exact' END AS tier, sum(size_bytes) - max(size_bytes) AS reclaimable, grp % 5 = 0 AS suspect FROM copies GROUP BY grp)"


@query("p22_dup_filter", with_(LISTING, GROUPS, then="""SELECT 'plain' AS f, grp FROM groups g WHERE NOT suspect AND EXISTS (SELECT 1 FROM copies c WHERE c.grp = g.grp AND NOT nested)
 UNION ALL SELECT 'tier', grp FROM groups g WHERE tier = 'moved' AND reclaimable >= 100000000 AND EXISTS (SELECT 1 FROM copies c WHERE c.grp = g.grp AND NOT nested)
 UNION ALL SELECT 'buckets', grp FROM groups g WHERE NOT suspect AND (SELECT count(*) FROM copies c WHERE c.grp = g.grp AND bucket = 'asia') >= 2 AND (SELECT count(*) FROM copies c WHERE c.grp = g.grp AND bucket = 'europe') >= 1
 UNION ALL SELECT 'q', grp FROM groups g WHERE EXISTS (SELECT 1 FROM copies c WHERE c.grp = g.grp AND contains(path, 'nation_7/'))"""))
def p22(spark, sf):
    c = X.listing(spark, sf).select((F.col("cust") % 200).alias("group"), "bucket", F.col("name").alias("path"), (F.col("key") % 4 == 0).alias("nested"), "size_bytes")
    k = F.col("group") % 3
    g = c.groupBy("group").agg((F.sum("size_bytes") - F.max("size_bytes")).alias("reclaimable")).select("group", F.when(k == 0, "tree").when(k == 1, "moved").otherwise("exact").alias("tier"), "reclaimable", (F.col("group") % 5 == 0).alias("suspect"))
    filters = {"plain": {}, "tier": {"tier": "moved", "least": 100_000_000, "suspect": True}, "buckets": {"buckets": ["asia", "europe", "asia"], "nested": True}, "q": {"q": "Nation_7/", "nested": True, "suspect": True}}
    out = None
    for name, f in filters.items():
        own = D.matching_groups(g, c, **f).select(F.lit(name).alias("f"), F.col("group").alias("grp"))
        out = own if out is None else out.unionByName(own)
    return out


@query("o10_dyadic", with_(*VERS, f"x AS (SELECT path, vf, vt, a.scan AS i, coalesce(b.scan, 6) - 1 AS j FROM versions JOIN cuts a ON a.t = vf LEFT JOIN cuts b ON b.t = vt)", then=f"SELECT path, vf, CAST(CASE WHEN vt = {OPEN} THEN 0 ELSE 1 + CASE WHEN i = j THEN 0 ELSE length(bin(xor(i, j))) END * 65536 + (i >> CASE WHEN i = j THEN 0 ELSE CAST(length(bin(xor(i, j))) AS INTEGER) END) END AS BIGINT) AS segment FROM x"))
def o10(spark, sf):
    return versions(spark, sf).select("path", "vf", H.dyadic_segment(F.col("vf"), F.col("vt"), T).alias("segment"))


@query("e10_partial_answers", with_(LISTING, DIRS, then="SELECT path, size, n_files FROM dirs WHERE size >= 60000000"))
def e10(spark, sf):
    """Each of three shards names what reaches its share of the floor, a superset of the answer; sums are made for those only, then cut."""
    f, floor, shards = X.files(spark, sf), 60_000_000, 3
    m = {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")}
    parts = [directories(f.filter(F.col("key") % shards == k), m) for k in range(shards)]
    named = [p.filter(F.col("size") * shards >= floor).select("path") for p in parts]
    wanted = named[0].unionByName(named[1]).unionByName(named[2]).distinct()
    own = [p.join(wanted, "path", "left_semi") for p in parts]
    merged = own[0].unionByName(own[1]).unionByName(own[2]).groupBy("path").agg(F.sum("size").alias("size"), F.sum("n_files").alias("n_files"))
    return merged.filter(F.col("size") >= floor)


@query("e02_size_sort_check", with_(LISTING, DIRS, then="SELECT 'both' AS side, count(*) AS n FROM (SELECT path FROM dirs WHERE size >= 30000000 AND path <> '' UNION ALL SELECT path FROM files WHERE size >= 30000000)"))
def e02(spark, sf):
    """Rows over a threshold as the store sorted by size has them, by its size classes, against those of the store sorted by path."""
    from heapscope.functions.paths import depth

    rows = _rows(spark, sf).withColumn("depth", depth(F.col("path")))
    by_size, by_path = scratch(spark, "by-size"), scratch(spark, "by-path")
    rows.withColumn("rank", F.coalesce(size_rank(F.col("size")), F.lit(-1))).write.partitionBy("rank").parquet(by_size)
    ST.write_by_path(rows, by_path, 4)
    least = 30_000_000
    a = spark.read.parquet(by_size).filter((F.col("rank") >= least.bit_length() - 1) & (F.col("size") >= least)).select("path", "size", "n_files")
    b = spark.read.parquet(by_path).filter(F.col("size") >= least).select("path", "size", "n_files")
    n = lambda x, side: x.agg(F.lit(side).alias("side"), F.count("*").alias("n")).filter("n > 0")
    return n(a.intersectAll(b), "both").unionByName(n(a.exceptAll(b), "by size only")).unionByName(n(b.exceptAll(a), "by path only"))


@query("j23_ranges", with_(LISTING, "st AS (SELECT min(path) AS start FROM files GROUP BY split_part(path, '/', 2))", then="SELECT path, CAST((SELECT count(*) FROM st WHERE start <= path) - 1 AS INTEGER) AS range FROM files"))
def j23(spark, sf):
    f = X.files(spark, sf).select("path")
    return J.in_ranges(f, f.groupBy(F.split_part("path", F.lit("/"), F.lit(2))).agg(F.min("path").alias("start")), "path")


@query("s15_own_files", with_(LISTING, DIRS, f"big AS (SELECT path FROM dirs WHERE n_files >= 40 AND path <> ''), up AS (SELECT path, unnest({ANC}) AS a FROM files), deep AS (SELECT up.path, arg_max(a, length(a)) AS chunk FROM up JOIN big ON big.path = a GROUP BY up.path)", then="SELECT f.path, coalesce(chunk, '') AS chunk, CASE WHEN chunk IS NULL THEN f.path ELSE substr(f.path, length(chunk) + 2) END AS rebased, f.path AS back FROM files f LEFT JOIN deep USING (path)"))
def s15(spark, sf):
    f = X.files(spark, sf).select("path", "size")
    d = directories(f, {"n_desc": (F.lit(1).cast("long"), "sum")})
    c = ST.chunked(f, ST.chunk_roots(d, 40))
    path = scratch(spark, "own-files")
    c.write.partitionBy("chunk").parquet(path)
    again = spark.read.schema("path string, size long, rebased string, chunk string").parquet(path).withColumn("chunk", F.coalesce("chunk", F.lit("")))
    back = ST.unbased(again.select("size", "chunk", "rebased")).select(F.col("path").alias("back"))
    return c.join(back, c["path"] == back["back"]).select("path", "chunk", "rebased", "back")


@query("s19_row_groups", with_(LISTING, then="SELECT CAST(count(*) AS BIGINT) AS n, min(path) AS lo, max(path) AS hi, true AS apart FROM files"))
def s19(spark, sf):
    """The manifest of a store in path order: row groups of the same depth don't overlap."""
    from heapscope.functions.paths import depth

    path = scratch(spark, "groups")
    ST.write_by_path(X.files(spark, sf).select("path", "size").withColumn("depth", depth(F.col("path"))), path, 6)
    g = ST.row_groups(spark, path, ["path", "depth"])
    lead = g.alias("a").join(g.alias("b"), F.expr("a.min_depth = b.min_depth and a.min_path < b.min_path and a.max_path > b.min_path"), "left_semi")
    return g.agg(F.sum("n").alias("n"), F.min("min_path").alias("lo"), F.max("max_path").alias("hi")).crossJoin(lead.agg((F.count("*") == 0).alias("apart")))


@query("s20_implied", with_(LISTING, then="SELECT 'sum_a' AS \"column\", true AS implied UNION ALL SELECT 'sum_b', false UNION ALL SELECT 'sum_c', false"))
def s20i(spark, sf):
    f = X.files(spark, sf)
    return ST.implied_columns(f.select("path", "size", F.col("size").alias("sum_a"), F.when(F.col("key") % 7 != 0, F.col("size")).alias("sum_b"), (F.col("size") + F.when(F.col("key") % 500 == 0, 1).otherwise(0)).alias("sum_c"), F.col("size").cast("string").alias("sum_d")))


@query("s22_export", with_(LISTING, then="SELECT bucket, segment, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(name) AS first FROM listing GROUP BY ALL"))
def s22e(spark, sf):
    """A table as CSV and back."""
    t = X.listing(spark, sf).groupBy("bucket", "segment").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.min("name").alias("first"))
    path = scratch(spark, "export")
    t.write.option("header", True).option("quoteAll", True).csv(path)
    return spark.read.option("header", True).schema(t.schema).csv(path)


#: Files delivered every hour, some up to nine hours late; what a run at the 15th's noon leaves for one a day later.
FILES = """f AS (SELECT 'b' || (event_id % 3) AS bucket, 'b' || (event_id % 3) || '_usage_' || strftime(date_trunc('hour', ts), '%Y_%m_%d_%H_%M_%S') || '_' || lpad(CAST(event_id AS VARCHAR), 7, '0') || '_v0' AS name, CAST(event_id AS BIGINT) AS size, date_trunc('hour', ts) AS hr, ts + to_hours(CAST(event_id % 10 AS INTEGER)) AS created FROM events),
 one AS (SELECT * FROM f WHERE created <= TIMESTAMP '2024-01-15 12:00:00'), wm AS (SELECT bucket, max(hr) AS hr FROM one GROUP BY bucket)"""


@query("t01_pending", "WITH " + FILES + " SELECT f.bucket, f.name, f.size FROM f JOIN wm USING (bucket) WHERE f.created <= TIMESTAMP '2024-01-16 12:00:00' AND f.hr >= wm.hr - INTERVAL 6 HOUR AND f.name NOT IN (SELECT name FROM one)")
def t01(spark, sf):
    e = X.table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    b = F.concat(F.lit("b"), F.col("event_id") % 3)
    name = F.concat(b, F.lit("_usage_"), F.date_format(hour, "yyyy_MM_dd_HH_mm_ss"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 7, "0"), F.lit("_v0"))
    files = e.select(b.alias("bucket"), name.alias("name"), F.col("event_id").alias("size"), (F.col("ts").cast("timestamp") + F.make_interval(hours=(F.col("event_id") % 10).cast("int"))).cast("timestamp_ntz").alias("created"))
    none = spark.createDataFrame([], "bucket string, watermark string, tail array<string>")
    there = lambda t: files.filter(F.col("created") <= F.lit(t).cast("timestamp_ntz")).drop("created")
    first = DL.pending(there("2024-01-15 12:00:00"), none)
    return DL.pending(there("2024-01-16 12:00:00"), DL.advanced(none, first))


@query("s09_state_keys", """SELECT 'b' || (n % 2) AS bucket, '2024-01-0' || (1 + n // 24) || 'T' || lpad(CAST(n % 24 AS VARCHAR), 2, '0') AS hour, CASE WHEN n >= 20 THEN 'agg/' || n ELSE 'frozen/' || n END AS key FROM range(0, 40) t(n) WHERE n < 34""")
def s09(spark, sf):
    """One state file for each of two buckets' hours; older hours are frozen, some of them under a later aggregate too."""
    n = spark.range(40).withColumn("n", F.col("id").cast("int"))
    hour = F.concat(F.lit("2024-01-0"), (1 + F.expr("n div 24")).cast("string"), F.lit("T"), F.lpad((F.col("n") % 24).cast("string"), 2, "0"))
    x = n.select(F.concat(F.lit("b"), F.col("n") % 2).alias("bucket"), hour.alias("hour"), "n")
    frozen = F.collect_list(F.when(F.col("n") < 24, F.struct("hour", F.concat(F.lit("frozen/"), "n").alias("key"))))
    hours = F.collect_list(F.when(F.col("n") >= 20, F.struct("hour", F.struct(F.concat(F.lit("agg/"), "n").alias("agg")).alias("key"))))
    one = x.groupBy("bucket").agg(F.map_from_entries(frozen).alias("frozen"), F.map_from_entries(hours).alias("hours"))
    b = one.select(F.concat(F.lit('{"schema_version":2,"buckets":{"'), "bucket", F.lit('":'), F.to_json(F.struct("frozen", "hours")), F.lit("}}")).alias("value"))
    return DL.state_keys(b, before=1704189600)
