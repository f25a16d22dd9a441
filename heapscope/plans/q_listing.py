"""Queries over listings, paths and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions import paths as P
from heapscope.functions import scalars as S
from heapscope.operators import rollup as R
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, REQUESTS, with_
from heapscope.plans.registry import query
from heapscope.sources import listing as L

COLS = "bucket, name, size_bytes, created, storage_class_id"


def _dialect_a(spark, sf):
    x = X.listing(spark, sf)
    kind = F.element_at(F.array(*[F.lit(k) for k in S.CLASS_A]), F.col("storage_class_id"))
    return x.select("bucket", "name", F.col("size_bytes").alias("size"), F.col("created").alias("timeCreated"), kind.alias("storageClass"), F.when(F.col("key") % 7 == 0, F.col("created")).alias("timeDeleted"))


def _dialect_b(spark, sf):
    x = X.listing(spark, sf)
    names = [*KINDS_B, None]
    kind = F.get(F.array(*[F.lit(k).cast("string") for k in names]), (F.col("key") % len(names)).cast("int"))
    gone = F.when(F.col("key") % 7 != 1, F.col("key") % 5 == 0)
    latest = F.when(F.col("key") % 7 != 2, F.col("key") % 3 != 0)
    return x.select(F.col("bucket").alias("Bucket"), F.col("name").alias("Key"), F.col("size_bytes").alias("Size"), F.col("created").alias("LastModifiedDate"), kind.alias("StorageClass"), gone.alias("IsDeleteMarker"), latest.alias("IsLatest"))


@query("s01_listing", with_(LISTING, then=f"SELECT {COLS} FROM listing"))
def s01(spark, sf):
    return L.normalised(X.listing(spark, sf))


@query("s02_inventory_a", with_(LISTING, then=f"SELECT {COLS} FROM listing WHERE key % 7 <> 0"))
def s02(spark, sf):
    return L.normalised(_dialect_a(spark, sf))


#: Every class name, one that isn't known and one in small letters; in the SQL their ids by hand, and 0 for a missing one.
KINDS_B = ["STANDARD", "REDUCED_REDUNDANCY", "INTELLIGENT_TIERING", "OUTPOSTS", "STANDARD_IA", "ONEZONE_IA", "GLACIER_IR", "GLACIER_INSTANT_RETRIEVAL", "GLACIER", "DEEP_ARCHIVE", "EXPRESS_ONEZONE", "glacier"]


@query("s03_inventory_b", with_(LISTING, then="SELECT bucket, name, size_bytes, created, CAST([1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 0, 0, 0][key % 13 + 1] AS INTEGER) AS storage_class_id FROM listing WHERE NOT (key % 5 = 0 AND key % 7 <> 1) AND NOT (key % 3 = 0 AND key % 7 <> 2)"))
def s03(spark, sf):
    return L.normalised(_dialect_b(spark, sf))


@query("s04_first_source_wins", with_(LISTING, then="SELECT bucket, name, size_bytes FROM listing WHERE bucket IN ('asia', 'europe') UNION ALL SELECT bucket, name, size_bytes + 1 FROM listing WHERE bucket NOT IN ('asia', 'europe')"))
def s04(spark, sf):
    x = X.listing(spark, sf)
    return L.first_source_wins([x.filter("bucket in ('asia', 'europe')"), x.withColumn("size_bytes", F.col("size_bytes") + 1)]).select("bucket", "name", "size_bytes")


@query("s05_buckets", with_(LISTING, then="SELECT bucket, count(*) AS n FROM listing GROUP BY bucket"))
def s05(spark, sf):
    return X.listing(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"))


@query("s13_duplicate_keys", "SELECT CAST(l_orderkey AS VARCHAR) AS bucket, CAST(l_linenumber AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def s13(spark, sf):
    return L.duplicate_keys(X.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("bucket"), F.col("l_linenumber").cast("string").alias("name")))


@query("s14_subtree_read", with_(LISTING, then="SELECT path, size FROM files WHERE (path = 'asia/nation_2' OR (path >= 'asia/nation_2/' AND path < 'asia/nation_20')) AND len(string_split(path, '/')) BETWEEN 3 AND 5"))
def s14(spark, sf):
    return X.files(spark, sf).filter(P.in_subtree(F.col("path"), "asia/nation_2") & P.depth(F.col("path")).between(3, 5)).select("path", "size")


@query("s16_shallow", with_(LISTING, DIRS, then="SELECT path, size, n_files FROM dirs WHERE path <> '' AND path NOT LIKE '%/%'"))
def s16(spark, sf):
    return R.rollup(X.files(spark, sf)).filter("depth = 1 and path != '.'").select("path", "size", "n_files")


@query("s17_point_stat", with_(LISTING, DIRS, then="SELECT path, size, n_files, mtime FROM dirs WHERE path = 'asia/nation_2'"))
def s17(spark, sf):
    return R.rollup(X.files(spark, sf)).filter("path = 'asia/nation_2'").select("path", "size", "n_files", "mtime")


@query("s21_rollup_to_listing", with_(LISTING, then="SELECT bucket, name, size_bytes, date_trunc('second', created) AS created FROM listing"))
def s21(spark, sf):
    return L.from_rollup(R.rollup(X.files(spark, sf))).select("bucket", "name", "size_bytes", "created")


@query("s22_sheet_diff", with_(LISTING, then="""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'update' END AS action, b.size AS size
 FROM (SELECT * FROM files WHERE key % 7 <> 0) a FULL JOIN (SELECT path, size + CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END AS size FROM files WHERE key % 11 <> 0) b ON a.path = b.path WHERE a.size IS DISTINCT FROM b.size"""))
def s22(spark, sf):
    x = X.files(spark, sf)
    a = x.filter("key % 7 != 0").select("path", F.col("size").alias("old"))
    b = x.filter("key % 11 != 0").select("path", (F.col("size") + F.when(F.col("key") % 5 == 0, 1).otherwise(0)).alias("size"))
    action = F.when(F.col("old").isNull(), "add").when(F.col("size").isNull(), "delete").otherwise("update")
    return a.join(b, "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("size"))).select("path", action.alias("action"), "size")


@query("s24_local_roots", with_(LISTING, then="SELECT bucket, name FROM listing"))
def s24(spark, sf):
    x = X.listing(spark, sf).select(F.when(F.col("key") % 2 == 0, "").otherwise(F.col("bucket")).alias("bucket"), F.when(F.col("key") % 2 == 0, F.concat_ws("/", "bucket", "name")).otherwise(F.col("name")).alias("name"))
    return L.rooted(x).select("bucket", "name")


@query("s25_urls", r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)) AS host,
 regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+', '/', 'g'), '/$', ''), '^/', '') AS path FROM pages""")
def s25(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", P.url_host(F.col("url")).alias("host"), P.url_path(F.col("url")).alias("path"))


@query("p01_canonical", with_(LISTING, then="""SELECT key, regexp_replace(regexp_replace(replace(name, '/', CASE WHEN key % 2 = 0 THEN '//' ELSE '/' END) || CASE WHEN key % 3 = 0 THEN '//' ELSE '' END, '/+', '/', 'g'), '/$', '') AS name FROM listing"""))
def p01(spark, sf):
    odd = F.concat(F.when(F.col("key") % 2 == 0, F.replace("name", F.lit("/"), F.lit("//"))).otherwise(F.col("name")), F.when(F.col("key") % 3 == 0, "//").otherwise(""))
    return X.listing(spark, sf).select("key", P.canonical(odd).alias("name"))


@query("p02_parent", with_(LISTING, then="SELECT path, array_to_string(string_split(path, '/')[:-2], '/') AS parent FROM files"))
def p02(spark, sf):
    return X.files(spark, sf).select("path", P.parent(F.col("path")).alias("parent"))


@query("p03_depth", with_(LISTING, then="SELECT CAST(len(string_split(path, '/')) AS INTEGER) AS depth, count(*) AS n FROM files GROUP BY 1"))
def p03(spark, sf):
    return X.files(spark, sf).groupBy(P.depth(F.col("path")).alias("depth")).agg(F.count("*").alias("n"))


@query("p04_prefix_k", with_(LISTING, then="SELECT path, array_to_string(string_split(path, '/')[1:2], '/') AS p2, CAST(NULL AS VARCHAR) AS p9 FROM files"))
def p04(spark, sf):
    return X.files(spark, sf).select("path", P.prefix_at(F.col("path"), 2).alias("p2"), P.prefix_at(F.col("path"), 9).alias("p9"))


@query("p05_subtree", with_(LISTING, then="SELECT path FROM files WHERE path = 'europe/nation_3' OR starts_with(path, 'europe/nation_3/')"))
def p05(spark, sf):
    return X.files(spark, sf).filter(P.in_subtree(F.col("path"), "europe/nation_3")).select("path")


#: Spellings of an operation in both APIs, the HTTP method, and what it is, by hand.
SPELLINGS = [
    ("GET_Object", "GET", "GET"),
    ("GET_Bucket", "GET", "LIST"),
    ("storage.objects.list", None, "LIST"),
    ("storage.buckets.list", "GET", "LIST"),
    ("LIST_Bucket", "GET", "LIST"),
    ("storage.objects.get", None, "GET"),
    ("get_object", None, "GET"),
    ("GET_Object_Metadata", "GET", "GET"),
    ("GET_Bucket_Metadata", "GET", "GET"),
    ("storage.buckets.getIamPolicy", None, "OTHER"),
    ("storage.objects.patch", None, "PUT"),
    ("storage.objects.update", "PATCH", "PUT"),
    ("storage.objects.insert", "POST", "PUT"),
    ("PUT_Object", "PUT", "PUT"),
    ("POST_Object", "POST", "PUT"),
    ("POST_Uploads", "POST", "PUT"),
    ("storage.objects.compose", "POST", "OTHER"),
    ("POST_Nested_Delete_Multi_Objects", "POST", "OTHER"),
    ("HEAD_Object", "HEAD", "HEAD"),
    ("DELETE_Object", "DELETE", "DELETE"),
    ("storage.objects.delete", None, "DELETE"),
    (None, "HEAD", "HEAD"),
    (None, None, "OTHER"),
]


def _nth(values: list, by):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (by % len(values)).cast("int"))


@query("p17_ops", f"SELECT CAST(event_id % {len(SPELLINGS)} AS INTEGER) AS spelling, {[x[2] for x in SPELLINGS]}[event_id % {len(SPELLINGS)} + 1] AS op, count(*) AS n FROM events GROUP BY ALL")
def p17(spark, sf):
    e, i = X.table(spark, sf, "events"), F.col("event_id")
    op = S.usage_op(_nth([x[0] for x in SPELLINGS], i), _nth([x[1] for x in SPELLINGS], i))
    return e.groupBy((i % len(SPELLINGS)).cast("int").alias("spelling"), op.alias("op")).agg(F.count("*").alias("n"))


#: op, raw operation, user agent, prefix, and the price class by hand.
PRICED = [
    ("GET", "GET_Object", "curl/8", "a", "B"),
    ("GET", "GET_Object", "curl/8", "", "A"),
    ("GET", None, None, None, "B"),
    ("HEAD", "HEAD_Object", "curl/8", "", "B"),
    ("LIST", "GET_Bucket", "curl/8", "", "A"),
    ("GET", "GET_Bucket", "curl/8", "a", "A"),
    ("GET", "storage.objects.list", None, "a", "A"),
    ("PUT", "PUT_Object", "curl/8", "a", "A"),
    ("OTHER", "storage.objects.compose", "curl/8", "a", "A"),
    ("OTHER", "POST_Nested_Delete_Multi_Objects", "curl/8", "", "free"),
    ("DELETE", "DELETE_Object", "curl/8", "a", "free"),
    ("PUT", "PUT_Object", "GCS Lifecycle Management", "a", "free"),
    ("LIST", "GET_Bucket", "GCS Lifecycle Management", "", "free"),
    (None, "storage.objects.delete", None, None, "free"),
    (None, None, None, None, "A"),
]


@query("p18_price_class", f"SELECT CAST(event_id % {len(PRICED)} AS INTEGER) AS kind, {[x[4] for x in PRICED]}[event_id % {len(PRICED)} + 1] AS price, count(*) AS n FROM events GROUP BY ALL")
def p18(spark, sf):
    e, i = X.table(spark, sf, "events"), F.col("event_id")
    price = S.price_class(*[_nth([x[k] for x in PRICED], i) for k in range(4)])
    return e.groupBy((i % len(PRICED)).cast("int").alias("kind"), price.alias("price")).agg(F.count("*").alias("n"))


@query("p20_identity", with_(LISTING, then="SELECT key, CASE WHEN key % 2 = 0 THEN 'v' || key WHEN key % 3 = 0 THEN CAST(key * 10 AS VARCHAR) END AS identity FROM listing"))
def p20(spark, sf):
    x = X.listing(spark, sf).select("key", F.when(F.col("key") % 2 == 0, F.concat(F.lit("v"), "key")).alias("version"), F.when((F.col("key") % 2 == 1) & (F.col("key") % 3 == 0), F.col("key") * 10).alias("generation"))
    return L.object_identity(x).select("key", "identity")


#: An occurrence of 3, 8 or 9 characters at each place of names with a long run, a short one, and none.
@query("p21_hex_runs", """WITH names AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN h || '-x' WHEN 1 THEN 'run-' || h WHEN 2 THEN substr(h, 1, 12) || '.tar' ELSE 'model-' || doc_id END AS name FROM (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents)),
 occ AS (SELECT doc_id, name, p, m FROM names, (SELECT unnest(range(0, 24, 3)) AS p), (SELECT unnest([3, 8, 9]) AS m)),
 x AS (SELECT *, length(regexp_extract(substr(name, 1, p), '[0-9a-f]*$')) AS b, length(regexp_extract(substr(name, p + 1), '^[0-9a-f]*')) AS a FROM occ)
 SELECT doc_id, CAST(p AS INTEGER) AS p, CAST(m AS INTEGER) AS m, b >= 1 AND a >= 1 AND b + a >= 16 AND (a > 8 OR m <= a) AS dropped FROM x""")
def p21(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat("h", F.lit("-x"))).when(k == 1, F.concat(F.lit("run-"), "h")).when(k == 2, F.concat(F.substring("h", 1, 12), F.lit(".tar"))).otherwise(F.concat(F.lit("model-"), "doc_id"))
    occ = d.select("doc_id", name.alias("name"), F.explode(F.sequence(F.lit(0), F.lit(23), F.lit(3))).alias("p")).select("*", F.explode(F.array(F.lit(3), F.lit(8), F.lit(9))).alias("m"))
    return occ.select("doc_id", "p", "m", S.hex_dropped(F.col("name"), F.col("p") + 1, F.col("m")).alias("dropped"))


@query("a01_rollup", with_(LISTING, f"""up AS (SELECT path, size, mtime, unnest(({ANC})[1:-2]) AS dir FROM files),
 all_dirs AS (SELECT dir AS path, CAST(sum(size) AS BIGINT) AS size, max(mtime) AS mtime, count(*) AS n_files FROM up GROUP BY dir),
 below AS (SELECT a.path, count(b.path) AS n FROM all_dirs a LEFT JOIN (SELECT path, unnest(({ANC})[1:-2]) AS up FROM all_dirs WHERE path <> '') b ON b.up = a.path GROUP BY a.path),
 kids AS (SELECT par, count(*) AS n FROM (SELECT array_to_string(string_split(path, '/')[:-2], '/') AS par FROM all_dirs WHERE path <> '' UNION ALL SELECT array_to_string(string_split(path, '/')[:-2], '/') FROM files) GROUP BY par)""",
    then="""SELECT CASE WHEN path = '' THEN '.' ELSE path END AS path, size, mtime, n_desc, n_files, n_children, kind,
 CASE WHEN path = '' THEN '' WHEN path NOT LIKE '%/%' THEN '.' ELSE array_to_string(string_split(path, '/')[:-2], '/') END AS parent, CAST(CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS INTEGER) AS depth
 FROM (SELECT d.path, d.size, d.mtime, d.n_files + below.n + 1 AS n_desc, d.n_files, kids.n AS n_children, 'dir' AS kind FROM all_dirs d JOIN below ON d.path = below.path JOIN kids ON kids.par = d.path
 UNION ALL SELECT path, size, mtime, 1, 1, 0, 'file' FROM files)"""))
def a01(spark, sf):
    return R.rollup(X.files(spark, sf))


@query("a02_ancestors", with_(LISTING, DIRS, then="SELECT path FROM dirs"))
def a02(spark, sf):
    return X.files(spark, sf).select(P.parent(F.col("path")).alias("d")).distinct().select(F.explode(P.ancestors(F.col("d"))).alias("path")).distinct()


LAB = f"""deep AS (SELECT path, (SELECT max_by(usr, length(prefix)) FROM labels_ WHERE path = prefix OR starts_with(path, prefix || '/')) AS usr FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[:-2], '/') AS path FROM files))"""
LAB = f"""deep AS (SELECT path, max_by(usr, length(prefix)) AS usr FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[:-2], '/') AS path FROM files) f LEFT JOIN LATERAL (SELECT unnest({ANC}) AS up) ON true LEFT JOIN labels_ ON prefix = up AND up <> '' GROUP BY path)"""
LAB = f"""ups AS (SELECT path, unnest({ANC}) AS up FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[:-2], '/') AS path FROM files)),
deep AS (SELECT path, max_by(usr, length(prefix)) FILTER (WHERE usr IS NOT NULL) AS usr FROM ups LEFT JOIN labels_ ON prefix = up GROUP BY path)"""


def owned(spark, sf):
    """Files with the label of their directory's deepest labelled prefix."""
    x = X.files(spark, sf).withColumn("dir", P.parent(F.col("path")))
    d = R.labelled(x.select(F.col("dir").alias("path")).distinct(), X.labels(spark, sf)).withColumnRenamed("path", "dir")
    return x.join(d, "dir")


OWNED = "owned AS (SELECT files.*, usr FROM files JOIN deep ON deep.path = array_to_string(string_split(files.path, '/')[:-2], '/'))"


@query("j01_deepest_prefix", with_(LISTING, LABELS, LAB, then="SELECT path, usr FROM deep"))
def j01(spark, sf):
    d = X.files(spark, sf).select(P.parent(F.col("path")).alias("path")).distinct()
    return R.labelled(d, X.labels(spark, sf))


@query("a03_labeled", with_(LISTING, LABELS, LAB, OWNED, f"up2 AS (SELECT usr, size, unnest(({ANC})[1:-2]) AS dir FROM owned)", then="SELECT dir AS path, usr, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_files FROM up2 GROUP BY ALL"))
def a03(spark, sf):
    return R.directories(owned(spark, sf), {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")}, ("usr",))


@query("a04_pivot_class", with_(LISTING, DIRS, then="SELECT dir AS path, CAST(sum(size) AS BIGINT) AS size, " + ", ".join(f"CAST(sum(CASE WHEN storage_class_id = {v} THEN size ELSE 0 END) AS BIGINT) AS sum_storage_class_id_{v}" for v in (1, 2, 3)) + " FROM dir_up GROUP BY dir"))
def a04(spark, sf):
    return R.pivoted(X.files(spark, sf), "storage_class_id", [1, 2, 3])


@query("a05_mean_mtime", with_(LISTING, DIRS, then="SELECT dir AS path, CAST(sum(size) AS BIGINT) AS size, CASE WHEN sum(size) > 0 THEN CAST(sum(CAST(size AS HUGEINT) * mtime) AS DOUBLE) / CAST(sum(size) AS DOUBLE) END AS mtime_mean FROM dir_up GROUP BY dir"))
def a05(spark, sf):
    return R.mean_mtime(X.files(spark, sf))


@query("a06_size_hist", with_(LISTING, DIRS, then="""SELECT path, CAST(bin AS INTEGER) AS bin, n, bytes FROM (SELECT dir AS path, least(CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END, 40) AS bin, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM dir_up GROUP BY ALL)"""))
def a06(spark, sf):
    h = R.size_histogram(X.files(spark, sf))
    pairs = F.arrays_zip("size_hist_n", "size_hist_bytes")
    return h.select("path", F.posexplode(pairs).alias("bin", "x")).filter("x.size_hist_n > 0").select("path", "bin", F.col("x.size_hist_n").alias("n"), F.col("x.size_hist_bytes").alias("bytes"))


@query("a07_side_max", with_(LISTING, REQUESTS, f"last AS (SELECT path, max(ts_s) AS last_ts FROM requests GROUP BY path), up AS (SELECT unnest({ANC}) AS dir, last_ts FROM last)", then="SELECT dir AS path, max(last_ts) AS last_ts FROM up GROUP BY dir"))
def a07(spark, sf):
    side = X.requests(spark, sf).groupBy("path").agg(F.max("ts_s").alias("last_ts"))
    return R.subtree_max(X.files(spark, sf), side, "last_ts")


@query("j04_side", with_(LISTING, REQUESTS, "last AS (SELECT path, max(ts_s) AS last_ts FROM requests GROUP BY path)", then="SELECT path, size, last_ts FROM files LEFT JOIN last USING (path)"))
def j04(spark, sf):
    side = X.requests(spark, sf).groupBy("path").agg(F.max("ts_s").alias("last_ts"))
    return R.with_side(X.files(spark, sf).select("path", "size"), side)


@query("a12_store", with_(LISTING, LABELS, LAB, OWNED, f"up2 AS (SELECT usr, size, mtime, storage_class_id, unnest(({ANC})[1:-2]) AS dir FROM owned)", then="""SELECT dir AS path, usr, CAST(sum(size) AS BIGINT) AS b, count(*) AS o, CAST(sum(CAST(size AS HUGEINT) * mtime) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS wts,
 CAST(sum(CASE WHEN storage_class_id = 2 THEN size ELSE 0 END) AS BIGINT) AS c2, CAST(sum(CASE WHEN storage_class_id = 3 THEN size ELSE 0 END) AS BIGINT) AS c3, max(mtime) AS mtime, min(mtime) AS created FROM up2 GROUP BY ALL"""))
def a12(spark, sf):
    m = {"b": (F.col("size"), "sum"), "o": (F.lit(1).cast("long"), "sum"), "w": (F.col("size").cast("decimal(19,0)") * F.col("mtime").cast("decimal(19,0)"), "sum"), "mtime": (F.col("mtime"), "max"), "c": (-F.col("mtime"), "max")}
    m |= {f"c{k}": (F.when(F.col("storage_class_id") == k, F.col("size")).otherwise(0), "sum") for k in (2, 3)}
    return R.directories(owned(spark, sf), m, ("usr",)).select("path", "usr", "b", "o", (F.col("w").cast("double") / F.col("b").cast("double")).alias("wts"), "c2", "c3", "mtime", (-F.col("c")).alias("created"))


@query("a29_attribution", with_(LISTING, LABELS, LAB, OWNED, then="SELECT coalesce(usr, '(none)') AS usr, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM owned GROUP BY 1"))
def a29(spark, sf):
    return owned(spark, sf).groupBy(F.coalesce("usr", F.lit("(none)")).alias("usr")).agg(F.sum("size").alias("bytes"), F.count("*").alias("objects"))


@query("a30_totals", with_(LISTING, then="SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects, " + ", ".join(f"CAST(sum(CASE WHEN storage_class_id = {k} THEN size ELSE 0 END) AS BIGINT) AS c{k}" for k in (1, 2, 3, 4)) + " FROM files"))
def a30(spark, sf):
    return R.total_by_class(X.files(spark, sf)).select("bytes", "objects", "c1", "c2", "c3", "c4")


@query("a31_prefix_stats", with_(LISTING, LABELS, then="SELECT prefix, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM labels_ JOIN files ON starts_with(path, prefix || '/') GROUP BY prefix"))
def a31(spark, sf):
    d = R.directories(X.files(spark, sf), {"bytes": (F.col("size"), "sum"), "objects": (F.lit(1).cast("long"), "sum")})
    return X.labels(spark, sf).select("prefix").join(d.withColumnRenamed("path", "prefix"), "prefix")


@query("o01_path_sort", with_(LISTING, then="SELECT path, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY len(string_split(path, '/')), path) AS rn FROM files"))
def o01(spark, sf):
    from pyspark.sql import Window

    return X.files(spark, sf).select("path", F.row_number().over(Window.partitionBy(F.substring_index("path", "/", 1)).orderBy(P.depth(F.col("path")), "path")).cast("long").alias("rn"))


@query("o02_size_bucket", with_(LISTING, then="SELECT path, CAST(floor(log2(size)) AS INTEGER) AS rank FROM files WHERE size > 0"))
def o02(spark, sf):
    return X.files(spark, sf).filter("size > 0").select("path", S.size_rank(F.col("size")).alias("rank"))


@query("o03_trigrams", """SELECT tri, count(*) AS n FROM (SELECT DISTINCT page_id, ascii(substr(u, i, 1)) * 65536 + ascii(substr(u, i + 1, 1)) * 256 + ascii(substr(u, i + 2, 1)) AS tri
 FROM (SELECT page_id, lower(url) AS u, unnest(range(1, length(url) - 1)) AS i FROM pages)) GROUP BY tri""")
def o03(spark, sf):
    return X.table(spark, sf, "pages").select(F.explode(S.trigrams(F.col("url"))).alias("tri")).groupBy("tri").agg(F.count("*").alias("n"))


@query("o06_largest_files", with_(LISTING, then="SELECT path, size FROM files WHERE starts_with(path, 'asia/') ORDER BY size DESC, path LIMIT 51"))
def o06(spark, sf):
    from heapscope.operators.views import largest

    return largest(X.files(spark, sf), "asia", 50).select("path", "size")


@query("o06_largest_dirs", with_(LISTING, DIRS, then="SELECT path, size FROM dirs WHERE starts_with(path, 'asia/') ORDER BY size DESC, path LIMIT 21"))
def o06d(spark, sf):
    from heapscope.operators.views import largest

    d = R.directories(X.files(spark, sf), {"size": (F.col("size"), "sum")})
    return largest(d, "asia", 20, own=False).select("path", "size")


@query("f12_ngrams", with_(LISTING, "n AS (SELECT DISTINCT bucket FROM listing), g AS (SELECT DISTINCT bucket, substr(bucket, i, k) AS g FROM (SELECT bucket, unnest(range(1, length(bucket) + 1)) AS i FROM n), (SELECT unnest([1, 2]) AS k) WHERE i + k - 1 <= length(bucket))", then="SELECT bucket, g FROM g"))
def f12(spark, sf):
    return X.listing(spark, sf).select("bucket").distinct().select("bucket", F.explode(S.ngrams(F.col("bucket"))).alias("g"))


@query("f13_suffixes", with_(LISTING, "n AS (SELECT DISTINCT split_part(name, '/', 1) AS nation FROM listing)", then="SELECT nation, substr(nation, i) AS s FROM (SELECT nation, unnest(range(1, length(nation) - 1)) AS i FROM n)"))
def f13(spark, sf):
    return X.listing(spark, sf).select(F.substring_index("name", "/", 1).alias("nation")).distinct().select("nation", F.explode(S.suffixes(F.col("nation"))).alias("s"))


@query("f15_scan_ids", "SELECT s AS scan_id, CAST(epoch(t) AS BIGINT) AS t FROM (VALUES ('2024-01-02', TIMESTAMP '2024-01-02'), ('2024-01-02T0345', TIMESTAMP '2024-01-02 03:45:00')) v(s, t)")
def f15(spark, sf):
    return spark.createDataFrame([("2024-01-02",), ("2024-01-02T0345",)], "scan_id string").select("scan_id", S.scan_time(F.col("scan_id")).alias("t"))


#: The same customer's name as a login, an address, with signs at its ends, and with underscores.
@query("f16_usernames", r"""SELECT c_custkey, trim(regexp_replace(lower(split_part(trim(raw), '@', 1)), '[^a-z0-9_-]+', '-', 'g'), '-') AS u FROM (SELECT c_custkey,
 CASE c_custkey % 5 WHEN 0 THEN c_name || '@Example.org' WHEN 1 THEN '  First.' || c_name || ' ' WHEN 2 THEN '--' || c_name || '!!' WHEN 3 THEN 'a_b_' || c_custkey || '@x@y' ELSE 'Ä' || c_name || '--x' END AS raw FROM customer)""")
def f16(spark, sf):
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    raw = F.when(k == 0, F.concat(name, F.lit("@Example.org"))).when(k == 1, F.concat(F.lit("  First."), name, F.lit(" "))).when(k == 2, F.concat(F.lit("--"), name, F.lit("!!")))
    raw = raw.when(k == 3, F.concat(F.lit("a_b_"), "c_custkey", F.lit("@x@y"))).otherwise(F.concat(F.lit("Ä"), name, F.lit("--x")))
    return X.table(spark, sf, "customer").select("c_custkey", S.username(raw).alias("u"))


@query("s20_digest", with_(LISTING, then="SELECT bucket, count(*) AS n, true AS same FROM listing GROUP BY bucket"))
def s20(spark, sf):
    from heapscope.sources.stores import digest

    x = X.listing(spark, sf).select("bucket", "name", "size_bytes")
    return digest(x, ["bucket"]).join(digest(x.repartition(5), ["bucket"]).withColumnsRenamed({"digest": "d2", "n": "n2"}), "bucket").select("bucket", "n", (F.col("digest") == F.col("d2")).alias("same"))
