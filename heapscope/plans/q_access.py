"""Queries over access logs and ages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.operators import access as A
from heapscope.operators import age as G
from heapscope.operators import reports as RP
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import ANC, DIRS, LABELS, LISTING, REQUESTS, with_
from heapscope.plans.q_listing import LAB, OWNED, owned
from heapscope.plans.registry import query

HOUR = "CAST(ts_s - ts_s % 3600 AS BIGINT)"
#: Middle of January 2024.
CUT = 1705276800


@query("p19_as_of", with_(LISTING, REQUESTS, then=f"SELECT 'exact' AS kind, count(*) AS n FROM requests WHERE ts_s < {CUT} UNION ALL SELECT 'minute', count(*) FROM requests WHERE ts_s + 60 <= {CUT}"))
def p19(spark, sf):
    r = X.requests(spark, sf)
    count = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(A.as_of(r, CUT), "exact").unionByName(count(A.as_of(r, CUT, 60), "minute"))


LEAF = f"leaf AS (SELECT path, {HOUR} AS hour, op, count(*) AS n_ops, sum(bytes_out) AS bytes_out, count(DISTINCT requester) AS n_requesters, max(ts_s) AS last_ts FROM requests GROUP BY ALL)"


@query("a08_access_tree", with_(LISTING, REQUESTS, LEAF, f"up AS (SELECT unnest({ANC}) AS p, * FROM leaf)", then="SELECT p AS path, hour, op, CAST(sum(n_ops) AS BIGINT) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(n_requesters) AS BIGINT) AS n_requesters, max(last_ts) AS last_ts FROM up GROUP BY p, hour, op"))
def a08(spark, sf):
    return A.tree(X.requests(spark, sf))


@query("a08_distinct_tree", with_(LISTING, REQUESTS, f"up AS (SELECT unnest({ANC}) AS p, ts_s, op, requester FROM requests)", then=f"SELECT p AS path, {HOUR} AS hour, op, count(DISTINCT requester) AS n_requesters FROM up GROUP BY ALL"))
def a08d(spark, sf):
    return A.distinct_tree(X.requests(spark, sf))


@query("a09_read_sizes", with_(LISTING, REQUESTS, then=f"SELECT bucket, array_to_string(string_split(path, '/')[1:4], '/') AS prefix, {HOUR} AS bin, CAST(CASE WHEN bytes_out > 0 THEN round(log2(CAST(bytes_out AS DOUBLE)) * 50) ELSE -9999 END AS INTEGER) AS lg2, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM requests WHERE op IN ('GET', 'HEAD') GROUP BY ALL"))
def a09(spark, sf):
    """Of keys written with several slashes, and one at the end, as logs have them."""
    odd = F.when(F.col("event_id") % 3 == 0, F.concat(F.regexp_replace("path", "/", "//"), F.lit("/"))).otherwise(F.col("path"))
    return A.read_sizes(X.requests(spark, sf).withColumn("path", odd))


@query("a10_requesters", with_(LISTING, REQUESTS, then="SELECT bucket, requester, op, CAST(ts_s - ts_s % 86400 AS BIGINT) AS day, count(*) AS n_ops, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM requests GROUP BY ALL"))
def a10(spark, sf):
    return A.requesters(X.requests(spark, sf))


AGENTS = ["python-gcsfs/2024.1 (linux)", "Go-http-client/2.0", "GCS Lifecycle Management", "curl/8.5.0"]
#: Reads of every fifth event are of the bucket itself; a quarter of requests is the lifecycle engine's.
READERS = f"""r AS (SELECT CAST(ts_s // 86400 AS BIGINT) AS day, bucket, op, {AGENTS}[event_id % 4 + 1] AS agent, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'p' END AS prefix FROM requests),
c AS (SELECT *, CASE WHEN agent LIKE 'GCS%' OR op = 'DELETE' THEN 'free' WHEN op = 'LIST' OR op = 'GET' AND prefix = '' THEN 'A' WHEN op IN ('GET', 'HEAD') THEN 'B' ELSE 'A' END AS cls FROM r),
d AS (SELECT count(DISTINCT day) AS days FROM r),
g AS (SELECT ['python-gcsfs', 'Go-http-client', 'GCS', 'curl'][list_position({AGENTS}, agent)] AS client, bucket, count(*) FILTER (cls = 'A') / max(days) AS a, count(*) FILTER (cls = 'B') / max(days) AS b, count(*) / max(days) AS n FROM c, d GROUP BY ALL),
k AS (SELECT *, (a * 5.0 + b * 0.4) / 1e6 AS usd, row_number() OVER (ORDER BY a * 5.0 + b * 0.4 DESC, client, bucket) AS rn FROM g),
t AS (SELECT CASE WHEN rn <= 6 THEN client ELSE '(' || ((SELECT count(*) FROM g) - 6) || ' others)' END AS client, CASE WHEN rn <= 6 THEN bucket ELSE '' END AS bucket, a, b, n, usd FROM k)"""


@query("a10_prices", with_(LISTING, REQUESTS, READERS, then="SELECT client, bucket, round(sum(a), 6) AS a_per_day, round(sum(b), 6) AS b_per_day, round(sum(n), 6) AS per_day, round(sum(usd), 9) AS usd_per_day FROM t GROUP BY ALL"))
def a10p(spark, sf):
    i = F.col("event_id")
    agent = F.get(F.array(*map(F.lit, AGENTS)), (i % 4).cast("int"))
    r = X.requests(spark, sf).select(F.expr("ts_s div 86400").alias("day"), "bucket", "op", F.lit(None).cast("string").alias("op_raw"), agent.alias("user_agent"), F.when(i % 5 == 0, "").otherwise("p").alias("prefix"))
    r = r.groupBy(*r.columns).agg(F.count("*").alias("n")).withColumn("client", A.client(F.col("user_agent")))
    out = A.readers(r, ["client", "bucket"], top=6)
    return out.select("client", "bucket", *[F.round(c, 9 if c[0] == "u" else 6).alias(c) for c in out.columns[2:]])


def _hosts(spark, sf):
    r = X.requests(spark, sf).filter("event_id % 10 = 0")
    return r.select((F.col("requester") % 50).alias("ip"), F.concat(F.lit("h"), F.col("event_id") % 40).alias("host"), (F.col("ts_s") + 30).alias("ts_s"))


@query("j12_nearest_host", with_(LISTING, REQUESTS, "hosts AS (SELECT requester % 50 AS ip, 'h' || (event_id % 40) AS host, ts_s + 30 AS host_ts FROM requests WHERE event_id % 10 = 0)", "near AS (SELECT event_id, host, abs(ts_s - host_ts) AS gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(ts_s - host_ts), host) AS rn FROM requests JOIN hosts ON requester % 50 = ip AND abs(ts_s - host_ts) <= 3600)", then="SELECT r.event_id, host, gap FROM requests r LEFT JOIN near n ON n.event_id = r.event_id AND rn = 1"))
def j12(spark, sf):
    r = X.requests(spark, sf).withColumn("ip", F.col("requester") % 50)
    return A.nearest_host(r, _hosts(spark, sf), 3600).select("event_id", "host", "gap")


TASKS = f"tasks AS (SELECT {HOUR} AS hour, requester % 50 AS ip, 't' || (event_id % 7) AS task, count(*) AS n FROM requests WHERE event_id % 3 = 0 GROUP BY ALL), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY hour, ip) AS share FROM tasks)"


def _tasks(spark, sf):
    r = X.requests(spark, sf).filter("event_id % 3 = 0")
    return A.shares(r.groupBy(A.hour(F.col("ts_s")).alias("hour"), (F.col("requester") % 50).alias("ip"), F.concat(F.lit("t"), F.col("event_id") % 7).alias("task")).agg(F.count("*").alias("n")))


@query("j13_shares", with_(LISTING, REQUESTS, TASKS, then="SELECT hour, ip, task, n, round(share, 9) AS share FROM shares"))
def j13(spark, sf):
    return _tasks(spark, sf).withColumn("share", F.round("share", 9))


@query("a11_attribution", with_(LISTING, REQUESTS, TASKS, then=f"SELECT task, round(sum(coalesce(share, 1.0)), 4) AS n_ops, round(sum(bytes_out * coalesce(share, 1.0)), 2) AS bytes_out FROM requests r LEFT JOIN shares s ON s.hour = {HOUR} AND s.ip = requester % 50 GROUP BY task"))
def a11(spark, sf):
    r = X.requests(spark, sf).withColumn("ip", F.col("requester") % 50)
    return A.attributed(r, _tasks(spark, sf)).select("task", F.round("n_ops", 4).alias("n_ops"), F.round("bytes_out", 2).alias("bytes_out"))


@query("t06_stalled", with_(LISTING, REQUESTS, then="SELECT bucket, max(ts_s) AS last_ts FROM requests GROUP BY bucket HAVING 1706659200 - max(ts_s) > 30"))
def t06(spark, sf):
    return A.stalled(X.requests(spark, sf), 1706659200, 30)


@query("a13_age_strata", with_(LISTING, LABELS, LAB, OWNED, then="SELECT CAST(mtime - mtime % 86400 AS BIGINT) AS day, split_part(path, '/', 1) AS seg, usr, CAST(sum(size) AS BIGINT) AS b, count(*) AS o FROM owned GROUP BY ALL"))
def a13(spark, sf):
    return G.strata(owned(spark, sf).withColumn("seg", F.substring_index("path", "/", 1)), ["seg", "usr"])


AGE = "age AS (SELECT dir AS path, CAST(mtime - mtime % {w} AS BIGINT) AS bin, CAST(sum(size) AS BIGINT) AS b, count(*) AS o FROM dir_up GROUP BY ALL)"


@query("a14_age_index", with_(LISTING, DIRS, AGE.format(w=86400), then="SELECT age.* FROM age WHERE path IN (SELECT path FROM dirs WHERE size >= pow(2, round(log2((SELECT size FROM dirs WHERE path = ''))) - 12))"))
def a14(spark, sf):
    return G.index(X.files(spark, sf), 86400, floor_bits=12)


@query("a15_age_pyramid", with_(LISTING, DIRS, AGE.format(w=3600), then=" UNION ALL ".join(f"SELECT '{n}' AS tier, path, CAST(bin - bin % {w} AS BIGINT) AS bin, CAST(sum(b) AS BIGINT) AS b, CAST(sum(o) AS BIGINT) AS o FROM age GROUP BY ALL" for n, w in G.WIDTHS.items())))
def a15(spark, sf):
    return G.pyramid(G.index(X.files(spark, sf), 3600, floor_bits=None))


@query("x07_age_tier", with_(LISTING, DIRS, AGE.format(w=3600), then="SELECT CAST(bin - bin % 691200 AS BIGINT) AS bin, CAST(sum(b) AS BIGINT) AS b, CAST(sum(o) AS BIGINT) AS o FROM age WHERE path = 'asia' GROUP BY ALL"))
def x07(spark, sf):
    tier = G.tier_for(7 * 365 * 86400, 400)
    p = G.pyramid(G.index(X.files(spark, sf).filter(F.col("path").startswith("asia/")), 3600, floor_bits=None), {tier: G.WIDTHS[tier]})
    return p.filter("path = 'asia'").select("bin", "b", "o")


@query("e03_age_check", with_(LISTING, then="SELECT CAST(0 AS BIGINT) AS wrong"))
def e03(spark, sf):
    f = X.files(spark, sf)
    a = G.index(f, 86400, None).groupBy("path").agg(F.sum("b").alias("b"))
    from heapscope.operators.rollup import directories

    d = directories(f, {"size": (F.col("size"), "sum")})
    return a.join(d, "path", "full_outer").filter(~F.col("b").eqNullSafe(F.col("size"))).agg(F.count("*").alias("wrong"))


@query("a32_percentiles", "SELECT event_type, " + ", ".join(f"max(CASE WHEN rn = least(n, CAST(floor(CAST({q} AS DOUBLE) * n) AS BIGINT) + 1) THEN value END) AS p{int(q * 100)}" for q in (0.5, 0.9, 1.0)) + " FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def a32(spark, sf):
    return RP.nearest_rank(X.table(spark, sf, "events"), "event_type", "value", [0.5, 0.9, 1.0])


@query("a33_costs", with_(LISTING, then="SELECT split_part(path, '/', 1) AS bucket, round(CAST(sum(CASE storage_class_id WHEN 1 THEN size * 20 WHEN 2 THEN size * 10 ELSE size * 4 END) AS DOUBLE) / 1e12, 6) AS cost FROM files GROUP BY 1"))
def a33(spark, sf):
    return RP.costs(X.files(spark, sf).withColumn("bucket", F.substring_index("path", "/", 1)), "bucket", {1: 20, 2: 10, 3: 4})


@query("a33_busy_seconds", "SELECT user_id, CAST(sum(CASE WHEN prev IS NULL OR s > prev THEN e - s WHEN e > prev THEN e - prev ELSE 0 END) AS BIGINT) AS busy FROM (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS e FROM events)) GROUP BY user_id")
def a33b(spark, sf):
    from heapscope.functions.scalars import epoch

    e = X.table(spark, sf, "events").select("user_id", epoch(F.col("ts")).alias("s")).withColumn("e", F.col("s") + 7200)
    return RP.union_seconds(e, "user_id")


@query("a34_top_n_other", with_(LISTING, LABELS, LAB, OWNED, "s AS (SELECT coalesce(usr, '-') AS usr, sum(size) AS b FROM owned GROUP BY 1)", then="SELECT CASE WHEN rn <= 5 THEN usr ELSE '(other)' END AS usr, CAST(sum(b) AS BIGINT) AS b FROM (SELECT *, row_number() OVER (ORDER BY b DESC, usr) AS rn FROM s) GROUP BY 1"))
def a34(spark, sf):
    from heapscope.operators.views import top_with_other

    s = owned(spark, sf).groupBy(F.coalesce("usr", F.lit("-")).alias("usr")).agg(F.sum("size").alias("b"))
    return top_with_other(s, "b", "usr", 5)


DAILY = "daily AS (SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS b FROM orders GROUP BY 1), totals AS (SELECT day, CAST(sum(b) OVER (ORDER BY day) AS BIGINT) AS total FROM daily)"


#: Bytes of each region by day, from the day before the last order back; a region that has stopped growing; and quotas with
#: room for some, for none, and for a group without an older reading.
RUNWAY = """h AS (SELECT bucket AS grp, created_s // 86400 * 86400 + 3600 * (key % 5) AS t, sum(size_bytes) AS b FROM listing GROUP BY ALL),
 hist AS (SELECT grp, t, CAST(sum(b) OVER (PARTITION BY grp ORDER BY t) AS BIGINT) AS v FROM h UNION ALL SELECT 'flat', t, 1000 FROM h WHERE grp = 'asia' UNION ALL SELECT 'fresh', 1000000000, 5),
 lastr AS (SELECT grp, max(t) AS t1, arg_max(v, t) AS used FROM hist GROUP BY grp),
 quotas AS (SELECT grp, CASE WHEN grp = 'europe' THEN used ELSE used * 2 + 10 END AS quota FROM lastr),
 then_ AS (SELECT l.grp, l.t1, l.used, w, max(h.t) AS t0, arg_max(h.v, h.t) AS v0 FROM lastr l JOIN hist h ON h.grp = l.grp, (SELECT unnest([1, 3, 7]) AS w) WHERE h.t <= l.t1 - w * 86400 GROUP BY ALL),
 rates AS (SELECT grp, w, CAST(used - v0 AS DOUBLE) / (CAST(t1 - t0 AS DOUBLE) / 86400.0) AS r FROM then_),
 best AS (SELECT grp, r, w FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r DESC, w DESC) AS rn FROM rates) WHERE rn = 1)"""


@query("a35_runway", with_(LISTING, RUNWAY, then="SELECT l.grp, l.used, round(r, 4) AS growth, CAST(w AS INTEGER) AS window_d, CASE WHEN quota <= used THEN 0.0 WHEN r > 0 THEN round((quota - used) / r, 6) ELSE CAST('infinity' AS DOUBLE) END AS days FROM lastr l JOIN quotas USING (grp) LEFT JOIN best USING (grp)"))
def a35(spark, sf):
    from pyspark.sql import Window

    x = X.listing(spark, sf)
    h = x.groupBy(F.col("bucket").alias("grp"), F.expr("created_s div 86400 * 86400 + 3600 * (key % 5)").alias("t")).agg(F.sum("size_bytes").alias("b"))
    grown = h.select("grp", "t", F.sum("b").over(Window.partitionBy("grp").orderBy("t")).alias("v"))  # a row for each day and region
    flat = h.filter("grp = 'asia'").select(F.lit("flat").alias("grp"), "t", F.lit(1000).cast("long").alias("v"))
    hist = grown.unionByName(flat).unionByName(spark.createDataFrame([("fresh", 1_000_000_000, 5)], "grp string, t long, v long"))
    last = hist.groupBy("grp").agg(F.max_by("v", "t").alias("u"))
    quotas = last.select("grp", F.when(F.col("grp") == "europe", F.col("u")).otherwise(F.col("u") * 2 + 10).alias("quota"))
    out = RP.runway(hist, quotas, "grp")
    return out.withColumns({"growth": F.round("growth", 4), "days": F.when(F.col("days") < float("inf"), F.round("days", 6)).otherwise(F.col("days"))})


@query("a36_daily_spine", "WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT user_id, min(day) AS first FROM d GROUP BY 1), spine AS (SELECT unnest(range((SELECT min(day) FROM d), (SELECT max(day) FROM d) + 1)) AS day) SELECT f.user_id, spine.day, CASE WHEN spine.day < first THEN NULL ELSE coalesce(n, 0) END AS n FROM f CROSS JOIN spine LEFT JOIN d ON d.user_id = f.user_id AND d.day = spine.day")
def a36(spark, sf):
    from heapscope.functions.scalars import epoch

    e = X.table(spark, sf, "events").groupBy("user_id", F.expr("x div 86400").alias("day") if False else (epoch(F.col("ts")) / 86400).cast("long").alias("day")).agg(F.count("*").alias("n"))
    return RP.daily_spine(e, "user_id")


@query("w15_day_deltas", with_(DAILY, then="SELECT day, b, b - lag(b) OVER (ORDER BY day) AS delta FROM daily"))
def w15(spark, sf):
    from heapscope.functions.scalars import epoch

    o = X.table(spark, sf, "orders").select((epoch(F.col("o_orderdate")) / 86400).cast("long").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("b"))
    return RP.deltas(o.groupBy("day").agg(F.sum("b").alias("b")))


@query("e05_streaks", "WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), h AS (SELECT user_id, event_type AS head FROM o WHERE rn = 1) SELECT o.user_id, head, count(*) AS streak FROM o JOIN h ON o.user_id = h.user_id WHERE rn < coalesce((SELECT min(x.rn) FROM o x WHERE x.user_id = o.user_id AND x.event_type <> head), 1000000) GROUP BY ALL")
def e05(spark, sf):
    return RP.streaks(X.table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("w09_name_ranks", with_(LISTING, "s AS (SELECT split_part(name, '/', 2) AS name, CAST(sum(size_bytes) AS BIGINT) AS b FROM listing GROUP BY 1)", then="SELECT name, b, row_number() OVER (ORDER BY b DESC, name) - 1 AS id FROM s"))
def w09(spark, sf):
    s = X.listing(spark, sf).groupBy(F.split_part("name", F.lit("/"), F.lit(2)).alias("name")).agg(F.sum("size_bytes").alias("b"))
    return RP.dense_ids(s, "b", "name")
