"""The scalar and aggregate functions that other queries use, each group by itself, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heapscope.functions.scalars import epoch
from heapscope.plans import fixtures as X
from heapscope.plans.fixtures import LISTING, with_
from heapscope.plans.registry import query


@query("f01_strings", with_(LISTING, then="""SELECT key, strpos(name, '/') AS at, substr(name, 3, 5) AS part, length(name) AS n, reverse(bucket) AS back, rtrim(name, 'tvg') AS cut, ltrim(name, 'abcn') AS rest, left(name, 4) AS head, right(name, 3) AS tail,
 replace(name, '/', '::') AS swapped, upper(bucket) AS big, starts_with(name, 'nation_1') AS begins, suffix(name, '.csv') AS ends, contains(name, '/c1') AS has, concat_ws('|', bucket, segment) AS joined, lpad(CAST(cust AS VARCHAR), 8, '0') AS padded, split_part(name, '/', 2) AS second FROM listing"""))
def f01(spark, sf):
    x = X.listing(spark, sf)
    cust = F.col("cust").cast("string")
    return x.select(
        "key", F.instr("name", "/").cast("long").alias("at"), F.substring("name", 3, 5).alias("part"), F.length("name").cast("long").alias("n"), F.reverse("bucket").alias("back"), F.rtrim("name", F.lit("tvg")).alias("cut"),
        F.ltrim("name", F.lit("abcn")).alias("rest"), F.left("name", F.lit(4)).alias("head"), F.right("name", F.lit(3)).alias("tail"), F.replace("name", F.lit("/"), F.lit("::")).alias("swapped"), F.upper("bucket").alias("big"),
        F.startswith("name", F.lit("nation_1")).alias("begins"), F.endswith("name", F.lit(".csv")).alias("ends"), F.contains("name", F.lit("/c1")).alias("has"), F.concat_ws("|", "bucket", "segment").alias("joined"),
        F.when(F.length(cust) < 8, F.lpad(cust, 8, "0")).otherwise(F.substring(cust, 1, 8)).alias("padded"), F.split_part("name", F.lit("/"), F.lit(2)).alias("second"),
    )


@query("f02_regex", with_(LISTING, then=r"""SELECT key, regexp_extract(name, '/c([0-9]+)/', 1) AS cust, regexp_replace(name, '[0-9]+', '#', 'g') AS shape, regexp_matches(name, 'URGENT', 'i') AS urgent, regexp_full_match(name, '.*\.(csv|log)') AS texty, len(regexp_extract_all(name, '[0-9]+')) AS numbers FROM listing"""))
def f02(spark, sf):
    n = F.col("name")
    return X.listing(spark, sf).select("key", F.regexp_extract(n, "/c([0-9]+)/", 1).alias("cust"), F.regexp_replace(n, "[0-9]+", "#").alias("shape"), n.rlike("(?i)URGENT").alias("urgent"), n.rlike(r"^(?:.*\.(csv|log))$").alias("texty"), F.regexp_count(n, F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("f04_times", """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, date_trunc('hour', ts) AS hour, CAST(date_trunc('month', ts) AS DATE) AS month, time_bucket(INTERVAL '15 minutes', ts) AS quarter, strftime(ts, '%Y-%m-%dT%H%M') AS label,
 CAST(year(ts) AS INTEGER) AS y, CAST(dayofyear(ts) AS INTEGER) AS yday, date_diff('day', TIMESTAMP '2024-01-01', ts) AS days, to_timestamp(floor(epoch(ts))) AT TIME ZONE 'UTC' AS whole FROM events""")
def f04(spark, sf):
    e, ts = X.table(spark, sf, "events"), F.col("ts")
    s = epoch(ts)
    us = F.unix_micros(ts.cast("timestamp"))
    quarter = F.timestamp_seconds(s - F.pmod(s, F.lit(900))).cast("timestamp_ntz")
    return e.select(
        "event_id", s.alias("s"), F.floor(us / 1000).cast("long").alias("ms"), us.alias("us"), F.date_trunc("hour", ts.cast("timestamp")).cast("timestamp_ntz").alias("hour"), F.trunc(ts.cast("date"), "month").alias("month"),
        quarter.alias("quarter"), F.date_format(ts, "yyyy-MM-dd'T'HHmm").alias("label"), F.year(ts).alias("y"), F.dayofyear(ts).alias("yday"), F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"), F.timestamp_seconds(s).cast("timestamp_ntz").alias("whole"),
    )


@query("f05_numbers", with_(LISTING, then="""SELECT key, floor(size_bytes / 7.0) AS fl, round(size_bytes / 1000.0, 1) AS rd, round_even(size_bytes / 200.0, 0) AS ev, floor(log2(size_bytes)) AS lg, greatest(cust, nation) AS hi, least(cust, nation) AS lo, abs(cust - nation * 100) AS gap, size_bytes // 1000 AS q, size_bytes % 1000 AS r,
 length(bin(size_bytes)) AS digits, xor(cust, nation) AS x, (size_bytes >> 5) AS down, (nation << 4) AS up, (cust & 15) AS low, pow(2.0, nation) AS p, sign(cust - 500) AS sg FROM listing"""))
def f05(spark, sf):
    b, c, n = F.col("size_bytes"), F.col("cust"), F.col("nation")
    return X.listing(spark, sf).select(
        "key", F.floor(b / 7.0).cast("double").alias("fl"), F.round(b / 1000.0, 1).alias("rd"), F.bround(b / 200.0, 0).alias("ev"), F.floor(F.log2(b.cast("double"))).cast("double").alias("lg"), F.greatest(c, n).alias("hi"), F.least(c, n).alias("lo"), F.abs(c - n * 100).alias("gap"),
        F.expr("size_bytes div 1000").alias("q"), (b % 1000).alias("r"), F.length(F.bin(b)).cast("long").alias("digits"), c.bitwiseXOR(n).alias("x"), F.shiftright(b, 5).alias("down"), F.shiftleft(n, 4).alias("up"), c.bitwiseAND(F.lit(15)).alias("low"), F.pow(F.lit(2.0), n).alias("p"), F.signum(c - 500).cast("byte").alias("sg"),
    )


_SEG = "string_split(name, '/')"


@query("f06_lists", with_(LISTING, then=f"""SELECT key, array_to_string({_SEG}[1:2], ',') AS firsts, len({_SEG}) AS n, array_to_string(list_sort({_SEG}), ',') AS sorted, array_to_string(list_filter({_SEG}, lambda s: contains(s, '1')), ',') AS ones, array_to_string(list_transform({_SEG}, lambda s: upper(s)), ',') AS big, list_contains({_SEG}, 'low') AS low, list_position({_SEG}, 'low') AS at, array_to_string(list_reverse({_SEG}), '<') AS back,
 array_to_string(list_sort(list_distinct([nation % 2, nation % 3, 1])), ',') AS few, CAST(list_sum([cust, nation, 1]) AS BIGINT) AS total, array_to_string(list_concat({_SEG}[-1:], [bucket]), ',') AS ends, array_to_string(flatten([[cust], [nation, 2]]), ',') AS flat FROM listing"""))
def f06(spark, sf):
    s, n, c = F.split("name", "/"), F.col("nation"), F.col("cust")
    one = F.lit(1).cast("long")
    few = F.array_sort(F.array_distinct(F.array(n % 2, n % 3, one)))
    line = lambda x: F.array_join(x.cast("array<string>"), ",")
    return X.listing(spark, sf).select(
        "key", line(F.slice(s, 1, 2)).alias("firsts"), F.size(s).cast("long").alias("n"), line(F.array_sort(s)).alias("sorted"), line(F.filter(s, lambda x: x.contains("1"))).alias("ones"), line(F.transform(s, F.upper)).alias("big"), F.array_contains(s, "low").alias("low"),
        F.nullif(F.array_position(s, "low"), F.lit(0)).cast("int").alias("at"), F.array_join(F.reverse(s), "<").alias("back"), line(few).alias("few"), F.aggregate(F.array(c, n, one), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        line(F.concat(F.slice(s, -1, 1), F.array("bucket"))).alias("ends"), line(F.flatten(F.array(F.array(c), F.array(n, F.lit(2).cast("long"))))).alias("flat"),
    )


@query("f07_structs", with_(LISTING, then="SELECT key, s.b AS b, s.n AS n, k.who AS who, k.x AS x FROM (SELECT key, {'b': bucket, 'n': nation} AS s, unnest([{'who': segment, 'x': cust}, {'who': bucket, 'x': nation}]) AS k FROM listing)"))
def f07(spark, sf):
    x = X.listing(spark, sf)
    pairs = F.array(F.struct(F.col("segment").alias("who"), F.col("cust").alias("x")), F.struct(F.col("bucket").alias("who"), F.col("nation").alias("x")))
    return x.select("key", F.struct(F.col("bucket").alias("b"), F.col("nation").alias("n")).alias("s"), F.explode(pairs).alias("k")).select("key", "s.b", "s.n", "k.who", "k.x")


@query("f08_json", """SELECT event_id, j->>'$.a' AS a, j->>'$.l[1]' AS second, CAST(json_array_length(j->'$.l') AS BIGINT) AS n, json_type(j->'$.o') AS kind, CAST(unnest(CAST(j->'$.l' AS BIGINT[])) AS BIGINT) AS item, json_valid(props) AS valid
 FROM (SELECT event_id, props, CAST('{"a":"' || event_type || '","l":[' || event_id || ',' || user_id || '],"o":{"x":1}}' AS JSON) AS j FROM events)""")
def f08(spark, sf):
    e = X.table(spark, sf, "events")
    text = F.concat(F.lit('{"a":"'), "event_type", F.lit('","l":['), "event_id", F.lit(","), "user_id", F.lit('],"o":{"x":1}}'))
    get = lambda p: F.get_json_object("t", p)
    kind = F.when(get("$.o").startswith("{"), "OBJECT").when(get("$.o").startswith("["), "ARRAY")
    return e.select("event_id", "props", text.alias("t")).select("event_id", get("$.a").alias("a"), get("$.l[1]").alias("second"), F.json_array_length(get("$.l")).cast("long").alias("n"), kind.alias("kind"), F.explode(F.from_json(get("$.l"), "array<bigint>")).alias("item"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query("f09_nulls", with_(LISTING, then="""SELECT bucket, count(v) AS some, count(*) AS n, sum(coalesce(v, 0)) AS filled, count(*) FILTER (WHERE v IS NOT DISTINCT FROM w) AS same, count(*) FILTER (WHERE v IS DISTINCT FROM w) AS other, count(nullif(nation, 3)) AS not3, any_value(v) IS NOT NULL AS some_value, CAST(sum(v) FILTER (WHERE v > 500) AS BIGINT) AS big, count(*) FILTER (WHERE v > w) AS more
 FROM (SELECT *, CASE WHEN key % 3 <> 0 THEN cust END AS v, CASE WHEN key % 2 = 0 THEN cust END AS w FROM listing) GROUP BY bucket"""))
def f09(spark, sf):
    x = X.listing(spark, sf).withColumns({"v": F.when(F.col("key") % 3 != 0, F.col("cust")), "w": F.when(F.col("key") % 2 == 0, F.col("cust"))})
    same = F.col("v").eqNullSafe(F.col("w"))
    return x.groupBy("bucket").agg(
        F.count("v").alias("some"), F.count("*").alias("n"), F.sum(F.coalesce("v", F.lit(0))).cast("decimal(38,0)").alias("filled"), F.count_if(same).alias("same"), F.count_if(~same).alias("other"), F.count(F.nullif(F.col("nation"), F.lit(3))).alias("not3"),
        F.any_value("v", ignoreNulls=True).isNotNull().alias("some_value"), F.sum(F.when(F.col("v") > 500, F.col("v"))).alias("big"), F.count_if(F.col("v") > F.col("w")).alias("more"),
    )


@query("f10_aggregates", with_(LISTING, then="""SELECT bucket, nation, CAST(sum(size_bytes) AS BIGINT) AS total, count(*) AS n, min(name) AS lo, max(name) AS hi, bool_or(cust > 900) AS any_big, bool_and(cust > 0) AS all_some, arg_min(name, (size_bytes, name)) AS smallest, arg_max(name, (size_bytes, name)) AS largest, count(DISTINCT cust) AS custs,
 len(list(DISTINCT segment)) AS segments, string_agg(DISTINCT segment, ',' ORDER BY segment) AS joined, CAST(bit_xor(key) AS BIGINT) AS x, round(avg(size_bytes), 3) AS mean, round(stddev_samp(size_bytes), 2) AS spread, quantile_disc(size_bytes, 0.5) AS mid, GROUPING(nation) AS g
 FROM listing GROUP BY GROUPING SETS ((bucket), (bucket, nation))"""))
def f10(spark, sf):
    x = X.listing(spark, sf)
    b = F.col("size_bytes")
    both = x.groupingSets([[F.col("bucket")], [F.col("bucket"), F.col("nation")]], "bucket", "nation")
    key = F.struct("size_bytes", "name")
    return both.agg(
        F.sum(b).alias("total"), F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.bool_or(F.col("cust") > 900).alias("any_big"), F.bool_and(F.col("cust") > 0).alias("all_some"), F.min_by("name", key).alias("smallest"), F.max_by("name", key).alias("largest"),
        F.count_distinct("cust").alias("custs"), F.size(F.collect_set("segment")).cast("long").alias("segments"), F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("joined"), F.bit_xor("key").alias("x"), F.round(F.avg(b), 3).alias("mean"), F.round(F.stddev_samp(b), 2).alias("spread"),
        F.expr("percentile_disc(0.5) within group (order by size_bytes)").cast("long").alias("mid"), F.grouping("nation").cast("long").alias("g"),
    )


@query("f11_hashes", with_(LISTING, then="SELECT bucket, md5(string_agg(md5(name), '' ORDER BY name)) AS digest, sha256(bucket) AS sha, CAST(sum(CAST(('0x' || md5(name)[1:8]) AS BIGINT)) AS BIGINT) AS order_free, hex('ab') AS hx, to_base64(CAST(bucket AS BLOB)) AS b64 FROM listing GROUP BY bucket"))
def f11(spark, sf):
    """Digests of names by bucket, and a sum of hashes that doesn't depend on their order."""
    x = X.listing(spark, sf).withColumn("h", F.md5(F.col("name").cast("binary")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda s: s["h"]), "")
    return x.groupBy("bucket").agg(F.md5(joined.cast("binary")).alias("digest"), F.sha2(F.col("bucket"), 256).alias("sha"), F.sum(F.conv(F.substring("h", 1, 8), 16, 10).cast("long")).alias("order_free"), F.hex(F.lit("ab")).alias("hx"), F.base64(F.col("bucket").cast("binary")).alias("b64"))
