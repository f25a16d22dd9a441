"""Access logs: rollups per path, hour and operation; read sizes; requesters; attribution to jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, canonical
from heapscope.functions.scalars import price_class, read_bin


def hour(ts_s: Column, seconds: int = 3600) -> Column:
    return (ts_s - F.pmod(ts_s, F.lit(seconds))).cast("long")


def as_of(requests: DataFrame, cut: int, grain: int = 0) -> DataFrame:
    """Requests before a cut; of minute- or day-grained stamps only those whose whole grain lies before it."""
    return requests.filter(F.col("ts_s") + grain <= cut) if grain else requests.filter(F.col("ts_s") < cut)


def distinct_deliveries(requests: DataFrame) -> DataFrame:
    """Whole equal records once; a request id may stand for many objects, so it is no key."""
    return requests.distinct()


def leaves(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """path, hour, op: n_ops, bytes_out, n_requesters (exact), last_ts."""
    return requests.groupBy("path", hour(F.col("ts_s"), seconds).alias("hour"), "op").agg(F.count("*").alias("n_ops"), F.sum("bytes_out").alias("bytes_out"), F.count_distinct("requester").alias("n_requesters"), F.max("ts_s").alias("last_ts"))


def tree(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """Leaves and all ancestors, the root '' included. Above leaves n_requesters is the sum of the leaves' counts, which
    counts a requester of several objects several times; distinct_tree gives the true number."""
    up = leaves(requests, seconds).select(F.explode(ancestors(F.col("path"))).alias("path"), "hour", "op", "n_ops", "bytes_out", "n_requesters", "last_ts")
    return up.groupBy("path", "hour", "op").agg(*[F.sum(c).alias(c) for c in ("n_ops", "bytes_out", "n_requesters")], F.max("last_ts").alias("last_ts"))


def distinct_tree(requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """path, hour, op and the exact number of requesters at or below: pairs are made distinct before they are exploded."""
    own = requests.select("path", hour(F.col("ts_s"), seconds).alias("hour"), "op", "requester").distinct()
    up = own.select(F.explode(ancestors(F.col("path"))).alias("path"), "hour", "op", "requester").distinct()
    return up.groupBy("path", "hour", "op").agg(F.count("*").alias("n_requesters"))


def read_sizes(requests: DataFrame, segments: int = 4, seconds: int = 3600) -> DataFrame:
    """Reads (GET and HEAD) by prefix of up to `segments` segments of the canonical path, time bin and size bin (50 to a doubling)."""
    reads = requests.filter("op in ('GET', 'HEAD')")
    return reads.groupBy("bucket", F.substring_index(canonical(F.col("path")), "/", segments).alias("prefix"), hour(F.col("ts_s"), seconds).alias("bin"), read_bin(F.col("bytes_out")).alias("lg2")).agg(F.count("*").alias("n_ops"), F.sum("bytes_out").alias("bytes_out"))


def requesters(requests: DataFrame, seconds: int = 86400) -> DataFrame:
    return requests.groupBy("bucket", "requester", "op", hour(F.col("ts_s"), seconds).alias("day")).agg(F.count("*").alias("n_ops"), F.sum("bytes_out").alias("bytes_out"))


#: List prices for a million requests of each class. Fixed values.
PRICE_PER_M = {"A": 5.0, "B": 0.40}


def client(user_agent: Column) -> Column:
    """A user agent's first product token."""
    return F.nullif(F.regexp_extract(F.coalesce(user_agent, F.lit("")), "^([^/ ,;()]+)", 1), F.lit(""))


def readers(rollup: DataFrame, by: list[str], top: int = 15, prices: dict[str, float] | None = None) -> DataFrame:
    """Requests a day of each group, by price class, and their cost; the dearest `top` groups, then all others as one row.

    rollup: day, op, op_raw, user_agent, prefix, n and the columns in by. Groups are summed before they are ranked, and the
    ranking takes the top rows of each partition first.
    """
    prices = prices or PRICE_PER_M
    days = rollup.agg(F.count_distinct("day").cast("double").alias("days"))
    kind = price_class(F.col("op"), F.col("op_raw"), F.col("user_agent"), F.col("prefix"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    of = lambda k: F.sum(F.when(F.col("_kind") == k, F.col("n")).otherwise(0))
    sums = rollup.select(*names, kind.alias("_kind"), "n").groupBy(*by).agg(of("A").alias("a"), of("B").alias("b"), F.sum("n").alias("n"))
    usd = (F.col("a") * prices["A"] + F.col("b") * prices["B"]) / 1e6
    rows = sums.crossJoin(F.broadcast(days)).select(*by, *[(x / F.col("days")).alias(c) for c, x in (("a_per_day", F.col("a")), ("b_per_day", F.col("b")), ("per_day", F.col("n")), ("usd_per_day", usd))])
    values = ["a_per_day", "b_per_day", "per_day", "usd_per_day"]
    head = rows.orderBy(F.desc("usd_per_day"), *by).limit(top)
    # by's columns are never null here.
    rest = rows.join(head.select(*by), by, "left_anti").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in values]).filter("_n > 0")
    other = [F.concat(F.lit("("), "_n", F.lit(" others)")).alias(by[0]), *[F.lit("").alias(c) for c in by[1:]]]
    return head.unionByName(rest.select(*other, *values))


def nearest_host(requests: DataFrame, hosts: DataFrame, slack: int) -> DataFrame:
    """requests with the host whose stamp on the same address is nearest in time, within slack seconds; ties by name.

    Both sides are cut into bins of the slack, so candidates meet by equality of (address, bin) and no address is one group.
    """
    h = hosts.select("ip", "host", F.col("ts_s").alias("host_ts"), F.explode(F.sequence(F.expr(f"ts_s div {slack} - 1"), F.expr(f"ts_s div {slack} + 1"))).alias("_bin"))
    r = requests.withColumn("_bin", F.expr(f"ts_s div {slack}"))
    near = r.join(h, ["ip", "_bin"]).withColumn("gap", F.abs(F.col("ts_s") - F.col("host_ts"))).filter(F.col("gap") <= slack)
    best = near.groupBy("event_id").agg(F.min(F.struct("gap", "host")).alias("b")).select("event_id", F.col("b.host").alias("host"), F.col("b.gap").alias("gap"))
    return requests.join(best, "event_id", "left")


def shares(tasks: DataFrame) -> DataFrame:
    """Each task's share of its (hour, ip)."""
    return tasks.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("hour", "ip")))


def attributed(requests: DataFrame, task_shares: DataFrame) -> DataFrame:
    """Requests split over the tasks on their address in that hour, by share; without any, over no task."""
    j = requests.withColumn("hour", hour(F.col("ts_s"))).join(task_shares.select("hour", "ip", "task", "share"), ["hour", "ip"], "left")
    return j.groupBy("task").agg(F.sum(F.coalesce("share", F.lit(1.0))).alias("n_ops"), F.sum(F.col("bytes_out") * F.coalesce("share", F.lit(1.0))).alias("bytes_out"))


def stalled(requests: DataFrame, now: int, after: int) -> DataFrame:
    """Buckets whose newest record is older than `after` seconds."""
    return requests.groupBy("bucket").agg(F.max("ts_s").alias("last_ts")).filter(F.lit(now) - F.col("last_ts") > after)
