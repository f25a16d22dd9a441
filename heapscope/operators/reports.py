"""Reports: percentiles, costs, growth, series by day, streaks, comparisons of two stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """Values at place floor(share * n), from 0, the last one at most; no interpolation. Equal values are counted first, so a
    group's rows needn't meet."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by).orderBy(value)
    up = n.withColumns({"_to": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(by))})
    rank = lambda q: F.least(F.col("_n"), F.floor(F.lit(float(q)) * F.col("_n")) + 1)
    return up.groupBy(by).agg(*[F.min(F.when(F.col("_to") >= rank(q), F.col(value))).alias(f"p{int(q * 100)}") for q in shares])


def costs(file_rows: DataFrame, by: str, prices: dict[int, int], unit: float = 1e12) -> DataFrame:
    """Whole-number prices of classes times bytes, summed exactly, then divided once."""
    of = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return file_rows.groupBy(by).agg(F.round(F.sum(F.col("size").cast("decimal(20,0)") * of[F.col("storage_class_id")].cast("decimal(10,0)")).cast("double") / unit, 6).alias("cost"))


def union_seconds(intervals: DataFrame, by: str) -> DataFrame:
    """Seconds covered by at least one of the intervals [s, e)."""
    w = Window.partitionBy(by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    x = intervals.withColumn("_to", F.max("e").over(w))
    new = F.when(F.col("_to").isNull() | (F.col("s") > F.col("_to")), F.col("e") - F.col("s")).otherwise(F.greatest(F.col("e") - F.col("_to"), F.lit(0)))
    return x.groupBy(by).agg(F.sum(new).cast("long").alias("busy"))


def deltas(daily: DataFrame) -> DataFrame:
    """day, b and its change from the day before that has one. One row a day, so the series is ordered in one task."""
    return daily.withColumn("delta", F.col("b") - F.lag("b").over(Window.orderBy("day")))


def runway(history: DataFrame, quotas: DataFrame, by: str, windows: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """used, growth a day, window_d and days until the quota of each group at its newest reading.

    history: by, t (epoch seconds), v; quotas: by, quota. Growth is the fastest of those over the windows (in days), each from
    the latest reading that is as old or older, over the time really elapsed; of equal ones the longest window counts. Days
    are 0 at or over the quota, and infinite where nothing grows or no reading is old enough.
    """
    last = history.groupBy(by).agg(F.max("t").alias("t1"), F.max_by("v", "t").alias("used"))
    seen = history.join(last, by)
    then = seen.groupBy(by, "t1", "used").agg(*[F.max(F.when(F.col("t") <= F.col("t1") - w * 86400, F.struct("t", "v"))).alias(f"w{w}") for w in windows])
    rate = lambda w: (F.col("used") - F.col(f"w{w}.v")).cast("double") / ((F.col("t1") - F.col(f"w{w}.t")).cast("double") / 86400.0)
    rates = [F.when(F.col(f"w{w}").isNotNull(), F.struct(rate(w).alias("growth"), F.lit(w).alias("window_d"))) for w in windows]
    best = F.greatest(*rates) if len(rates) > 1 else rates[0]
    j = then.withColumn("best", best).join(quotas, by).select(by, "used", "best.growth", "best.window_d", (F.col("quota") - F.col("used")).alias("free"))
    days = F.when(F.col("free") <= 0, 0.0).when(F.col("growth") > 0, F.col("free").cast("double") / F.col("growth")).otherwise(float("inf"))
    return j.select(by, "used", "growth", "window_d", days.alias("days"))


def daily_spine(counts: DataFrame, by: str) -> DataFrame:
    """A row for each key and day of the table's range: null before the key's first day, 0 where it has none later."""
    edge = F.broadcast(counts.agg(F.min("day").alias("lo"), F.max("day").alias("hi")))
    first = counts.groupBy(by).agg(F.min("day").alias("first"))
    grid = first.crossJoin(edge).select(by, "first", F.explode(F.sequence("lo", "hi")).alias("day"))
    return grid.join(counts, [by, "day"], "left").select(by, "day", F.when(F.col("day") >= F.col("first"), F.coalesce("n", F.lit(0))).alias("n"))


def streaks(rows: DataFrame, by: str, key: str, order: list[str]) -> DataFrame:
    """The newest row's key and how many newest rows share it."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    x = rows.withColumn("_new", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1), 0).otherwise(1))
    x = x.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter("_run = 0").groupBy(by, F.col(key).alias("head")).agg(F.count("*").alias("streak"))


def dense_ids(names: DataFrame, by: str, name: str) -> DataFrame:
    """Ids from 0 in the order of `by`, greatest first: places are counted by blocks of values, then within a block."""
    block = F.length(F.bin(F.col(by)))
    b = names.withColumn("_block", block)
    sizes = b.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(F.desc(by), name)) - 1
    return b.withColumn("_in", inside).join(F.broadcast(before), "_block").select(name, by, (F.col("_from") + F.col("_in")).cast("long").alias("id"))


def compared(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """column, mismatches, worst difference of two stores; null counts as 0."""
    x = a.select(*key, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"_a_{c}") for c in columns])
    y = b.select(*key, *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(f"_b_{c}") for c in columns])
    gaps = F.array(*[F.struct(F.lit(c).alias("column"), F.abs(F.coalesce(f"_a_{c}", F.lit(0.0)) - F.coalesce(f"_b_{c}", F.lit(0.0))).alias("gap")) for c in columns])
    j = x.join(y, key, "full_outer").select(F.explode(gaps).alias("x"))
    return j.groupBy("x.column").agg(F.sum((F.col("x.gap") > tolerance).cast("long")).alias("mismatches"), F.max("x.gap").alias("worst"))


def merged_parts(parts: DataFrame, key: list[str], sums: list[str], maxima: list[str], once: list[str]) -> DataFrame:
    """Root rows of shards as one: sums, maxima, and values that are taken once for each part (column part)."""
    first = parts.groupBy(*key, "part").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in (*maxima, *once)])
    return first.groupBy(*key).agg(*[F.sum(c).alias(c) for c in (*sums, *once)], *[F.max(c).alias(c) for c in maxima])
