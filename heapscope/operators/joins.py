"""Joins that Spark has no operator for: as-of both ways, ranges, run names, and changes of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors


def as_of_backward(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """left with `value` of the last right row at or before it. One sorted pass over both sides; neither is sent around."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_v")


def as_of_forward(left: DataFrame, stamps: list[int], at: str, out: str = "stamp") -> DataFrame:
    """left with the first of a few stamps at or after it."""
    return left.withColumn(out, F.try_element_at(F.filter(F.array(*[F.lit(s).cast("long") for s in sorted(stamps)]), lambda s: s >= F.col(at)), F.lit(1)))


def in_ranges(left: DataFrame, starts: DataFrame, at: str, out: str = "range") -> DataFrame:
    """left with the number (from 0) of the range it falls in, -1 before the first. starts: start, the lower bounds of ranges, as many as a
    plan has shards; they are sorted and sent around as one list."""
    lows = starts.agg(F.array_sort(F.collect_set("start")).alias("_lows"))
    below = F.size(F.filter("_lows", lambda b: b <= F.col(at)))
    return left.crossJoin(F.broadcast(lows)).withColumn(out, (below - 1).cast("int")).drop("_lows")


def counts_below(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key at or below each directory."""
    return rows.select(*keys, F.explode(ancestors(F.col("path"))).alias("dir")).groupBy(*keys, "dir").agg(F.count("*").alias("n"))


def transitions(closed: DataFrame, opened: DataFrame, key: list[str]) -> DataFrame:
    """state of each key at a scan: continues (closed and opened again), closes, opens."""
    a, b = closed.select(*key).distinct().withColumn("_a", F.lit(True)), opened.select(*key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(*key, F.when(F.col("_a") & F.col("_b"), "continues").when(F.col("_a"), "closes").otherwise("opens").alias("state"))


def run_stem(name: Column) -> Column:
    """A run's name without the hash at its end, then without a resume suffix, dashes and underscores at its end."""
    return F.rtrim(F.regexp_replace(without_hash(name), r"[_-]resume\d+.*$", ""), F.lit("_-"))


def without_hash(name: Column) -> Column:
    return F.regexp_replace(name, "-[0-9a-f]{6,8}$", "")


def run_names(dirs: DataFrame, runs: DataFrame, block: int = 12, least: int = 16) -> DataFrame:
    """name, usr: directories matched to runs (run, usr).

    A name matches the run of that name, else of its name without hash, else of its stem. Else, of the runs whose names begin
    as its stem does (`block` characters), the one with the longest stem that is its stem's beginning or has it as its own,
    `least` characters being common; the least name among equally long ones. Names whose run has several users get none.
    """
    users = runs.filter("run <> '' and usr <> ''").groupBy("run").agg(F.min("usr").alias("usr"), F.max("usr").alias("_x")).select("run", F.when(F.col("usr") == F.col("_x"), F.col("usr")).alias("usr"))
    d = dirs.select("name").distinct().withColumn("_stem", run_stem(F.col("name")))
    tries = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("run")) for k, c in enumerate((F.col("name"), without_hash(F.col("name")), F.col("_stem")))])
    exact = d.select("name", F.explode(tries).alias("x")).select("name", "x.*").join(users, "run").groupBy("name").agg(F.min_by("usr", "kind").alias("usr"))
    left = d.join(exact.select("name"), "name", "left_anti").withColumn("_block", F.substring("_stem", 1, block))
    r = users.select("run", "usr", run_stem(F.col("run")).alias("_own"), F.substring("run", 1, block).alias("_block"))
    near = left.join(r, "_block").filter(F.least(F.length("_stem"), F.length("_own")) >= least)
    near = near.filter(F.col("_stem").startswith(F.col("_own")) | F.col("_own").startswith(F.col("_stem")))
    fuzzy = near.groupBy("name").agg(F.min_by("usr", F.struct(-F.length("_own"), "run")).alias("usr"))
    return exact.unionByName(fuzzy).filter("usr is not null")


def numbered(names: DataFrame, name: str, out: str = "id") -> DataFrame:
    """The distinct names with their numbers from 1 in order: cut into ranges, which are written, counted, and numbered one by one."""
    from heapscope.sources.scratch import scratch

    spark = names.sparkSession
    path = scratch(spark, "names")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = names.select(name).distinct().repartitionByRange(parts, name).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(path)
    kept = spark.read.schema(ranges.schema).parquet(path)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(name))
    return kept.withColumn("_at", place).join(counts, "_part").select(name, (F.col("_from") + F.col("_at")).cast("long").alias(out))


def dictionary(rows: DataFrame, names: DataFrame, name: str, id_: str = "id") -> DataFrame:
    return rows.join(names.select(name, id_), name)


def attributed_as_of(paths: DataFrame, attribution: DataFrame, t: int) -> DataFrame:
    """usr of the deepest attribution prefix in force at t."""
    live = attribution.filter((F.col("vf") <= t) & (F.col("vt") > t)).select(F.col("path").alias("prefix"), "usr")
    up = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    return up.join(live, "prefix").groupBy("path").agg(F.max_by("usr", F.length("prefix")).alias("usr"))


def back_filled(versions: DataFrame, identities: DataFrame) -> DataFrame:
    """Versions with the identity that was seen for the same path within their validity (the first one)."""
    i = identities.select("path", "t", "identity")
    j = versions.join(i, "path").filter("vf <= t and t < vt").groupBy("path", "vf").agg(F.min_by("identity", "t").alias("identity"))
    return versions.join(j, ["path", "vf"], "left")


def settled(manifest: DataFrame, done: DataFrame, identity: list[str]) -> DataFrame:
    """What of a manifest isn't done yet."""
    return manifest.join(done, identity, "left_anti")


def keyed_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    a, b = old.select(key, F.col(value).alias("_a")), new.select(key, F.col(value).alias("_b"))
    j = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), key, "full_outer")
    return j.select(key, F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("changed").alias("change"), F.col("_b").alias(value), (F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("_same")).filter("not _same").drop("_same")


def newest_layout(catalog: DataFrame) -> DataFrame:
    """One row for each scan: the greatest generation."""
    return catalog.groupBy("scan_id").agg(F.max_by(F.struct(*[c for c in catalog.columns if c != "scan_id"]), "gen").alias("x")).select("scan_id", "x.*")


def eligibility(events: DataFrame, keys: list[str]) -> DataFrame:
    """Census of a joint state over events: path, keys, t, running bytes and objects of every directory. events: path, keys, t, db, do."""
    up = events.select(F.explode(ancestors(F.col("path"), own=False)).alias("dir"), *keys, "t", "db", "do").groupBy("dir", *keys, "t").agg(F.sum("db").alias("db"), F.sum("do").alias("do"))
    w = Window.partitionBy("dir", *keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return up.select("dir", *keys, "t", F.sum("db").over(w).alias("bytes"), F.sum("do").over(w).alias("objects"))


def page(rows: DataFrame, size: int, after: tuple[int, str] | None = None) -> DataFrame:
    """The next rows in order of (size descending, path) after a (size, path)."""
    if after:
        rows = rows.filter((F.col("size") < after[0]) | ((F.col("size") == after[0]) & (F.col("path") > after[1])))
    return rows.orderBy(F.desc("size"), "path").limit(size)


def federated(members: list[DataFrame], roots: list[str]) -> DataFrame:
    """Union of stores whose roots lie apart; refused if one holds another."""
    for i, a in enumerate(roots):
        if any(j != i and (b == a or b.startswith(a.rstrip("/") + "/")) for j, b in enumerate(roots)):
            raise ValueError(f"root {a} holds another")
    out = members[0]
    for m in members[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out
