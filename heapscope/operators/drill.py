"""Rollups of directories with many matches, kept as running cells of their largest children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, child_of
from heapscope.functions.scalars import OPEN


def heavy(roots: DataFrame, least: int) -> DataFrame:
    """q, dir, rows, children: directories with more than `least` rows of roots strictly below them. roots: q, path."""
    up = roots.select("q", "path", F.explode(ancestors(F.col("path"), own=False, root=False)).alias("dir"))
    by_child = up.groupBy("q", "dir", child_of(F.col("path"), F.col("dir")).alias("child")).agg(F.count("*").alias("n"))
    return by_child.groupBy("q", "dir").agg(F.sum("n").alias("rows"), F.count("*").alias("children")).filter(F.col("rows") > least)


def changes(roots: DataFrame, dirs: DataFrame) -> DataFrame:
    """q, dir, child, t, db, dn: what the roots below each of the directories add and take away, by child and time.

    roots: q, path, vf, vt, size, n_files. Rows are summed by path and time before they are exploded, and only ancestors
    among the directories go on.
    """
    plus = roots.select("q", "path", F.col("vf").alias("t"), F.col("size").alias("db"), F.col("n_files").alias("dn"))
    minus = roots.filter(F.col("vt") != OPEN).select("q", "path", F.col("vt").alias("t"), (-F.col("size")).alias("db"), (-F.col("n_files")).alias("dn"))
    own = plus.unionByName(minus).groupBy("q", "path", "t").agg(F.sum("db").alias("db"), F.sum("dn").alias("dn"))
    up = own.select("*", F.explode(ancestors(F.col("path"), own=False, root=False)).alias("dir")).join(dirs.select("q", "dir"), ["q", "dir"])
    return up.groupBy("q", "dir", child_of(F.col("path"), F.col("dir")).alias("child"), "t").agg(F.sum("db").alias("db"), F.sum("dn").alias("dn"))


def rollups(roots: DataFrame, least: int, k: int) -> DataFrame:
    """q, dir, kind, child, vf, b, o of every heavy directory.

    kind 0: its number of kept children (vf), of rows (b) and of children (o). kind 1: a cell for each change of one of the k
    children with the greatest peak of bytes (ties by name), with the running bytes and objects from then on. kind 2: the
    same of all other children together.
    """
    dirs = heavy(roots, least)
    moved = changes(roots, dirs)
    run = Window.partitionBy("q", "dir", "child").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    peak = moved.withColumn("b", F.sum("db").over(run)).groupBy("q", "dir", "child").agg(F.max("b").alias("peak"))
    rank = F.row_number().over(Window.partitionBy("q", "dir").orderBy(F.desc("peak"), "child"))
    kept = peak.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "dir", "child", F.lit(1).alias("kind"))
    named = moved.join(kept, ["q", "dir", "child"], "left").select("q", "dir", F.coalesce("kind", F.lit(2)).alias("kind"), F.when(F.col("kind") == 1, F.col("child")).otherwise("").alias("child"), "t", "db", "dn")
    cells = named.groupBy("q", "dir", "kind", "child", "t").agg(F.sum("db").alias("db"), F.sum("dn").alias("dn")).filter("db <> 0 or dn <> 0")
    over = Window.partitionBy("q", "dir", "kind", "child").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("q", "dir", "kind", "child", F.col("t").alias("vf"), F.sum("db").over(over).cast("long").alias("b"), F.sum("dn").over(over).cast("long").alias("o"))
    heads = dirs.join(kept.groupBy("q", "dir").agg(F.count("*").alias("vf")), ["q", "dir"])
    return heads.select("q", "dir", F.lit(0).alias("kind"), F.lit("").alias("child"), "vf", F.col("rows").alias("b"), F.col("children").alias("o")).unionByName(cells)


def run_deltas(roots: DataFrame, since: int, least: int) -> DataFrame:
    """q, dir, child, t, db, dn, fresh: what a run after `since` adds to the rollups.

    A directory that was heavy before stays so and gets its changes since then; one that has become heavy gets all of its
    changes (fresh). roots holds all versions, as they are after the run.
    """
    before = roots.filter(F.col("vf") <= since)
    old = heavy(before, least).select("q", "dir", F.lit(False).alias("fresh"))
    now = heavy(roots, least).select("q", "dir").join(old.select("q", "dir"), ["q", "dir"], "left_anti").withColumn("fresh", F.lit(True))
    dirs = old.unionByName(now)
    return changes(roots, dirs).join(dirs, ["q", "dir"]).filter(F.col("fresh") | (F.col("t") > since))
