"""Rollup of objects to all their ancestors.

Objects are first reduced to their own directory, and only directories are exploded to ancestors: the explosion then
costs directories times depth, and map-side aggregation folds the top of the tree, where every object ends up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, depth, parent
from heapscope.functions.scalars import log2_bin

BINS = 41


def files(listing: DataFrame) -> DataFrame:
    """path (bucket first), size, mtime (epoch seconds) of every object."""
    return listing.select(F.concat_ws("/", "bucket", "name").alias("path"), F.col("size_bytes").alias("size"), F.col("created_s").alias("mtime"), "storage_class_id")


def directories(file_rows: DataFrame, measures: dict[str, tuple[Column, str]], keys: tuple[str, ...] = (), root: bool = True) -> DataFrame:
    """path, keys and measures of every ancestor directory. A measure is (expression, 'sum' or 'max')."""
    fold = {"sum": F.sum, "max": F.max, "or": F.bool_or}
    first = file_rows.groupBy(parent(F.col("path")).alias("dir"), *keys).agg(*[fold[how](x).alias(n) for n, (x, how) in measures.items()])
    up = first.select(F.explode(ancestors(F.col("dir"), root=root)).alias("path"), *keys, *measures)
    return up.groupBy("path", *keys).agg(*[fold[how](n).alias(n) for n, (_, how) in measures.items()])


def rollup(file_rows: DataFrame) -> DataFrame:
    """A row for each file and directory: path, size, mtime, n_desc, n_files, n_children, kind, parent, depth.

    n_desc counts the row itself and all below. Root: path '.', parent ''; top-level rows have parent '.'. The directories'
    rows come from one pass over the files: sums by a file's own directory, those exploded to ancestors, and the directories
    that come of it exploded once more to count what lies below each.
    """
    here = file_rows.groupBy(parent(F.col("path")).alias("dir")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.count("*").alias("n"))
    up = here.select("*", F.explode(ancestors(F.col("dir"))).alias("path"))
    own = F.sum(F.when(F.col("path") == F.col("dir"), F.col("n")).otherwise(0)).alias("own")
    dirs = up.groupBy("path").agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime"), F.sum("n").alias("n_files"), own)
    linked = dirs.select("*", F.explode(ancestors(F.col("path"))).alias("up"))
    itself = F.col("path") == F.col("up")
    counts = linked.groupBy("up").agg(
        F.max(F.when(itself, F.struct("size", "mtime", "n_files", "own"))).alias("v"),
        F.count_if(~itself).alias("below"),
        F.count_if(~itself & (parent(F.col("path")) == F.col("up"))).alias("kids"),
    )
    dirs = counts.select(F.col("up").alias("path"), "v.size", "v.mtime", (F.col("v.n_files") + F.col("below") + 1).alias("n_desc"), "v.n_files", (F.col("v.own") + F.col("kids")).alias("n_children"), F.lit("dir").alias("kind"))
    one = F.lit(1).cast("long")
    leaf = file_rows.select("path", "size", "mtime", one.alias("n_desc"), one.alias("n_files"), F.lit(0).cast("long").alias("n_children"), F.lit("file").alias("kind"))
    both = dirs.unionByName(leaf).withColumns({"parent": F.when(F.col("path") == "", "").when(~F.col("path").contains("/"), ".").otherwise(parent(F.col("path"))), "depth": depth(F.col("path"))})
    return both.withColumn("path", F.when(F.col("path") == "", ".").otherwise(F.col("path")))


def pivoted(file_rows: DataFrame, column: str, values: list[int]) -> DataFrame:
    """size and sum_<column>_<v> for each directory; at most 32 values."""
    if len(values) > 32:
        raise ValueError("more than 32 values")
    m = {"size": (F.col("size"), "sum")} | {f"sum_{column}_{v}": (F.when(F.col(column) == v, F.col("size")).otherwise(0), "sum") for v in values}
    return directories(file_rows, m)


def mean_mtime(file_rows: DataFrame) -> DataFrame:
    """Size-weighted mean mtime; products are summed exactly, then divided once."""
    wide = "decimal(38,0)"
    d = directories(file_rows, {"size": (F.col("size").cast(wide), "sum"), "weighted": (F.col("size").cast("decimal(19,0)") * F.col("mtime").cast("decimal(19,0)"), "sum")})
    return d.select("path", F.col("size").cast("long").alias("size"), F.when(F.col("size") > 0, F.col("weighted").cast("double") / F.col("size").cast("double")).alias("mtime_mean"))


def size_histogram(file_rows: DataFrame, bins: int = BINS) -> DataFrame:
    """size_hist_n and size_hist_bytes: files and bytes by number of binary digits of the size, the last bin open."""
    b = F.least(log2_bin(F.col("size")), F.lit(bins - 1)).alias("bin")
    first = file_rows.groupBy(parent(F.col("path")).alias("dir"), b).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    up = first.select(F.explode(ancestors(F.col("dir"))).alias("path"), "bin", "n", "b").groupBy("path", "bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    # At most `bins` entries a path.
    m = up.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "b")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    of = lambda field: F.transform(every, lambda k: F.coalesce(F.try_element_at(F.col("m"), k)[field], F.lit(0).cast("long")))
    return m.select("path", of("n").alias("size_hist_n"), of("b").alias("size_hist_bytes"))


def labelled(paths: DataFrame, labels: DataFrame, label: str = "usr") -> DataFrame:
    """paths with the label of the longest prefix that covers each; prefix '' covers all. Labels are joined on distinct
    parent directories first where a caller passes those; label tables may be of any size."""
    clean = labels.select(F.regexp_replace("prefix", "/$", "").alias("prefix"), F.col(label).alias("_label"))
    up = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    best = up.join(clean, "prefix").groupBy("path").agg(F.max_by("_label", F.length("prefix")).alias(label))
    return paths.join(best, "path", "left")


def with_side(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Exact-path left join of a side table, '.' meaning the root."""
    return rows.join(side, "path", "left")


def subtree_max(file_rows: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """The greatest value of a side column at or below every directory and file."""
    up = side.select(F.explode(ancestors(F.col("path"))).alias("path"), column).groupBy("path").agg(F.max(column).alias(column))
    return up


def total_by_class(file_rows: DataFrame) -> DataFrame:
    """Totals, with class 1 as what other classes leave."""
    t = file_rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("objects"), *[F.sum(F.when(F.col("storage_class_id") == k, F.col("size")).otherwise(0)).alias(f"c{k}") for k in (2, 3, 4)])
    return t.withColumn("c1", F.col("bytes") - F.col("c2") - F.col("c3") - F.col("c4"))
