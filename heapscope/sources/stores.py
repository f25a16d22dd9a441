"""Rollups at rest: sorted layouts, digests to compare rewrites by, and reads of a subtree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heapscope.functions.paths import in_subtree
from heapscope.functions.scalars import size_rank


def write_by_path(rows: DataFrame, path: str, partitions: int, block_bytes: int = 16 << 20) -> None:
    """Ordered by (depth, path), in ranges; row groups then have narrow ranges of both, which filters prune by."""
    rows.repartitionByRange(partitions, "depth", "path").sortWithinPartitions("depth", "path").write.option("parquet.block.size", block_bytes).option("compression", "zstd").parquet(path)


def write_by_size(rows: DataFrame, path: str, partitions: int, block_bytes: int = 16 << 20) -> None:
    """Ordered by size class, largest first, then path."""
    ranked = rows.withColumn("_rank", -F.coalesce(size_rank(F.col("size")), F.lit(-1)))
    ranked.repartitionByRange(partitions, "_rank", "path").sortWithinPartitions("_rank", "path").drop("_rank").write.option("parquet.block.size", block_bytes).option("compression", "zstd").parquet(path)


def read_subtree(spark: SparkSession, path: str, top: str, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """Rows at or below top with depths in a range; both conditions are pushed to the scan."""
    return spark.read.parquet(path).filter(in_subtree(F.col("path"), top) & F.col("depth").between(least, most))


def write_chunked(rows: DataFrame, path: str, depth: int = 1) -> None:
    """A folder for each subtree at the given depth."""
    rows.withColumn("chunk", F.substring_index("path", "/", depth)).write.partitionBy("chunk").option("compression", "zstd").parquet(path)


def digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows and an order-free digest of each group: the exact sum of row hashes. Compare within one Spark version only."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("digest"))


def recompressed(spark: SparkSession, source: str, target: str, codec: str = "zstd") -> bool:
    """Rewrites a Parquet folder and tells whether both hold the same rows."""
    rows = spark.read.parquet(source)
    rows.write.option("compression", codec).parquet(target)
    a, b = (digest(x, []).first() for x in (rows, spark.read.parquet(target)))
    return a == b


def implied_columns(rows: DataFrame, of: str = "size", like: str = "sum_") -> DataFrame:
    """column, implied: of the columns that begin with `like`, which equal the column `of` in every row, and needn't be stored."""
    names = [c for c in rows.columns if c.startswith(like) and rows.schema[c].dataType == rows.schema[of].dataType]
    same = rows.agg(*[F.bool_and(F.coalesce(F.col(c) == F.col(of), F.lit(False))).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit(False)).alias("implied")) for c in names])
    return same.select(F.explode(pairs).alias("x")).select("x.*")


def _ends(stats) -> tuple:
    return (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)


def row_groups(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, rg, n, bytes, and the least and greatest value (as text) of each column, of every row group. Only footers are read, the files
    being dealt out over tasks; their file system must be one that pyarrow opens."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    names = ["file", "rg", "n", "bytes", *[f"{e}_{c}" for c in columns for e in ("min", "max")]]

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * (2 * len(columns))]
        for batch in batches:
            out: list[tuple] = []
            for file in batch.column("path").to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                meta = pq.ParquetFile(at, filesystem=fs).metadata
                for i in range(meta.num_row_groups):
                    g = meta.row_group(i)
                    stats = {g.column(k).path_in_schema: g.column(k).statistics for k in range(g.num_columns)}
                    ends = [None if x is None else str(x) for c in columns for x in _ends(stats.get(c))]
                    out.append((file.rsplit("/", 1)[-1], i, g.num_rows, g.total_byte_size, *ends))
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    ends = "".join(f", {n} string" for n in names[4:])
    return files.mapInArrow(read, f"file string, rg int, n long, bytes long{ends}")


def chunk_roots(dirs: DataFrame, least: int) -> DataFrame:
    """Directories (path, n_desc) with `least` descendants or more: each one's rows go to a file of their own, less those of such directories
    below it."""
    return dirs.filter((F.col("n_desc") >= least) & (F.col("path") != "")).select("path")


def chunked(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with chunk (the deepest root above or at them, '' for none) and rebased, their path from there on ('.' for the root itself)."""
    from heapscope.functions.paths import ancestors

    up = rows.select("path", F.explode(ancestors(F.col("path"))).alias("chunk")).join(roots.select(F.col("path").alias("chunk")), "chunk")
    best = up.groupBy("path").agg(F.max_by("chunk", F.length("chunk")).alias("chunk"))
    j = rows.join(best, "path", "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))
    inside = F.when(F.col("chunk") == "", F.col("path")).when(F.col("path") == F.col("chunk"), ".").otherwise(F.substr("path", F.length("chunk") + 2))
    return j.withColumn("rebased", inside)


def unbased(rows: DataFrame) -> DataFrame:
    """The inverse: path from chunk and rebased."""
    path = F.when(F.col("chunk") == "", F.col("rebased")).when(F.col("rebased") == ".", F.col("chunk")).otherwise(F.concat_ws("/", "chunk", "rebased"))
    return rows.withColumn("path", path).drop("chunk", "rebased")
