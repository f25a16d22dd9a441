"""Object listings: one row for each object, from raw listings and two inventory dialects."""

from __future__ import annotations

import heapq
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, canonical
from heapscope.functions.scalars import CLASS_A, CLASS_B, mapped

COLUMNS = ["bucket", "name", "size_bytes", "created", "storage_class_id"]


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else default


def normalised(df: DataFrame) -> DataFrame:
    """A listing in the common columns; the dialect is told by the columns that are there."""
    if {"Bucket", "Key", "Size"} <= set(df.columns):
        live = (F.coalesce(_column(df, "IsDeleteMarker", F.lit(False)).cast("boolean"), F.lit(False)) == F.lit(False)) & F.coalesce(_column(df, "IsLatest", F.lit(True)).cast("boolean"), F.lit(True))
        kind = mapped(_column(df, "StorageClass", F.lit(None).cast("string")), CLASS_B, 0)
        out = df.filter(live).select(F.col("Bucket").alias("bucket"), F.col("Key").alias("name"), F.col("Size").alias("size_bytes"), _column(df, "LastModifiedDate", F.lit(None).cast("timestamp_ntz")).alias("created"), kind.alias("storage_class_id"))
    elif {"size", "timeCreated", "storageClass"} <= set(df.columns):
        live = _column(df, "timeDeleted", F.lit(None)).isNull()
        out = df.filter(live).select("bucket", "name", F.col("size").alias("size_bytes"), F.col("timeCreated").alias("created"), mapped(F.col("storageClass"), CLASS_A, 0).alias("storage_class_id"))
    elif "size_bytes" not in df.columns:
        raise ValueError(f"not a listing: {sorted(df.columns)}")
    else:
        out = df.select("bucket", "name", "size_bytes", _column(df, "created", F.lit(None).cast("timestamp_ntz")).alias("created"), F.coalesce(_column(df, "storage_class_id", F.lit(0)), F.lit(0)).alias("storage_class_id"))
    return out.select("bucket", "name", F.col("size_bytes").cast("long").alias("size_bytes"), "created", F.col("storage_class_id").cast("int").alias("storage_class_id"))


def first_source_wins(sources: list[DataFrame]) -> DataFrame:
    """Union in which a bucket is taken from the first source that has it. Each source's buckets are read once, and few."""
    own, taken = [], None
    for df in map(normalised, sources):
        own.append(df if taken is None else df.join(taken, "bucket", "left_anti"))
        buckets = df.select("bucket").distinct()
        taken = buckets if taken is None else taken.union(buckets).distinct()
    return reduce(DataFrame.unionByName, own)


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket", "name").agg(F.count("*").alias("n")).filter("n > 1")


def rooted(df: DataFrame) -> DataFrame:
    """Local scan roots: where bucket is '', the name's first segment is the bucket."""
    local = F.col("bucket") == ""
    return df.withColumns({"bucket": F.when(local, F.substring_index("name", "/", 1)).otherwise(F.col("bucket")), "name": F.when(local, F.regexp_replace("name", "^[^/]*/?", "")).otherwise(F.col("name"))})


def object_identity(df: DataFrame) -> DataFrame:
    """identity: the version, else the generation; a row with both is refused."""
    version, generation = (_column(df, c, F.lit(None)).cast("string") for c in ("version", "generation"))
    both = version.isNotNull() & generation.isNotNull()
    return df.withColumn("identity", F.when(both, F.raise_error(F.lit("a row has a version and a generation"))).otherwise(F.coalesce(version, generation)))


def prefix_weights(df: DataFrame) -> DataFrame:
    """prefix (with a slash at its end), n: objects below each first segment, and each first two, of names with a slash."""
    name, two = F.col("name"), F.concat(F.substring_index("name", "/", 1), F.lit("/"))
    both = F.array(two, F.concat(two, F.split_part("name", F.lit("/"), F.lit(2)), F.lit("/")))
    return df.filter(name.contains("/")).select(F.explode(both).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def split_hot_prefixes(df: DataFrame, weights: DataFrame, streams: int, sample_rows: int = 500_000) -> DataFrame:
    """prefix, start, end, n: the prefixes (prefix, n) as one range each, or cut at quantiles of their names where they weigh more
    than their share of a stream; null ends are open. A prefix whose quantiles repeat stays whole.

    Quantiles are of at most about sample_rows names of a prefix, drawn by hash; prefixes don't overlap.
    """
    ideal = weights.agg(F.greatest(F.expr(f"sum(n) div {max(streams, 1)}"), F.lit(1)).alias("ideal"))
    w = weights.crossJoin(F.broadcast(ideal)).withColumn("k", F.least(F.ceil(F.col("n") / F.col("ideal")), F.lit(streams)).cast("int"))
    hot = w.filter("k >= 2")
    own = df.select("name", F.explode(F.array(*[F.concat(F.substring_index("name", "/", i), F.lit("/")) for i in (1, 2)])).alias("prefix"))
    drawn = own.join(hot, "prefix").filter(F.col("name").startswith(F.col("prefix")))
    drawn = drawn.filter(F.pmod(F.xxhash64("name"), F.lit(1 << 31)) * F.col("n") < F.lit(float(sample_rows) * (1 << 31)))
    by = Window.partitionBy("prefix")
    ranked = drawn.withColumns({"rn": F.row_number().over(by.orderBy("name")), "m": F.count("*").over(by)})
    at = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.greatest(F.lit(1), F.ceil(i / F.col("k") * F.col("m"))).cast("int"))
    bounds = ranked.filter(F.array_contains(at, F.col("rn"))).groupBy("prefix").agg(F.array_sort(F.collect_list("name")).alias("b"))
    cut = hot.join(bounds, "prefix").filter(F.size("b") == F.col("k") - 1).filter(F.size(F.array_distinct("b")) == F.col("k") - 1)
    edges = F.concat(F.array(F.lit(None).cast("string")), F.col("b"), F.array(F.lit(None).cast("string")))
    ranges = cut.select("prefix", F.posexplode(F.slice(edges, 1, F.col("k"))).alias("i", "start"), edges.alias("e"), F.expr("n div k").alias("n"))
    ranges = ranges.select("prefix", "start", F.get("e", F.col("i") + 1).alias("end"), "n")
    none = F.lit(None).cast("string")
    return ranges.unionByName(weights.join(cut.select("prefix"), "prefix", "left_anti").select("prefix", none.alias("start"), none.alias("end"), "n"))


def pack_chunks(items: list[tuple[str, int]], chunks: int) -> list[list[str]]:
    """Items (name, weight) in chunks of about equal weight: the heaviest first, each to the lightest chunk. A plan of a few prefixes."""
    heap: list[tuple[int, int]] = [(0, i) for i in range(chunks)]
    out: list[list[str]] = [[] for _ in range(chunks)]
    for name, weight in sorted(items, key=lambda x: (-x[1], x[0])):
        total, i = heapq.heappop(heap)
        out[i].append(name)
        heapq.heappush(heap, (total + weight, i))
    return out


def dedupe_prefixes(prefixes: DataFrame) -> DataFrame:
    """prefix, kept: distinct prefixes (with slashes at their ends); one that lies below another isn't kept."""
    p = prefixes.select("prefix").distinct()
    up = p.select("prefix", F.explode(ancestors(F.rtrim("prefix", F.lit("/")), own=False, root=False)).alias("up"))
    inner = up.join(p.select(F.rtrim("prefix", F.lit("/")).alias("up")), "up", "left_semi").select("prefix", F.lit(False).alias("kept")).distinct()
    return p.join(inner, "prefix", "left").select("prefix", F.coalesce("kept", F.lit(True)).alias("kept"))


def ranged(df: DataFrame, partitions: int) -> DataFrame:
    """Listing in key order, in ranges of about equal size; a hot prefix is split as any other."""
    return df.repartitionByRange(partitions, "bucket", "name").sortWithinPartitions("bucket", "name")


def next_prefix(prefix: str) -> str:
    """The least string above all that start with prefix; '' if there is none."""
    trimmed = prefix.rstrip("\U0010ffff")
    return trimmed[:-1] + chr(ord(trimmed[-1]) + 1 + 0x800 * (ord(trimmed[-1]) == 0xD7FF)) if trimmed else ""


def key_midpoint(lo: str, hi: str, digits: int = 8) -> str:
    """A key between lo and hi, about halfway by code points of 21 bits each."""
    a = [ord(c) for c in lo[:digits]] + [0] * (digits - len(lo[:digits]))
    b = [ord(c) for c in hi[:digits]] + [0] * (digits - len(hi[:digits])) if hi else [0x10FFFF] * digits
    low, high = (sum(d << (21 * (digits - 1 - i)) for i, d in enumerate(x)) for x in (a, b))
    mid, out = (low + high) // 2, []
    for i in range(digits):
        c = mid >> (21 * (digits - 1 - i)) & 0x1FFFFF
        out.append(chr(min(c, 0x10FFFF) if not 0xD800 <= c <= 0xDFFF else 0xD7FF))
    return "".join(out).rstrip("\0")


def between(lo: str, hi: str) -> str | None:
    """A key over lo and under hi ('' is open) about halfway, after what both begin with; None if they are too near."""
    same = len(os.path.commonprefix([lo, hi])) if hi else 0
    mid = lo[:same] + key_midpoint(lo[same:], hi[same:])
    return mid if lo < mid and (not hi or mid < hi) else None


#: A range of at most so many names is cut to its end by one task, which holds them.
WITHIN_TASK = 500_000


def _cut(names: list[str], lo: str, hi: str, most: int) -> Iterator[tuple[str, str, int]]:
    """The ranges in order that lo to hi comes to; names are all that it has, sorted."""
    todo = [(lo, hi, 0, len(names))]
    while todo:
        lo, hi, a, b = todo.pop()
        mid = between(names[a], names[b - 1]) if b - a > most and names[a] < names[b - 1] else None
        if mid is None:
            yield lo, hi, b - a
        else:
            m = bisect_left(names, mid, a, b)
            todo += [(mid, hi, m, b), (lo, mid, a, m)]


def cut_ranges(df: DataFrame, most: int, within: int = WITHIN_TASK) -> DataFrame:
    """lo, hi, n: ranges of names, without gaps, of `most` names at most. A range with more is cut in the middle of its names' keyspace, from the
    least to the greatest that it has, until none is left or keys are too near; so only more than `most` equal names, or names that differ late,
    make a larger one.

    The driver cuts what has over `within` names, one aggregation a round, over these ranges only; the others are cut on by a task each.
    df is read once a round.
    """
    spark, names = df.sparkSession, df.select("name").filter("name is not null")
    done: list[tuple[str, str, int]] = []
    small: list[tuple[str, str]] = []
    todo = [("", "")]

    def placed(ranges: list[tuple[str, str]]) -> DataFrame:
        lows, highs = (F.array(*[F.lit(x[i]) for x in ranges]) for i in (0, 1))
        # Ranges are in order, so a name's is the last that begins at or before it, if it ends after it.
        at = names.select("name", (F.size(F.filter(lows, lambda x: x <= F.col("name"))) - 1).alias("r")).filter("r >= 0")
        return at.filter((F.get(highs, F.col("r")) == "") | (F.col("name") < F.get(highs, F.col("r"))))

    while todo:
        stats = {r["r"]: r for r in placed(todo).groupBy("r").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).collect()}
        following: list[tuple[str, str]] = []
        for i, (lo, hi) in enumerate(todo):
            s = stats.get(i)
            n = s["n"] if s else 0
            mid = between(s["lo"], s["hi"]) if n > max(most, within) and s["lo"] < s["hi"] else None
            if mid is not None:
                following += [(lo, mid), (mid, hi)]
            elif most < n <= within:
                small.append((lo, hi))
            else:
                done.append((lo, hi, n))
        todo = following
    kind = "lo string, hi string, n long"
    out = spark.createDataFrame(done, kind)
    if not small:
        return out
    small.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (x for b in batches for x in zip(b.column("r").to_pylist(), b.column("name").to_pylist(), strict=True))
        for r, own in groupby(given, key=lambda x: x[0]):
            found = list(zip(*_cut([name for _, name in own], *small[r], most), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], ["lo", "hi", "n"])

    # Spark and Python order strings alike, by code points.
    own = placed(small).repartition(len(small), "r").sortWithinPartitions("r", "name").select("r", "name")
    return out.unionByName(own.mapInArrow(run, kind))


def split_ranges(df: DataFrame, most: int) -> list[tuple[str, str, int]]:
    """The ranges of cut_ranges as a list in order; it grows with the names."""
    return sorted(tuple(r) for r in cut_ranges(df, most).collect())


def local_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder that Spark can read, as a listing; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(os.path.normpath(root.removeprefix("file://")) + "/")
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(F.lit("local").alias("bucket"), canonical(F.substr(plain, F.length(base) + 1)).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("timestamp_ntz").alias("created"), F.lit(0).alias("storage_class_id"))


def from_rollup(rows: DataFrame) -> DataFrame:
    """The listing that file rows of a rollup stand for (path starts with the bucket; mtime in epoch seconds)."""
    return rows.filter("kind = 'file'").select(F.substring_index("path", "/", 1).alias("bucket"), F.regexp_replace("path", "^[^/]*/", "").alias("name"), F.col("size").alias("size_bytes"), F.timestamp_seconds("mtime").cast("timestamp_ntz").alias("created"), F.lit(0).alias("storage_class_id"))
