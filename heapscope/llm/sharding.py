"""Sharding by sampled splitters: size-weighted key samples give the boundaries of ranges, and ranges go to shards.

Key: the hash of the text, then doc_id, then for rows without a doc_id a number of the row; so equal texts lie together, and
a text with very many copies, with or without ids, still falls into several ranges. 1. Draw a sample in which a row's
chance follows its size. 2. Its quantiles are the splitters; every row goes to the range of its key. The number of ranges
follows the session's partitions. 3. Ranges are summed exactly, and a shard boundary that falls within a range subdivides
it by the running size in it. Law "bytes": the shards' sizes differ by no more than a row's size from even, unless equal
texts are kept together, and then by a group's size at most; groups over keep_share of a shard are subdivided.

Null text: size 1. Null doc_id: sorts first. Empty texts form one group of equal texts. Rows that repeat are
placed one by one; ties of the whole key are equal rows, and their order is that of their sizes and checksums. Very long
texts: only their size and hashes move. An empty table gives an empty result. Extra columns are ignored, whatever their
names. Only built-in DataFrame functions run here.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heapscope.llm.common import spread, staged


_LOW = -(2**63)


def _range_of(key: Column, splitters: list[tuple[int, int, int]]) -> Column:
    """The number of splitters that are not above key.

    The hash's first bits say which splitters are near: a list says how many lie before those bits, and only the few with the
    same bits are compared. So the plan holds a few lists, and a row costs the same at any number of splitters.
    """
    if not splitters:
        return F.lit(0)
    bits = max(1, (len(splitters) - 1).bit_length())
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    of = [(h >> (64 - bits)) + (1 << (bits - 1)) for h, _, _ in splitters]
    upto = [0] * ((1 << bits) + 1)
    for x in of:
        upto[x + 1] += 1
    for i in range(1 << bits):
        upto[i + 1] += upto[i]
    at = (F.shiftright(key["h"], 64 - bits) + (1 << (bits - 1))).cast("int")
    before, after = F.get(numbers(upto), at), F.get(numbers(upto), at + 1)
    near = F.slice(F.arrays_zip(*(numbers(x).alias(n) for x, n in zip(zip(*splitters, strict=True), "hdr", strict=True))), before.cast("int") + 1, (after - before).cast("int"))
    below = F.filter(near, lambda x: F.struct(x["h"], x["d"], x["r"]) <= F.struct(key["h"], key["d"], key["r"]))
    return (before + F.size(below)).cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, sample_rows: int | None = None, ranges_per_shard: int | None = None, keep_share: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. The sample is of about sample_rows keys (16 a range if not given), drawn by hash.

    ranges_per_shard: 16 or more, so that there are two ranges for each partition of the session.
    """
    spark = docs.sparkSession
    ranges_per_shard = ranges_per_shard or max(16, -(-2 * spread(spark) // shards))
    sample_rows = sample_rows or max(4096, 16 * shards * ranges_per_shard)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.struct(
                F.xxhash64(text).alias("h"),
                F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("d"),
                F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("r"),
            ).alias("key"),
        ),
        "shard-keys",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # A row stands as often in the sample as hits of a comb with one tooth each `step` bytes, at its own offset.
    step = max(1, -(-total // sample_rows))
    hits = F.expr(f"(size + pmod(xxhash64(key.d, key.h, key.r), {step})) div {step}")
    drawn = sorted((tuple(r.key), r.hits) for r in keyed.select("key", hits.alias("hits")).filter("hits > 0").collect())
    n, seen, splitters = shards * ranges_per_shard, 0, []
    weight = sum(w for _, w in drawn)
    for k, w in drawn:
        while len(splitters) < n - 1 and seen + w > weight * (len(splitters) + 1) / n:
            splitters.append(k)
        seen += w
    # A text that is a splitter once starts a range with all its copies; one that is a splitter again and again is subdivided by doc_id.
    often = Counter(k[0] for k in set(splitters))
    splitters = sorted({k if often[k[0]] > 1 else (k[0], _LOW, 0) for k in splitters})
    placed = keyed.withColumn("range", _range_of(F.col("key"), splitters))

    # Exact totals of the ranges: at most n rows, whatever the input.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("c"))
    sums = sums.select("range", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "bc"))
    w = Window.partitionBy("range").orderBy("key", "size", "text_crc32")
    here = w.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "key.h")
    ordered = (
        placed.withColumns({"b_in": F.coalesce(F.sum("size").over(here), F.lit(0)), "c_in": F.row_number().over(w) - 1})
        .withColumns({"g_from": F.min("b_in").over(group), "g_size": F.sum("size").over(group)})
        .join(F.broadcast(sums), "range")
        .withColumns({"b": F.col("b_in") + F.col("b_before"), "rank": F.col("c_in") + F.col("c_before")})
    )
    # A small group of equal texts goes where its middle byte falls; a large one, and any single row, where its own middle falls.
    small = F.col("g_size") <= int(keep_share * total / shards)
    middle = F.when(small, F.col("g_from") + F.col("b_before") + F.expr("g_size div 2")).otherwise(F.col("b") + F.expr("size div 2"))
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(total)).cast("int"))
    ordered = staged(ordered.select("doc_id", "size", "text_crc32", shard.alias("shard"), "rank"), "shard-ranks")
    # Shards follow the key order, so a row's slot is its rank less the first rank of its shard.
    first = ordered.groupBy("shard").agg(F.min("rank").alias("first"))
    return ordered.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes docs as Parquet, a folder for each shard, rows in the order of their slots.

    doc_id must be unique and not null here, and docs have no columns called shard or slot.
    """
    if taken := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns of these names: {sorted(taken)}")
    placed = assign_shards(docs, shards).select("doc_id", "shard", "slot")
    joined = docs.join(placed, "doc_id").repartitionByRange(max(shards, spread(docs.sparkSession)), "shard", "slot")
    joined.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
