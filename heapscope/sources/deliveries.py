"""Which delivered log files are still to be read: a watermark for each bucket, with a window for stragglers; and state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours before the watermark in which files may still come late. A fixed value.
LAG_HOURS = 6
#: The delivery time in a file's name (a fixed pattern), and how it is written.
STAMP, FORM = r"_usage_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2})_", "yyyy_MM_dd_HH_mm_ss"


def delivered_at(name: Column) -> Column:
    """Epoch seconds of a file's name; null without a stamp."""
    text = F.regexp_extract(name, STAMP, 1)
    return F.when(text != "", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.to_timestamp_ntz(text, F.lit(FORM))))


def pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """Of the files (bucket, name, size) those still to be read: names past the bucket's watermark, and stragglers within the lag before
    it that its tail doesn't hold. state: bucket, watermark (a name), tail (names read within the lag); a bucket without state is read whole."""
    j = files.join(state, "bucket", "left").withColumn("_at", delivered_at(F.col("name")))
    edge = delivered_at(F.col("watermark")) - LAG_HOURS * 3600
    listed = F.col("watermark").isNull() | edge.isNull() | (F.col("_at") >= edge)
    return j.filter(listed & ~F.coalesce(F.array_contains("tail", F.col("name")), F.lit(False))).select("bucket", "name", "size")


def advanced(state: DataFrame, read: DataFrame) -> DataFrame:
    """The state after the files in read (bucket, name): the greatest name, and the names within the lag before it. A tail holds six
    hours' files of a bucket."""
    old = state.select("bucket", F.explode_outer(F.array_append(F.coalesce("tail", F.array().cast("array<string>")), F.col("watermark"))).alias("name"))
    known = old.filter("name is not null").unionByName(read.select("bucket", "name")).distinct()
    top = known.groupBy("bucket").agg(F.max(F.struct(delivered_at(F.col("name")).alias("at"), "name")).alias("m"))
    kept = known.join(top, "bucket").filter(delivered_at(F.col("name")) >= F.col("m.at") - LAG_HOURS * 3600)
    return kept.groupBy("bucket", F.col("m.name").alias("watermark")).agg(F.array_sort(F.collect_list("name")).alias("tail"))


def planned_chunks(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Names (with sizes, in order of delivery) in chunks of at most `most` bytes, a file at least; so a chunk is a span of time."""
    out: list[list[str]] = []
    total = 0
    for name, size in files:
        if not out or total + size > most:
            out.append([])
            total = 0
        out[-1].append(name)
        total += size
    return out


class BadState(ValueError):
    """A state of an unknown version, with daily aggregates, or ahead of what has been read."""


def state_keys(states: DataFrame, before: int | None = None) -> DataFrame:
    """bucket, hour, key: the current aggregate of every hour that the state files (value, one JSON each) name, within retention (hours) or
    past it (frozen; hours wins), starting before a time."""
    get = lambda p: F.get_json_object("value", p)
    if states.filter(~F.coalesce(get("$.schema_version").isin("2", "3"), F.lit(False))).limit(1).count():
        raise BadState("unknown schema_version")
    buckets = states.select(F.explode(F.from_json(get("$.buckets"), "map<string, string>")).alias("bucket", "b"))
    of = lambda p: F.get_json_object("b", p)
    if buckets.filter(F.coalesce(of("$.legacy_days"), F.lit("null")).isin("null", "[]", "{}", "false") == F.lit(False)).limit(1).count():
        raise BadState("daily aggregates")
    none = F.create_map().cast("map<string, string>")
    frozen, hours = F.coalesce(F.from_json(of("$.frozen"), "map<string, string>"), none), F.coalesce(F.from_json(of("$.hours"), "map<string, string>"), none)
    current = F.transform_values(hours, lambda _, v: F.get_json_object(v, "$.agg"))
    named = F.map_concat(F.map_filter(frozen, lambda k, _: ~F.map_contains_key(hours, k)), current)
    rows = buckets.select("bucket", F.explode(named).alias("hour", "key"))
    start = F.unix_seconds(F.coalesce(F.try_to_timestamp("hour", F.lit("yyyy-MM-dd'T'HH")), F.try_to_timestamp("hour", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("hour")))
    return rows if before is None else rows.filter(start < before)
