"""Age of data: bytes and objects by creation time, per prefix, in several bin widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, parent

#: Bin widths in seconds (fixed values): 1, 3, 6, 12 hours, 1, 2, 4, 8 days.
WIDTHS = {"1h": 3600, "3h": 10800, "6h": 21600, "12h": 43200, "1d": 86400, "2d": 172800, "4d": 345600, "8d": 691200}


def _bin(column: str, seconds: int):
    return (F.col(column) - F.pmod(F.col(column), F.lit(seconds))).cast("long")


def strata(file_rows: DataFrame, keys: list[str]) -> DataFrame:
    return file_rows.groupBy(_bin("mtime", 86400).alias("day"), *keys).agg(F.sum("size").alias("b"), F.count("*").alias("o"))


def index(file_rows: DataFrame, seconds: int = 86400, floor_bits: int | None = 24) -> DataFrame:
    """path, bin, b, o for every directory; directories under 2^(round(log2 total) - floor_bits) bytes are left out."""
    first = file_rows.groupBy(parent(F.col("path")).alias("d"), _bin("mtime", seconds).alias("bin")).agg(F.sum("size").alias("b"), F.count("*").alias("o"))
    up = first.select(F.explode(ancestors(F.col("d"))).alias("path"), "bin", "b", "o").groupBy("path", "bin").agg(F.sum("b").alias("b"), F.sum("o").alias("o"))
    if floor_bits is None:
        return up
    totals = up.groupBy("path").agg(F.sum("b").alias("t"))
    floor = totals.filter("path = ''").select(F.pow(F.lit(2.0), F.round(F.log2(F.col("t").cast("double"))) - floor_bits).alias("floor"))
    return up.join(totals.crossJoin(F.broadcast(floor)).filter("t >= floor").select("path"), "path", "left_semi")


def pyramid(base: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """tier, path, bin, b, o: the base bins and coarser ones, each from the base by one pass that explodes a row to its bins."""
    widths = widths or WIDTHS
    tiers = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), _bin("bin", w).alias("bin")) for n, w in widths.items()])).alias("x")
    return base.select("path", "b", "o", tiers).groupBy("x.tier", "path", "x.bin").agg(F.sum("b").alias("b"), F.sum("o").alias("o"))


def tier_for(span_seconds: int, budget: int, widths: dict[str, int] | None = None) -> str:
    """The finest tier with at most `budget` bins over the span, else the coarsest."""
    widths = widths or WIDTHS
    return next((n for n, w in widths.items() if -(-span_seconds // w) <= budget), list(widths)[-1])
