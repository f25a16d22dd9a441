"""Thresholds that grow with depth, in doubles and in exact whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heapscope.functions.paths import depth

_WIDE = "decimal(38,0)"


def over_band(size: Column, path: Column, top: str, least: float, attenuation: float) -> Column:
    """size >= least * attenuation^max(0, levels below top - 1)."""
    d = depth(path) - depth(F.lit(top))
    return size >= F.lit(float(least)) * F.pow(F.lit(float(attenuation)), F.greatest(d - 1, F.lit(0)))


def over_cell(size: Column, path: Column, least: int, scale_bits: int, step: int) -> Column:
    """size * 2^scale_bits >= least * 2^(step * depth), in whole numbers only."""
    bits = F.array(*[F.lit(2 ** (step * d)).cast(_WIDE) for d in range(max(1, 62 // max(1, step)))])
    return size.cast("decimal(19,0)") * F.lit(2**scale_bits).cast("decimal(19,0)") >= F.lit(least).cast("decimal(19,0)") * F.element_at(bits, depth(path) + 1).cast("decimal(19,0)")


def scaled(value: Column, part: Column, whole: Column) -> Column:
    """value * part / whole, cut to a whole number, without rounding on the way."""
    product = (value.cast("decimal(19,0)") * part.cast("decimal(19,0)")).cast(_WIDE)
    return F.when(whole != 0, F.call_function("div", product, whole.cast(_WIDE))).otherwise(0).cast("long")
