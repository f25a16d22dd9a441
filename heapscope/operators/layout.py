"""Squarified treemap rectangles of the children of each directory."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def squarified(sizes: list[float], w: float, h: float) -> list[tuple[float, float, float, float]]:
    """x, y, width, height for sizes in descending order, filling w by h: rows are laid along the shorter side, and a row takes
    another size as long as its worst ratio of sides doesn't grow."""
    total = sum(sizes)
    if total <= 0 or w <= 0 or h <= 0:
        return [(0.0, 0.0, 0.0, 0.0)] * len(sizes)
    areas = [s * w * h / total for s in sizes]
    out: list[tuple[float, float, float, float]] = []
    x = y = 0.0
    i = 0

    def worst(row: list[float], side: float) -> float:
        s = sum(row)
        return max(max(side * side * a / (s * s), s * s / (side * side * a)) if a > 0 else 1.0 for a in row)

    while i < len(areas):
        side, row = min(w, h), [areas[i]]
        while i + len(row) < len(areas) and worst([*row, areas[i + len(row)]], side) <= worst(row, side):
            row.append(areas[i + len(row)])
        thick, at = (sum(row) / side if side else 0.0), 0.0
        for a in row:
            long = a / thick if thick else 0.0
            out.append((x, y + at, thick, long) if w >= h else (x + at, y, long, thick))
            at += long
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        i += len(row)
    return out


def rectangles(children: DataFrame, width: float = 1000.0, height: float = 600.0, most: int = 500) -> DataFrame:
    """up, path, x, y, w, h of the children of each directory: the `most` largest, and all others as one tile '(other)'.

    A view's tiles are bounded, so is what is laid out at once.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("up").orderBy(F.desc("size"), "path"))
    tile = children.withColumn("_rn", F.least(rank, F.lit(most + 1)))
    named = tile.withColumn("path", F.when(F.col("_rn") <= most, F.col("path")).otherwise("(other)")).groupBy("up", "_rn", "path").agg(F.sum("size").cast("double").alias("size"))
    top = named.groupBy("up").agg(F.array_sort(F.collect_list(F.struct(-F.col("size"), "path", "size"))).alias("k"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = [(up, c["path"], *r) for up, kids in zip(b["up"], b["k"], strict=True) for c, r in zip(kids, squarified([float(c["size"]) for c in kids], width, height), strict=True)]
            yield pd.DataFrame(rows, columns=["up", "path", "x", "y", "w", "h"])

    return top.mapInPandas(run, "up string, path string, x double, y double, w double, h double")
