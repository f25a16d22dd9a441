"""Views of rollups: largest rows, thresholded trees, diffs, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import depth, in_subtree, parent


def largest(rows: DataFrame, top: str, n: int, own: bool = True) -> DataFrame:
    """The n + 1 largest rows under top, ties by path; the last one only tells that there are more."""
    under = rows.filter(in_subtree(F.col("path"), top) & ((F.col("path") != top) if not own or top else F.lit(True)))
    return under.orderBy(F.desc("size"), "path").limit(n + 1)


def _under(rows: DataFrame, top: str) -> DataFrame:
    """rows at and below top, with d, the levels below it."""
    return rows.filter(in_subtree(F.col("path"), top)).withColumn("d", depth(F.col("path")) - depth(F.lit(top)))


def _grown(least: Column, d: Column, attenuation: float) -> Column:
    """The threshold d levels below the top."""
    return least * F.pow(F.lit(float(attenuation)), F.greatest(d - 1, F.lit(0)))


def _other(path: str) -> Column:
    return F.concat_ws("/", F.nullif(path, F.lit("")), F.lit("(other)"))


def view(rows: DataFrame, top: str, width: int, height: int, least_area: float = 12.0, attenuation: float = 2.0, levels: int | None = None) -> DataFrame:
    """The tiles of a subtree: path, kind, size, n_files, up (the tile it lies in) and folded.

    rows: path, kind, size, n_files, n_children of top and all below. The threshold is top's size times the least area of a
    tile over the canvas; d levels down it is attenuation^(d - 1) times that. What a tile's own tiles leave of it is its
    '(other)', if that is over its tiles' threshold, with the number of children that aren't drawn as folded.
    """
    under = _under(rows, top)
    least = under.filter("d = 0").select((F.col("size") * F.lit(least_area) / F.lit(float(width * height))).alias("least"))
    within = F.lit(True) if levels is None else F.col("d") <= levels
    kept = under.crossJoin(F.broadcast(least)).filter((F.col("d") == 0) | (within & (F.col("size") >= _grown(F.col("least"), F.col("d"), attenuation))))
    kept = kept.withColumn("up", F.when(F.col("d") > 0, parent(F.col("path"))))
    there = kept.select(F.col("path").alias("up"), F.lit(True).alias("_there"))
    kept = kept.join(there, "up", "left").withColumn("up", F.when(F.col("up").isNull() | F.col("_there"), F.col("up")).otherwise(F.lit(top)))
    inside = kept.filter("up is not null").groupBy("up").agg(F.sum("size").alias("s"), F.sum("n_files").alias("n"), F.count("*").alias("drawn"), F.min("d").alias("below")).withColumnRenamed("up", "path")
    rest = kept.join(inside, "path").withColumn("left", F.col("size") - F.col("s")).filter(F.col("left") > _grown(F.col("least"), F.col("below"), attenuation))
    folded = F.greatest(F.lit(0), F.col("n_children") - F.col("drawn")).cast("long")
    other = rest.select(_other("path").alias("path"), F.lit("dir").alias("kind"), F.col("left").alias("size"), F.greatest(F.lit(0), F.col("n_files") - F.col("n")).cast("long").alias("n_files"), F.col("path").alias("up"), folded.alias("folded"))
    return kept.select("path", "kind", "size", "n_files", "up", F.lit(None).cast("long").alias("folded")).unionByName(other)


SIDES = ["before", "after", "n_before", "n_after"]


def diff(old: DataFrame, new: DataFrame, top: str, width: int, height: int, least_area: float = 12.0, attenuation: float = 2.0, levels: int | None = None) -> DataFrame:
    """Tiles of two scans of a subtree: path, kind, status, before, after, n_before, n_after, expanded.

    Both sides are drawn at one threshold, that of the larger top. What is a tile on either side has both sides' values, also
    where it is too small for a tile on the other. A tile with tiles in it is expanded; what they leave on either side is its
    '(other)', if one side's is over their threshold.
    """
    a, b = (_under(x, top).select("path", "d", "kind", "size", "n_files") for x in (old, new))
    j = a.select("path", F.col("d").alias("da"), F.col("kind").alias("ka"), F.col("size").alias("before"), F.col("n_files").alias("n_before"), F.lit(True).alias("ina")).join(
        b.select("path", F.col("d").alias("db"), F.col("kind").alias("kb"), F.col("size").alias("after"), F.col("n_files").alias("n_after"), F.lit(True).alias("inb")), "path", "full_outer"
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in SIDES}
    j = j.withColumns(zero | {"d": F.coalesce("da", "db"), "kind": F.coalesce("kb", "ka")})
    least = j.filter("d = 0").select((F.greatest("before", "after") * F.lit(least_area) / F.lit(float(width * height))).alias("least"))
    within = F.lit(True) if levels is None else F.col("d") <= levels
    most = F.greatest("before", "after")
    drawn = j.crossJoin(F.broadcast(least)).filter((F.col("d") == 0) | (within & (most >= _grown(F.col("least"), F.col("d"), attenuation))))
    same = (F.col("before") == F.col("after")) & (F.col("n_before") == F.col("n_after"))
    status = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    drawn = drawn.withColumn("status", status)
    kids = drawn.filter("d > 0").groupBy(parent(F.col("path")).alias("path")).agg(*[F.sum(c).alias(f"_{c}") for c in SIDES])
    tiles = drawn.join(kids, "path", "left").withColumn("expanded", F.col("_before").isNotNull())
    left = {c: (F.col(c) - F.col(f"_{c}")).alias(c) for c in SIDES}
    rest = tiles.filter("expanded").select("path", "d", "least", *left.values())
    rest = rest.filter(F.greatest("before", "after") > _grown(F.col("least"), F.col("d") + 1, attenuation))
    other = rest.select(_other("path").alias("path"), F.lit("dir").alias("kind"), F.when(same, "unchanged").otherwise("changed").alias("status"), *SIDES, F.lit(False).alias("expanded"))
    return tiles.select("path", "kind", "status", *SIDES, "expanded").unionByName(other)


def descent(old: DataFrame, new: DataFrame, top: str, levels: int, width: int, height: int, least_area: float = 12.0, attenuation: float = 2.0) -> DataFrame:
    """The tiles of diff() without '(other)', from files (path, size) by going down level by level: a level's sums are made only below the
    directories that the level before has drawn. path, kind, status, before, after, n_before, n_after."""
    own = lambda x, c, n: x.filter(in_subtree(F.col("path"), top)).select("path", *[(F.col("size") if k == c else F.lit(1) if k == n else F.lit(0)).cast("long").alias(k) for k in SIDES])
    both = own(old, "before", "n_before").unionByName(own(new, "after", "n_after"))
    sums = [F.sum(c).alias(c) for c in SIDES]
    whole = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIDES])
    least = F.broadcast(whole.select((F.greatest("before", "after") * F.lit(least_area) / F.lit(float(width * height))).alias("least")))
    base = top.count("/") + 1 if top else 0
    tiles = [whole.select(F.lit(top).alias("path"), F.lit("dir").alias("kind"), *SIDES)]
    frontier = whole.select(F.lit(top).alias("up"))
    for d in range(1, levels + 1):
        at = both.withColumn("up", F.substring_index("path", "/", base + d - 1) if base + d > 1 else F.lit("")).filter(depth(F.col("path")) >= base + d)
        below = at.join(frontier, "up", "left_semi").groupBy(F.substring_index("path", "/", base + d).alias("tile"))
        kids = below.agg(*sums, F.when(F.max(depth(F.col("path"))) > base + d, "dir").otherwise("file").alias("kind")).withColumnRenamed("tile", "path")
        drawn = kids.crossJoin(least).filter(F.greatest("before", "after") >= F.col("least") * float(attenuation ** (d - 1)))
        tiles.append(drawn.select("path", "kind", *SIDES))
        frontier = drawn.filter("kind = 'dir'").select(F.col("path").alias("up"))
    same = (F.col("before") == F.col("after")) & (F.col("n_before") == F.col("n_after"))
    status = F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed").when(same, "unchanged").otherwise("changed")
    return reduce(DataFrame.unionByName, tiles).select("path", "kind", status.alias("status"), *SIDES)


def level(versions: DataFrame, top: str, t1: int, t2: int, k: int, first_t: int, by: str = "churn") -> DataFrame:
    """What a directory's children did over (t1, t2]: role, name, kind, status, count, before, after, n_before, n_after, churn.

    Roles: own (the directory), row (the k children with the greatest churn, or change in size, ties by name), other (the rest
    of the changed ones, summed), unchanged (the directory less the changed ones), and next, the only changed child, if it is
    a directory. Children are summed before they are ranked, and the ranking takes the top of each partition first.
    """
    from heapscope.functions.paths import child_of
    from heapscope.operators.history import file_churn

    under = versions.filter(in_subtree(F.col("path"), top) & (F.col("path") != top))
    own = lambda x: x.withColumns({"child": child_of(F.col("path"), F.lit(top)), "deeper": depth(F.col("path")) > depth(F.lit(top)) + 1})
    at = lambda t: (F.col("vf") <= t) & (F.col("vt") > t)
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0)).cast("long")
    size = own(under).groupBy("child").agg(total(at(t1), F.col("size")).alias("before"), total(at(t2), F.col("size")).alias("after"), total(at(t1), F.lit(1)).alias("n_before"), total(at(t2), F.lit(1)).alias("n_after"), F.bool_or("deeper").alias("deeper"))
    moved = own(file_churn(under, first_t).filter((F.col("t") > t1) & (F.col("t") <= t2))).groupBy("child").agg(F.sum("churn").alias("churn"))
    each = size.join(moved, "child", "left").withColumn("churn", F.coalesce("churn", F.lit(0)).cast("long"))
    changed = each.filter("churn <> 0 or before <> after or n_before <> n_after")
    measure = F.col("churn") if by == "churn" else F.abs(F.col("after") - F.col("before"))
    rows = changed.orderBy(measure.desc(), "child").limit(k)
    values = [*SIDES, "churn"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in values]
    status = F.when((F.col("n_before") == 0) & (F.col("n_after") > 0), "added").when((F.col("n_before") > 0) & (F.col("n_after") == 0), "removed").otherwise("changed")
    kind = F.when(F.col("deeper"), "dir").otherwise("file")

    def out(x: DataFrame, role: str, name: Column, kind: Column, status: Column, count: Column) -> DataFrame:
        return x.select(F.lit(role).alias("role"), name.cast("string").alias("name"), kind.cast("string").alias("kind"), status.cast("string").alias("status"), count.cast("long").alias("count"), *values)

    none, one = F.lit(None), F.lit(1)
    label = F.element_at(F.split("child", "/"), -1)
    whole, other = each.agg(*sums), changed.join(rows.select("child"), "child", "left_anti").agg(F.count("*").alias("count"), *sums).filter("count > 0")
    gone = changed.agg(F.count("*").alias("count"), F.max("child").alias("child"), F.bool_or("deeper").alias("deeper"), *sums)
    still = whole.crossJoin(gone.select(*[F.col(c).alias(f"_{c}") for c in values])).select(*[(F.col(c) - F.col(f"_{c}")).alias(c) for c in SIDES], F.lit(0).cast("long").alias("churn"))
    parts = [
        out(whole, "own", F.lit(top), F.lit("dir"), none, one),
        out(rows, "row", label, kind, status, one),
        out(other, "other", none, none, none, F.col("count")),
        out(still, "unchanged", none, none, none, none),
        out(gone.filter("count = 1 and deeper"), "next", label, F.lit("dir"), none, one),
    ]
    return reduce(DataFrame.unionByName, parts)


def _drawn(nodes: DataFrame, total: DataFrame, top: str, levels: int, rule: dict) -> DataFrame:
    """role, path, before, n_before, after, n_after: the total, the nodes that the rule keeps, and what their kept children leave.

    nodes: node, k (levels below top) and the sides. rule: share_log2, atten_log2 and floor_bytes in whole numbers, or min_ppm.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    power = lambda base, step: F.get(F.array(*[F.lit(base * 2 ** (step * i)).cast("decimal(38,0)") for i in range(levels)]), F.col("k") - 1)
    most = wide(F.greatest("before", "after"))
    whole = total.select(wide(F.greatest("before", "after")).alias("whole"))
    if "min_ppm" in rule:
        keep = most * 1_000_000 >= F.col("whole") * rule["min_ppm"]
    else:
        step, keep = rule.get("atten_log2", 1), F.lit(True)
        if "share_log2" in rule:
            keep &= most * F.lit(2 ** rule["share_log2"]).cast("decimal(20,0)") >= F.col("whole").cast("decimal(20,0)") * power(1, step).cast("decimal(18,0)")
        if rule.get("floor_bytes"):
            keep &= most >= power(rule["floor_bytes"], step)
    sides = ["before", "n_before", "after", "n_after"]
    kept = nodes.crossJoin(F.broadcast(whole)).filter(keep).select(F.col("node").alias("path"), "k", *sides)
    every = kept.unionByName(total.select(F.lit(top).alias("path"), F.lit(0).alias("k"), *sides))
    kids = kept.groupBy(F.when(F.col("k") > 1, parent(F.col("path"))).otherwise(F.lit(top)).alias("path")).agg(*[F.sum(c).alias(f"_{c}") for c in sides])
    rest = every.filter(F.col("k") < levels).join(kids, "path", "left").select("path", *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) for c in sides])
    rest = rest.filter(" or ".join(f"{c} <> 0" for c in sides))
    role = lambda x, r: x.select(F.lit(r).alias("role"), "path", *[F.col(c).cast("long").alias(c) for c in sides])
    return role(total.withColumn("path", F.lit(top)), "total").unionByName(role(kept, "node")).unionByName(role(rest, "rest"))


def full_scan(objects: DataFrame, top: str, t1: int, t2: int | None, levels: int, **rule) -> DataFrame:
    """A view of one or two scans from object versions (path, size, vf, vt), of which a caller has taken those it asks for.

    Objects are summed by their directory within the levels before they are exploded to them.
    """
    at = lambda t: (F.col("vf") <= t) & (F.col("vt") > t) if t is not None else F.lit(False)
    a, b = at(t1), at(t2)
    live = _under(objects, top).filter((F.col("d") > 0) & (a | b))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v).otherwise(0)), F.lit(0)).cast("long")
    base = depth(F.lit(top))
    own = live.groupBy(F.substring_index("path", "/", levels + (top.count("/") + 1 if top else 0)).alias("path"), F.least("d", F.lit(levels)).alias("d"))
    own = own.agg(total(a, F.col("size")).alias("before"), total(a, F.lit(1)).alias("n_before"), total(b, F.col("size")).alias("after"), total(b, F.lit(1)).alias("n_after"))
    sides = ["before", "n_before", "after", "n_after"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sides]
    each = own.select("path", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("k"), *sides)
    segments = F.split("path", "/")
    nodes = each.groupBy(F.array_join(F.slice(segments, 1, base + F.col("k")), "/").alias("node"), "k").agg(*sums)
    return _drawn(nodes, own.agg(*sums), top, levels, rule)


def dirs_scan(old: DataFrame, new: DataFrame | None, top: str, levels: int, **rule) -> DataFrame:
    """The same from each path's own row (path, size, n_files, directories rolled up), without a filter."""
    a = _under(old, top).select("path", "d", F.col("size").alias("before"), F.col("n_files").alias("n_before"))
    b = _under(new if new is not None else old.limit(0), top).select("path", "d", F.col("size").alias("after"), F.col("n_files").alias("n_after"))
    j = a.join(b, ["path", "d"], "full_outer").select("path", "d", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("before", "n_before", "after", "n_after")])
    sides = ["before", "n_before", "after", "n_after"]
    nodes = j.filter((F.col("d") > 0) & (F.col("d") <= levels)).select(F.col("path").alias("node"), F.col("d").alias("k"), *sides)
    return _drawn(nodes, j.filter("d = 0").select(*sides), top, levels, rule)


def top_with_other(rows: DataFrame, by: str, name: str, n: int, partition: list[str] | None = None, value: str | None = None) -> DataFrame:
    """The n names with the greatest |value| of each partition, and one row '(other)' for the rest.

    Sums come first, so the ranking is over names, not rows.
    """
    partition, value = partition or [], value or by
    if not partition:  # the top of each task's rows, then of those; the others are summed where they are
        head = rows.orderBy(F.desc(F.abs(F.col(by))), name).limit(n)
        named = head.select(F.col(name).alias("_name"))
        rest = rows.join(named, rows[name].eqNullSafe(named["_name"]), "left_anti")
        other = rest.agg(F.lit("(other)").alias(name), F.sum(value).alias(value), F.count("*").alias("_n")).filter("_n > 0")
        return head.select(name, value).unionByName(other.select(name, value))
    w = Window.partitionBy(*partition).orderBy(F.desc(F.abs(F.col(by))), name)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    return ranked.withColumn(name, F.when(F.col("_rn") <= n, F.col(name)).otherwise("(other)")).groupBy(*partition, name).agg(F.sum(value).alias(value))


def step_union(points: DataFrame) -> DataFrame:
    """Series (series, t, v) at the instants of all of them: t, series and the series' latest value; null before its first.

    A value holds until the series' next one, so instants are joined to it by the time it holds; nothing is crossed but a
    series with the instants it has a row for in the result.
    """
    times = points.select("t").distinct()
    first = points.groupBy("series").agg(F.min("t").alias("first"))
    own = points.groupBy("series", "t").agg(F.max("v").alias("v"))
    until = F.lead("t").over(Window.partitionBy("series").orderBy("t"))
    holds = own.withColumn("until", until)
    p, i = holds.alias("p"), times.alias("i")
    known = p.join(i, F.expr("i.t >= p.t and (p.until is null or i.t < p.until)")).select("i.t", "p.series", "p.v")
    before = first.alias("f").join(times.alias("i"), F.expr("i.t < f.first")).select("i.t", "f.series", F.lit(None).cast(points.schema["v"].dataType).alias("v"))
    return known.unionByName(before)
