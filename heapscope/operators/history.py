"""History of rows over scans as validity intervals [vf, vt), and what is read from them.

A version is a run of consecutive scans with equal change columns; an absent scan ends it. vt is the time of the scan
after the run, OPEN if there is none.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, parent
from heapscope.functions.scalars import OPEN


def _same(columns: list[str], w) -> Column:
    return reduce(lambda a, b: a & b, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in columns], F.lit(True))


def versions(scans: DataFrame, key: list[str], change: list[str], carried: list[str] | None = None, times: Sequence[int] | None = None) -> DataFrame:
    """key, change and carried columns (those of the first scan), vf, vt. scans has scan (ordinal, from 0) and t (epoch seconds).

    A run's first and last rows are told by their neighbours; of these alone, a first row's next one is its run's last. So all
    is done in one order of the rows, with one shuffle. times: t of all scans in order; without it they are read from scans.
    """
    carried = carried or []
    w = Window.partitionBy(*key).orderBy("scan")
    follows = lambda near, step: near("scan") == F.col("scan") + step
    same = lambda near: reduce(lambda a, b: a & b, [near(c).eqNullSafe(F.col(c)) for c in change], F.lit(True))
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    edges = {
        "_first": ~F.coalesce(same(before) & follows(before, -1), F.lit(False)),
        "_last": ~F.coalesce(same(after) & follows(after, 1), F.lit(False)),
    }
    ends = scans.select(*key, *change, *carried, "scan", "t").withColumns(edges).filter("_first or _last")
    runs = ends.withColumn("_end", F.when(F.col("_last"), F.col("scan")).otherwise(F.lead("scan").over(w))).filter("_first")
    own = [*key, *change, *carried]
    if times is not None:
        until = F.get(F.array(*[F.lit(t).cast("long") for t in times]), (F.col("_end") + 1).cast("int"))
        return runs.select(*own, F.col("t").alias("vf"), F.coalesce(until, F.lit(OPEN)).cast("long").alias("vt"))
    # One row for each scan.
    known = scans.select((F.col("scan") - 1).alias("_end"), F.col("t").alias("_t")).distinct()
    return runs.join(known, "_end", "left").select(*own, F.col("t").alias("vf"), F.coalesce("_t", F.lit(OPEN)).cast("long").alias("vt"))


def coalesced(v: DataFrame, key: list[str], change: list[str]) -> DataFrame:
    """Adjacent versions with equal values as one."""
    w = Window.partitionBy(*key).orderBy("vf")
    fresh = F.when(_same(change, w) & (F.lag("vt").over(w) == F.col("vf")), 0).otherwise(1)
    runs = v.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, *change, "_run").agg(F.min("vf").alias("vf"), F.max("vt").alias("vt")).drop("_run")


def best(parts: DataFrame, identity: list[str]) -> DataFrame:
    """One row for each version: that with the least vt, as a closed copy stands for an open one."""
    rest = [c for c in parts.columns if c not in identity]
    return parts.groupBy(*identity).agg(F.min_by(F.struct(*rest), "vt").alias("_x")).select(*identity, "_x.*")


def live(v: DataFrame, t: int) -> DataFrame:
    return v.filter((F.col("vf") <= t) & (F.col("vt") > t))


def as_of(base: DataFrame, runs: DataFrame, identity: list[str], t: int) -> DataFrame:
    return live(best(base.unionByName(runs), identity), t)


def changed(v: DataFrame, t1: int, t2: int) -> DataFrame:
    """Versions that begin or end in (t1, t2]."""
    return v.filter(((F.col("vf") > t1) & (F.col("vf") <= t2)) | ((F.col("vt") > t1) & (F.col("vt") <= t2)))


def appended(open_versions: DataFrame, scan: DataFrame, key: list[str], change: list[str], t: int) -> DataFrame:
    """What a new scan does to the open state: op -1 closes, +1 opens, 0 keeps; vf, vt as they are after it."""
    a = open_versions.select(*key, *[F.col(c).alias(f"_o_{c}") for c in change], F.col("vf").alias("_vf"))
    b = scan.select(*key, *change).withColumn("_new", F.lit(True))
    j = a.join(b, key, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"_o_{c}").eqNullSafe(F.col(c)) for c in change])
    keeps = F.col("_vf").isNotNull() & F.coalesce("_new", F.lit(False)) & same
    closes = F.col("_vf").isNotNull() & ~keeps
    opens = F.coalesce("_new", F.lit(False)) & ~keeps
    row = lambda cond, op, values, vf, vt: F.when(cond, F.struct(F.lit(op).alias("op"), *[F.col(v).alias(c) for c, v in zip(change, values, strict=True)], vf.cast("long").alias("vf"), vt.cast("long").alias("vt")))
    old, new = [f"_o_{c}" for c in change], change
    acts = F.array_compact(F.array(row(keeps, 0, old, F.col("_vf"), F.lit(OPEN)), row(closes, -1, old, F.col("_vf"), F.lit(t)), row(opens, 1, new, F.lit(t), F.lit(OPEN))))
    return j.select(*key, F.explode(acts).alias("_x")).select(*key, "_x.*")


def retained(v: DataFrame, key: list[str], change: list[str], stamps: list[int]) -> DataFrame:
    """Versions as the retained scans alone would give them: ends move forward to the next retained stamp."""
    at = F.array(*[F.lit(s).cast("long") for s in sorted(stamps)])
    ahead = lambda c: F.coalesce(F.element_at(F.filter(at, lambda s: s >= F.col(c)), 1), F.lit(OPEN))
    moved = v.withColumns({"vf": F.try_element_at(F.filter(at, lambda s: s >= F.col("vf")), F.lit(1)), "vt": F.coalesce(F.try_element_at(F.filter(at, lambda s: s >= F.col("vt")), F.lit(1)), F.lit(OPEN))})
    return coalesced(moved.filter("vf is not null and vf < vt"), key, change)


def over_time(scans: DataFrame) -> DataFrame:
    """Versions of (bytes, objects) of every directory and the fleet (path '')."""
    first = scans.groupBy("scan", "t", parent(F.col("path")).alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("o"))
    up = first.select("scan", "t", F.explode(ancestors(F.col("d"))).alias("path"), "b", "o").groupBy("scan", "t", "path").agg(F.sum("b").alias("b"), F.sum("o").alias("o"))
    return versions(up, ["path"], ["b", "o"])


def series(v: DataFrame, times: DataFrame, value: list[str], key: list[str]) -> DataFrame:
    """Values at each of a few times (t)."""
    return v.join(F.broadcast(times), (F.col("vf") <= F.col("t")) & (F.col("t") < F.col("vt"))).select(*key, "t", *value)


def scan_counts(v: DataFrame) -> DataFrame:
    """t, opened and closed versions."""
    o = v.groupBy(F.col("vf").alias("t")).agg(F.count("*").alias("opened"))
    c = v.filter(F.col("vt") != OPEN).groupBy(F.col("vt").alias("t")).agg(F.count("*").alias("closed"))
    return o.join(c, "t", "full_outer").select("t", F.coalesce("opened", F.lit(0)).alias("opened"), F.coalesce("closed", F.lit(0)).alias("closed"))


def running_totals(v: DataFrame, keys: list[str], value: str = "size") -> DataFrame:
    """t, bytes and objects after each change of a key, from +/- events; whole totals of a key are summed in time order."""
    plus = v.select(*keys, F.col("vf").alias("t"), F.col(value).alias("b"), F.lit(1).alias("o"))
    minus = v.filter(F.col("vt") != OPEN).select(*keys, F.col("vt").alias("t"), (-F.col(value)).alias("b"), F.lit(-1).alias("o"))
    e = plus.unionByName(minus).groupBy(*keys, "t").agg(F.sum("b").alias("b"), F.sum("o").alias("o"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(*keys, "t", F.sum("b").over(w).alias("bytes"), F.sum("o").over(w).alias("objects"))


def file_churn(v: DataFrame, first_t: int) -> DataFrame:
    """path, t, churn: bytes that a file's change moves at t; the first scan is no change. A gap removes and adds."""
    w = Window.partitionBy("path").orderBy("vf")
    x = v.withColumns({"_pvt": F.lag("vt").over(w), "_psize": F.lag("size").over(w), "_nvf": F.lead("vf").over(w)})
    joined = F.col("_pvt") == F.col("vf")
    begin = F.when(F.col("vf") > first_t, F.struct(F.col("vf").alias("t"), F.when(joined, F.abs(F.col("size") - F.col("_psize"))).otherwise(F.col("size")).alias("churn")))
    end = F.when((F.col("vt") != OPEN) & ~F.coalesce(F.col("_nvf") == F.col("vt"), F.lit(False)), F.struct(F.col("vt").alias("t"), F.col("size").alias("churn")))
    return x.select("path", F.explode(F.array_compact(F.array(begin, end))).alias("x")).select("path", "x.t", "x.churn")


def churn(v: DataFrame, first_t: int) -> DataFrame:
    """path, t, churn, cumulated for every directory."""
    f = file_churn(v, first_t).groupBy(parent(F.col("path")).alias("d"), "t").agg(F.sum("churn").alias("churn"))
    up = f.select(F.explode(ancestors(F.col("d"))).alias("path"), "t", "churn").groupBy("path", "t").agg(F.sum("churn").alias("churn"))
    w = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return up.withColumn("cumulated", F.sum("churn").over(w))


def level_transitions(v: DataFrame) -> DataFrame:
    """up (parent), t, name, op (1 added, 0 changed, 2 removed), size, size_prev of every row."""
    w = Window.partitionBy("path").orderBy("vf")
    x = v.withColumns({"_pvt": F.lag("vt").over(w), "_psize": F.lag("size").over(w), "_nvf": F.lead("vf").over(w)})
    joined = F.coalesce(F.col("_pvt") == F.col("vf"), F.lit(False))
    begin = F.struct(F.col("vf").alias("t"), F.when(joined, 0).otherwise(1).alias("op"), F.col("size").alias("size"), F.when(joined, F.col("_psize")).alias("size_prev"))
    end = F.when((F.col("vt") != OPEN) & ~F.coalesce(F.col("_nvf") == F.col("vt"), F.lit(False)), F.struct(F.col("vt").alias("t"), F.lit(2).alias("op"), F.lit(None).cast("long").alias("size"), F.col("size").alias("size_prev")))
    return x.select("path", F.explode(F.array_compact(F.array(begin, end))).alias("x")).select(parent(F.col("path")).alias("up"), "x.t", F.element_at(F.split("path", "/"), -1).alias("name"), "x.op", "x.size", "x.size_prev")


def compare(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Counts of added, removed, equal and changed keys, and of changes by column."""
    a = old.select(*key, F.struct(*columns).alias("_a"))
    b = new.select(*key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return j.agg(n(F.col("_a").isNull()).alias("added"), n(F.col("_b").isNull()).alias("removed"), n(both & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"), n(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), *[n(both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(f"changed_{c}") for c in columns])


def delta(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """op a (added), c (changed), d (removed, values null)."""
    a = old.select(*key, F.struct(*columns).alias("_a"))
    b = new.select(*key, F.struct(*columns).alias("_b"))
    j = a.join(b, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(*key, F.when(F.col("_a").isNull(), "a").when(F.col("_b").isNull(), "d").otherwise("c").alias("op"), *[F.col(f"_b.{c}").alias(c) for c in columns])


def parity(v: DataFrame, scan: DataFrame, t: int, columns: list[str]) -> DataFrame:
    """Rows that only one side has: the versions live at t, or the scan; both ways, repeated rows counted."""
    a, b = live(v, t).select(*columns), scan.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("versions")).unionByName(b.exceptAll(a).withColumn("side", F.lit("scan")))


def folded_reads(v: DataFrame, reads: DataFrame) -> DataFrame:
    """Versions split where the last read changes, with last_read of each piece. reads: path, vf, vt, last_read."""
    edges = v.select("path", F.col("vf").alias("t")).unionByName(v.select("path", F.col("vt").alias("t"))).unionByName(reads.select("path", F.col("vf").alias("t"))).unionByName(reads.select("path", F.col("vt").alias("t"))).distinct()
    w = Window.partitionBy("path").orderBy("t")
    pieces = edges.withColumn("hi", F.lead("t").over(w)).filter("hi is not null").withColumnRenamed("t", "lo")
    inside = pieces.join(v, "path").filter("vf <= lo and hi <= vt").select("path", "lo", "hi", "size")
    r = reads.select("path", F.col("vf").alias("rf"), F.col("vt").alias("rt"), "last_read")
    both = inside.join(r, (inside["path"] == r["path"]) & (F.col("rf") <= F.col("lo")) & (F.col("hi") <= F.col("rt")), "left").select(inside["path"], F.col("lo").alias("vf"), F.col("hi").alias("vt"), "size", "last_read")
    return coalesced(both, ["path"], ["size", "last_read"])


def slice_totals(slices: DataFrame, totals: DataFrame) -> DataFrame:
    """Owner slices cut at the edges of their path's versions, with the path's total: both overlap for vf..vt."""
    t = totals.select("path", F.col("vf").alias("tf"), F.col("vt").alias("tt"), F.col("size").alias("tot"))
    j = slices.join(t, "path").filter("vf < tt and tf < vt")
    return j.select("path", "usr", "size", "tot", F.greatest("vf", "tf").alias("vf"), F.least("vt", "tt").alias("vt"))


#: A segment's number: 0 for open versions, else 1 + level * SEGMENT + block.
SEGMENT = 1 << 16


def dyadic_segment(vf: Column, vt: Column, stamps: list[int]) -> Column:
    """The segment of a version: the smallest aligned block of a power of two scans that holds its first and last scan; 0 while it is open.

    A read at a scan then touches one block of each level. stamps: the times of all scans.
    """
    if stamps != sorted(set(stamps)):
        raise ValueError("stamps must ascend and be distinct")
    at = F.create_map(*[F.lit(x) for i, t in enumerate(stamps) for x in (t, i)])
    i, j = at[vf], F.coalesce(at[vt], F.lit(len(stamps))) - 1
    level = F.when(i == j, 0).otherwise(F.length(F.bin(i.bitwiseXOR(j))))
    return F.when(vt == OPEN, 0).otherwise(1 + level * SEGMENT + F.call_function("shiftright", i, level)).cast("long")


def pair_changes(scans: DataFrame) -> DataFrame:
    """scan, n: how many keys differ between each scan and the one after it; the input of thinning plans."""
    a = scans.select("path", F.col("scan"), F.col("size").alias("sa"))
    b = scans.select("path", (F.col("scan") - 1).alias("scan"), F.col("size").alias("sb"))
    last = scans.agg(F.max("scan")).first()[0]
    j = a.join(b, ["path", "scan"], "full_outer").filter(~F.col("sa").eqNullSafe(F.col("sb")) & (F.col("scan") >= 0) & (F.col("scan") < (last if last is not None else 0)))
    return j.groupBy("scan").agg(F.count("*").alias("n"))
