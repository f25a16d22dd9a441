"""Duplicate directories over buckets, and exact copies by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, basename, parent


def groups(dirs: DataFrame, least_size: int) -> DataFrame:
    """grp, path, bucket, rel, size, n_files of directories with equal relative path, size and file count in two buckets or more."""
    x = dirs.filter((F.col("size") >= least_size) & F.col("path").contains("/")).withColumns({"bucket": F.substring_index("path", "/", 1), "rel": F.regexp_replace("path", "^[^/]*/", "")})
    x = x.withColumn("grp", F.md5(F.concat_ws("|", "rel", F.col("size").cast("string"), F.col("n_files").cast("string")).cast("binary")))
    several = x.groupBy("grp").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo < hi").select("grp")
    return x.join(several, "grp", "left_semi")


def moved(dirs: DataFrame, least_size: int) -> DataFrame:
    """As groups(), by base name, size and file count, with two relative paths or more."""
    x = dirs.filter((F.col("size") >= least_size) & F.col("path").contains("/")).withColumns({"bucket": F.substring_index("path", "/", 1), "rel": F.regexp_replace("path", "^[^/]*/", "")})
    x = x.withColumn("grp", F.md5(F.concat_ws("|", basename(F.col("path")), F.col("size").cast("string"), F.col("n_files").cast("string")).cast("binary")))
    several = x.groupBy("grp").agg(F.min("rel").alias("lo"), F.max("rel").alias("hi")).filter("lo < hi").select("grp")
    return x.join(several, "grp", "left_semi")


def maximal(copies: DataFrame) -> DataFrame:
    """Groups whose copies aren't the children of another group's copies, set by set. Sets are compared by digests of
    sums of hashes, so no group is collected."""
    sign = lambda c: F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias("h"))
    g = copies.groupBy("grp").agg(sign(F.col("path")).alias("own"), sign(parent(F.col("path"))).alias("up"))
    return copies.join(g.join(g.select(F.col("own").alias("up")).distinct(), "up", "left_anti").select("grp"), "grp", "left_semi")


def keepers(copies: DataFrame) -> DataFrame:
    """copies with keep: the one read last, then created first, then by path."""
    w = Window.partitionBy("grp").orderBy(F.desc_nulls_last("last_read"), F.asc_nulls_last("created"), "path")
    return copies.withColumn("keep", F.row_number().over(w) == 1)


def nested(copies: DataFrame) -> DataFrame:
    """copies with nested: some directory above is a copy too."""
    up = copies.select("path").distinct().select("path", F.explode(ancestors(F.col("path"), own=False)).alias("up"))
    inner = up.join(copies.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("path").distinct().withColumn("nested", F.lit(True))
    return copies.join(inner, "path", "left").withColumn("nested", F.coalesce("nested", F.lit(False)))


def exact(copies: DataFrame, objects: DataFrame) -> DataFrame:
    """grp, copies, exact: whether all copies of a group hold the same objects by relative name, size and checksum."""
    up = objects.select("path", "size", "check", F.explode(ancestors(F.col("path"), own=False, root=False)).alias("top"))
    d = up.join(copies.select(F.col("path").alias("top"), "grp"), "top").select("grp", "top", F.substr("path", F.length("top") + 2).alias("rel"), "size", "check")
    digest = d.groupBy("grp", "top").agg(F.sum(F.xxhash64("rel", "size", "check").cast("decimal(38,0)")).alias("digest"))
    return digest.groupBy("grp").agg(F.count("*").alias("copies"), (F.min("digest") == F.max("digest")).alias("exact"))


def summary(copies: DataFrame) -> DataFrame:
    """groups, copies, reclaimable bytes of groups that aren't nested."""
    g = nested(copies).groupBy("grp").agg(F.count("*").alias("copies"), F.min("size").alias("size"), F.bool_and("nested").alias("nested"))
    return g.filter("not nested").agg(F.count("*").alias("groups"), F.sum("copies").alias("copies"), F.sum(F.col("size") * (F.col("copies") - 1)).alias("reclaimable"))


def pairs(copies: DataFrame) -> DataFrame:
    """a, b, groups, bytes: pairs of buckets that share groups. A group's buckets are few, whatever its copies."""
    x = copies.groupBy("grp", "bucket").agg(F.min("size").alias("size"))
    y = x.select("grp", F.col("bucket").alias("b"))
    return x.withColumnRenamed("bucket", "a").join(y, "grp").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("groups"), F.sum("size").alias("bytes"))


def equal_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Order-free digests of equal texts: text_md5, n, ids from the least."""
    return rows.groupBy(F.md5(F.col(text).cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def matching_groups(groups: DataFrame, copies: DataFrame, tier: str | None = None, least: int | None = None, buckets: list[str] | None = None, q: str | None = None, suspect: bool = False, nested: bool = False) -> DataFrame:
    """Groups (group, tier, reclaimable, suspect) of duplicates that a filter lets through. copies: group, bucket, path, nested.

    Suspect groups, and groups of nested copies only, pass if asked for; buckets is a multiset that the copies' buckets must
    hold; q must stand in some copy's path, in any case.
    """
    own = F.lit(True)
    if tier is not None:
        own &= F.col("tier") == tier
    if least is not None:
        own &= F.col("reclaimable") >= least
    if not suspect:
        own &= ~F.coalesce("suspect", F.lit(False))
    wanted = {b: (buckets or []).count(b) for b in buckets or []}
    tests = [F.bool_and("nested").alias("_inner"), F.bool_or(F.lower("path").contains((q or "").lower())).alias("_q")]
    tests += [F.count_if(F.col("bucket") == b).alias(f"_b{i}") for i, b in enumerate(wanted)]
    of = copies.groupBy("group").agg(*tests)
    passes = F.col("_q") & (F.lit(nested) | ~F.col("_inner"))
    for i, n in enumerate(wanted.values()):
        passes &= F.col(f"_b{i}") >= n
    return groups.filter(own).join(of.filter(passes).select("group"), "group", "left_semi")
