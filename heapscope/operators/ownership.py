"""Ownership: a ledger of assignments over labels of the scan, pools, class scopes, staged deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, parent


def folded(ledger: DataFrame) -> DataFrame:
    """The latest row of each prefix: prefix, owner (null: released), ts, action_id."""
    return ledger.groupBy("prefix").agg(F.max_by(F.struct("owner", "ts", "action_id"), F.struct("ts", "action_id")).alias("x")).select("prefix", "x.*")


def owners_of(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """paths with assigned (is an assignment in force?) and owner: the newest row of the path or anything above; age beats
    depth. A release in force means the scan's own label counts again."""
    up = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    best = up.join(folded(ledger), "prefix").groupBy("path").agg(F.max_by("owner", F.struct("ts", "action_id")).alias("owner"))
    return paths.join(best.withColumn("assigned", F.col("owner").isNotNull()), "path", "left").withColumn("assigned", F.coalesce("assigned", F.lit(False)))


def effective(file_rows: DataFrame, ledger: DataFrame, label: str = "usr") -> DataFrame:
    """file_rows with who: the assigned owner, else the label. Directories are looked up first, single objects after them."""
    dirs = file_rows.select(parent(F.col("path")).alias("path")).distinct()
    by_dir = _newest(dirs, ledger).withColumnsRenamed({"path": "_dir", "x": "_d"})
    own = folded(ledger).select(F.col("prefix").alias("path"), F.struct("ts", "action_id", "owner").alias("_o"))
    j = file_rows.withColumn("_dir", parent(F.col("path"))).join(by_dir, "_dir", "left").join(own, "path", "left")
    newest = F.when(F.col("_d").isNull() | (F.struct("_o.ts", "_o.action_id") > F.struct("_d.ts", "_d.action_id")), F.col("_o")).otherwise(F.col("_d"))
    newest = F.when(F.col("_o").isNull(), F.col("_d")).otherwise(newest)
    return j.withColumn("who", F.coalesce(newest["owner"], F.col(label))).drop("_dir", "_d", "_o")


def _newest(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    return up.join(folded(ledger), "prefix").groupBy("path").agg(F.max(F.struct("ts", "action_id", "owner")).alias("x"))


def lens(file_rows: DataFrame, ledger: DataFrame, label: str = "usr") -> DataFrame:
    """path, who, size, n_files of every directory."""
    from heapscope.operators.rollup import directories

    return directories(effective(file_rows, ledger, label), {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")}, ("who",))


def estate(ledger: DataFrame, file_rows: DataFrame, owner: str) -> DataFrame:
    """Prefixes in the hands of an owner, outermost ones, with their totals."""
    from heapscope.operators.rollup import directories
    from heapscope.operators.search import outermost

    own = owners_of(folded(ledger).select(F.col("prefix").alias("path")), ledger).filter(F.col("owner") == owner).select("path")
    d = directories(file_rows, {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")})
    return outermost(own).join(d, "path")


def matrix(ledger: DataFrame) -> DataFrame:
    """who assigned how much to whom, by latest rows."""
    last = ledger.groupBy("prefix").agg(F.max_by(F.struct("owner", "who"), F.struct("ts", "action_id")).alias("x")).select("prefix", "x.*")
    return last.filter("owner is not null").groupBy("who", "owner").agg(F.count("*").alias("n"))


def action_status(ledger: DataFrame) -> DataFrame:
    """action_id, status of each row (prefix, kind: null or 'object', ts, action_id, tombstoned).

    retracted: has a tombstone; superseded: a newer row without one is on the same prefix and of the same kind; overridden:
    a newer one without, for a whole prefix, lies above; else live. An object's row covers nothing but its key.
    """
    key = F.struct("ts", "action_id")
    standing = ledger.filter("tombstoned is null")
    kind = F.coalesce("kind", F.lit("prefix")).alias("_kind")
    newest = standing.groupBy("prefix", kind).agg(F.max(key).alias("newest"))
    over = standing.filter("kind is null").groupBy("prefix").agg(F.max(key).alias("n")).withColumnRenamed("prefix", "up")
    up = ledger.select("action_id", F.explode(ancestors(F.col("prefix"), own=False)).alias("up"))
    above = up.join(over, "up").groupBy("action_id").agg(F.max("n").alias("above"))
    j = ledger.withColumn("_kind", kind).join(newest, ["prefix", "_kind"], "left").join(above, "action_id", "left")
    status = F.when(F.col("tombstoned").isNotNull(), "retracted").when(key < F.col("newest"), "superseded").when(key < F.col("above"), "overridden").otherwise("live")
    return j.select("action_id", status.alias("status"))


def pool(usr: Column, kind: str, names: list[str] | None = None) -> Column:
    """owned, unowned, or everyone but some names."""
    none = usr.isNull() | (usr == "")
    return {"owned": ~none, "unowned": none}[kind] if kind in ("owned", "unowned") else none | ~usr.isin(names or [])


def class_scope(rows: DataFrame, classes: list[int]) -> DataFrame:
    """Rows scaled to some storage classes (columns c1 to c4); n_files by byte share, rounded half up, in whole numbers throughout."""
    kept = sum((F.col(f"c{k}") for k in classes), F.lit(0)).cast("long")
    whole = rows.select("path", kept.alias("kept"), *(F.col(c).cast("decimal(19,0)").alias(a) for c, a in (("size", "s"), ("n_files", "n"))), kept.cast("decimal(19,0)").alias("k"))
    # A quotient of decimals keeps six digits, and what is less than a half by less would be rounded up.
    share = F.when(F.col("s") > 0, F.expr("(2 * (n * k) + s) div (2 * s)")).otherwise(0)
    return whole.select("path", F.col("kept").alias("size"), share.cast("long").alias("n_files"))


def exact_scope(file_rows: DataFrame, classes: list[int] | None, owners: list[str] | None) -> DataFrame:
    """Directory totals of the files in both scopes: no scaling."""
    from heapscope.operators.rollup import directories

    x = file_rows if classes is None else file_rows.filter(F.col("storage_class_id").isin(classes))
    x = x if owners is None else x.filter(F.col("usr").isin(owners))
    return directories(x, {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")})


def under_any(rows: DataFrame, prefixes: DataFrame, hit: bool = True) -> DataFrame:
    """Rows that some prefix covers (or none does), by exploded ancestors: no prefix list is sent around."""
    up = rows.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    covered = up.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("path").distinct()
    return rows.join(covered, "path", "left_semi" if hit else "left_anti")


def staging(items: DataFrame, wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """state of each wanted prefix against staged items: covered by one, absorbs some, gone (no object), or new."""
    w, i = wanted.select("prefix").distinct(), items.select("prefix").distinct()
    cov = under_any(w.withColumnRenamed("prefix", "path"), i).withColumn("covered", F.lit(True)).withColumnRenamed("path", "prefix")
    up = i.select(F.explode(ancestors(F.col("prefix"), own=False)).alias("prefix")).distinct().withColumn("absorbs", F.lit(True))
    there = existing.select(F.explode(ancestors(F.col("path"))).alias("prefix")).distinct().withColumn("there", F.lit(True))
    j = w.join(cov, "prefix", "left").join(up, "prefix", "left").join(there, "prefix", "left")
    return j.select("prefix", F.when(F.col("there").isNull(), "gone").when(F.col("covered"), "covered").when(F.col("absorbs"), "absorbs").otherwise("new").alias("state"))


def held(objects: DataFrame, reference: DataFrame) -> DataFrame:
    """objects with reason: ok if the reference scan has the same size and mtime, else new or changed."""
    r = reference.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    return objects.join(r, "path", "left").withColumn("reason", F.when(F.col("_s").isNull(), "new").when((F.col("_s") != F.col("size")) | (F.col("_m") != F.col("mtime")), "changed").otherwise("ok")).drop("_s", "_m")


def run_history(items: DataFrame, bands: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs since an item was staged that deleted in its prefix: items (prefix, added), bands (prefix, run), runs (run, started)."""
    return items.join(bands, "prefix").join(runs, "run").filter("started >= added").select("prefix", "run", "started")


def by_precedence(rules: DataFrame) -> DataFrame:
    """One owner for each prefix: the least priority, then the order it came in."""
    w = Window.partitionBy("prefix").orderBy("priority", "seq")
    return rules.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rule_findings(rules: DataFrame, users: DataFrame) -> DataFrame:
    """prefix, finding: duplicates of a prefix and rules for unknown users."""
    dup = rules.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select("prefix", F.lit("duplicate").alias("finding"))
    return dup.unionByName(rules.join(users, "usr", "left_anti").select("prefix", F.lit("unknown user").alias("finding")))
