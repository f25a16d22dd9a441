"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the queries' seconds, `rates` has rows a second of the rollup, the history and the full scan over the listing multiplied to
$BENCH_ROWS rows (2 million; 0: left out), where the time is work and not the start of jobs.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

NAMES = [
    "a01_rollup",
    "a03_labeled",
    "a04_pivot_class",
    "a05_mean_mtime",
    "a06_size_hist",
    "a08_access_tree",
    "a12_store",
    "a15_age_pyramid",
    "w01_versions",
    "v02_as_of",
    "v14_over_time",
    "w06_churn_cum",
    "x01_view",
    "x02_diff",
    "x08_ledger",
    "x09_lens",
    "x13_full_scan",
    "q01_match_roots",
    "q12_filtered",
    "p09_terms",
    "a22_dups",
    "o06_largest_files",
]


def seconds(df) -> float:
    t = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def rates(spark, sf: str, rows: int) -> dict:
    """Rows a second at about `rows` files; six scans of a sixth of them each for the history."""
    from heapscope.operators import history, rollup, views
    from heapscope.plans import fixtures
    from heapscope.sources.scratch import scratch

    files = fixtures.files(spark, sf).select("path", "size", "mtime", "key")
    times = -(-rows // max(1, files.count()))
    path = scratch(spark, "bench")
    many = files.crossJoin(spark.range(times)).select(F.concat("path", F.lit("/part-"), "id").alias("path"), "size", "mtime", (F.col("key") * times + F.col("id")).alias("key"))
    many.write.parquet(f"{path}/files")
    many = spark.read.parquet(f"{path}/files")
    n, cuts = many.count(), list(range(6))
    scans = many.select("*", F.explode(F.array(*map(F.lit, cuts))).alias("scan")).filter("key % 6 != scan and key % 5 < 1")
    scans.select("path", F.when(F.col("key") % 7 == 0, F.col("size") + F.col("scan")).otherwise(F.col("size")).alias("size"), "scan", F.col("scan").cast("long").alias("t")).write.parquet(f"{path}/scans")
    scans = spark.read.parquet(f"{path}/scans")
    live = many.select("path", "size", F.lit(0).cast("long").alias("vf"), F.lit(4291747200).cast("long").alias("vt"))
    done = {
        "a01_rollup": (n, rollup.rollup(many)),
        "w01_versions": (scans.count(), history.versions(scans, ["path"], ["size"], times=cuts)),
        "x13_full_scan": (n, views.full_scan(live, "", 1, None, 4, share_log2=12, atten_log2=1)),
    }
    out = {}
    for name, (rows_, df) in done.items():
        s = seconds(df)
        out[name] = {"rows": rows_, "sec": s, "rows_per_sec": round(rows_ / s)}
    return out


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from heapscope.catalog import QUERIES

    seconds(QUERIES["a01_rollup"](spark, sf))  # starts the JVM's compilers
    took = {}
    for name in NAMES:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
    out = {"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}
    rows = int(os.environ.get("BENCH_ROWS", "2000000"))
    if rows:
        out["rates"] = rates(spark, sf, rows)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
