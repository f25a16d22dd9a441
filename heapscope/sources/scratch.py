"""A folder for files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="heapscope-")
        _OWN[app] = f"{base.rstrip('/')}/heapscope-scratch-{app}"
    return f"{_OWN[app]}/{name}-{uuid.uuid4().hex[:10]}"
