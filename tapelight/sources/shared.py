"""Where queries write files to read them back."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.lru_cache(1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="tapelight-")


def folder(spark: SparkSession) -> str:
    """A new path under `spark.checkpoint.dir`, which all executors share; under a temporary folder only where Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/tapelight-{uuid.uuid4().hex}"
