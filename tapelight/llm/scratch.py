"""Tables written to the shared folder, to cut lineage and to use a costly result more than once."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(1)
def _own() -> str:
    return tempfile.mkdtemp(prefix="tapelight-")


def folder(spark: SparkSession) -> str:
    """A new path under `spark.checkpoint.dir`; where that is unset and Spark runs in this process, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/tapelight-{uuid.uuid4().hex}"


def table(frame: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: no executor's loss makes them be computed anew."""
    path = folder(frame.sparkSession)
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
