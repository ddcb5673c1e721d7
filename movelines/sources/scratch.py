"""Intermediate tables in the folder that all executors share, and what Python workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}
ROOT = str(Path(__file__).resolve().parents[2])


def workers_ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, parts)])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where a local session has none (tests), one
    temporary folder per application stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
    path = f"{base.rstrip('/')}/movelines/{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this application has made so far, and says how many.
    DataFrames that were made from them can't be read any more, so write results first."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors. With
    `by`, a column of few values, a filter on it reads only what it needs."""
    path = scratch_dir(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
