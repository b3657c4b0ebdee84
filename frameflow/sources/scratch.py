"""Intermediate tables of a job, below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table below spark.checkpoint.dir and reads it again: what several branches of a plan read is computed once, and a lost executor costs no recomputation.

    Where that setting is unset, a fresh local folder in local mode, an error on a cluster.
    """
    spark, key = df.sparkSession, "spark.checkpoint.dir"
    if not spark.conf.get(key, None):
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {key} to a folder that the driver and all executors share")
        spark.conf.set(key, tempfile.mkdtemp(prefix="spark-shared-"))
    path, schema = f"{spark.conf.get(key).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
