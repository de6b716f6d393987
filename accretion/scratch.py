"""A folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset a temporary folder serves, but only if the executors are in this process: on a cluster nobody else
    could read it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="accretion-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/accretion/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in that folder, reread: what follows neither computes it again nor grows its plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
