"""Where intermediate tables go, and how inputs are read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where that is unset a temporary one serves, but only if the executors are in this process: on a cluster nobody else
    could read it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="accretion-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has."""
    used = {n.lower() for n in taken}
    return [next(n for n in (w + "_" * k for k in range(len(used) + 1)) if n not in used) for w in wanted]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, reread: later jobs neither recompute it nor depend on the executors that made it.

    The tables lie under <shared>/accretion/<application id>; they can go when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/accretion/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
