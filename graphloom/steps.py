"""Written steps: a frame as a Parquet table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster session raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written and read again, which cuts its lineage: what was lost is read, not computed anew."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores by ``keys``: small rows are one or two partitions, but what is made of each may take long."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)
