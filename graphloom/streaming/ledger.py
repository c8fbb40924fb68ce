"""The spend ledger as a file stream: workers append JSON lines, a running query keeps totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, cell string, model string, cost_usd double, cached boolean, accepted boolean"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 100).json(path)


def spend_totals(ledger: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, cell, calls, cost, cached) by hour and cell; rows later than ``late`` are not counted, which bounds the state."""
    return ledger.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "cell").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost"), F.count_if(F.col("cached")).alias("cached")).select(F.col("w.start").alias("start"), "cell", "calls", "cost", "cached")
