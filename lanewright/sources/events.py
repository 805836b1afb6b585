"""Register-write logs from event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tune_id, seq, clock (microseconds), reg (0 to 24), val (one byte) from the table `events`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.col("user_id") % 8).alias("tune_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("clock"),
        (F.col("event_id") % 25).cast("int").alias("reg"), F.floor(F.col("value") * 100).cast("long").bitwiseAND(255).alias("val"))
