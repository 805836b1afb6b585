"""Register logs from the file formats and connectors that Spark reads, with one fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "tune_id LONG, seq LONG, clock LONG, reg INT, val LONG"
FILES = ("parquet", "orc", "json", "csv")


def read_log(spark: SparkSession, path: str, kind: str, **options: str) -> DataFrame:
    """tune_id, seq, clock, reg, val from files of one kind. Nothing is inferred: the schema is fixed, so the files are not read for it,
    and only the columns that are used are parsed where the format allows it."""
    if kind not in FILES:
        raise ValueError(f"not one of {', '.join(FILES)}: {kind}")
    return spark.read.schema(SCHEMA).options(**options).format(kind).load(path)


def read_database(spark: SparkSession, url: str, table: str, parts: int, lowest: int, highest: int) -> DataFrame:
    """The same from a database table, in `parts` ranges of seq that are read side by side."""
    return spark.read.jdbc(url, table, column="seq", lowerBound=lowest, upperBound=highest, numPartitions=parts).select(*(c.split(" ")[0] for c in SCHEMA.split(", ")))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same as a stream of JSON messages of a topic, with the time of each message as ts."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return messages(raw)


def messages(raw: DataFrame) -> DataFrame:
    """Log rows from messages (value: bytes of a JSON object, timestamp). What is no such object gives nulls, and is left out."""
    rows = raw.select(F.from_json(F.col("value").cast("string"), SCHEMA).alias("m"), F.col("timestamp").alias("ts"))
    return rows.filter(F.col("m.tune_id").isNotNull()).select("m.*", "ts")
