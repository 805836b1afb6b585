"""Readers of register dumps, bus traces, write traces, tune headers and side files. Binary files are read through Spark's own
file source, so any store that Spark reaches will do; a file is one row, so it may have up to two gigabytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cycles of a frame by video system, first register address, the number of registers, registers of the high bits of
#: the pulse width.
CYCLES_PAL, CYCLES_NTSC, REGISTER_BASE, REGISTERS, WIDTH_HIGH = 19656, 17095, 0xD400, 25, (3, 10, 17)
#: Little-endian records of bus traces and of write traces; a mark of another format of traces.
BUS = np.dtype([("cyc", "<i8"), ("addr", "<u2"), ("val", "u1"), ("rw", "u1")])
WRITES = np.dtype([("cyc", "<i8"), ("addr", "<u2"), ("reg", "u1"), ("val", "u1")])
OTHER_FORMAT = b"RBT1"


def register_dump(spark: SparkSession, path: str, chip: int = 0) -> DataFrame:
    """path, seq, clock, reg, val of one chip of parquet dumps (clock, reg, val, chipno). Only these columns are read, and the chip
    is filtered in the scan. seq orders writes of one clock: their place in the file."""
    rows = spark.read.parquet(path).select("clock", "reg", "val", "chipno", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("seq"))
    return rows.filter(F.col("chipno") == chip).select("path", "seq", F.col("clock").cast("long"), F.col("reg").cast("int"), F.col("val").cast("long"))


def _records(spark: SparkSession, path: str, kind: np.dtype) -> DataFrame:
    names = list(kind.names)
    step = 1 << 16

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"], strict=True):
                raw = data.as_py()
                if raw[:4] == OTHER_FORMAT or len(raw) % kind.itemsize:
                    raise ValueError(f"not a trace of records of {kind.itemsize} bytes: {name}")
                rows = np.frombuffer(raw, kind)
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), *(pa.array(part[n].astype(np.int64)) for n in names)], ["path", "seq", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, seq long, " + ", ".join(f"{n} long" for n in names))


def bus_trace(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, cyc, addr, val, rw of bus traces."""
    return _records(spark, path, BUS)


def write_trace(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, cyc, addr, reg, val of write traces."""
    return _records(spark, path, WRITES)


def as_bus(writes: DataFrame) -> DataFrame:
    """Write traces in the form of bus traces: every record is a write."""
    return writes.select("path", "seq", "cyc", "addr", "val", F.lit(1).cast("long").alias("rw"))


def register_writes(bus: DataFrame) -> DataFrame:
    """The writes of a bus trace that go to a register, with reg in place of addr; of pulse widths, the low four high bits count."""
    own = bus.filter(F.col("addr").between(REGISTER_BASE, REGISTER_BASE + REGISTERS - 1) & (F.col("rw") == 1))
    reg = (F.col("addr") - REGISTER_BASE).cast("int")
    return own.withColumn("reg", reg).withColumn("val", F.when(F.col("reg").isin(*WIDTH_HIGH), F.col("val").bitwiseAND(15)).otherwise(F.col("val"))).drop("addr", "rw")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned integer of `size` bytes that starts at byte `at` (0-based)."""
    digits = [F.hex(F.substring(content, at + 1 + k, 1)) for k in (range(size - 1, -1, -1) if little else range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def tune_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, version, load, init, play, songs, start, speed, data of tune files (big-endian header, then the program). Where the
    header has no load address, the first two bytes of the program are it."""
    c = F.col("content")
    files = spark.read.format("binaryFile").load(path).filter(F.substring(c, 2, 3) == F.lit(b"SID"))
    begin = F.col("begin").cast("int")
    found = files.select("path", "content", _number(c, 4, 2).alias("version"), _number(c, 6, 2).alias("begin"), _number(c, 8, 2).alias("load"), _number(c, 10, 2).alias("init"), _number(c, 12, 2).alias("play"),
                         _number(c, 14, 2).alias("songs"), _number(c, 16, 2).alias("start"), _number(c, 18, 4).alias("speed"))
    own = F.col("load") == 0
    first = F.conv(F.concat(F.hex(F.substring(c, begin + 2, F.lit(1))), F.hex(F.substring(c, begin + 1, F.lit(1)))), 16, 10).cast("long")
    data = F.when(own, F.substring(c, begin + 3, F.length(c))).otherwise(F.substring(c, begin + 1, F.length(c)))
    return found.select("path", "version", F.when(own, first).otherwise(F.col("load")).alias("load"), "init", "play", "songs", "start", "speed", data.alias("data"))


def cycles_per_frame(spark: SparkSession, path: str) -> DataFrame:
    """path, cycles: by the first line of a side file that tells the speed."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("k"), "value")
    first = F.min_by("value", F.when(F.col("value").startswith("speed="), F.col("k")))
    found = lines.groupBy("path").agg(first.alias("speed"))
    return found.select("path", F.when(F.col("speed").contains("NTSC"), CYCLES_NTSC).otherwise(CYCLES_PAL).alias("cycles"))


def run_lengths(rows: DataFrame, keys: list[str], order: str, run: str, value: str) -> DataFrame:
    """keys, addr, value: runs of a value laid one after another from address 0 on."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(run).over(before), F.lit(0))
    return rows.withColumn("_start", start).filter(F.col(run) > 0).select(*keys, F.explode(F.sequence("_start", F.col("_start") + F.col(run) - 1)).alias("addr"), F.col(value).alias(value))


def sparse_image(rows: DataFrame, keys: list[str], order: str, addr: str, data: str) -> DataFrame:
    """keys, addr, byte: runs of bytes at addresses, the last one of each address."""
    each = rows.select(*keys, order, F.col(addr).alias("_a"), F.col(data).alias("_d")).select(*keys, order, "_a", F.posexplode(F.regexp_extract_all(F.hex("_d"), F.lit(".."), F.lit(0))).alias("_k", "_h"))
    return each.groupBy(*keys, (F.col("_a") + F.col("_k")).alias("addr")).agg(F.max_by(F.conv("_h", 16, 10).cast("long"), order).alias("byte"))
