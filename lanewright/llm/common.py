"""Shared helpers: tables, written steps, slices of batches, running totals and hot-key joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key that holds more than 1/HOT_SHARE of all rows is hot; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 400
#: Bytes of text that a Python task turns into Python objects at once, and rows of the batches that it is sent.
SLICE, BATCH_ROWS = 1 << 21, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode one of our own, if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lanewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches to and from Python get fewer of them than Spark's default, unless the session sets a number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


class Steps:
    """Tables that an operator writes to the shared folder, so that what follows neither recomputes them nor depends on one
    executor. Those that nothing reads any more are dropped; what the operator's result reads stays until `clear`."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/lanewright/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, list[str]] = {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df and reads it again. A step of the same tag is kept beside it until it is dropped."""
        path = f"{self.path}/{tag}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.paths.setdefault(tag, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df, which may read the step of the same tag, and then drops that step."""
        old = self.paths.pop(tag, [])
        out = self.write(df, tag)
        self._delete(old)
        return out

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(self.paths.pop(tag, []))

    def collect(self) -> None:
        """Has the driver collect garbage: Spark drops what earlier jobs shuffled and broadcast, and the classes made for their
        plans, when nothing on the driver refers to them any more, and a driver with room left may not look for a long time."""
        gc.collect()
        give_back()
        self.spark._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all steps in the shared folder. Results that were not written anywhere else can't be read afterwards."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lanewright")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """A single step that stays until `clear`."""
    return Steps(df.sparkSession, "step").write(df, tag)


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns memory to the system that this process holds but does not use: a worker lives on from one operator to the next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_KEPT: list[tuple] = []


def kept(make, *args):
    """What make(*args) gives, kept in this process until something else is asked for: a worker that serves one operator after
    another holds the tables of one of them."""
    if not _KEPT or _KEPT[0][:2] != (make, args):
        _KEPT.clear()
        give_back()
        _KEPT.append((make, args, make(*args)))
    return _KEPT[0][2]


def slices(batches: Iterator[pa.RecordBatch], col: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices with about `most` bytes in col. Memory that Arrow holds in reserve is given back."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[col]), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            size += n + 64
            if size >= most:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows or not b.num_rows:
            yield b.slice(start)
    give_back()


def held(fields: list[str], wanted: str) -> str:
    """A column name that is not among the fields: wanted, or wanted with underscores before it."""
    while wanted.lower() in {f.lower() for f in fields}:
        wanted = "_" + wanted
    return wanted


def running_total(df: DataFrame, order: str, value: str, out: str, block: int = 1 << 15) -> DataFrame:
    """Adds out: the sum of value over all rows with a smaller order (unique, dense or not, at least 0).

    Two levels: inside blocks of `block` order values, then over one row per block, so no task sees all rows.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(F.floor(F.col("_block") / block)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_in", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
    tops = sums.groupBy(F.floor(F.col("_block") / block).alias("_top")).agg(F.sum("_sum").alias("_topsum"))
    tops = tops.withColumn("_before", F.coalesce(F.sum("_topsum").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.join(tops.select("_top", "_before"), F.floor(F.col("_block") / block) == F.col("_top"))
    sums = sums.select("_block", (F.col("_in") + F.col("_before")).alias("_base"))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, "_block")
    return df.withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_in", "_base", "_block")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, steps: Steps | None = None) -> DataFrame:
    """Inner join of rows with one row per group, where a group may hold a third of all rows.

    size: rows of each group; total: rows, at least. Groups over total / HOT_SHARE rows number fewer than HOT_SHARE, whatever
    the data; these are broadcast, and their rows never meet in one task. All others go through an ordinary join. Groups are
    written first, so they are made once.
    """
    least = max(2, total // HOT_SHARE)
    groups = (steps or Steps(rows.sparkSession, "step")).write(groups, "groups")
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    if not hot.limit(1).count():
        return rows.join(groups, keys)
    mark = hot.select(*keys, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(mark), keys, "left")
    a = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), keys)
    b = marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, keys)
    return a.unionByName(b)


def least_hot(total: int) -> int:
    """Keys of more rows than this are hot."""
    return max(2, total // HOT_SHARE)


def salted_join(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, total: int, by: str) -> DataFrame:
    """Inner join of rows with side (one row for most keys) on key, by shuffles only.

    hot: key and c, for the keys of more than least_hot(total) rows, so fewer than HOT_SHARE. The rows of such a key are dealt
    to several tasks by the column `by`, and its rows of side are repeated for each of these.
    """
    if not hot.limit(1).count():
        return rows.join(side, key)
    cuts = F.broadcast(hot.select(key, F.ceil(F.col("c") / least_hot(total)).cast("int").alias("_cuts")))  # fewer than HOT_SHARE rows
    one = F.lit(1)
    left = rows.join(cuts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_cuts", one)).cast("int")).drop("_cuts")
    right = side.join(cuts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", one) - 1))).drop("_cuts")
    return left.join(right, [key, "_salt"]).drop("_salt")


#: Keys of up to so many bytes, as they lie in a hash table, are broadcast; more go through an ordinary join.
BROADCAST_BYTES = 16 << 20


def sendable(keys: DataFrame) -> DataFrame:
    """keys, marked for broadcast where their bytes are within BROADCAST_BYTES: counted rows at 64 bytes each, and strings."""
    strings = [F.octet_length(f.name) for f in keys.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = keys.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(s), F.lit(0)).alias(f"s{k}") for k, s in enumerate(strings)]).collect()[0]
    return F.broadcast(keys) if 64 * size["n"] + sum(size[1:]) <= BROADCAST_BYTES else keys


def without(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among the dropped ones."""
    dropped = materialise(dropped.select(keys).distinct(), "dropped")
    return rows.join(sendable(dropped), keys, "left_anti").select(rows.columns)
