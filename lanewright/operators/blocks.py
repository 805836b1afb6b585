"""Windows over long sequences in two levels: inside blocks of the order, then over one row for each block.

A window of a whole key puts all rows of the key into one task. Here a task sees one block of one key, and what a block takes over
from the ones before it comes from a table with one row for each block, joined back by key and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocked(df: DataFrame, at: Column, size: int) -> DataFrame:
    return df.withColumn("_block", F.floor(at / size).cast("long"))


def previous(df: DataFrame, keys: list[str], at: str, order: list[str], value: str, out: str, size: int) -> DataFrame:
    """Adds out: value of the row before, in the order of (at, *order) for each key; null for the first."""
    df = _blocked(df, F.col(at), size)
    w = Window.partitionBy(*keys, "_block").orderBy(at, *order)
    ends = df.groupBy(*keys, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(at, *order)).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    rows = df.withColumn("_own", F.lag(F.struct(F.col(value).alias("v"))).over(w)).join(ends, [*keys, "_block"])
    return rows.withColumn(out, F.coalesce("_own", "_before")["v"]).drop("_own", "_before", "_block")


def running(df: DataFrame, keys: list[str], at: str, order: list[str], value: Column, out: str, size: int, own: bool = True) -> DataFrame:
    """Adds out: the sum of value over all rows up to this one (without it, if own is False)."""
    df = _blocked(df, F.col(at), size).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_block").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*keys, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = df.withColumn("_in", F.sum("_v").over(w)).join(sums, [*keys, "_block"])
    return rows.withColumn(out, F.col("_in") + F.col("_base") - (F.lit(0) if own else F.col("_v"))).drop("_in", "_base", "_v", "_block")


def following(df: DataFrame, keys: list[str], at: str, value: Column, out: str, size: int) -> DataFrame:
    """Adds out: the least value of the rows after this one; null if there is none."""
    df = _blocked(df, F.col(at), size).withColumn("_v", value)
    later = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    least = df.groupBy(*keys, "_block").agg(F.min("_v").alias("_least"))
    least = least.withColumn("_after", F.min("_least").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    rows = df.withColumn("_in", F.min("_v").over(later)).join(least, [*keys, "_block"])
    return rows.withColumn(out, F.least("_in", "_after")).drop("_in", "_after", "_v", "_block")


def last_known(df: DataFrame, keys: list[str], at: str, order: list[str], value: str, out: str, size: int) -> DataFrame:
    """Adds out: the last value, up to this row, that is not null."""
    df = _blocked(df, F.col(at), size)
    w = Window.partitionBy(*keys, "_block").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(at, *order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", True).over(before)).drop("_end")
    rows = df.withColumn("_own", F.last(value, True).over(w)).join(ends, [*keys, "_block"])
    return rows.withColumn(out, F.coalesce("_own", "_before")).drop("_own", "_before", "_block")
