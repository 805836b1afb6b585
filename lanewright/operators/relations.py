"""Joins by time and by range, and what a bus trace tells of tables and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import last_known

#: Bits of an access byte (executed, written, read), and the range that data of a song may lie in.
EXECUTED, WRITTEN, READ, IO_START = 1, 2, 4, 0xD000


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], block: int = 1 << 36) -> DataFrame:
    """The rows of left, each with the values of the last row of right that is not later (null if there is none).

    Both are laid in one order for each key and block of `block` units of `at` (a number), and the last right row before is carried
    on, also from the blocks before: no pair of rows is made, and no task sees all rows of a key. Of equal times, the right row
    comes first.
    """
    own = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    b = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_right"))
    both = last_known(a.unionByName(b, allowMissingColumns=True), keys, "_at", ["_side"], "_right", "_last", block)
    return both.filter("_side = 1").select(*keys, *(F.col(f"_left.{c}").alias(c) for c in own), *(F.col(f"_last.{v}").alias(v) for v in values))


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined with the spans [start, end) that hold them. A span is in each bucket of `width` that it touches, so the join is
    an equi-join on keys and bucket, with the exact bounds beside it."""
    touched = spans.filter(F.col(end) > F.col(start)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    rows = points.withColumn("_bucket", F.floor(F.col(at) / width)).join(touched, [*keys, "_bucket"])
    return rows.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bucket")


def nearest_reads(writes: DataFrame, reads: DataFrame, keys: list[str], span: int) -> DataFrame:
    """keys, seq, addr: for each write the nearest read of the same value at most `span` places before it."""
    w = writes.select(*keys, F.col("seq").alias("seq"), "val", F.explode(F.array(F.floor(F.col("seq") / span), F.floor(F.col("seq") / span) - 1)).alias("_b"))
    r = reads.select(*keys, F.col("seq").alias("_rs"), "val", "addr", F.floor(F.col("seq") / span).alias("_b"))
    found = w.join(r, [*keys, "val", "_b"]).filter((F.col("seq") - F.col("_rs")).between(1, span))
    return found.groupBy(*keys, "seq").agg(F.max_by("addr", "_rs").alias("addr"))


def table_start(sources: DataFrame, keys: list[str], least: int) -> DataFrame:
    """keys, addr, hits: the smallest address with at least so many hits, else the one with most (the smallest on ties)."""
    hits = sources.groupBy(*keys, "addr").agg(F.count("*").alias("hits"))
    enough = F.min(F.when(F.col("hits") >= least, F.struct("addr", "hits")))
    most = F.min_by(F.struct("addr", "hits"), F.struct(-F.col("hits"), "addr"))
    return hits.groupBy(*keys).agg(F.coalesce(enough, most).alias("t")).select(*keys, "t.addr", "t.hits")


def words_at(image: DataFrame, starts: DataFrame, keys: list[str], words: int) -> DataFrame:
    """keys, k, word: little-endian words from the start address on; bytes that are not there are 0."""
    rows = image.join(starts, keys).withColumn("off", F.col("addr") - F.col("start")).filter(F.col("off").between(0, 2 * words - 1))
    shift = F.when(F.col("off") % 2 == 0, 1).otherwise(256)
    return rows.groupBy(*keys, F.floor(F.col("off") / 2).alias("k")).agg(F.sum(F.col("byte") * shift).cast("long").alias("word"))


def access_masks(acc: Column, addr: Column, first: Column | int, last: Column | int) -> dict[str, Column]:
    """Predicates over access bytes: code, code that changes, and data of a song (read, not executed, in the image)."""
    code = acc.bitwiseAND(EXECUTED) != 0
    changed = code & (acc.bitwiseAND(WRITTEN) != 0)
    data = ~code & (addr >= first) & (addr <= last) & (addr < IO_START)
    return {"code": code, "changed": changed, "eligible": data, "read": acc.bitwiseAND(READ) != 0}


def pitch_factored(tables: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """key, refs: values of tables (key, k, v) as indexes of notes (idx, v), the smallest index of a value. A table counts only if all
    of its values are notes."""
    index = notes.groupBy("v").agg(F.min("idx").alias("idx"))
    found = tables.join(F.broadcast(index), "v", "left")  # notes are one table of at most 256 entries
    refs = F.transform(F.array_sort(F.collect_list(F.struct("k", "idx"))), lambda x: x["idx"])
    return found.groupBy(key).agg(refs.alias("refs"), F.count("*").alias("n"), F.count("idx").alias("hit")).filter("n = hit").select(key, "refs")


def aligned(states: DataFrame, boot: DataFrame, keys: list[str], slack: int = 256) -> DataFrame:
    """keys, offset: the first frame, up to slack, whose digest and the next one's are those of boot's frames 0 and 1; null if none."""
    w = Window.partitionBy(*keys).orderBy("frame")
    own = states.filter(F.col("frame") <= slack + 1).withColumn("_n", F.lead("h").over(w)).filter(F.col("frame") <= slack)
    first = boot.groupBy(*keys).agg(F.max(F.when(F.col("frame") == 0, F.col("h"))).alias("_h0"), F.max(F.when(F.col("frame") == 1, F.col("h"))).alias("_h1"))
    rows = own.join(first, keys)
    return rows.groupBy(*keys).agg(F.min(F.when((F.col("h") == F.col("_h0")) & (F.col("_n") == F.col("_h1")), F.col("frame"))).alias("offset"))
