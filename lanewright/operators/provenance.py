"""Where values come from: the reads that feed register writes, tables that are walked, pointer tables and the patterns they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dumps import REGISTER_BASE, REGISTERS
from .blocks import last_known, previous, running
from .structure import strides

#: Events of a block, and bytes of a pattern at most.
BLOCK, LONGEST = 1 << 14, 1024
#: An address was read while playing; entries of a pointer table, least and most.
READ_PLAYING, ENTRIES = 16, (2, 512)


def fed(bus: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, seq, reg, addr: for each register write, the address that was read last before it, if what was read there is what is
    written; else null."""
    rows = bus.withColumn("_read", F.when(F.col("rw") == 0, F.struct("addr", "val")))
    rows = last_known(rows, keys, "seq", [], "_read", "_last", block)
    own = rows.filter((F.col("rw") == 1) & F.col("addr").between(REGISTER_BASE, REGISTER_BASE + REGISTERS - 1))
    same = F.when(F.col("_last.val") == F.col("val"), F.col("_last.addr"))
    return own.select(*keys, "seq", (F.col("addr") - REGISTER_BASE).cast("int").alias("reg"), same.alias("addr"))


def table_walks(reads: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """keys, reg, walk, start, addr, stride, n: the addresses that feed a register, cut where the step from one to the next is another
    than the step before. stride: of the walk, null if it is a single read and the first; start: seq of its first read."""
    by = [*keys, "reg"]
    rows = previous(reads.filter(F.col("addr").isNotNull()), by, "seq", [], "addr", "_prev", block).withColumn("_d", F.col("addr") - F.col("_prev"))
    rows = previous(rows, by, "seq", [], "_d", "_d0", block)
    rows = running(rows, by, "seq", [], F.when(F.col("_d") != F.col("_d0"), 1).otherwise(0), "walk", block)
    return rows.groupBy(*by, "walk").agg(F.min("seq").alias("start"), F.min_by("addr", "seq").alias("addr"), F.max("_d").alias("stride"), F.count("*").alias("n"))


def pointer_sequences(reads: DataFrame, memory: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """keys, pc, base, packing, k, pointer: the words that an indexed read of addresses may have formed, for each way that low and
    high bytes may lie: interleaved (where the index is doubled), split (all low bytes, then all high ones), adjacent.

    reads: as section files give them, with inside; memory: keys, addr, byte, where bytes that are not there are 0. A table that
    leaves the image first..last is none."""
    n = F.col("hi") - F.col("lo") + 1
    own = reads.filter(F.col("inside") & n.between(*ENTRIES))
    base, scale = F.when(F.col("fitted"), F.col("base_fit")).otherwise(F.col("base")), F.when(F.col("fitted"), F.col("scale")).otherwise(F.col("stride"))
    way = lambda name, step, off: F.struct(F.lit(name).alias("packing"), F.lit(step).alias("step"), F.lit(off).cast("long").alias("off") if isinstance(off, int) else off.alias("off"))
    ways = F.array(F.when(scale == 2, way("interleaved", 2, 1)), way("split", 1, n), way("adjacent", 1, 1))
    own = own.select(*keys, "pc", base.alias("base"), "lo", "hi", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select(*keys, "pc", "base", "lo", "hi", "w.*")
    low = lambda i: (F.col("base") + F.col("step") * i).bitwiseAND(0xFFFF)
    high = lambda i: (low(i) + F.col("off")).bitwiseAND(0xFFFF)
    index = F.sequence("lo", "hi")
    own = own.filter(F.forall(index, lambda i: low(i).between(first, last) & high(i).between(first, last)))
    each = own.select(*keys, "pc", "base", "packing", "step", "off", F.explode(index).alias("k"))
    each = each.withColumn("_low", low(F.col("k"))).withColumn("_high", high(F.col("k")))
    for at, out in (("_low", "_l"), ("_high", "_h")):
        each = each.join(memory.select(*keys, F.col("addr").alias(at), F.col("byte").alias(out)), [*keys, at], "left")
    byte = lambda c: F.coalesce(F.col(c), F.lit(0))
    return each.select(*keys, "pc", "base", "packing", "k", (byte("_l") + 256 * byte("_h")).alias("pointer"))


def read_extents(access: DataFrame, keys: list[str], first: int, last: int, playing: Column | None = None) -> DataFrame:
    """keys, addr, length: for each address of the image that was read while playing, how many from it on were, LONGEST at most. An
    image has 65,536 addresses, which bounds the window."""
    own = access.filter((F.col("bits").bitwiseAND(READ_PLAYING) > 0 if playing is None else playing) & (F.col("addr") >= first) & (F.col("addr") < last))
    rows = own.withColumn("_g", F.col("addr") - F.row_number().over(Window.partitionBy(*keys).orderBy("addr")))
    end = F.max("addr").over(Window.partitionBy(*keys, "_g"))
    return rows.select(*keys, "addr", F.least(end - F.col("addr") + 1, F.lit(LONGEST)).alias("length"))


def read_banks(pointers: DataFrame, extents: DataFrame, shifts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The patterns that a pointer table leads to, as far as they were read, and the order in which it names them.

    Each table is tried with each shift of its keys (keys, delta). A pointer that leads to nothing that was read names no pattern.
    A table must name two patterns and, as order lists repeat patterns, five for each four at most; of those that do, the one with
    most patterns is kept, then the smallest pc, packing and shift. Gives (keys, pc, packing, delta, src, length, pattern) and
    (keys, k, pattern), where pattern is null if there is none."""
    by = [*keys, "pc", "packing", "delta"]
    moved = pointers.join(shifts, keys).withColumn("src", (F.col("pointer") - F.col("delta")).bitwiseAND(0xFFFF))
    moved = moved.join(extents.select(*keys, F.col("addr").alias("src"), "length"), [*keys, "src"], "left").select(*by, "k", "src", "length")
    known = F.when(F.col("length").isNotNull(), F.col("src"))
    score = moved.groupBy(*by).agg(F.count_distinct(known).alias("_patterns"), F.count("length").alias("_walked")).filter((F.col("_patterns") >= 2) & (5 * F.col("_patterns") <= 4 * F.col("_walked")))
    best = score.groupBy(*keys).agg(F.min(F.struct((-F.col("_patterns")).alias("m"), "pc", "packing", "delta")).alias("b")).select(*keys, "b.pc", "b.packing", "b.delta")
    won = moved.join(best, by)
    bank = won.filter(F.col("length").isNotNull()).select(*by, "src", "length").distinct()
    bank = bank.withColumn("pattern", F.row_number().over(Window.partitionBy(*keys).orderBy("src")) - 1)  # an entry for each of up to 512 pointers
    return bank, won.join(bank.select(*keys, "src", "pattern"), [*keys, "src"], "left").select(*keys, "k", "pattern")


def record_tables(leaves: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """keys, base, stride: where records of a fixed size lie that register writes take their values from. leaves: keys, pc, reg, addr,
    the addresses that a write at pc was fed from. Addresses of one field of a table lie a multiple of the stride apart: of writes
    with three addresses in the image or more, the stride that most have, the smallest on ties, and the least address of all."""
    own = leaves.filter((F.col("addr") >= first) & (F.col("addr") < last)).select(*keys, "pc", "reg", F.col("addr").cast("long").alias("addr"))
    fields = strides(own, [*keys, "pc", "reg"]).filter("n >= 3 and stride >= 2")
    counts = fields.groupBy(*keys, "stride").agg(F.count("*").alias("_n"), F.min("first").alias("_first"))
    return counts.groupBy(*keys).agg(F.min("_first").alias("base"), F.min_by("stride", F.struct(-F.col("_n"), "stride")).alias("stride"))


def read_leaves(slices: DataFrame, leaf_read: int = 1) -> DataFrame:
    """path, pc, reg, addr: the addresses in memory that a slice of a section file flowed from."""
    pairs = F.filter(F.arrays_zip("leaf_kind", "leaf_addr"), lambda x: x["leaf_kind"] == leaf_read)
    return slices.select("path", "pc", "reg", F.explode(F.transform(pairs, lambda x: x["leaf_addr"])).alias("addr"))
