"""Structure of lanes and memory: loops, interleaving, dictionaries of segments, pointer banks, patterns, and the choice of forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.scalars import rotation
from .blocks import following
from .lanes import _w


def walked(lane: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v, k: the values that a lane walks through (each change, and the first), numbered."""
    rows = lane.withColumn("_b", F.lag("v").over(_w())).filter(F.col("_b").isNull() | (F.col("_b") != F.col("v"))).drop("_b")
    return rows.withColumn("k", F.row_number().over(_w()) - 1).select("tune_id", "lane", "frame", "v", "k")


def loops(walk: DataFrame, periods: tuple[int, int] = (4, 16), distinct: int = 3) -> DataFrame:
    """tune_id, lane, period, length: the longest prefix of a walk that repeats with a period in range, over at least two cycles and
    with at least so many different values; the smallest period on ties. Lanes without such a loop have no row."""
    size = walk.groupBy("tune_id", "lane").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tune_id", "lane").orderBy("k")
    found = []
    rows = walk
    for p in range(periods[0], periods[1] + 1):
        rows = rows.withColumn(f"_e{p}", F.when(F.lag("v", p).over(w) != F.col("v"), F.col("k")))
        found.append(F.struct(F.lit(p).alias("p"), F.min(f"_e{p}").alias("first"), F.countDistinct(F.when(F.col("k") < p, F.col("v"))).alias("d")))
    each = rows.groupBy("tune_id", "lane").agg(F.array(*found).alias("f")).join(size, ["tune_id", "lane"]).select("tune_id", "lane", "n", F.explode("f").alias("f"))
    each = each.withColumn("length", F.coalesce("f.first", "n")).filter((F.col("length") >= 2 * F.col("f.p")) & (F.col("f.d") >= distinct))
    best = F.max_by(F.struct("f.p", "length"), F.struct("length", -F.col("f.p")))
    return each.groupBy("tune_id", "lane").agg(best.alias("b")).select("tune_id", "lane", F.col("b.p").alias("period"), F.col("b.length").alias("length"))


def interleave_period(lane: DataFrame, most: int = 4) -> DataFrame:
    """tune_id, lane, ways: the smallest number of sub-lanes (frame mod ways) whose median steps are all at most a quarter of the
    lane's own median step; null if there is none."""
    rows = lane.withColumn("_d", F.abs(F.col("v") - F.lag("v").over(_w())))
    for n in range(2, most + 1):
        rows = rows.withColumn(f"_d{n}", F.abs(F.col("v") - F.lag("v", n).over(_w())))
    whole = rows.groupBy("tune_id", "lane").agg(F.median("_d").alias("m"))
    out = whole
    for n in range(2, most + 1):
        phases = rows.groupBy("tune_id", "lane", (F.col("frame") % n).alias("_p")).agg(F.median(f"_d{n}").alias("_m"))
        out = out.join(phases.groupBy("tune_id", "lane").agg(F.max("_m").alias(f"m{n}")), ["tune_id", "lane"])
    ok = [F.when((F.col("m") > 0) & (4 * F.col(f"m{n}") <= F.col("m")), n) for n in range(2, most + 1)]
    return out.select("tune_id", "lane", F.coalesce(*ok).alias("ways"))


def held_seeds(lane: DataFrame, by: str) -> DataFrame:
    """tune_id, lane, frame, seed, changes: within each island of equal `by`, its first value held; and how often by has changed."""
    rows = lane.withColumn("_c", F.when(F.lag(by).over(_w()) != F.col(by), 1).otherwise(0)).withColumn("changes", F.sum("_c").over(_w()))
    first = F.first("v").over(Window.partitionBy("tune_id", "lane", "changes").orderBy("frame"))
    return rows.select("tune_id", "lane", "frame", first.alias("seed"), "changes")


def segments_back(refs: DataFrame, shapes: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v from segments (tune_id, voice, start, base, ref) and the shapes (tune_id, voice, ref, shape)."""
    rows = refs.join(shapes, ["tune_id", "voice", "ref"]).select("tune_id", "voice", "start", "base", F.posexplode("shape").alias("i", "d"))
    return rows.select("tune_id", F.concat(F.lit("freq"), F.col("voice")).alias("lane"), (F.col("start") + F.col("i")).cast("int").alias("frame"), (F.col("base") + F.col("d")).alias("v"))


def clamped_onsets(onsets: DataFrame, keys: list[str], at: str, low: int, high: int) -> DataFrame:
    """keys, at: onsets in [low, high), with low itself for each key."""
    return onsets.filter((F.col(at) >= low) & (F.col(at) < high)).select(*keys, at).union(onsets.select(*keys, F.lit(low).alias(at))).distinct()


def carved(addresses: DataFrame, spans: DataFrame, keys: list[str], addr: str = "addr") -> DataFrame:
    """keys, lo, n: maximal runs of consecutive addresses that lie in no span (keys, lo, hi; hi not included)."""
    taken = spans.filter("hi > lo").select(*keys, F.explode(F.sequence("lo", F.col("hi") - 1)).alias(addr)).distinct()
    left = addresses.select(*keys, addr).distinct().join(taken, [*keys, addr], "left_anti")
    left = left.withColumn("_g", F.col(addr) - F.row_number().over(Window.partitionBy(*keys).orderBy(addr)))
    return left.groupBy(*keys, "_g").agg(F.min(addr).alias("lo"), F.count("*").alias("n")).drop("_g")


def longest_region(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, n: the longest region, the first on ties."""
    best = F.max_by(F.struct("lo", "n"), F.struct("n", -F.col("lo")))
    return regions.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.lo", "b.n")


def lengths_to_end(image: DataFrame, keys: list[str], ends: tuple[int, ...], size: int = 4096) -> DataFrame:
    """keys, addr, length: bytes from each address up to and with the next end byte; null if none follows."""
    mark = F.when(F.col("byte").isin(*ends), F.col("addr"))
    rows = following(image, keys, "addr", mark, "_n", size)
    stop = F.when(F.col("byte").isin(*ends), F.col("addr")).otherwise(F.col("_n"))
    return rows.select(*keys, "addr", (stop - F.col("addr") + 1).alias("length"))


def packed_pointers(image: DataFrame, keys: list[str], base: int, count: int) -> DataFrame:
    """keys, packing, k, pointer: `count` 16-bit pointers from base on under three packings: low and high bytes in turn, all low
    bytes before all high ones, all high ones before all low ones. Pointers of which a byte is missing are left out."""
    k = F.floor(F.col("off") / 2)
    rows = image.withColumn("off", F.col("addr") - base).filter(F.col("off").between(0, 2 * count - 1))
    half = F.when(F.col("off") < count, F.col("off")).otherwise(F.col("off") - count)
    first = F.col("off") < count
    place = F.array(
        F.struct(F.lit("interleaved").alias("packing"), k.alias("k"), (F.col("off") % 2 == 0).alias("low")),
        F.struct(F.lit("low_first").alias("packing"), half.alias("k"), first.alias("low")),
        F.struct(F.lit("high_first").alias("packing"), half.alias("k"), (~first).alias("low")))
    each = rows.select(*keys, "byte", F.explode(place).alias("p"))
    made = each.groupBy(*keys, "p.packing", "p.k").agg(F.sum(F.when(F.col("p.low"), F.col("byte")).otherwise(256 * F.col("byte"))).cast("long").alias("pointer"), F.count("*").alias("n"))
    return made.filter("n = 2").select(*keys, "packing", "k", "pointer")


def bank_ranking(pointers: DataFrame, lengths: DataFrame, keys: list[str], deltas: list[int]) -> DataFrame:
    """keys, packing, delta, patterns, covered: for each way of packing and each shift, the distinct pointers that start a pattern and
    the bytes of these patterns; the best of each key first covers most, then has most patterns, then the smallest shift."""
    shifted = pointers.withColumn("delta", F.explode(F.array(*map(F.lit, deltas)))).withColumn("addr", F.col("pointer") + F.col("delta"))
    hits = shifted.select(*keys, "packing", "delta", "addr").distinct().join(lengths.filter(F.col("length").isNotNull()), [*keys, "addr"])
    banks = hits.groupBy(*keys, "packing", "delta").agg(F.count("*").alias("patterns"), F.sum("length").alias("covered"))
    order = F.struct("covered", "patterns", -F.abs("delta"), -F.col("delta"), "packing")
    best = F.max_by(F.struct("packing", "delta", "patterns", "covered"), order)
    return banks.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.packing", "b.delta", "b.patterns", "b.covered")


def note_groups(stream: DataFrame, key: str, pos: str, byte: str, note_below: int, end: int) -> DataFrame:
    """key, group, bytes: markers with the note that they lead to; what follows the last note is a group of its own."""
    b = F.col(byte)
    w = Window.partitionBy(key, "_pattern").orderBy(pos)
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    rows = stream.withColumn("_pattern", F.coalesce(F.sum(F.when(b == end, 1).otherwise(0)).over(before), F.lit(0)))
    rows = rows.withColumn("_g", F.coalesce(F.sum(F.when(b < note_below, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bytes_ = F.transform(F.array_sort(F.collect_list(F.struct(pos, byte))), lambda x: x[byte])
    return rows.groupBy(key, F.col("_pattern").alias("pattern"), F.col("_g").alias("group")).agg(bytes_.alias("bytes"), F.min(pos).alias("at"))


def groups_back(groups: DataFrame, key: str, pos: str, byte: str) -> DataFrame:
    """key, the place among the key's bytes, and the byte: the inverse of note_groups."""
    rows = groups.select(key, "pattern", "group", F.posexplode("bytes").alias("i", byte))
    place = F.row_number().over(Window.partitionBy(key).orderBy("pattern", "group", "i")) - 1
    return rows.select(key, place.alias(pos), byte)


def merged_rotations(tables: DataFrame, key: str, table: str) -> DataFrame:
    """key, table, least, merged: tables that are rotations of each other have one least rotation; they are rewritten to it where at
    least two different rotations occur."""
    rows = tables.withColumn("least", rotation(F.col(table)))
    seen = rows.groupBy("least").agg(F.countDistinct(table).alias("_n"))
    rows = rows.join(seen, "least")
    return rows.select(key, F.when(F.col("_n") > 1, F.col("least")).otherwise(F.col(table)).alias(table), "least", (F.col("_n") > 1).alias("merged"))


def literal_runs(runs: DataFrame, least: int = 8, share: float = 0.6) -> DataFrame:
    """tune_id, lane, start, frames, distinct: maximal stretches of runs of one frame that are long and varied enough to be one
    literal table."""
    w = Window.partitionBy("tune_id", "lane").orderBy("start")
    rows = runs.withColumn("_one", F.col("length") == 1).withColumn("_new", F.when(F.col("_one") & ~F.coalesce(F.lag("_one").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_g", F.sum("_new").over(w)).filter("_one")
    found = rows.groupBy("tune_id", "lane", "_g").agg(F.min("start").alias("start"), F.count("*").alias("frames"), F.countDistinct("v").alias("distinct"))
    return found.filter((F.col("frames") >= least) & (F.col("distinct") >= share * F.col("frames"))).drop("_g")


def with_literals(fits: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, literal: what no generator fits is written out; literal is null where one does."""
    rows = segments.join(fits, keys, "left")
    return rows.select(*keys, F.coalesce("kind", F.lit("literal")).alias("kind"), F.when(F.col("kind").isNull(), F.col("v")).alias("literal"))


def unfit_frames(fits: DataFrame) -> DataFrame:
    """tune_id, voice, unfit, frames: frames of segments that nothing fits, of all frames."""
    return fits.groupBy("tune_id", "voice").agg(F.sum(F.when(F.col("kind").isNull(), F.col("n")).otherwise(0)).cast("long").alias("unfit"), F.sum("n").cast("long").alias("frames"))


def held_pitches(runs: DataFrame, least: int = 2) -> DataFrame:
    """tune_id, k, v: the positive values that a tune's frequency lanes hold for more than a frame, sorted and numbered; tunes with
    fewer than `least` have none."""
    own = runs.filter(F.col("lane").startswith("freq") & (F.col("length") > 1) & (F.col("v") > 0)).select("tune_id", "v").distinct()
    enough = own.groupBy("tune_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return own.join(enough, "tune_id").select("tune_id", (F.row_number().over(Window.partitionBy("tune_id").orderBy("v")) - 1).alias("k"), "v")


@F.pandas_udf(LongType())
def gcd_of(v: pd.Series) -> int:
    return int(np.gcd.reduce(v.dropna().to_numpy(np.int64), initial=0))


def strides(addresses: DataFrame, keys: list[str], addr: str = "addr") -> DataFrame:
    """keys, first, stride, n: the smallest address, the greatest common divisor of the gaps of distinct addresses (0 if there is but
    one), and their number."""
    own = addresses.select(*keys, addr).distinct().withColumn("_d", F.col(addr) - F.lag(addr).over(Window.partitionBy(*keys).orderBy(addr)))
    gaps = own.filter(F.col("_d").isNotNull()).select(*keys, "_d").distinct().groupBy(*keys).agg(gcd_of("_d").alias("stride"))
    base = own.groupBy(*keys).agg(F.min(addr).alias("first"), F.count("*").alias("n"))
    return base.join(gaps, keys, "left").select(*keys, "first", F.coalesce("stride", F.lit(0).cast("long")).alias("stride"), "n")


def durations(points: DataFrame, ends: DataFrame) -> DataFrame:
    """tune_id, frame, duration: frames to the next distinct point, or to the end (tune_id, end)."""
    own = points.select("tune_id", "frame").distinct().join(ends, "tune_id")
    return own.select("tune_id", "frame", (F.coalesce(F.lead("frame").over(Window.partitionBy("tune_id").orderBy("frame")), F.col("end")) - F.col("frame")).alias("duration"))


def index_walk(lane: DataFrame, modulus: int = 65536, by: str = "acc") -> DataFrame:
    """tune_id, lane, frame, seed, idx: the value less an accumulator, and its place among the distinct seeds of the lane."""
    rows = lane.withColumn("seed", F.pmod(F.col("v") - F.col(by), F.lit(modulus)))
    return rows.select("tune_id", "lane", "frame", "seed", (F.dense_rank().over(Window.partitionBy("tune_id", "lane").orderBy("seed")) - 1).alias("idx"))


def flattest(lane: DataFrame, cells: DataFrame, modulus: int = 65536) -> DataFrame:
    """tune_id, lane, cell, changes: the accumulator cell (tune_id, cell, frame, acc) that leaves the fewest changes when it is taken
    off a lane; the smallest cell on ties."""
    rows = lane.join(cells, ["tune_id", "frame"]).withColumn("_s", F.pmod(F.col("v") - F.col("acc"), F.lit(modulus)))
    w = Window.partitionBy("tune_id", "lane", "cell").orderBy("frame")
    counts = rows.withColumn("_c", (F.lag("_s").over(w) != F.col("_s")).cast("int")).groupBy("tune_id", "lane", "cell").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("changes"))
    return counts.groupBy("tune_id", "lane").agg(F.min_by(F.struct("cell", "changes"), F.struct("changes", "cell")).alias("b")).select("tune_id", "lane", "b.cell", "b.changes")


def cheapest(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, form, tokens: the form with the fewest tokens of rows (keys, form, tokens); names break ties."""
    return sizes.groupBy(*keys).agg(F.min_by(F.struct("form", "tokens"), F.struct("tokens", "form")).alias("b")).select(*keys, "b.form", "b.tokens")


def lane_forms(changes: DataFrame, ramps: DataFrame, values: DataFrame) -> DataFrame:
    """tune_id, lane, form, tokens: what a lane takes as change points (frame and value each), ramps (frame, seed and step each) and as
    a dictionary of its values (one each, and one reference a frame)."""
    a = changes.groupBy("tune_id", "lane").agg((2 * F.count("*")).alias("tokens")).withColumn("form", F.lit("changes"))
    b = ramps.groupBy("tune_id", "lane").agg((3 * F.count("*")).alias("tokens")).withColumn("form", F.lit("ramps"))
    c = values.groupBy("tune_id", "lane").agg((F.countDistinct("v") + F.count("*")).alias("tokens")).withColumn("form", F.lit("dictionary"))
    return a.unionByName(b).unionByName(c).select("tune_id", "lane", "form", "tokens")


def amortised(uses: DataFrame, key: str, cost: Column) -> DataFrame:
    """key, uses, share: what an entry costs for each of its uses."""
    return uses.groupBy(key).agg(F.count("*").alias("uses"), (F.max(cost) / F.count("*")).alias("share"))


def gates(streams: DataFrame) -> DataFrame:
    """tune_id, lane, no_copies, no_far_copies, bytes_share: checks of token streams (tune_id, lane, block, tokens as back-reference
    groups): whether there are no copies, no offsets of more than 4096, and the share of literals among groups."""
    rows = streams.groupBy("tune_id", "lane").agg(
        F.bool_and(F.col("op") == "literal").alias("no_copies"), (F.max("offset") <= 4096).alias("no_far_copies"), (F.sum((F.col("op") == "literal").cast("int")) / F.count("*")).alias("literals"))
    return rows
