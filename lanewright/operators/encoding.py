"""Dictionary encoding of runs and of note segments, and marker streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lanes
from .blocks import following, running
from .framing import BLOCK


def numbered(first: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ref: the place of a row among those of its keys."""
    return first.withColumn("ref", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def pool(runs: DataFrame) -> DataFrame:
    """tune_id, ref, length, v: the distinct (length, value) of a tune's runs, in the order of their first use: by lane, then by
    start. They are numbered in each lane, and after those of the lanes before."""
    first = runs.groupBy("tune_id", "length", "v").agg(F.min(F.struct("lane", "start")).alias("at")).select("*", F.col("at.lane").alias("lane"))
    sizes = first.groupBy("tune_id", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tune_id").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("tune_id", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each lane
    return numbered(first, ["tune_id", "lane"], ["at"]).join(sizes, ["tune_id", "lane"]).select("tune_id", (F.col("ref") + F.col("base")).cast("int").alias("ref"), "length", "v")


def pool_encode(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """tune_id, lane, pos, ref: runs of a lane as references to the pool."""
    place = F.row_number().over(Window.partitionBy("tune_id", "lane").orderBy("start")) - 1
    return runs.withColumn("pos", place).join(entries, ["tune_id", "length", "v"]).select("tune_id", "lane", "pos", "ref")


def pool_decode(coded: DataFrame, entries: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v: starts are the sums of the lengths before."""
    before = Window.partitionBy("tune_id", "lane").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = coded.join(entries, ["tune_id", "ref"]).withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    frames = F.sequence(F.col("start").cast("int"), (F.col("start") + F.col("length") - 1).cast("int"))
    return rows.select("tune_id", "lane", F.explode(frames).alias("frame"), "v")


def note_segments(lane: DataFrame, kind: str = "freq") -> DataFrame:
    """tune_id, voice, start, base, shape: a lane of each voice cut at its note boundaries; shape is the array of values less
    the first one. An array holds one segment of one tune."""
    own = lane.filter(F.col("lane").startswith(kind)).select("tune_id", F.substring("lane", -1, 1).cast("int").alias("voice"), "frame", "v")
    marks = lanes.note_boundaries(lane).withColumn("mark", F.lit(1))
    w = Window.partitionBy("tune_id", "voice").orderBy("frame")
    cut = own.join(marks, ["tune_id", "voice", "frame"], "left").withColumn("seg", F.sum(F.coalesce("mark", F.lit(0))).over(w))
    rows = cut.groupBy("tune_id", "voice", "seg").agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("xs"))
    return rows.select("tune_id", "voice", F.col("xs")[0]["frame"].alias("start"), F.col("xs")[0]["v"].alias("base"), F.transform("xs", lambda x: x["v"] - F.col("xs")[0]["v"]).alias("shape"))


def shape_refs(segments: DataFrame) -> DataFrame:
    """tune_id, voice, start, base, ref: shapes numbered by their first use in the voice."""
    first = segments.groupBy("tune_id", "voice", "shape").agg(F.min("start").alias("at"))
    return segments.join(numbered(first, ["tune_id", "voice"], ["at"]), ["tune_id", "voice", "shape"]).select("tune_id", "voice", "start", "base", "ref")


def accumulator_kind(shape: Column) -> Column:
    """ramp if all steps are equal, quadratic if all changes of steps are, else raw."""
    steps = lambda xs: F.transform(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, i: x - F.get(xs, i))
    one = steps(shape)
    two = steps(one)
    return F.when(F.size(F.array_distinct(one)) <= 1, "ramp").when(F.size(F.array_distinct(two)) <= 1, "quadratic").otherwise("raw")


def next_boundary(frames: DataFrame, boundaries: DataFrame) -> DataFrame:
    """tune_id, frame, next: the next boundary after each frame; null after the last."""
    marked = frames.join(boundaries.withColumn("mark", F.col("frame")), ["tune_id", "frame"], "left")
    return following(marked, ["tune_id"], "frame", F.col("mark"), "next", BLOCK).select("tune_id", "frame", "next")


def marked_regions(addresses: DataFrame, keys: list[str], addr: str, mark: Column) -> DataFrame:
    """keys, addr: distinct addresses in those maximal runs that hold at least one marked row."""
    own = addresses.groupBy(*keys, addr).agg(F.max(mark).alias("hit"))
    own = own.withColumn("g", F.col(addr) - F.row_number().over(Window.partitionBy(*keys).orderBy(addr)))
    return own.withColumn("any", F.max("hit").over(Window.partitionBy(*keys, "g"))).filter("any").select(*keys, addr)


def decode_markers(stream: DataFrame, key: str, pos: str, byte: str, note_below: int, length_below: int, end: int) -> DataFrame:
    """key, pattern, pos, note, instrument, length from a stream of bytes.

    Bytes under note_below are notes, those under length_below set the length, `end` ends a pattern, all others set the
    instrument. Settings hold to the end of the pattern; null before the first.
    """
    b = F.col(byte)
    cut = running(stream, [key], pos, [], F.when(b == end, 1).otherwise(0).cast("long"), "pattern", 1 << 14, False)
    own = Window.partitionBy(key, "pattern").orderBy(pos)
    length = F.when((b >= note_below) & (b < length_below) & (b != end), b - note_below)
    instrument = F.when((b >= length_below) & (b != end), b - length_below)
    state = cut.withColumn("length", F.last(length, True).over(own)).withColumn("instrument", F.last(instrument, True).over(own))
    return state.filter((b < note_below) & (b != end)).select(key, "pattern", pos, b.alias("note"), "instrument", "length")
