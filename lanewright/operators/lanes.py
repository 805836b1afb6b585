"""Lanes of a state table, their boundaries and their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import previous
from .framing import BLOCK

#: Bits of a register that count, where not all do.
MASKS = {3: 0x0F, 10: 0x0F, 17: 0x0F, 21: 0x07, 23: 0xF7}
VOICES = (0, 1, 2)


def mask_of(reg: Column) -> Column:
    out = F.lit(255)
    for r, m in MASKS.items():
        out = F.when(reg == r, m).otherwise(out)
    return out.cast("long")


def lanes(state: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v: for each voice frequency (16 bits), pulse width (12 bits), control and envelope bytes; and
    the four global registers. Registers are gathered by one aggregation, not by joins."""
    reg = lambda r: F.max(F.when(F.col("reg") == r, F.col("val")))
    parts = []
    for v in VOICES:
        at = 7 * v
        parts += [(f"freq{v}", reg(at) + 256 * reg(at + 1)), (f"pw{v}", reg(at + 2) + 256 * reg(at + 3).bitwiseAND(15))]
        parts += [(f"{name}{v}", reg(at + k)) for name, k in (("ctrl", 4), ("ad", 5), ("sr", 6))]
    parts += [(f"global{r}", reg(r)) for r in range(21, 25)]
    wide = state.groupBy("tune_id", "frame").agg(F.array(*[F.struct(F.lit(n).alias("lane"), c.alias("v")) for n, c in parts]).alias("lanes"))
    return wide.select("tune_id", "frame", F.explode("lanes").alias("l")).select("tune_id", "l.lane", "frame", "l.v")


def _w(*more: str) -> Window:
    return Window.partitionBy("tune_id", "lane", *more).orderBy("frame")


def note_boundaries(lane: DataFrame) -> DataFrame:
    """tune_id, voice, frame: any change in control or envelope, and frame 0."""
    own = lane.filter(F.col("lane").rlike("^(ctrl|ad|sr)[0-2]$")).withColumn("b", F.lag("v").over(_w()))
    changed = own.filter(F.col("b").isNull() | (F.col("b") != F.col("v")))
    return changed.select("tune_id", F.substring("lane", -1, 1).cast("int").alias("voice"), "frame").distinct()


def gate_noteons(lane: DataFrame) -> DataFrame:
    """tune_id, voice, frame: the gate bit goes from 0 to 1."""
    own = lane.filter(F.col("lane").startswith("ctrl")).withColumn("b", F.coalesce(F.lag("v").over(_w()), F.lit(0)))
    return own.filter((F.col("b").bitwiseAND(1) == 0) & (F.col("v").bitwiseAND(1) == 1)).select("tune_id", F.substring("lane", -1, 1).cast("int").alias("voice"), "frame")


def jumps(lane: DataFrame, kind: str, down_only: bool) -> DataFrame:
    """tune_id, lane, frame: steps beyond max(8, 4 * the median step that is not 0)."""
    own = lane.filter(F.col("lane").startswith(kind)).withColumn("d", F.col("v") - F.lag("v").over(_w()))
    usual = own.filter("d <> 0").groupBy("tune_id", "lane").agg(F.floor(F.median(F.abs("d"))).alias("m"))
    size = -F.col("d") if down_only else F.abs("d")
    return own.join(usual, ["tune_id", "lane"]).filter(size > F.greatest(F.lit(8), 4 * F.col("m"))).select("tune_id", "lane", "frame")


def rest_boundaries(lane: DataFrame) -> DataFrame:
    """tune_id, lane, frame: a frequency becomes 0 or ceases to be."""
    own = lane.filter(F.col("lane").startswith("freq")).withColumn("b", F.lag("v").over(_w()))
    return own.filter((F.col("b") == 0) != (F.col("v") == 0)).select("tune_id", "lane", "frame")


def all_boundaries(lane: DataFrame) -> DataFrame:
    """tune_id, frame: note boundaries and pulse width resets of all voices, and frame 0."""
    both = note_boundaries(lane).select("tune_id", "frame").union(jumps(lane, "pw", True).select("tune_id", "frame"))
    return both.union(lane.select("tune_id", F.lit(0).alias("frame"))).distinct()


def hold_lengths(lane: DataFrame) -> DataFrame:
    """tune_id, lane, frame, run: frames from here on with the same value."""
    nxt = lane.withColumn("n", F.lead("v").over(_w()))
    ends = F.when(F.col("n").isNull() | (F.col("n") != F.col("v")), F.col("frame"))
    stop = F.min(ends).over(_w().rowsBetween(0, Window.unboundedFollowing))
    return nxt.select("tune_id", "lane", "frame", (stop - F.col("frame") + 1).alias("run"))


def runs(lane: DataFrame) -> DataFrame:
    """tune_id, lane, start, length, v: islands of equal values."""
    flag = lane.withColumn("b", F.lag("v").over(_w())).withColumn("c", F.when(F.col("b") == F.col("v"), 0).otherwise(1))
    island = flag.withColumn("g", F.sum("c").over(_w()))
    return island.groupBy("tune_id", "lane", "g").agg(F.min("frame").alias("start"), F.count("*").alias("length"), F.min("v").alias("v")).drop("g")


def regions(addresses: DataFrame, keys: list[str], addr: str = "addr") -> DataFrame:
    """keys, lo, n: maximal runs of consecutive distinct addresses."""
    own = addresses.select(*keys, addr).distinct()
    own = own.withColumn("g", F.col(addr) - F.row_number().over(Window.partitionBy(*keys).orderBy(addr)))
    return own.groupBy(*keys, "g").agg(F.min(addr).alias("lo"), F.count("*").alias("n")).drop("g")


def smallest_period(lane: DataFrame, most: int = 8) -> DataFrame:
    """tune_id, lane, period: the smallest shift up to `most` at which a lane repeats itself throughout; null if none."""
    own = lane
    for p in range(1, most + 1):
        own = own.withColumn(f"p{p}", F.lag("v", p).over(_w()))
    ok = [F.when(F.min(F.coalesce(F.col(f"p{p}") == F.col("v"), F.lit(True))) & (F.count("*") > p), p) for p in range(1, most + 1)]
    return own.groupBy("tune_id", "lane").agg(F.coalesce(*ok).alias("period"))


def schedule(points: DataFrame) -> DataFrame:
    """tune_id, gap: the commonest interval of distinct frames, the smallest on ties."""
    own = previous(points.select("tune_id", "frame").distinct(), ["tune_id"], "frame", [], "frame", "_p", BLOCK).withColumn("gap", F.col("frame") - F.col("_p"))
    counts = own.filter(F.col("gap").isNotNull()).groupBy("tune_id", "gap").agg(F.count("*").alias("n"))
    return counts.groupBy("tune_id").agg(F.min_by("gap", F.struct(-F.col("n"), "gap")).alias("gap"))


def first_use(lane: DataFrame) -> DataFrame:
    """tune_id, lane, frame, ref: values numbered by their first appearance in the lane."""
    first = lane.groupBy("tune_id", "lane", "v").agg(F.min("frame").alias("first"))
    ref = first.withColumn("ref", F.row_number().over(Window.partitionBy("tune_id", "lane").orderBy("first")) - 1)
    return lane.join(ref, ["tune_id", "lane", "v"]).select("tune_id", "lane", "frame", "ref")


def top_cover(lane: DataFrame, k: int = 8) -> DataFrame:
    """tune_id, lane, covered: share of the frames that the k commonest values hold (values break ties)."""
    counts = lane.groupBy("tune_id", "lane", "v").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("tune_id", "lane").orderBy(F.desc("n"), "v")))
    return ranked.groupBy("tune_id", "lane").agg((F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("covered"))
