"""From a log of writes to a table of states: binning, last write wins, forward fill; bursts and periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import previous, running

REGISTERS = 25
#: Microseconds of a frame, and of the gap that starts a burst.
FRAME, GAP = 3_600_000_000, 1_800_000_000
#: Frames of a block of a tune; a task sees one block.
BLOCK = 256


def binned(log: DataFrame, frame: int = FRAME, starts: DataFrame | None = None, preroll: str = "carry") -> DataFrame:
    """The last write of each (tune, frame, register); frames are counted from the first write, halves rounded to even.

    starts: tune_id, t0, where frames are to be counted from another time. Writes before frame 0 then are carried into it, or
    dropped (preroll: carry or drop).
    """
    t0 = log.groupBy("tune_id").agg(F.min("clock").alias("t0")) if starts is None else starts
    if starts is not None:
        at = F.rint((F.col("clock") - F.col("t0")) / frame).cast("int")
        rows = log.join(t0, "tune_id").withColumn("frame", at)
        rows = rows.filter("frame >= 0") if preroll == "drop" else rows.withColumn("frame", F.greatest("frame", F.lit(0)))
        return rows.groupBy("tune_id", "frame", "reg").agg(F.max_by("val", F.struct("clock", "seq")).alias("val"))
    at = F.rint((F.col("clock") - F.col("t0")) / frame).cast("int")
    return log.join(t0, "tune_id").groupBy("tune_id", at.alias("frame"), "reg").agg(F.max_by("val", F.struct("clock", "seq")).alias("val"))


def framed_state(log: DataFrame, frame: int = FRAME, starts: DataFrame | None = None, preroll: str = "carry") -> DataFrame:
    """tune_id, frame, reg, val for all frames and registers; 0 before the first write."""
    return filled_state(binned(log, frame, starts, preroll))


def filled_state(writes: DataFrame) -> DataFrame:
    """tune_id, frame, reg, val for all frames up to the last and all registers, from the last writes of frames."""
    frames = writes.groupBy("tune_id").agg(F.max("frame").alias("last"))
    grid = frames.select("tune_id", F.explode(F.sequence(F.lit(0), "last")).alias("frame")).select("tune_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))).alias("reg"))
    filled = F.last("val", True).over(Window.partitionBy("tune_id", "reg").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(writes, ["tune_id", "frame", "reg"], "left").select("tune_id", "frame", "reg", F.coalesce(filled, F.lit(0)).alias("val"))


def change_points(series: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """The rows whose value differs from the one before; the first always."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("frame"))
    return series.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def hold_render(points: DataFrame, lengths: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Each change point held until the next one, or to the last frame (lengths: tune_id, last)."""
    nxt = F.lead("frame").over(Window.partitionBy(*keys).orderBy("frame"))
    held = points.withColumn("_next", nxt).join(lengths, "tune_id").withColumn("_stop", F.coalesce(F.col("_next") - 1, F.col("last")))
    return held.select(*keys, F.explode(F.sequence("frame", "_stop")).alias("frame"), value)


def residual(state: DataFrame, rendered: DataFrame) -> DataFrame:
    """Frames of each (tune, register) that a rendering misses or gets wrong."""
    both = state.join(rendered.withColumnRenamed("val", "r"), ["tune_id", "reg", "frame"], "full")
    return both.groupBy("tune_id", "reg").agg(F.sum(F.when(F.col("val").eqNullSafe(F.col("r")), 0).otherwise(1)).cast("long").alias("residual"))


def burst_starts(log: DataFrame, gap: int = GAP) -> DataFrame:
    """tune_id, start, ord: writes that follow the one before by more than the gap, and the first."""
    rows = previous(log, ["tune_id"], "clock", ["seq"], "clock", "_p", BLOCK * FRAME)
    starts = rows.filter(F.col("_p").isNull() | (F.col("clock") - F.col("_p") > gap)).select("tune_id", "seq", F.col("clock").alias("start"))
    return running(starts, ["tune_id"], "start", ["seq"], F.lit(1).cast("long"), "ord", BLOCK * FRAME).select("tune_id", "start", F.col("ord").cast("int").alias("ord"))


def _steps(log: DataFrame, gap: int) -> DataFrame:
    """Bursts with d, the interval from the one before."""
    return previous(burst_starts(log, gap), ["tune_id"], "ord", [], "start", "_p", 4 * BLOCK).withColumn("d", F.col("start") - F.col("_p")).drop("_p")


def play_period(log: DataFrame, frame: int = FRAME, gap: int = GAP) -> DataFrame:
    """tune_id, period: the median interval of bursts; the frame where there are under 4 bursts or it is out of range."""
    found = _steps(log, gap).groupBy("tune_id").agg(F.count("*").alias("n"), F.median("d").alias("m"))
    bad = (F.col("n") < 4) | (F.col("m") <= 0) | (F.col("m") >= 0.9 * frame)
    return found.select("tune_id", F.when(bad, F.lit(float(frame))).otherwise(F.col("m")).alias("period"))


def first_play(log: DataFrame, frame: int = FRAME, gap: int = GAP, slack: int = FRAME // 2) -> DataFrame:
    """tune_id, first: the first burst that three intervals follow which differ from the frame by less than the slack, else the
    first burst."""
    steps = _steps(log, gap)
    # Each near interval stands for the burst that is one, two or three places before its end.
    near = steps.filter(F.abs(F.col("d") - frame) < slack).select("tune_id", F.explode(F.array(*(F.col("ord") - k for k in (1, 2, 3)))).alias("ord"))
    good = near.groupBy("tune_id", "ord").agg(F.count("*").alias("n")).filter("n = 3")
    starts = steps.join(good, ["tune_id", "ord"], "left")
    return starts.groupBy("tune_id").agg(F.coalesce(F.min(F.when(F.col("n") == 3, F.col("start"))), F.min("start")).alias("first"))


def framing_loss(log: DataFrame, frame: int = FRAME) -> DataFrame:
    """tune_id, raw, framed, loss: changes of register values before and after framing, and the share that is lost."""
    by_write = Window.partitionBy("tune_id", "reg").orderBy("clock", "seq")
    raw = log.withColumn("b", F.lag("val").over(by_write)).groupBy("tune_id").agg(F.sum(F.when(F.col("b") != F.col("val"), 1).otherwise(0)).alias("raw"))
    by_frame = Window.partitionBy("tune_id", "reg").orderBy("frame")
    framed = binned(log, frame).withColumn("b", F.lag("val").over(by_frame)).groupBy("tune_id").agg(F.sum(F.when(F.col("b") != F.col("val"), 1).otherwise(0)).alias("framed"))
    loss = F.when(F.col("raw") > 0, F.greatest(F.lit(0.0), 1 - F.col("framed") / F.col("raw"))).otherwise(F.lit(0.0))
    return raw.join(framed, "tune_id").select("tune_id", "raw", "framed", loss.alias("loss"))


def best_lag(state: DataFrame, a: int, b: int, span: int = 12, least: int = 20) -> DataFrame:
    """tune_id, lag, same: the shift of register b against register a with most equal frames; the smallest of the best."""
    x = state.filter(F.col("reg") == a).select("tune_id", "frame", F.col("val").alias("x"))
    y = state.filter(F.col("reg") == b).select("tune_id", F.col("frame").alias("f"), F.col("val").alias("y"))
    y = y.select("tune_id", "y", F.col("f"), F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("lag")).withColumn("frame", F.col("f") - F.col("lag"))
    per = x.join(y, ["tune_id", "frame"]).groupBy("tune_id", "lag").agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("same"))
    return per.filter(F.col("n") > least).groupBy("tune_id").agg(F.max_by("lag", F.struct("same", -F.col("lag"))).alias("lag"), F.max("same").alias("same"))


def policies(log: DataFrame, frame: int = FRAME, gap: int = GAP) -> DataFrame:
    """tune_id, bursts, span, policy: how to frame a tune. static: all writes are in one frame; cadence: fewer than two bursts, or
    fewer than nine tenths of the frames that they span; gap: each burst is a frame."""
    rows = previous(log, ["tune_id"], "clock", ["seq"], "clock", "_p", BLOCK * frame).withColumn("_d", F.col("clock") - F.col("_p"))
    stats = rows.groupBy("tune_id").agg(F.sum(F.when(F.col("_d").isNull() | (F.col("_d") > gap), 1).otherwise(0)).alias("bursts"), (F.rint((F.max("clock") - F.min("clock")) / frame) + 1).cast("long").alias("span"))
    policy = F.when(F.col("span") < 2, "static").when((F.col("bursts") < 2) | (F.col("bursts") < 0.9 * F.col("span")), "cadence").otherwise("gap")
    return stats.select("tune_id", "bursts", "span", policy.alias("policy"))


def burst_frames(log: DataFrame, gap: int = GAP) -> DataFrame:
    """The last write of each (tune, burst, register), with the burst's place as the frame."""
    own = previous(log, ["tune_id"], "clock", ["seq"], "clock", "_p", BLOCK * FRAME)
    new = F.when(F.col("clock") - F.col("_p") > gap, 1).otherwise(0)
    own = running(own, ["tune_id"], "clock", ["seq"], new, "frame", BLOCK * FRAME).withColumn("frame", F.col("frame").cast("int"))
    return own.groupBy("tune_id", "frame", "reg").agg(F.max_by("val", F.struct("clock", "seq")).alias("val"))


def state_by_policy(log: DataFrame, frame: int = FRAME, gap: int = GAP) -> DataFrame:
    """tune_id, frame, reg, val, framed as the policy of each tune says. Static tunes hold their last values in their one frame."""
    chosen = policies(log, frame, gap).select("tune_id", "policy")
    rows = log.join(chosen, "tune_id")
    bursts = burst_frames(rows.filter("policy = 'gap'").drop("policy"), gap)
    return filled_state(bursts.unionByName(binned(rows.filter("policy <> 'gap'").drop("policy"), frame)))


def held_state(log: DataFrame, ends: DataFrame, frame: int = FRAME) -> DataFrame:
    """tune_id, frame, reg, val: the last value of each register (0 if none) over all frames up to an end time (tune_id, end)."""
    last = log.groupBy("tune_id", "reg").agg(F.max_by("val", F.struct("clock", "seq")).alias("val"))
    t0 = log.groupBy("tune_id").agg(F.min("clock").alias("t0")).join(ends, "tune_id")
    frames = t0.select("tune_id", F.explode(F.sequence(F.lit(0), F.rint((F.col("end") - F.col("t0")) / frame).cast("int"))).alias("frame"))
    grid = frames.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))))
    return grid.join(last, ["tune_id", "reg"], "left").select("tune_id", "frame", "reg", F.coalesce("val", F.lit(0)).alias("val"))


def state_digests(state: DataFrame) -> DataFrame:
    """tune_id, frame, h: one number for all registers of a frame."""
    return state.groupBy("tune_id", "frame").agg(F.sum((F.col("val") + 1) * (F.col("reg") + 1) * (F.col("reg") + 3)).cast("long").alias("h"))
