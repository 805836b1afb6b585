"""Maximal ramps of a lane, in window functions only, and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lanes import _w

MODULUS = 1 << 16


def ramp_segments(lane: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """tune_id, lane, start, length, seed, step: each ramp is as long as its step stays the same; the next one starts right
    after its last frame, so the step between two ramps belongs to neither.

    Runs of equal steps are islands. A ramp takes the first frame of the run after it, so a run of one step vanishes if a
    ramp precedes it. In a row of such runs every other one vanishes. A last frame that is left alone is a ramp of its own.
    """
    steps = lane.withColumn("d", F.pmod(F.lead("v").over(_w()) - F.col("v"), F.lit(modulus)))
    last = lane.groupBy("tune_id", "lane").agg(F.count("*").alias("n"), F.max("frame").alias("start"), F.max("v").alias("seed"))
    steps = steps.filter(F.col("d").isNotNull()).withColumn("c", F.when(F.col("d") == F.lag("d").over(_w()), 0).otherwise(1))
    runs = steps.withColumn("k", F.sum("c").over(_w())).groupBy("tune_id", "lane", "k").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.min_by("v", "frame").alias("v"), F.min("d").alias("step"))
    by_run = Window.partitionBy("tune_id", "lane").orderBy("k")
    place = F.col("k") - F.max(F.when((F.col("k") == 1) | (F.col("a") < F.col("b")), F.col("k"))).over(by_run)
    runs = runs.withColumn("gone", place % 2 == 1)
    runs = runs.withColumn("whole", F.coalesce(F.lag("gone").over(by_run), F.lit(True))).withColumn("end", F.lead("k").over(by_run).isNull())
    start = F.when(F.col("whole"), F.col("a")).otherwise(F.col("a") + 1)
    seed = F.when(F.col("whole"), F.col("v")).otherwise((F.col("v") + F.col("step")) % modulus)
    kept = runs.filter(~F.col("gone")).select("tune_id", "lane", start.alias("start"), (F.col("b") + 2 - start).cast("long").alias("length"), seed.alias("seed"), "step")
    one, none = F.lit(1).cast("long").alias("length"), F.lit(0).cast("long").alias("step")
    alone = runs.filter(F.col("gone") & F.col("end")).select("tune_id", "lane", (F.col("b") + 1).alias("start"), one, ((F.col("v") + F.col("step")) % modulus).alias("seed"), none)
    return kept.unionByName(alone).unionByName(last.filter("n = 1").select("tune_id", "lane", "start", one, "seed", none))


def ramp_render(ramps: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """tune_id, lane, frame, v of ramps."""
    rows = ramps.filter("length > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    return rows.select("tune_id", "lane", (F.col("start") + F.col("i")).cast("int").alias("frame"), F.pmod(F.col("seed") + F.col("i") * F.col("step"), F.lit(modulus)).alias("v"))


def lane_residual(lane: DataFrame, rendered: DataFrame) -> DataFrame:
    """tune_id, lane, residual: frames that a rendering misses, gets wrong or has too many of."""
    both = lane.join(rendered.withColumnRenamed("v", "r"), ["tune_id", "lane", "frame"], "full")
    return both.groupBy("tune_id", "lane").agg(F.sum(F.when(F.col("v").eqNullSafe(F.col("r")), 0).otherwise(1)).cast("long").alias("residual"))
