"""Which generator a segment begins with: all candidates of small grids of parameters, as rows, and the longest match of each.

A candidate's values come from the segment itself (its first cycle, its first step), so a candidate is tested by one pass over the
segment's array, in built-in functions. An array holds one segment of one lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which they win ties, and the dwells and periods that are tried.
GRIDS = {"arp": [(d, p) for d in (1, 2, 3, 4) for p in range(2, 7)], "tablewalk": [(1, p) for p in range(2, 13)], "dwell": [(d, 1) for d in range(1, 9)], "ratewalk": [(1, p) for p in range(2, 9)],
         "decay": [(d, p) for d in range(2, 5) for p in range(1, d)], "vibrato": [(1, p) for p in range(8)], "lead": [(d, p) for d in range(1, 7) for p in range(2, 9)]}
MASK = 65535


def candidates(spark: SparkSession) -> DataFrame:
    """rank, kind, dwell, period: fewer than a hundred rows."""
    rows = [(kind, d, p) for kind, grid in GRIDS.items() for d, p in grid]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rank int, kind string, dwell int, period int")


def predicted(kind: Column, v: Column, i: Column, d: Column, p: Column) -> Column:
    """What a candidate of this kind has at place i, by the values v of the segment."""
    at = lambda k: F.get(v, k.cast("int"))
    walk = at(F.pmod(F.floor(i / d), p) * d)
    step = at(F.lit(0)) + (at(d) - at(F.lit(0))) * F.floor(i / d)
    rate = at(F.pmod(i, p)) + (at(p) - at(F.lit(0))) * F.floor(i / p)
    fall = at(F.lit(0)) - (at(F.lit(0)) - at(d - p)) * F.floor((p + i) / d)  # p is the phase of the first drop
    tri = lambda x: F.least(F.pmod(x, F.lit(8)), 7 - F.pmod(x, F.lit(8)))
    turn = F.when(tri(p + 1) != tri(p), F.lit(1)).otherwise(F.lit(2))  # the first place where the triangle moves; p is its phase
    amp = (at(turn) - at(F.lit(0))) * (tri(p + turn) - tri(p))
    swing = at(F.lit(0)) + (tri(p + i) - tri(p)) * amp
    late = F.when(i < d, at(F.lit(0))).otherwise(at(d + F.pmod(i - d, p)))  # d is the lead
    return (
        F.when(kind.isin("arp", "tablewalk"), walk).when(kind == "dwell", step.bitwiseAND(MASK)).when(kind == "ratewalk", rate.bitwiseAND(MASK))
        .when(kind == "decay", fall.bitwiseAND(MASK)).when(kind == "vibrato", swing.bitwiseAND(MASK)).otherwise(late)
    )


def matched(v: Column, kind: Column, d: Column, p: Column) -> Column:
    """How many places from the first on the candidate gets right."""
    wrong = F.transform(v, lambda x, i: F.when(~x.eqNullSafe(predicted(kind, v, i, d, p)), i))
    return F.coalesce(F.array_min(wrong), F.size(v))


def accepted(v: Column, kind: Column, d: Column, p: Column, match: Column) -> Column:
    """Whether a match is long enough: a whole cycle of at least two values, two cycles, two steps, two cycles of steps, two drops,
    a whole triangle, two cycles after the lead."""
    cycle = F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), p - 1), lambda k: F.get(v, k * d)))) >= 2
    return (
        F.when(kind == "arp", (match >= p * d) & cycle).when(kind == "tablewalk", (match >= 2 * p) & cycle)
        .when(kind == "dwell", (match >= 2 * d + 1) & (F.get(v, d) != F.get(v, F.lit(0)))).when(kind == "ratewalk", (match >= F.greatest(F.lit(8), 2 * p)) & (F.size(v) > p))
        .when(kind == "decay", (match >= 2 * d + 1) & (F.get(v, F.lit(0)) > F.get(v, d - p))).when(kind == "vibrato", (match >= 9) & (F.get(v, F.lit(0)) != F.get(v, F.lit(2))))
        .otherwise((match >= d + 2 * p) & (F.size(F.array_distinct(F.slice(v, d + 1, p))) >= 2))
    )


def best_fits(segments: DataFrame, keys: list[str], values: str = "v") -> DataFrame:
    """keys, n, kind, dwell, period, length: the longest accepted match of each segment, the first kind and the smallest dwell and
    period on ties; kind is null where none is accepted."""
    c = F.broadcast(candidates(segments.sparkSession))
    rows = segments.withColumn("n", F.size(values)).crossJoin(c)  # a fixed grid
    kind, d, p, v = F.col("kind"), F.col("dwell"), F.col("period"), F.col(values)
    rows = rows.withColumn("length", matched(v, kind, d, p))
    ok = accepted(v, kind, d, p, F.col("length"))
    best = F.max_by(F.struct("kind", "dwell", "period", "length"), F.when(ok, F.struct("length", (-F.col("rank")).alias("r"))))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), best.alias("b")).select(*keys, "n", "b.kind", "b.dwell", "b.period", "b.length")


def tally(fits: DataFrame) -> DataFrame:
    """kind, n, frames, all_frames: segments of each kind, the frames that its matches hold, and those of its segments; with a
    total (kind null is none found; total has the kind "all")."""
    named = fits.withColumn("kind", F.coalesce("kind", F.lit("none")))
    total = named.rollup("kind").agg(F.count("*").alias("n"), F.sum(F.coalesce("length", F.lit(0))).cast("long").alias("frames"), F.sum("n").cast("long").alias("all_frames"))
    return total.withColumn("kind", F.coalesce("kind", F.lit("all")))
