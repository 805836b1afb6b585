"""Registered queries of programs: songs are put together from lanes, written as tokens and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import framing, lanes, programs, ramps, structure
from .coding_queries import RAMPS
from .queries import LANE, LOG, Q, SQL, _island, add, lane


def _gathered(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """keys, out: the values of each key in order. What is gathered are the parts of one tune's program."""
    each = F.array_sort(F.collect_list(F.struct(*order, value.alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(each, lambda x: x["_v"]).alias(out))


def _songs(log: DataFrame) -> DataFrame:
    """A song for each tune: held pitches, (ad, sr) pairs, control values, bytes of patterns, voices with their ramps and control
    lanes with their change points."""
    state = framing.framed_state(log)
    own = lanes.lanes(state)
    struct = F.struct
    base = state.groupBy("tune_id").agg((F.max("frame") + 1).cast("long").alias("frames"), F.transform(F.array_sort(F.collect_list(F.when(F.col("frame") == 0, struct("reg", "val")))), lambda x: x["val"]).alias("boot"))
    pitches = _gathered(structure.held_pitches(lanes.runs(own)), ["tune_id"], ["k"], F.col("v"), "note_table")
    # Both columns of envelopes come from one grid, frame by frame.
    pairs = state.filter("reg in (5, 6, 12, 13, 19, 20)").groupBy("tune_id", "frame", F.floor(F.col("reg") / 7).alias("voice")).agg(F.max_by("val", -F.col("reg")).alias("ad"), F.max_by("val", "reg").alias("sr"))
    pairs = pairs.select("tune_id", F.array("ad", "sr").alias("p")).distinct()
    instruments = _gathered(pairs, ["tune_id"], ["p"], F.col("p"), "instruments")
    controls = own.filter("lane like 'ctrl%'")
    used = controls.groupBy("tune_id").agg(F.array_sort(F.collect_set("v")).alias("programs"))
    bytes_ = structure.note_groups(log, "tune_id", "seq", "val", 96, 127)
    patterns = _gathered(bytes_, ["tune_id", "pattern"], ["group"], F.col("bytes").cast("array<long>"), "_bytes")
    patterns = _gathered(patterns, ["tune_id"], ["pattern"], F.flatten("_bytes"), "patterns")
    voice = lambda: F.substring("lane", -1, 1).cast("int").alias("voice")
    number = lambda c: F.col(c).cast("long").alias(c)
    segs = ramps.ramp_segments(own.filter("lane like 'freq%'")).select("tune_id", voice(), number("start"), number("seed"), number("step"))
    segs = _gathered(segs, ["tune_id", "voice"], ["start"], struct("start", "seed", "step"), "ramps")
    nothing = lambda node: F.lit(None).cast(programs.spark_type(node))
    cases = dict(programs.NODES["bases"].of.cases)
    choice = struct(F.lit(0).cast("long").alias("kind"), F.col("ramps"), *(nothing(node).alias(n) for n, node in (cases[1], cases[2])))
    bases = _gathered(segs, ["tune_id"], ["voice"], choice, "bases")
    points = framing.change_points(controls.withColumnRenamed("v", "val"), ["tune_id", "lane"]).select("tune_id", voice(), F.col("frame").cast("long").alias("start"), F.col("val").cast("long").alias("v"))
    points = _gathered(points, ["tune_id", "voice"], ["start"], struct("start", "v"), "points")
    cases = dict(programs.NODES["lanes"].of.cases)
    choice = struct(F.lit(0).cast("long").alias("kind"), struct((7 * F.col("voice") + 4).cast("long").alias("reg"), "points").alias("points"), *(nothing(node).alias(n) for n, node in (cases[1], cases[2])))
    changes = _gathered(points, ["tune_id"], ["voice"], choice, "lanes")
    for part in (pitches, instruments, used, patterns, bases, changes):
        base = base.join(part, "tune_id", "left")
    return base


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.concat_ws(" ", F.col(n).cast("array<string>")).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes))


_RN = LANE + RAMPS + _island + ", rn AS (SELECT tune_id, lane, min(frame) AS start, count(*) AS length, min(v) AS v FROM isl GROUP BY tune_id, lane, g)"
_RAMP = """, rs AS (SELECT tune_id, lane, a + CASE WHEN whole THEN 0 ELSE 1 END AS start, CASE WHEN whole THEN v ELSE (v + step) % 65536 END AS seed, step FROM u WHERE NOT gone
UNION ALL SELECT tune_id, lane, b + 1, (v + step) % 65536, 0 FROM u WHERE gone AND fin UNION ALL SELECT tune_id, lane, max(frame), max(v), 0 FROM lane GROUP BY 1, 2 HAVING count(*) = 1),
fr AS (SELECT *, start - coalesce(lag(start) OVER (PARTITION BY tune_id, lane ORDER BY start), 0) AS d FROM rs WHERE lane LIKE 'freq%'),
cp AS (SELECT tune_id, lane, frame, v FROM lagged WHERE lane LIKE 'ctrl%' AND (b IS NULL OR b <> v)), cd AS (SELECT *, frame - coalesce(lag(frame) OVER (PARTITION BY tune_id, lane ORDER BY frame), 0) AS d FROM cp)"""
_list = lambda x, by: f"string_agg({x}, ' ' ORDER BY {by})"
_SECTIONS = f"""{_RN}{_RAMP}, held AS (SELECT DISTINCT tune_id, v FROM rn WHERE lane LIKE 'freq%' AND length > 1 AND v > 0), pairs AS (SELECT DISTINCT tune_id, r5 AS a, r6 AS s FROM wide UNION SELECT tune_id, r12, r13 FROM wide UNION SELECT tune_id, r19, r20 FROM wide),
byts AS (SELECT tune_id, seq, val, coalesce(sum((val = 127)::INT) OVER (PARTITION BY tune_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pattern FROM log), pats AS (SELECT tune_id, pattern, count(*) || ' ' || {_list("val", "seq")} AS t FROM byts GROUP BY 1, 2),
ctls AS (SELECT DISTINCT tune_id, v FROM lane WHERE lane LIKE 'ctrl%'), tunes AS (SELECT DISTINCT tune_id FROM log),
vs AS (SELECT tune_id, lane, '0 ' || count(*) || ' ' || {_list("d", "start")} || ' ' || {_list("seed", "start")} || ' ' || {_list("step", "start")} AS t FROM fr GROUP BY 1, 2),
ls AS (SELECT tune_id, lane, '0 ' || (7 * right(lane, 1)::INT + 4) || ' ' || count(*) || ' ' || {_list("d", "frame")} || ' ' || {_list("v", "frame")} AS t FROM cd GROUP BY 1, 2),
parts AS (SELECT tune_id, 'note_table' AS section, count(*) AS n, {_list("v", "v")} AS t FROM held GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT tune_id, 'instruments', count(*), {_list("'2 ' || a || ' ' || s", "a, s")} FROM pairs GROUP BY 1
UNION ALL SELECT tune_id, 'programs', count(*), {_list("v", "v")} FROM ctls GROUP BY 1 UNION ALL SELECT tune_id, 'patterns', count(*), {_list("t", "pattern")} FROM pats GROUP BY 1
UNION ALL SELECT tune_id, 'bases', count(*), {_list("t", "lane")} FROM vs GROUP BY 1 UNION ALL SELECT tune_id, 'lanes', count(*), {_list("t", "lane")} FROM ls GROUP BY 1)"""
add("program_tokens", lambda x: _text(programs.section_tokens(_songs(x), "tune_id")), _SECTIONS, "SELECT tune_id, section, coalesce(n || ' ' || t, '0') AS tokens FROM tunes CROSS JOIN (SELECT DISTINCT section FROM parts UNION SELECT 'note_table') LEFT JOIN parts USING (tune_id, section)")


def _again(log: DataFrame) -> DataFrame:
    return programs.songs_of(programs.song_ids(_songs(log), "tune_id"), "tune_id")


def _ramps_again(log: DataFrame) -> DataFrame:
    voices = _again(log).select("tune_id", F.posexplode("bases").alias("voice", "b"))
    return voices.select("tune_id", "voice", F.explode("b.ramps").alias("r")).select("tune_id", "voice", "r.start", "r.seed", "r.step")


def _points_again(log: DataFrame) -> DataFrame:
    own = _again(log).select("tune_id", F.explode("lanes").alias("x")).select("tune_id", "x.points.reg", F.explode("x.points.points").alias("p"))
    return own.select("tune_id", "reg", "p.start", "p.v")


add("program_ramps_read", _ramps_again, _SECTIONS, "SELECT tune_id, right(lane, 1)::INT AS voice, start::BIGINT AS start, seed, step FROM fr")
add("program_points_read", _points_again, _SECTIONS, "SELECT tune_id, (7 * right(lane, 1)::INT + 4)::BIGINT AS reg, frame::BIGINT AS start, v FROM cp")
add("program_patterns_read", lambda x: _again(x).select("tune_id", F.posexplode("patterns").alias("pattern", "p")).select("tune_id", "pattern", F.concat_ws(" ", F.col("p").cast("array<string>")).alias("bytes")), _SECTIONS, "SELECT tune_id, pattern::INT AS pattern, string_agg(val, ' ' ORDER BY seq) AS bytes FROM byts GROUP BY 1, 2")


def _log(spark, sf_dir):
    from ..sources.events import register_log

    return register_log(spark, sf_dir)


#: Back references have no SQL here; tests compare them with a search of all places.
Q["program_ids"] = lambda spark, sf_dir: _text(programs.song_ids(_songs(_log(spark, sf_dir)), "tune_id"))
__all__ = ["LOG", "Q", "SQL", "lane"]
