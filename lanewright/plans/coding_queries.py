"""Registered queries of ramps, dictionaries, segments and marker streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encoding, framing, lanes, ramps
from ..streaming.framing import binned_stream
from .queries import LANE, LOG, Q, SQL, _island, _jump, _segments, add, lane

RAMPS = """, d AS (SELECT tune_id, lane, frame, v, ((nx - v) % 65536 + 65536) % 65536 AS d FROM lagged WHERE nx IS NOT NULL),
e AS (SELECT *, CASE WHEN d = lag(d) OVER (PARTITION BY tune_id, lane ORDER BY frame) THEN 0 ELSE 1 END AS c FROM d),
f AS (SELECT *, sum(c) OVER (PARTITION BY tune_id, lane ORDER BY frame) AS k FROM e),
r AS (SELECT tune_id, lane, k, min(frame) AS a, max(frame) AS b, arg_min(v, frame) AS v, min(d) AS step FROM f GROUP BY 1, 2, 3),
p AS (SELECT *, (k - max(CASE WHEN k = 1 OR a < b THEN k END) OVER (PARTITION BY tune_id, lane ORDER BY k)) % 2 = 1 AS gone FROM r),
u AS (SELECT *, coalesce(lag(gone) OVER w, true) AS whole, lead(k) OVER w IS NULL AS fin FROM p WINDOW w AS (PARTITION BY tune_id, lane ORDER BY k))"""
NOTES = """, marks AS (SELECT DISTINCT tune_id, CAST(right(lane, 1) AS INT) AS voice, frame FROM lagged WHERE regexp_matches(lane, '^(ctrl|ad|sr)[0-2]$') AND (b IS NULL OR b <> v)),
own AS (SELECT tune_id, CAST(right(lane, 1) AS INT) AS voice, frame, v FROM lane WHERE lane LIKE 'freq%'),
cut AS (SELECT own.*, sum(CASE WHEN marks.frame IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY own.tune_id, own.voice ORDER BY own.frame) AS seg FROM own LEFT JOIN marks USING (tune_id, voice, frame)),
segs AS (SELECT tune_id, voice, min(frame) AS start, arg_min(v, frame) AS base, list(v ORDER BY frame) AS vs FROM cut GROUP BY tune_id, voice, seg),
shapes AS (SELECT tune_id, voice, start, base, [x - base FOR x IN vs] AS shape FROM segs)"""


def _pool(log):
    runs = lanes.runs(lane(log))
    return runs, encoding.pool(runs)


def _pool_residual(log):
    runs, entries = _pool(log)
    return ramps.lane_residual(lane(log), encoding.pool_decode(encoding.pool_encode(runs, entries), entries))


add("ramp_segments", lambda x: ramps.ramp_segments(lane(x)), LANE + RAMPS, """SELECT tune_id, lane, a + CASE WHEN whole THEN 0 ELSE 1 END AS start, b + 2 - a - CASE WHEN whole THEN 0 ELSE 1 END AS length,
CASE WHEN whole THEN v ELSE (v + step) % 65536 END AS seed, step FROM u WHERE NOT gone
UNION ALL SELECT tune_id, lane, b + 1, 1, (v + step) % 65536, 0 FROM u WHERE gone AND fin
UNION ALL SELECT tune_id, lane, max(frame), 1, max(v), 0 FROM lane GROUP BY 1, 2 HAVING count(*) = 1""")
add("ramp_residual", lambda x: ramps.lane_residual(lane(x), ramps.ramp_render(ramps.ramp_segments(lane(x)))), LANE, "SELECT DISTINCT tune_id, lane, CAST(0 AS BIGINT) AS residual FROM lane")
_runs = LANE + _island + """, rn AS (SELECT tune_id, lane, min(frame) AS start, count(*) AS length, min(v) AS v FROM isl GROUP BY tune_id, lane, g),
pl AS (SELECT tune_id, length, v, row_number() OVER (PARTITION BY tune_id ORDER BY min({'l': lane, 's': start})) - 1 AS ref FROM rn GROUP BY 1, 2, 3)"""
add("run_pool", lambda x: _pool(x)[1], _runs, "SELECT tune_id, ref, length, v FROM pl")
add("pool_encode", lambda x: encoding.pool_encode(*_pool(x)), _runs, "SELECT tune_id, lane, row_number() OVER (PARTITION BY tune_id, lane ORDER BY start) - 1 AS pos, ref FROM rn JOIN pl USING (tune_id, length, v)")
add("pool_residual", _pool_residual, LANE, "SELECT DISTINCT tune_id, lane, CAST(0 AS BIGINT) AS residual FROM lane")
add("shape_refs", lambda x: encoding.shape_refs(encoding.note_segments(lane(x))), LANE + NOTES, """, sp AS (SELECT tune_id, voice, shape, row_number() OVER (PARTITION BY tune_id, voice ORDER BY min(start)) - 1 AS ref FROM shapes GROUP BY 1, 2, 3)
SELECT tune_id, voice, start, base, ref FROM shapes JOIN sp USING (tune_id, voice, shape)""")
add("accumulator_kinds", lambda x: encoding.note_segments(lane(x)).select("tune_id", "voice", "start", encoding.accumulator_kind(F.col("shape")).alias("kind")), LANE + NOTES, """, o AS (SELECT *, [shape[(k + 1)::INT] - shape[k::INT] FOR k IN range(1, len(shape))] AS d FROM shapes), q AS (SELECT *, [d[(k + 1)::INT] - d[k::INT] FOR k IN range(1, len(d))] AS dd FROM o)
SELECT tune_id, voice, start, CASE WHEN len(list_distinct(d)) <= 1 THEN 'ramp' WHEN len(list_distinct(dd)) <= 1 THEN 'quadratic' ELSE 'raw' END AS kind FROM q""")
add("next_boundary", lambda x: encoding.next_boundary(framing.framed_state(x).filter("reg = 0").select("tune_id", "frame"), lanes.all_boundaries(lane(x))), LANE + _jump.format(kind="pw"), """, bs AS (SELECT tune_id, frame FROM lagged WHERE regexp_matches(lane, '^(ctrl|ad|sr)[0-2]$') AND (b IS NULL OR b <> v)
UNION SELECT tune_id, frame FROM own JOIN usual USING (tune_id, lane) WHERE -d > greatest(8, 4 * m) UNION SELECT tune_id, 0 FROM lane)
SELECT tune_id, s.frame, min(bs.frame) OVER (PARTITION BY tune_id ORDER BY s.frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT tune_id, frame FROM state WHERE reg = 0) s LEFT JOIN bs USING (tune_id, frame)""")
add("marked_regions", lambda x: encoding.marked_regions(x.withColumn("addr", F.col("val")), ["tune_id"], "addr", F.col("reg") == 4), LOG, """, m AS (SELECT tune_id, val AS addr, max(CASE WHEN reg = 4 THEN 1 ELSE 0 END) AS hit FROM log GROUP BY 1, 2),
g AS (SELECT *, addr - row_number() OVER (PARTITION BY tune_id ORDER BY addr) AS g FROM m), h AS (SELECT *, max(hit) OVER (PARTITION BY tune_id, g) AS hits FROM g) SELECT tune_id, addr FROM h WHERE hits = 1""")
add("decode_markers", lambda x: encoding.decode_markers(x, "tune_id", "seq", "val", 96, 127, 127), LOG, """, c AS (SELECT tune_id, seq, val, coalesce(sum(CASE WHEN val = 127 THEN 1 ELSE 0 END) OVER (PARTITION BY tune_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pattern FROM log),
s AS (SELECT *, last_value(CASE WHEN val >= 128 THEN val - 127 END IGNORE NULLS) OVER w AS instrument, last_value(CASE WHEN val >= 96 AND val < 127 THEN val - 96 END IGNORE NULLS) OVER w AS length FROM c WINDOW w AS (PARTITION BY tune_id, pattern ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT tune_id, pattern, seq, val AS note, instrument, length FROM s WHERE val < 96""")


def _hours(log):
    return binned_stream(log.withColumn("ts", F.timestamp_micros("clock"))).withColumn("frame_start", F.unix_micros("frame_start"))


add("hourly_writes", _hours, LOG, "SELECT tune_id, reg, clock // 3600000000 * 3600000000 AS frame_start, arg_max(val, {'c': clock, 's': seq}) AS val FROM log GROUP BY ALL")
Q["segment_tally"] = lambda spark, sf_dir: _segments(spark, sf_dir).groupBy("every", "dur").agg(F.count("*").alias("n"), F.sum("dur").alias("frames"))
SQL["segment_tally"] = "SELECT l_quantity::BIGINT % 3 + 1 AS every, l_quantity::BIGINT % 13 + 1 AS dur, count(*) AS n, sum(l_quantity::BIGINT % 13 + 1)::BIGINT AS frames FROM lineitem GROUP BY 1, 2"
