"""Registered queries of lane and memory structure, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import compression, encoding, fits, framing, lanes, ramps, structure
from .coding_queries import NOTES, RAMPS
from .engine_queries import _BUS, _FITS, ZERO, _bus, _segments_of
from .queries import LANE, LOG, Q, SQL, STATE, _island, add, lane

_WALK = LANE + ", wk AS (SELECT tune_id, lane, frame, v, row_number() OVER (PARTITION BY tune_id, lane ORDER BY frame) - 1 AS k FROM lagged WHERE b IS NULL OR b <> v)"
add("walked", lambda x: structure.walked(lane(x)), _WALK, "SELECT * FROM wk")
_lags = ", ".join(f"CASE WHEN lag(v, {p}) OVER w <> v THEN k END AS e{p}" for p in range(4, 17))
_loops = " UNION ALL ".join(f"SELECT tune_id, lane, {p} AS p, count(*) AS n, coalesce(min(e{p}), count(*)) AS length, count(DISTINCT CASE WHEN k < {p} THEN v END) AS d FROM e GROUP BY 1, 2" for p in range(4, 17))
add("loops", lambda x: structure.loops(structure.walked(lane(x).withColumn("v", F.col("v") % 3))), _WALK.replace("wk AS (SELECT tune_id, lane, frame, v, row", "wk0 AS (SELECT tune_id, lane, frame, v % 3 AS v, lag(v % 3) OVER (PARTITION BY tune_id, lane ORDER BY frame) AS b3 FROM lane), wk AS (SELECT tune_id, lane, frame, v, row").replace("FROM lagged WHERE b IS NULL OR b <> v", "FROM wk0 WHERE b3 IS NULL OR b3 <> v"),
    f", e AS (SELECT *, {_lags} FROM wk WINDOW w AS (PARTITION BY tune_id, lane ORDER BY k)), l AS ({_loops}) SELECT tune_id, lane, p::INT AS period, length FROM l WHERE length >= 2 * p AND d >= 3 QUALIFY row_number() OVER (PARTITION BY tune_id, lane ORDER BY length DESC, p) = 1")
_ways = ", ".join(f"abs(v - lag(v, {n}) OVER w) AS d{n}" for n in (2, 3, 4))
_meds = "".join(f", m{n} AS (SELECT tune_id, lane, max(m) AS m{n} FROM (SELECT tune_id, lane, frame % {n} AS p, median(d{n}) AS m FROM ds GROUP BY 1, 2, 3) GROUP BY 1, 2)" for n in (2, 3, 4))
add("interleave_period", lambda x: structure.interleave_period(lane(x)), LANE, f", ds AS (SELECT tune_id, lane, frame, abs(v - lag(v) OVER w) AS d, {_ways} FROM lane WINDOW w AS (PARTITION BY tune_id, lane ORDER BY frame)), m1 AS (SELECT tune_id, lane, median(d) AS m FROM ds GROUP BY 1, 2){_meds}"
    " SELECT tune_id, lane, CASE WHEN m > 0 AND 4 * m2 <= m THEN 2 WHEN m > 0 AND 4 * m3 <= m THEN 3 WHEN m > 0 AND 4 * m4 <= m THEN 4 END AS ways FROM m1 JOIN m2 USING (tune_id, lane) JOIN m3 USING (tune_id, lane) JOIN m4 USING (tune_id, lane)")  # fmt: skip
add("held_seeds", lambda x: structure.held_seeds(lane(x).withColumn("acc", F.col("v") % 4), "acc"), LANE, """, c AS (SELECT *, CASE WHEN lag(v % 4) OVER (PARTITION BY tune_id, lane ORDER BY frame) <> v % 4 THEN 1 ELSE 0 END AS c FROM lane),
s AS (SELECT *, sum(c) OVER (PARTITION BY tune_id, lane ORDER BY frame)::BIGINT AS changes FROM c) SELECT tune_id, lane, frame, first_value(v) OVER (PARTITION BY tune_id, lane, changes ORDER BY frame) AS seed, changes FROM s""")


def _segments_residual(log: DataFrame) -> DataFrame:
    segments = encoding.note_segments(lane(log))
    refs = encoding.shape_refs(segments)
    shapes = segments.join(refs.select("tune_id", "voice", "start", "ref"), ["tune_id", "voice", "start"]).select("tune_id", "voice", "ref", "shape").distinct()
    return ramps.lane_residual(lane(log).filter("lane like 'freq%'"), structure.segments_back(refs, shapes))


add("segments_residual", _segments_residual, LANE, ZERO + " WHERE lane LIKE 'freq%'")
add("clamped_onsets", lambda x: structure.clamped_onsets(lanes.jumps(lane(x), "freq", False), ["tune_id", "lane"], "frame", 100, 400), LANE + ", own AS (SELECT *, v - b AS d FROM lagged WHERE lane LIKE 'freq%'), usual AS (SELECT tune_id, lane, floor(median(abs(d))) AS m FROM own WHERE d <> 0 GROUP BY 1, 2), j AS (SELECT tune_id, lane, frame FROM own JOIN usual USING (tune_id, lane) WHERE abs(d) > greatest(8, 4 * m))",
    "SELECT tune_id, lane, frame FROM j WHERE frame BETWEEN 100 AND 399 UNION SELECT tune_id, lane, 100 FROM j")
_IMG = ", img AS (SELECT tune_id, addr, arg_max(val, seq) AS byte FROM bus WHERE rw = 0 GROUP BY 1, 2)"


def _image(bus: DataFrame) -> DataFrame:
    return bus.filter("rw = 0").groupBy("tune_id", "addr").agg(F.max_by("val", "seq").alias("byte"))


def _carved(bus: DataFrame) -> DataFrame:
    spans = bus.filter("rw = 1").select("tune_id", (F.lit(4096) + F.col("val")).alias("lo"), (F.lit(4098) + F.col("val")).alias("hi")).filter("lo % 5 = 0")
    return structure.carved(bus.filter("rw = 0"), spans, ["tune_id"])


_CARVE = """, t AS (SELECT DISTINCT tune_id, 4096 + val + k.range AS addr FROM bus, range(2) k WHERE rw = 1 AND (4096 + val) % 5 = 0), a AS (SELECT DISTINCT tune_id, addr FROM bus WHERE rw = 0 EXCEPT SELECT tune_id, addr FROM t),
g AS (SELECT tune_id, addr, addr - row_number() OVER (PARTITION BY tune_id ORDER BY addr) AS g FROM a), r AS (SELECT tune_id, min(addr) AS lo, count(*) AS n FROM g GROUP BY tune_id, g)"""
_bus("carved_regions", _carved, _CARVE + " SELECT * FROM r")
_bus("longest_region", lambda b: structure.longest_region(_carved(b), ["tune_id"]), _CARVE + " SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY n DESC, lo) = 1")
_LEN = _IMG + ", ln AS (SELECT tune_id, addr, min(CASE WHEN byte IN (7, 31) THEN addr END) OVER (PARTITION BY tune_id ORDER BY addr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - addr + 1 AS length FROM img)"
_bus("lengths_to_end", lambda b: structure.lengths_to_end(_image(b), ["tune_id"], (7, 31), 16), _LEN + " SELECT * FROM ln")
_PTR = _IMG + """, o AS (SELECT tune_id, addr - 4096 AS o, byte FROM img WHERE addr BETWEEN 4096 AND 4115), e AS (SELECT tune_id, byte, 'interleaved' AS packing, o // 2 AS k, o % 2 = 0 AS low FROM o
UNION ALL SELECT tune_id, byte, 'low_first', o % 10, o < 10 FROM o UNION ALL SELECT tune_id, byte, 'high_first', o % 10, o >= 10 FROM o), ptr AS (SELECT tune_id, packing, k, sum(CASE WHEN low THEN byte ELSE 256 * byte END)::BIGINT AS pointer FROM e GROUP BY 1, 2, 3 HAVING count(*) = 2)"""
_bus("packed_pointers", lambda b: structure.packed_pointers(_image(b), ["tune_id"], 4096, 10), _PTR + " SELECT tune_id, packing, k::BIGINT AS k, pointer FROM ptr")
_bus("bank_ranking", lambda b: structure.bank_ranking(structure.packed_pointers(_image(b), ["tune_id"], 4096, 10).withColumn("pointer", F.col("pointer") % 40), structure.lengths_to_end(_image(b), ["tune_id"], (7, 31), 16), ["tune_id"], [4090, 4096, 4100]),
     _PTR + _LEN.replace(_IMG, "") + """, h AS (SELECT DISTINCT tune_id, packing, d AS delta, pointer % 40 + d AS addr FROM ptr, (VALUES (4090), (4096), (4100)) v(d)), bk AS (SELECT tune_id, packing, delta, count(*) AS patterns, sum(length)::BIGINT AS covered FROM h JOIN ln USING (tune_id, addr) WHERE length IS NOT NULL GROUP BY 1, 2, 3)
SELECT tune_id, packing, delta, patterns, covered FROM bk QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY covered DESC, patterns DESC, delta, packing DESC) = 1""")  # fmt: skip


def _group_loss(log: DataFrame) -> DataFrame:
    """Bytes that grouping and laying out again changes: none."""
    groups = structure.note_groups(log, "tune_id", "seq", "val", 96, 127)
    again = structure.groups_back(groups, "tune_id", "k", "val")
    from pyspark.sql import Window

    own = log.select("tune_id", (F.row_number().over(Window.partitionBy("tune_id").orderBy("seq")) - 1).alias("k"), "val")
    return own.exceptAll(again).unionByName(again.exceptAll(own))


add("note_groups", lambda x: structure.note_groups(x, "tune_id", "seq", "val", 96, 127).select("tune_id", "pattern", "group", F.concat_ws(" ", F.col("bytes").cast("array<string>")).alias("bytes")), LOG,
    """, p AS (SELECT *, coalesce(sum((val = 127)::INT) OVER (PARTITION BY tune_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pattern FROM log), g AS (SELECT *, coalesce(sum((val < 96)::INT) OVER (PARTITION BY tune_id, pattern ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "group" FROM p)
SELECT tune_id, pattern, "group", string_agg(val, ' ' ORDER BY seq) AS bytes FROM g GROUP BY 1, 2, 3""")  # fmt: skip
add("note_groups_loss", _group_loss, LOG, "SELECT tune_id, seq AS k, val FROM log WHERE false")


def _rotations(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = lambda c: (F.col(c).cast("long") % 6)
    rows = x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seg_id"), F.array(m("l_suppkey"), m("l_quantity"), m("l_partkey")).alias("t"))
    out = structure.merged_rotations(rows, "seg_id", "t")
    return out.select("seg_id", F.concat_ws(",", F.col("t").cast("array<string>")).alias("t"), "merged")


Q["merged_rotations"] = _rotations
SQL["merged_rotations"] = """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS seg_id, l_suppkey % 6 AS a, l_quantity::BIGINT % 6 AS b, l_partkey % 6 AS c FROM lineitem), r AS (SELECT seg_id, [a, b, c] AS t, least([a, b, c], [b, c, a], [c, a, b]) AS l FROM s),
n AS (SELECT l, count(DISTINCT t) AS n FROM r GROUP BY 1) SELECT seg_id, array_to_string(CASE WHEN n > 1 THEN l ELSE t END, ',') AS t, n > 1 AS merged FROM r JOIN n USING (l)"""
_RUN = LANE + _island + ", rn AS (SELECT tune_id, lane, min(frame) AS start, count(*) AS length, min(v) AS v FROM isl GROUP BY tune_id, lane, g)"
add("literal_runs", lambda x: structure.literal_runs(lanes.runs(lane(x)), 2, 0.6), _RUN, """, o AS (SELECT *, length = 1 AS one, coalesce(lag(length = 1) OVER (PARTITION BY tune_id, lane ORDER BY start), false) AS before FROM rn), g AS (SELECT *, sum((one AND NOT before)::INT) OVER (PARTITION BY tune_id, lane ORDER BY start) AS g FROM o)
SELECT tune_id, lane, min(start) AS start, count(*) AS frames, count(DISTINCT v) AS "distinct" FROM g WHERE one GROUP BY tune_id, lane, g HAVING count(*) >= 2 AND count(DISTINCT v) >= 0.6 * count(*)""")


def _fits(log: DataFrame) -> DataFrame:
    return fits.best_fits(_segments_of(log), ["tune_id", "voice", "start"])


_KEYS = ["tune_id", "voice", "start"]
add("with_literals", lambda x: structure.with_literals(_fits(x).select(*_KEYS, "kind"), _segments_of(x), _KEYS).select(*_KEYS, "kind", F.concat_ws(" ", F.col("literal").cast("array<string>")).alias("literal")), _FITS,
    "SELECT tune_id, voice, start, coalesce(kind, 'literal') AS kind, CASE WHEN kind IS NULL THEN array_to_string(vs, ' ') ELSE '' END AS literal FROM segs JOIN fit USING (tune_id, voice, start)")
add("unfit_frames", lambda x: structure.unfit_frames(_fits(x)), _FITS, "SELECT tune_id, voice, sum(CASE WHEN kind IS NULL THEN n ELSE 0 END)::BIGINT AS unfit, sum(n)::BIGINT AS frames FROM fit GROUP BY 1, 2")
add("held_pitches", lambda x: structure.held_pitches(lanes.runs(lane(x))), _RUN, """, h AS (SELECT DISTINCT tune_id, v FROM rn WHERE lane LIKE 'freq%' AND length > 1 AND v > 0)
SELECT tune_id, row_number() OVER (PARTITION BY tune_id ORDER BY v) - 1 AS k, v FROM h QUALIFY count(*) OVER (PARTITION BY tune_id) >= 2""")
_bus("strides", lambda b: structure.strides(b.filter("rw = 0").withColumn("addr", F.col("addr") * 6), ["tune_id", "val"]), """, a AS (SELECT DISTINCT tune_id, val, addr * 6 AS addr FROM bus WHERE rw = 0), d AS (SELECT *, addr - lag(addr) OVER (PARTITION BY tune_id, val ORDER BY addr) AS d FROM a)
SELECT tune_id, val, min(addr) AS "first", coalesce(list_reduce(list(d) FILTER (d IS NOT NULL), lambda x, y: gcd(x, y)), 0)::BIGINT AS stride, count(*) AS n FROM d GROUP BY 1, 2""")
add("durations", lambda x: structure.durations(lanes.note_boundaries(lane(x)), framing.framed_state(x).groupBy("tune_id").agg((F.max("frame") + 1).alias("end"))), LANE, """, m AS (SELECT DISTINCT tune_id, frame FROM lagged WHERE regexp_matches(lane, '^(ctrl|ad|sr)[0-2]$') AND (b IS NULL OR b <> v)), l AS (SELECT tune_id, max(frame) + 1 AS e FROM lane GROUP BY 1)
SELECT tune_id, frame, coalesce(lead(frame) OVER (PARTITION BY tune_id ORDER BY frame), e) - frame AS duration FROM m JOIN l USING (tune_id)""")
add("index_walk", lambda x: structure.index_walk(lane(x).withColumn("acc", F.col("frame") * 3)), LANE, "SELECT tune_id, lane, frame, ((v - frame * 3) % 65536 + 65536) % 65536 AS seed, dense_rank() OVER (PARTITION BY tune_id, lane ORDER BY ((v - frame * 3) % 65536 + 65536) % 65536) - 1 AS idx FROM lane")


def _cells(log: DataFrame) -> DataFrame:
    state = framing.framed_state(log).filter("reg in (0, 7, 14, 22)")
    return state.select("tune_id", F.col("reg").alias("cell"), "frame", F.col("val").alias("acc"))


add("flattest", lambda x: structure.flattest(lane(x).filter("lane like 'freq%'"), _cells(x)), LANE, """, c AS (SELECT l.tune_id, lane, reg AS cell, l.frame, ((v - val) % 65536 + 65536) % 65536 AS s FROM lane l JOIN state s ON l.tune_id = s.tune_id AND l.frame = s.frame AND reg IN (0, 7, 14, 22) AND lane LIKE 'freq%'),
n AS (SELECT *, lag(s) OVER (PARTITION BY tune_id, lane, cell ORDER BY frame) <> s AS ch FROM c), t AS (SELECT tune_id, lane, cell, count(*) FILTER (ch) AS changes FROM n GROUP BY 1, 2, 3) SELECT tune_id, lane, cell, changes FROM t QUALIFY row_number() OVER (PARTITION BY tune_id, lane ORDER BY changes, cell) = 1""")
_FORMS = LANE + RAMPS + """, forms AS (SELECT tune_id, lane, 'changes' AS form, 2 * count(*) AS tokens FROM lagged WHERE b IS NULL OR b <> v GROUP BY 1, 2 UNION ALL SELECT tune_id, lane, 'dictionary', count(DISTINCT v) + count(*) FROM lane GROUP BY 1, 2
UNION ALL SELECT tune_id, lane, 'ramps', 3 * (count(*) FILTER (NOT gone) + count(*) FILTER (gone AND fin)) FROM u GROUP BY 1, 2)"""


def _forms(log: DataFrame) -> DataFrame:
    own = lane(log)
    return structure.lane_forms(structure.walked(own), ramps.ramp_segments(own), own)


add("lane_forms", _forms, _FORMS, "SELECT tune_id, lane, form, tokens::BIGINT AS tokens FROM forms")
add("cheapest_form", lambda x: structure.cheapest(_forms(x), ["tune_id", "lane"]), _FORMS, "SELECT tune_id, lane, form, tokens::BIGINT AS tokens FROM forms QUALIFY row_number() OVER (PARTITION BY tune_id, lane ORDER BY tokens, form) = 1")
add("amortised", lambda x: structure.amortised(lanes.runs(lane(x)), "v", scalars.leb16_length(F.col("v")) + 1), _RUN, "SELECT v, count(*) AS uses, (length(to_hex(v)) + 1) / count(*)::DOUBLE AS share FROM rn GROUP BY 1")
Q["stream_gates"] = lambda spark, sf_dir: structure.gates(compression.compress(lane(_log(spark, sf_dir))))


def _log(spark, sf_dir):
    from ..sources.events import register_log

    return register_log(spark, sf_dir)


__all__ = ["Q", "SQL", "STATE", "_BUS", "NOTES"]
