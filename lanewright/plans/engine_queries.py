"""Registered queries of compression, generators, fits, framing policies, bus traces and relational operators, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import scalars
from ..operators import compression, cover, encoding, fits, framing, generators, lanes, machine, ramps, relations
from .coding_queries import NOTES
from .queries import BIN, BURST, KINDS, LANE, LOG, Q, SQL, STATE, add, lane  # noqa: F401

ZERO = "SELECT DISTINCT tune_id, lane, CAST(0 AS BIGINT) AS residual FROM lane"

# Compression and lane programs: what is encoded and decoded again differs nowhere.


def _ops(log: DataFrame) -> DataFrame:
    return compression.compress(lane(log))


add("compressed_residual", lambda x: ramps.lane_residual(lane(x), compression.decompress(_ops(x))), LANE, ZERO)
add("token_stream_residual", lambda x: ramps.lane_residual(lane(x), compression.decompress(compression.read_tokens(compression.token_stream(_ops(x))))), LANE, ZERO)
add("program_residual", lambda x: ramps.lane_residual(lane(x), compression.run_programs(compression.lane_programs(lane(x)))), LANE, ZERO)
add("cover_residual", lambda x: ramps.lane_residual(lane(x), compression.run_programs(cover.cover_lanes(lane(x)))), LANE, ZERO)
add("program_coverage", lambda x: compression.lane_programs(lane(x)).groupBy("tune_id", "lane").agg(F.sum("length").alias("frames")), LANE, "SELECT tune_id, lane, count(*) AS frames FROM lane GROUP BY 1, 2")
Q["compressed_sizes"] = lambda spark, sf_dir: compression.sizes(compression.compress(lane(_log(spark, sf_dir))))
Q["lane_signatures"] = lambda spark, sf_dir: compression.signatures(compression.lane_programs(lane(_log(spark, sf_dir))))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.events import register_log

    return register_log(spark, sf_dir)


# Generators.


def _generators(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """Segments with all parameters from all order lines. deal: order lines are dealt to many tasks first, as they take fewest bytes."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = machine.dealt(x, ["l_orderkey", "l_linenumber"]) if deal else x
    q, part, supp, line = F.col("l_quantity").cast("long"), F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long")
    one = F.lit(1).cast("long")
    return x.select(
        (F.col("l_orderkey") * 8 + line).alias("seg_id"), (q % 13).alias("dur"), (part % 40 + 100).alias("v0"), (q % 5 + 1).alias("rate"), (line % 3 + 1).alias("dwell"), (q % 7).alias("ctr0"), (line % 4).alias("lead"),
        F.lit(100).cast("long").alias("lo"), F.lit(150).cast("long").alias("hi"), (line % 3).alias("frac"), (q % 6 + 3).alias("top"), (part % 2).alias("parity"),
        F.array(supp, q, F.lit(7).cast("long")).alias("table"), F.array(one, part % 2, F.lit(0).cast("long"), one).alias("mask"))


Q["generator_forms"] = lambda spark, sf_dir: generators.digest(_generators(spark, sf_dir))
_S = lambda n: f"(({n}) // 3 * (t1 + t2 + t3) + CASE ({n}) % 3 WHEN 0 THEN 0 WHEN 1 THEN t1 ELSE t1 + t2 END)"
_M = lambda n: f"(({n}) // 4 * (2 + m2) + CASE ({n}) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 1 + m2 END)"
_T = lambda k: f"(CASE ({k}) % 3 WHEN 0 THEN t1 WHEN 1 THEN t2 ELSE t3 END)"
_tri = lambda x, r: f"least(({x}) % (2 * ({r})), 2 * ({r}) - ({x}) % (2 * ({r})))"
_H = lambda n: f"(dwell * {_S(f'({n}) // dwell')} + (({n}) % dwell) * {_T(f'({n}) // dwell')})"
_PH = "(CASE WHEN ((ctr0 + i) & 7) >= 4 THEN xor((ctr0 + i) & 7, 7) ELSE (ctr0 + i) & 7 END)"
_AFTER, _VIB = "greatest(0, i - lead)", f"((v0 + {_PH} * rate) & 65535)"
_ARP = f"({_T('(ctr0 + i) // dwell')} & 65535)"
_FIRST = "((parity + ctr0) % 2)"
_fall = lambda b: f"CASE WHEN i >= {_FIRST} AND (i - {_FIRST}) % 2 = 0 AND top - (i - {_FIRST} + 1) // 2 > 0 THEN ({b} & 255) + 256 * (top - (i - {_FIRST} + 1) // 2) ELSE {b} & 65535 END"
_REACH = "(2 + parity + 2 * ctr0)"
_BELOW = f"(({_REACH} - 1) // 2 + 1)"
_DOWN, _UP = "((v0 - lo) // rate)", "((hi - v0) // rate)"
_GEN = {
    "wrapaccum": "lo + (v0 - lo + i * rate) % (hi - lo)", "dwell": f"(v0 + rate * ({_AFTER} // dwell)) & 65535", "maskaccum": f"(v0 + rate * {_M('i')}) & 65535", "ratewalk": f"(v0 + {_S('ctr0 + i')} - {_S('ctr0')}) & 65535",
    "dwellratewalk": f"(v0 + {_H('ctr0 + i')} - {_H('ctr0')}) & 65535", "tablewalk": f"{_T('ctr0 + i')} & 65535", "tablewalk_lead": f"CASE WHEN i < lead THEN v0 ELSE {_T('ctr0 + i - lead')} END & 65535", "arp": _ARP,
    "wavetable_ptr": f"{_T(f'ctr0 + {_M(chr(105))}')} & 65535", "glide": f"CASE (ctr0 + rate * ({_AFTER} // dwell)) & 255 WHEN 0 THEN t1 WHEN 1 THEN t2 WHEN 2 THEN t3 ELSE 0 END", "vibrato": _VIB,
    "decay": "(v0 - rate * ((ctr0 % dwell + i) // dwell)) & 65535", "pingpong": f"v0 + rate * ({_tri(f'{_DOWN} + (i + dwell) // (dwell + 1)', f'{_DOWN} + {_UP}')} - {_DOWN})",
    "pingfold": f"({_tri('(v0 - lo) * (1 << frac) + i * rate', '(hi - lo) * (1 << frac)')} + lo * (1 << frac)) // (1 << frac)",
    "vibreflect": f"(v0 + rate * ({_tri(f'{_BELOW} + greatest(0, i + 1 - greatest(lead - 1, 0))', _REACH)} - {_BELOW})) & 65535", "vibskydive": _fall(_VIB), "arp_decay": _fall(_ARP),
    "additive_pw": f"(v0 // 256 * 256 + (v0 + i * rate + {_M('i')}) % 256) & 4095", "vibrato_carry": f"CASE WHEN {_PH} = 0 THEN 1 ELSE (((v0 + ({_PH} - 1) * rate) & 65535) + (rate & 65535)) // 65536 END",
}
SQL["generator_forms"] = """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS seg_id, l_quantity::BIGINT % 13 AS dur, l_partkey % 40 + 100 AS v0, l_quantity::BIGINT % 5 + 1 AS rate, l_linenumber::BIGINT % 3 + 1 AS dwell, l_quantity::BIGINT % 7 AS ctr0,
l_linenumber::BIGINT % 4 AS lead, 100::BIGINT AS lo, 150::BIGINT AS hi, l_linenumber::BIGINT % 3 AS frac, l_quantity::BIGINT % 6 + 3 AS top, l_partkey % 2 AS parity, l_suppkey AS t1, l_quantity::BIGINT AS t2, 7::BIGINT AS t3, l_partkey % 2 AS m2 FROM lineitem),
r AS (SELECT *, unnest(range(0, dur)) AS i FROM s) SELECT seg_id, """ + ", ".join(f"sum((i + 1) * ({e}))::BIGINT AS {k}" for k, e in _GEN.items()) + " FROM r GROUP BY 1"


# Fits.


def _segments_of(log: DataFrame) -> DataFrame:
    return encoding.note_segments(lane(log)).select("tune_id", "voice", "start", F.transform("shape", lambda x: x + F.col("base")).alias("v"))


_cand = ", ".join(f"({k}, '{kind}', {d}, {p})" for k, (kind, d, p) in enumerate((kind, d, p) for kind, grid in fits.GRIDS.items() for d, p in grid))
_FITS = LANE + NOTES + f""", cand AS (SELECT *, CASE WHEN least((p + 1) % 8, 7 - (p + 1) % 8) <> least(p % 8, 7 - p % 8) THEN 1 ELSE 2 END AS tn FROM (VALUES {_cand}) c(rank, kind, d, p)),
m AS (SELECT tune_id, voice, start, vs AS v, len(vs) AS n, rank, kind, d, p, coalesce(list_min([i FOR i IN range(0, len(vs)) IF vs[(i + 1)::INT] IS DISTINCT FROM CASE WHEN kind IN ('arp', 'tablewalk') THEN vs[((i // d) % p * d + 1)::INT]
WHEN kind = 'dwell' THEN (vs[1] + (vs[(d + 1)::INT] - vs[1]) * (i // d)) & 65535 WHEN kind = 'ratewalk' THEN (vs[(i % p + 1)::INT] + (vs[(p + 1)::INT] - vs[1]) * (i // p)) & 65535 WHEN kind = 'decay' THEN (vs[1] - (vs[1] - vs[(d - p + 1)::INT]) * ((p + i) // d)) & 65535
WHEN kind = 'vibrato' THEN (vs[1] + (least((p + i) % 8, 7 - (p + i) % 8) - least(p, 7 - p)) * (vs[(tn + 1)::INT] - vs[1]) * (least((p + tn) % 8, 7 - (p + tn) % 8) - least(p, 7 - p))) & 65535 WHEN i < d THEN vs[1] ELSE vs[(d + (i - d) % p + 1)::INT] END]), len(vs)) AS length FROM segs, cand),
ok AS (SELECT * FROM m WHERE CASE kind WHEN 'arp' THEN length >= p * d AND len(list_distinct([vv FOR vv IN [v[(k * d + 1)::INT] FOR k IN range(0, p)]])) + CASE WHEN list_contains([v[(k * d + 1)::INT] IS NULL FOR k IN range(0, p)], true) THEN 1 ELSE 0 END >= 2
WHEN 'tablewalk' THEN length >= 2 * p AND len(list_distinct([v[(k * d + 1)::INT] FOR k IN range(0, p)])) >= 2 WHEN 'dwell' THEN length >= 2 * d + 1 AND v[(d + 1)::INT] <> v[1] WHEN 'ratewalk' THEN length >= greatest(8, 2 * p) AND n > p WHEN 'decay' THEN length >= 2 * d + 1 AND v[1] > v[(d - p + 1)::INT]
WHEN 'vibrato' THEN length >= 9 AND v[1] <> v[3] ELSE length >= d + 2 * p AND len(list_distinct(v[(d + 1)::INT:(d + p)::INT])) >= 2 END),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY tune_id, voice, start ORDER BY length DESC, rank) = 1),
fit AS (SELECT tune_id, voice, start, len(vs)::INT AS n, kind, d::INT AS dwell, p::INT AS period, length::INT AS length FROM segs LEFT JOIN best USING (tune_id, voice, start))"""
add("best_fits", lambda x: fits.best_fits(_segments_of(x), ["tune_id", "voice", "start"]), _FITS, "SELECT * FROM fit")
add("fit_tally", lambda x: fits.tally(fits.best_fits(_segments_of(x), ["tune_id", "voice", "start"])), _FITS,
    "SELECT CASE WHEN grouping(k) = 1 THEN 'all' ELSE k END AS kind, count(*) AS n, sum(coalesce(length, 0))::BIGINT AS frames, sum(n)::BIGINT AS all_frames FROM (SELECT coalesce(kind, 'none') AS k, length, n FROM fit) GROUP BY ROLLUP (k)")
add("falling_segments", lambda x: _segments_of(x).select("tune_id", "voice", "start", scalars.falls_by_one(F.col("v")).alias("falls")), LANE + NOTES,
    ", h AS (SELECT tune_id, voice, start, [(x >> 8) & 255 FOR x IN vs[1:8]] AS h FROM segs) SELECT tune_id, voice, start, len([1 FOR i IN range(2, len(h)) IF h[(i - 1)::INT] - h[(i + 1)::INT] = 1]) >= 3 AS falls FROM h")

# Framing policies.
_POL = f"""{LOG}, g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY tune_id ORDER BY clock, seq) AS d FROM log),
st AS (SELECT tune_id, sum(CASE WHEN d IS NULL OR d > 1800000000 THEN 1 ELSE 0 END)::BIGINT AS bursts, (round_even((max(clock) - min(clock)) / 3600000000.0, 0) + 1)::BIGINT AS span FROM g GROUP BY 1),
pol AS (SELECT *, CASE WHEN span < 2 THEN 'static' WHEN bursts < 2 OR bursts < 0.9 * span THEN 'cadence' ELSE 'gap' END AS policy FROM st)"""
add("framing_policies", framing.policies, _POL, "SELECT * FROM pol")
add("burst_frames", framing.burst_frames, LOG, """, g AS (SELECT *, clock - lag(clock) OVER (PARTITION BY tune_id ORDER BY clock, seq) AS d FROM log), b AS (SELECT *, sum(CASE WHEN d > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY tune_id ORDER BY clock, seq)::INT AS frame FROM g)
SELECT tune_id, frame, reg, arg_max(val, {'c': clock, 's': seq}) AS val FROM b GROUP BY 1, 2, 3""")


def _starts(log: DataFrame) -> DataFrame:
    return framing.first_play(log).select("tune_id", (F.col("first") + 10 * framing.FRAME).alias("t0"))


_ROLL = BURST + """, nexts AS (SELECT tune_id, start, abs(lead(start) OVER w - start - 3600000000) < 1800000000 AND abs(lead(start, 2) OVER w - lead(start) OVER w - 3600000000) < 1800000000
AND abs(lead(start, 3) OVER w - lead(start, 2) OVER w - 3600000000) < 1800000000 AS near FROM bursts WINDOW w AS (PARTITION BY tune_id ORDER BY ord)), t0 AS (SELECT tune_id, coalesce(min(start) FILTER (near), min(start)) + 36000000000 AS t0 FROM nexts GROUP BY 1),
f AS (SELECT tune_id, round_even((clock - t0) / 3600000000.0, 0)::INT AS frame, reg, val, clock, seq FROM log JOIN t0 USING (tune_id)) """
add("preroll_carried", lambda x: framing.binned(x, starts=_starts(x)), _ROLL, "SELECT tune_id, greatest(frame, 0) AS frame, reg, arg_max(val, {'c': clock, 's': seq}) AS val FROM f GROUP BY ALL")
add("preroll_dropped", lambda x: framing.binned(x, starts=_starts(x), preroll="drop"), _ROLL, "SELECT tune_id, frame, reg, arg_max(val, {'c': clock, 's': seq}) AS val FROM f WHERE frame >= 0 GROUP BY ALL")
add("held_state", lambda x: framing.held_state(x, x.groupBy("tune_id").agg((F.min("clock") + 20 * framing.FRAME).alias("end"))), LOG, """, l AS (SELECT tune_id, reg, arg_max(val, {'c': clock, 's': seq}) AS val FROM log GROUP BY 1, 2)
SELECT t.tune_id, f.range::INT AS frame, r.range::INT AS reg, coalesce(l.val, 0) AS val FROM (SELECT DISTINCT tune_id FROM log) t, range(21) f, range(25) r LEFT JOIN l ON l.tune_id = t.tune_id AND l.reg = r.range""")


def _aligned(log: DataFrame) -> DataFrame:
    h = framing.state_digests(framing.framed_state(log))
    boot = h.filter("frame in (40, 41)").withColumn("frame", F.col("frame") - 40)
    return relations.aligned(h, boot, ["tune_id"])


add("aligned_offset", _aligned, STATE, """, h AS (SELECT tune_id, frame, sum((val + 1) * (reg + 1) * (reg + 3))::BIGINT AS h FROM state GROUP BY 1, 2), n AS (SELECT *, lead(h) OVER (PARTITION BY tune_id ORDER BY frame) AS nx FROM h WHERE frame <= 257),
b AS (SELECT tune_id, max(h) FILTER (frame = 40) AS h0, max(h) FILTER (frame = 41) AS h1 FROM h GROUP BY 1) SELECT tune_id, min(frame) FILTER (h = h0 AND nx = h1 AND frame <= 256) AS "offset" FROM n JOIN b USING (tune_id) GROUP BY 1""")

# Bus traces: reads and writes made from events.


def bus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tune_id, seq, cyc, addr, val, rw: every fifth event is a write to a register, all others read memory."""
    e = _log(spark, sf_dir)
    write = F.col("seq") % 5 == 0
    return e.select("tune_id", "seq", F.col("clock").alias("cyc"), F.when(write, 0xD400 + F.floor(F.col("seq") / 5) % 29).otherwise(F.col("seq") * 37 % 40 + 4096).alias("addr"), F.col("val").bitwiseAND(31).alias("val"), write.cast("int").alias("rw"))


_BUS = LOG + ", bus AS (SELECT tune_id, seq, clock AS cyc, CASE WHEN seq % 5 = 0 THEN 54272 + seq // 5 % 29 ELSE seq * 37 % 40 + 4096 END AS addr, val & 31 AS val, CASE WHEN seq % 5 = 0 THEN 1 ELSE 0 END AS rw FROM log)"


def _bus(name: str, build, select: str) -> None:
    Q[name] = lambda spark, sf_dir: build(bus_log(spark, sf_dir))
    SQL[name] = f"WITH {_BUS} {select}"


def _register_writes(bus: DataFrame) -> DataFrame:
    from ..sources.dumps import register_writes

    return register_writes(bus)


_bus("register_writes", _register_writes, "SELECT tune_id, seq, cyc, (addr - 54272)::INT AS reg, CASE WHEN addr - 54272 IN (3, 10, 17) THEN val & 15 ELSE val END AS val FROM bus WHERE addr BETWEEN 54272 AND 54296 AND rw = 1")


def _sources(bus: DataFrame) -> DataFrame:
    low = bus.filter((F.col("rw") == 1) & F.col("addr").isin(0xD400, 0xD407, 0xD40E))
    return relations.nearest_reads(low, bus.filter("rw = 0"), ["tune_id"], 192)


_NEAR = """, near AS (SELECT w.tune_id, w.seq, arg_max(r.addr, r.seq) AS addr FROM bus w JOIN bus r ON w.tune_id = r.tune_id AND w.val = r.val AND r.seq >= w.seq - 192 AND r.seq < w.seq AND w.rw = 1 AND r.rw = 0 AND w.addr IN (54272, 54279, 54286) GROUP BY 1, 2)"""
_bus("nearest_reads", _sources, _NEAR + " SELECT * FROM near")
_bus("table_start", lambda b: relations.table_start(_sources(b), ["tune_id"], 3), _NEAR + """, h AS (SELECT tune_id, addr, count(*) AS hits FROM near GROUP BY 1, 2)
SELECT tune_id, addr, hits FROM h QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY hits >= 3 DESC, CASE WHEN hits >= 3 THEN addr END, hits DESC, addr) = 1""")


def _words(bus: DataFrame) -> DataFrame:
    image = bus.filter("rw = 0").groupBy("tune_id", "addr").agg(F.max_by("val", "seq").alias("byte"))
    return relations.words_at(image, bus.select("tune_id", F.lit(4100).alias("start")).distinct(), ["tune_id"], 12)


_bus("words_of_table", _words, ", i AS (SELECT tune_id, addr, arg_max(val, seq) AS byte FROM bus WHERE rw = 0 GROUP BY 1, 2) SELECT tune_id, ((addr - 4100) // 2)::BIGINT AS k, sum(byte * CASE WHEN (addr - 4100) % 2 = 0 THEN 1 ELSE 256 END)::BIGINT AS word FROM i WHERE addr BETWEEN 4100 AND 4123 GROUP BY 1, 2")


def _masks(bus: DataFrame) -> DataFrame:
    acc = bus.groupBy("tune_id", "addr").agg(F.bit_or(F.when(F.col("rw") == 1, 2).when(F.col("val") % 3 == 0, 1).otherwise(4)).alias("acc"))
    found = relations.access_masks(F.col("acc"), F.col("addr"), 4096, 5000)
    return acc.select("tune_id", "addr", *(c.alias(n) for n, c in found.items()))


_bus("access_masks", _masks, """, a AS (SELECT tune_id, addr, bit_or(CASE WHEN rw = 1 THEN 2 WHEN val % 3 = 0 THEN 1 ELSE 4 END) AS acc FROM bus GROUP BY 1, 2)
SELECT tune_id, addr, (acc & 1) <> 0 AS code, (acc & 3) = 3 AS changed, (acc & 1) = 0 AND addr BETWEEN 4096 AND 5000 AND addr < 53248 AS eligible, (acc & 4) <> 0 AS read FROM a""")


def _factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tables = x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seg_id"), F.posexplode(F.array(F.col("l_suppkey") % 60, F.col("l_partkey") % 60)).alias("k", "v")).distinct()
    notes = spark.range(96).select(F.col("id").alias("idx"), (F.col("id") * 7 % 50).alias("v"))
    one = tables.groupBy("seg_id", "k").agg(F.min("v").alias("v"))
    return relations.pitch_factored(one, notes, "seg_id").select("seg_id", F.concat_ws(",", F.col("refs").cast("array<string>")).alias("refs"))


Q["pitch_factored"] = _factored
SQL["pitch_factored"] = """WITH n AS (SELECT range * 7 % 50 AS v, min(range) AS idx FROM range(96) GROUP BY 1), t AS (SELECT l_orderkey * 8 + l_linenumber AS seg_id, min(l_suppkey % 60) AS a, min(l_partkey % 60) AS b FROM lineitem GROUP BY 1)
SELECT seg_id, x.idx || ',' || y.idx AS refs FROM t JOIN n x ON x.v = a JOIN n y ON y.v = b"""

# Scalars.
add("codes_read_back", lambda x: x.select("seq", scalars.unleb16(scalars.leb16(F.col("clock"))).alias("clock"), scalars.unzigzag(scalars.zigzag(F.col("val") - 128)).alias("centred")), LOG, "SELECT seq, clock, val - 128 AS centred FROM log")
add("pitches", lambda x: lane(x).filter("lane like 'freq%'").select("v").distinct().select("v", F.round(scalars.pitch_hz(F.col("v")), 6).alias("hz"), scalars.grid_pitch(scalars.pitch_grid(F.col("v"))).alias("nearest"), scalars.note_atom(F.col("v")).alias("atom")), LANE,
    """, g AS (SELECT DISTINCT v, CASE WHEN v > 0 THEN round_even(12 * log2(v / (440.0 * 16777216 / 985248)), 0) END AS grid FROM lane WHERE lane LIKE 'freq%'), p AS (SELECT *, round_even(440.0 * 16777216 / 985248 * pow(2.0, grid / 12.0), 0)::BIGINT AS nearest FROM g)
SELECT v, round(v * (985248 / 16777216.0::DOUBLE), 6)::DOUBLE AS hz, nearest, CASE WHEN v = 0 THEN 17 WHEN nearest = v AND grid BETWEEN -80 AND 79 THEN grid + 144 END::BIGINT AS atom FROM p""")  # fmt: skip
add("atoms", lambda x: x.select("seq", F.concat_ws(" ", scalars.word_atoms(F.col("clock") % 65536).cast("array<string>")).alias("word"), scalars.byte_share(F.concat(scalars.word_atoms(F.col("clock") % 65536), F.array(F.col("val")))).alias("share"), scalars.feeds(F.col("val"), F.col("reg") % 8).alias("feeds")), LOG,
    "SELECT seq, (320 + clock % 256) || ' ' || (320 + clock // 256 % 256) AS word, 2 / 3::DOUBLE AS share, (val >> (reg % 8)) & 1 = 1 AS feeds FROM log")

# Relational operators.
add("as_of_join", lambda x: relations.as_of(x.filter("reg = 0").select("tune_id", "seq", "clock", "val"), x.filter("reg = 7").select("tune_id", "clock", F.col("val").alias("other"), F.col("seq").alias("other_seq")), ["tune_id"], "clock", ["other", "other_seq"]), LOG,
    "SELECT l.tune_id, l.seq, l.clock, l.val, r.val AS other, r.seq AS other_seq FROM (SELECT * FROM log WHERE reg = 0) l ASOF LEFT JOIN (SELECT * FROM log WHERE reg = 7) r ON l.tune_id = r.tune_id AND l.clock >= r.clock")


def _within(log: DataFrame) -> DataFrame:
    starts = framing.burst_starts(log)
    spans = starts.select("tune_id", "ord", "start", (F.col("start") + framing.GAP).alias("end"))
    return relations.within(log.select("tune_id", "clock", "val"), spans, ["tune_id"], "clock", "start", "end", framing.FRAME).groupBy("tune_id", "ord").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


add("range_join", _within, BURST, "SELECT b.tune_id, b.ord, count(*) AS n, sum(val)::BIGINT AS total FROM bursts b JOIN log l ON l.tune_id = b.tune_id AND l.clock >= b.start AND l.clock < b.start + 1800000000 GROUP BY 1, 2")


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_c, _o, _l, _e = (_table(n) for n in ("customer", "orders", "lineitem", "events"))
Q["semi_join"] = lambda s, d: _c(s, d).join(_o(s, d).filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
SQL["semi_join"] = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"
Q["anti_join"] = lambda s, d: _c(s, d).join(_o(s, d).filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
SQL["anti_join"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def _levels() -> list:
    return [F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity")]


Q["rollup"] = lambda s, d: _l(s, d).rollup("l_returnflag", "l_linestatus").agg(*_levels())
Q["cube"] = lambda s, d: _l(s, d).cube("l_returnflag", "l_linestatus").agg(*_levels())
for _name, _by in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
    SQL[_name] = f"SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY {_by}"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _l(spark, sf_dir).createOrReplaceTempView("_order_lines")
    return spark.sql("SELECT l_returnflag, l_linestatus, CAST(grouping_id() AS BIGINT) AS level, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM _order_lines GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


Q["grouping_sets"] = _sets
for _name, _how in (("intersect", "intersect"), ("except", "subtract")):
    Q[_name] = lambda s, d, how=_how: getattr(_l(s, d).filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey"), how)(_l(s, d).filter("l_returnflag = 'N'").select("l_partkey", "l_suppkey"))
    SQL[_name] = f"SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' {_name.upper()} SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'"
Q["top_k"] = lambda s, d: _o(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_custkey")
SQL["top_k"] = "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"
Q["json_fields"] = lambda s, d: _e(s, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"))).alias("j"))
SQL["json_fields"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS j FROM events"
Q["map_split"] = lambda s, d: _e(s, d).withColumn("m", F.create_map(F.lit("id"), F.col("event_id"), F.lit("user"), F.col("user_id"))).select("event_id", F.map_filter("m", lambda k, v: k == "user")["user"].alias("user"), F.size(F.map_filter("m", lambda k, v: v > 100)).alias("large"))
SQL["map_split"] = "SELECT event_id, user_id AS \"user\", ((event_id > 100)::INT + (user_id > 100)::INT)::INT AS large FROM events"


@F.pandas_udf(LongType())
def _folded(v: pd.Series) -> pd.Series:
    return (v * 2654435761 % 65521).astype("int64")


@F.pandas_udf(LongType())
def _span(v: pd.Series) -> int:
    return int(v.max() - v.min())


@F.udtf(returnType=StructType([StructField("part", IntegerType()), StructField("digit", IntegerType())]))
class Digits:
    """The decimal digits of a number, one row each."""

    def eval(self, n: int):
        for k, c in enumerate(str(n)):
            yield k, int(c)


def _digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("lanewright_digits", Digits)
    _o(spark, sf_dir).select("o_orderkey").createOrReplaceTempView("_order_keys")
    return spark.sql("SELECT o_orderkey, part, digit FROM _order_keys, LATERAL lanewright_digits(o_orderkey)")


Q["vector_udf"] = lambda s, d: _o(s, d).select("o_orderkey", _folded("o_custkey").alias("folded"))
SQL["vector_udf"] = "SELECT o_orderkey, o_custkey * 2654435761 % 65521 AS folded FROM orders"
Q["vector_udaf"] = lambda s, d: _l(s, d).groupBy("l_suppkey").agg(_span(F.col("l_partkey")).alias("span"))
SQL["vector_udaf"] = "SELECT l_suppkey, max(l_partkey) - min(l_partkey) AS span FROM lineitem GROUP BY 1"
Q["table_function"] = _digits
SQL["table_function"] = "SELECT o_orderkey, k::INT AS part, substr(o_orderkey::VARCHAR, k::INT + 1, 1)::INT AS digit FROM (SELECT o_orderkey, unnest(range(0, length(o_orderkey::VARCHAR))) AS k FROM orders)"
Q["dates"] = lambda s, d: _o(s, d).groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.dayofweek("o_orderdate").alias("weekday")).agg(F.count("*").alias("n"), F.max(F.datediff(F.last_day("o_orderdate"), "o_orderdate")).alias("left"))
SQL["dates"] = "SELECT date_trunc('month', o_orderdate)::DATE AS \"month\", (dayofweek(o_orderdate) + 1)::INT AS weekday, count(*) AS n, max(date_diff('day', o_orderdate::DATE, last_day(o_orderdate)))::INT AS \"left\" FROM orders GROUP BY 1, 2"
Q["sliding_sum"] = lambda s, d: _e(s, d).select("event_id", F.sum("user_id").over(Window.partitionBy("event_type").orderBy("event_id").rowsBetween(-6, 0)).alias("total"))
SQL["sliding_sum"] = "SELECT event_id, sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM events"
