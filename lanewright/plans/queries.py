"""Registered queries of the register-log operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import framing, lanes, render
from ..sources.events import register_log

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG = """log AS (SELECT user_id % 8 AS tune_id, event_id AS seq, epoch_us(ts) AS clock, CAST(event_id % 25 AS INT) AS reg, CAST(floor(value * 100) AS BIGINT) & 255 AS val FROM events)"""
BIN = f"""{LOG}, t0 AS (SELECT tune_id, min(clock) AS t0 FROM log GROUP BY 1),
binned AS (SELECT tune_id, CAST(round_even((clock - t0) / 3600000000.0, 0) AS INT) AS frame, reg, arg_max(val, seq) AS val FROM log JOIN t0 USING (tune_id) GROUP BY ALL)"""
STATE = f"""{BIN}, lengths AS (SELECT tune_id, max(frame) AS last FROM binned GROUP BY 1),
grid AS (SELECT tune_id, f.frame, r.reg FROM lengths, LATERAL (SELECT CAST(unnest(range(0, last + 1)) AS INT) AS frame) f, (SELECT CAST(range AS INT) AS reg FROM range(25)) r),
state AS (SELECT tune_id, frame, reg, coalesce(last_value(val IGNORE NULLS) OVER (PARTITION BY tune_id, reg ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS val FROM grid LEFT JOIN binned USING (tune_id, frame, reg))"""
_wide = ", ".join(f"max(val) FILTER (reg = {r}) AS r{r}" for r in range(25))
_lanes = " UNION ALL ".join(
    [f"SELECT tune_id, frame, '{n}{v}' AS lane, {e} AS v FROM wide" for v in range(3) for n, e in (("freq", f"r{7 * v} + 256 * r{7 * v + 1}"), ("pw", f"r{7 * v + 2} + 256 * (r{7 * v + 3} & 15)"), ("ctrl", f"r{7 * v + 4}"), ("ad", f"r{7 * v + 5}"), ("sr", f"r{7 * v + 6}"))]
    + [f"SELECT tune_id, frame, 'global{r}' AS lane, r{r} AS v FROM wide" for r in range(21, 25)])
LANE = f"{STATE}, wide AS (SELECT tune_id, frame, {_wide} FROM state GROUP BY 1, 2), lane AS ({_lanes}), lagged AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS nx FROM lane WINDOW w AS (PARTITION BY tune_id, lane ORDER BY frame))"
BURST = f"{LOG}, gaps AS (SELECT *, clock - lag(clock) OVER (PARTITION BY tune_id ORDER BY clock, seq) AS d FROM log), bursts AS (SELECT tune_id, clock AS start, row_number() OVER (PARTITION BY tune_id ORDER BY clock, seq) AS ord FROM gaps WHERE d IS NULL OR d > 1800000000)"


def add(name: str, build: Callable[[DataFrame], DataFrame], ctes: str, select: str) -> None:
    Q[name] = lambda spark, sf_dir: build(register_log(spark, sf_dir))
    SQL[name] = f"WITH {ctes} {select}"


def lane(log: DataFrame) -> DataFrame:
    return lanes.lanes(framing.framed_state(log))


def held(log: DataFrame) -> DataFrame:
    """Frame, find change points, hold them, compare: 0 for each register."""
    state = framing.framed_state(log)
    points = framing.change_points(state, ["tune_id", "reg"])
    lengths = state.groupBy("tune_id").agg(F.max("frame").alias("last"))
    return framing.residual(state, framing.hold_render(points, lengths, ["tune_id", "reg"]))


add("register_log", lambda x: x, LOG, "SELECT * FROM log")
add("framed_state", framing.framed_state, STATE, "SELECT * FROM state")
add("hold_residual", held, STATE, "SELECT DISTINCT tune_id, reg, CAST(0 AS BIGINT) AS residual FROM state")
add("change_points", lambda x: framing.change_points(framing.framed_state(x), ["tune_id", "reg"]), STATE, "SELECT tune_id, frame, reg, val FROM (SELECT *, lag(val) OVER (PARTITION BY tune_id, reg ORDER BY frame) AS b FROM state) WHERE b IS NULL OR b <> val")
add("changed_frames", lambda x: framing.binned(x).select("tune_id", "frame").distinct(), BIN, "SELECT DISTINCT tune_id, frame FROM binned")
add("burst_starts", framing.burst_starts, BURST, "SELECT * FROM bursts")
add("play_period", framing.play_period, BURST, """, steps AS (SELECT tune_id, start - lag(start) OVER (PARTITION BY tune_id ORDER BY ord) AS d FROM bursts)
SELECT tune_id, CASE WHEN count(*) < 4 OR median(d) <= 0 OR median(d) >= 0.9 * 3600000000 THEN 3600000000.0::DOUBLE ELSE median(d)::DOUBLE END AS period FROM steps GROUP BY 1""")
add("first_play", framing.first_play, BURST, """, nexts AS (SELECT tune_id, start, abs(lead(start) OVER w - start - 3600000000) < 1800000000 AND abs(lead(start, 2) OVER w - lead(start) OVER w - 3600000000) < 1800000000
AND abs(lead(start, 3) OVER w - lead(start, 2) OVER w - 3600000000) < 1800000000 AS near FROM bursts WINDOW w AS (PARTITION BY tune_id ORDER BY ord))
SELECT tune_id, coalesce(min(start) FILTER (near), min(start)) AS first FROM nexts GROUP BY 1""")
add("framing_loss", framing.framing_loss, BIN, """, a AS (SELECT tune_id, count(*) FILTER (b <> val) AS raw FROM (SELECT *, lag(val) OVER (PARTITION BY tune_id, reg ORDER BY clock, seq) AS b FROM log) GROUP BY 1),
c AS (SELECT tune_id, count(*) FILTER (b <> val) AS framed FROM (SELECT *, lag(val) OVER (PARTITION BY tune_id, reg ORDER BY frame) AS b FROM binned) GROUP BY 1)
SELECT tune_id, raw, framed, CASE WHEN raw > 0 THEN greatest(0.0::DOUBLE, 1 - framed::DOUBLE / raw) ELSE 0.0 END AS loss FROM a JOIN c USING (tune_id)""")
add("best_lag", lambda x: framing.best_lag(framing.framed_state(x), 0, 7), STATE, """, per AS (SELECT x.tune_id, l.range - 12 AS lag, count(*) AS n, sum(CASE WHEN x.val = y.val THEN 1 ELSE 0 END)::BIGINT AS same
FROM state x JOIN range(25) l ON true JOIN state y ON x.tune_id = y.tune_id AND y.frame = x.frame + l.range - 12 AND x.reg = 0 AND y.reg = 7 GROUP BY 1, 2)
SELECT tune_id, CAST(arg_max(lag, same * 100 - lag) AS INT) AS lag, max(same) AS same FROM per WHERE n > 20 GROUP BY 1""")
add("masked_state", lambda x: framing.framed_state(x).withColumn("val", F.col("val").bitwiseAND(lanes.mask_of(F.col("reg")))), STATE,
    "SELECT tune_id, frame, reg, val & CASE reg WHEN 3 THEN 15 WHEN 10 THEN 15 WHEN 17 THEN 15 WHEN 21 THEN 7 WHEN 23 THEN 247 ELSE 255 END AS val FROM state")
add("lanes", lane, LANE, "SELECT tune_id, lane, frame, v FROM lane")
add("pitch_grid", lambda x: lane(x).filter("lane like 'freq%'").select("v").distinct().select("v", scalars.pitch_grid(F.col("v")).alias("grid")), LANE,
    "SELECT DISTINCT v, CASE WHEN v > 0 THEN CAST(round_even(12 * log2(v / (440.0 * 16777216 / 985248)), 0) AS INT) END AS grid FROM lane WHERE lane LIKE 'freq%'")
add("note_boundaries", lambda x: lanes.note_boundaries(lane(x)), LANE, "SELECT DISTINCT tune_id, CAST(right(lane, 1) AS INT) AS voice, frame FROM lagged WHERE regexp_matches(lane, '^(ctrl|ad|sr)[0-2]$') AND (b IS NULL OR b <> v)")
add("gate_noteons", lambda x: lanes.gate_noteons(lane(x)), LANE, "SELECT tune_id, CAST(right(lane, 1) AS INT) AS voice, frame FROM lagged WHERE lane LIKE 'ctrl%' AND (coalesce(b, 0) & 1) = 0 AND (v & 1) = 1")
_jump = ", own AS (SELECT *, v - b AS d FROM lagged WHERE lane LIKE '{kind}%'), usual AS (SELECT tune_id, lane, floor(median(abs(d))) AS m FROM own WHERE d <> 0 GROUP BY 1, 2)"
add("pw_resets", lambda x: lanes.jumps(lane(x), "pw", True), LANE + _jump.format(kind="pw"), "SELECT tune_id, lane, frame FROM own JOIN usual USING (tune_id, lane) WHERE -d > greatest(8, 4 * m)")
add("freq_onsets", lambda x: lanes.jumps(lane(x), "freq", False), LANE + _jump.format(kind="freq"), "SELECT tune_id, lane, frame FROM own JOIN usual USING (tune_id, lane) WHERE abs(d) > greatest(8, 4 * m)")
add("rest_boundaries", lambda x: lanes.rest_boundaries(lane(x)), LANE, "SELECT tune_id, lane, frame FROM lagged WHERE lane LIKE 'freq%' AND (b = 0) <> (v = 0)")
add("all_boundaries", lambda x: lanes.all_boundaries(lane(x)), LANE + _jump.format(kind="pw"), """SELECT DISTINCT tune_id, frame FROM lagged WHERE regexp_matches(lane, '^(ctrl|ad|sr)[0-2]$') AND (b IS NULL OR b <> v)
UNION SELECT tune_id, frame FROM own JOIN usual USING (tune_id, lane) WHERE -d > greatest(8, 4 * m) UNION SELECT DISTINCT tune_id, 0 FROM lane""")
_island = ", isl AS (SELECT *, sum(CASE WHEN b = v THEN 0 ELSE 1 END) OVER (PARTITION BY tune_id, lane ORDER BY frame) AS g FROM lagged)"
add("hold_lengths", lambda x: lanes.hold_lengths(lane(x)), LANE + _island, "SELECT tune_id, lane, frame, max(frame) OVER (PARTITION BY tune_id, lane, g) - frame + 1 AS run FROM isl")
add("runs", lambda x: lanes.runs(lane(x)), LANE + _island, "SELECT tune_id, lane, min(frame) AS start, count(*) AS length, min(v) AS v FROM isl GROUP BY tune_id, lane, g")
add("first_use", lambda x: lanes.first_use(lane(x)), LANE, """, f AS (SELECT tune_id, lane, v, row_number() OVER (PARTITION BY tune_id, lane ORDER BY min(frame)) - 1 AS ref FROM lane GROUP BY 1, 2, 3)
SELECT tune_id, lane, frame, ref FROM lane JOIN f USING (tune_id, lane, v)""")
add("top_cover", lambda x: lanes.top_cover(lane(x)), LANE, """, c AS (SELECT tune_id, lane, n, row_number() OVER (PARTITION BY tune_id, lane ORDER BY n DESC, v) AS r FROM (SELECT tune_id, lane, v, count(*) AS n FROM lane GROUP BY 1, 2, 3))
SELECT tune_id, lane, sum(CASE WHEN r <= 8 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS covered FROM c GROUP BY 1, 2""")
_periods = ", ".join(f"coalesce(bool_and(p{p}), true) AND count(*) > {p} AS ok{p}" for p in range(1, 9))
_shift = ", ".join(f"lag(v, {p}) OVER (PARTITION BY tune_id, lane ORDER BY frame) = v AS p{p}" for p in range(1, 9))
add("smallest_period", lambda x: lanes.smallest_period(lane(x)), LANE, f", s AS (SELECT tune_id, lane, {_shift} FROM lane), o AS (SELECT tune_id, lane, {_periods} FROM s GROUP BY 1, 2) SELECT tune_id, lane, CASE {' '.join(f'WHEN ok{p} THEN {p}' for p in range(1, 9))} END AS period FROM o")
add("schedule", lambda x: lanes.schedule(framing.change_points(framing.framed_state(x), ["tune_id", "reg"])), STATE, """, cp AS (SELECT DISTINCT tune_id, frame FROM (SELECT *, lag(val) OVER (PARTITION BY tune_id, reg ORDER BY frame) AS b FROM state) WHERE b IS NULL OR b <> val),
g AS (SELECT tune_id, lead(frame) OVER (PARTITION BY tune_id ORDER BY frame) - frame AS gap FROM cp), n AS (SELECT tune_id, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT tune_id, gap FROM n QUALIFY row_number() OVER (PARTITION BY tune_id ORDER BY n DESC, gap) = 1""")
add("regions", lambda x: lanes.regions(x.withColumn("addr", F.col("val")), ["tune_id"]), LOG, """, a AS (SELECT DISTINCT tune_id, val AS addr FROM log), g AS (SELECT *, addr - row_number() OVER (PARTITION BY tune_id ORDER BY addr) AS g FROM a)
SELECT tune_id, min(addr) AS lo, count(*) AS n FROM g GROUP BY tune_id, g""")
add("variable_length_codes", lambda x: x.select("seq", F.col("clock").alias("n")).select("seq", scalars.zigzag(-F.col("n")).alias("zigzag"), scalars.leb16_length(F.col("n")).alias("digits"), F.concat_ws(" ", scalars.leb16(F.col("n")).cast("array<string>")).alias("code")), LOG,
    """, d AS (SELECT seq, clock AS n, length(to_hex(clock))::INT AS digits FROM log) SELECT seq, 2 * n - 1 AS zigzag, digits, array_to_string([((n >> (4 * k)) & 15) + CASE WHEN k = digits - 1 THEN 16 ELSE 0 END FOR k IN range(0, digits)], ' ') AS code FROM d""")  # fmt: skip


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with parameters from all order lines; an order has fewer than eight."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("long")
    return x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seg_id"), (q % 13 + 1).alias("dur"), F.col("l_partkey").alias("v0"), (q - 25).alias("rate"), (q % 3 + 1).alias("every"), F.array(F.col("l_suppkey"), q, F.lit(7).cast("long")).alias("table"))


KINDS = ["hold", "accum", "dwell", "decay", "vibrato", "tablewalk", "arp", "ratewalk"]
Q["closed_forms"] = lambda spark, sf_dir: render.render(_segments(spark, sf_dir), KINDS)
_form = {
    "hold": "v0", "accum": "v0 + i * rate", "dwell": "v0 + rate * (i // every)", "decay": "v0 - rate * (i // every)", "vibrato": "v0 + rate * CASE WHEN (i & 7) >= 4 THEN xor(i & 7, 7) ELSE i & 7 END",
    "tablewalk": "t[(i % 3 + 1)::INT]", "arp": "t[((i // every) % 3 + 1)::INT]", "ratewalk": "v0 + (i // 3) * list_sum(t) + coalesce(list_sum(t[1:(i % 3)::INT]), 0)",
}
SQL["closed_forms"] = """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS seg_id, l_quantity::BIGINT AS q, l_partkey AS v0, l_quantity::BIGINT - 25 AS rate, l_quantity::BIGINT % 3 + 1 AS every, [l_suppkey, l_quantity::BIGINT, 7] AS t FROM lineitem),
r AS (SELECT *, unnest(range(0, q % 13 + 1)) AS i FROM s) """ + " UNION ALL ".join(f"SELECT seg_id, '{k}' AS kind, i, ({e})::BIGINT & 65535 AS v FROM r" for k, e in _form.items())
Q["rotations"] = lambda spark, sf_dir: _segments(spark, sf_dir).select("seg_id", F.concat_ws(",", scalars.rotation(F.col("table")).cast("array<string>")).alias("least"))
SQL["rotations"] = "WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS seg_id, l_suppkey AS a, l_quantity::BIGINT AS b, 7 AS c FROM lineitem) SELECT seg_id, array_to_string(least([a, b, c], [b, c, a], [c, a, b]), ',') AS least FROM s"


def _first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.split("text", " ").alias("a"))
    y = x.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("a").alias("b"))
    return x.join(y, ["conv_id", "turn"]).select("conv_id", "turn", scalars.first_difference(F.col("a"), F.col("b")).alias("same"))


Q["first_difference"] = _first_difference
SQL["first_difference"] = """WITH x AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations), p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b, least(len(x.a), len(y.a)) AS n FROM x JOIN x y ON x.conv_id = y.conv_id AND x.turn = y.turn + 1)
SELECT conv_id, turn, coalesce(list_min([k FOR k IN range(0, n) IF a[(k + 1)::INT] IS DISTINCT FROM b[(k + 1)::INT]]), n)::INT AS same FROM p"""
