"""Registered queries of accumulators: quadratic and reflecting ones from order lines, and note segments of lanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accumulators, framing, machine
from .queries import LANE, Q, SQL, add, lane

FRAMES = 40


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, first, v: for each order line values of a ramp, a quadratic, a triangle, or of none of these. What is dealt to many tasks
    are the order lines, as they take fewer bytes."""
    x = machine.dealt(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(FRAMES)
        for b in batches:
            order, line, q, part, supp = (np.asarray(c, np.int64)[:, None] for c in b.columns)
            turn = (supp % 7 + i * (q % 5 + 1)) % 60
            forms = [part + i * (q - 25), part + i * q + i * (i - 1) // 2 * (line - 3), 100 + np.minimum(turn, 60 - turn)]
            kind = (part + q) % 4
            v = np.select([kind == k for k in range(3)], forms, (part * i * i * i + supp) % 1000) & 65535
            at = np.arange(len(v) + 1, dtype=np.int32) * FRAMES
            yield pa.RecordBatch.from_arrays([pa.array((order * 8 + line)[:, 0]), pa.array(line[:, 0] * 3), pa.ListArray.from_arrays(pa.array(at), pa.array(v.reshape(-1)))], ["cell", "first", "v"])

    rows = x.select(*(F.col(f"l_{c}").cast("long") for c in ("orderkey", "linenumber", "quantity", "partkey", "suppkey")))
    return rows.mapInArrow(made, "cell long, first long, v array<long>")


_SQL = f"""WITH s AS (SELECT row_number() OVER () AS rid, l_orderkey * 8 + l_linenumber AS cell, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS q, l_partkey AS part, l_suppkey AS supp, (l_partkey + l_quantity::BIGINT) % 4 AS k FROM lineitem),
r AS (SELECT *, unnest(range(0, {FRAMES})) AS i FROM s), t AS (SELECT *, (supp % 7 + i * (q % 5 + 1)) % 60 AS y FROM r),
x AS (SELECT rid, cell, line, i, CASE k WHEN 0 THEN part + i * (q - 25) WHEN 1 THEN part + i * q + i * (i - 1) // 2 * (line - 3) WHEN 2 THEN 100 + least(y, 60 - y) ELSE (part * i * i * i + supp) % 1000 END & 65535 AS v FROM t),
d AS (SELECT *, ((lead(v) OVER w - v) % 65536 + 65536) % 65536 AS d FROM x WINDOW w AS (PARTITION BY rid ORDER BY i)), e AS (SELECT *, ((lead(d) OVER w - d) % 65536 + 65536) % 65536 AS e FROM d WINDOW w AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, any_value(cell) AS cell, arg_min(v, i) AS v0, arg_min(d, i) AS d0, arg_min(e, i) AS e0, count(DISTINCT d) AS nd, count(DISTINCT e) AS ne, min(v) AS lo, max(v) AS hi FROM e GROUP BY 1),
g AS (SELECT *, CASE WHEN d0 > 32767 THEN d0 - 65536 ELSE d0 END AS st, greatest(hi - lo, 1) AS reach FROM f),
h AS (SELECT rid, bool_and(v = lo + least(z, 2 * reach - z)) AS tri FROM (SELECT x.*, lo, reach, (CASE WHEN st >= 0 THEN v0 - lo ELSE 2 * reach - v0 + lo END + i * abs(st)) % (2 * reach) AS z FROM x JOIN g USING (rid)) GROUP BY 1),
b AS (SELECT *, CASE WHEN nd = 1 THEN 0 WHEN ne = 1 THEN 1 WHEN tri THEN 2 ELSE 3 END AS kind FROM g JOIN h USING (rid))"""
Q["accumulator_fits"] = lambda spark, sf_dir: accumulators.fits(_cells(spark, sf_dir), ["cell"]).select("cell", "kind", "seed", "p1", "p2", "p3", F.size("raw").alias("raw"))
SQL["accumulator_fits"] = _SQL + f" SELECT cell, kind, v0 AS seed, CASE kind WHEN 2 THEN st WHEN 3 THEN 0 ELSE d0 END AS p1, CASE kind WHEN 1 THEN e0 WHEN 2 THEN lo ELSE 0 END AS p2, CASE kind WHEN 2 THEN hi ELSE 0 END AS p3, CASE WHEN kind = 3 THEN {FRAMES} END AS raw FROM b"


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values again, from what was fitted, on the frames that they belong to."""
    found = accumulators.fits(_cells(spark, sf_dir), ["cell", "first"]).withColumn("frames", F.col("first") + FRAMES)
    return accumulators.digests(found, ["cell"], "first", "frames").groupBy("cell").agg(F.sum("digest").alias("digest"))


Q["accumulator_grids"], SQL["accumulator_grids"] = _grids, _SQL + " SELECT cell, sum((i + 3 * line) * v)::BIGINT AS digest FROM x GROUP BY 1"


def _pitches(log: DataFrame) -> DataFrame:
    state = framing.framed_state(log)
    seeds = lane(log).filter("lane like 'freq%'").select("tune_id", "lane", "frame", F.col("v").alias("seed"))
    cells = state.filter("reg in (21, 22, 23)").select("tune_id", F.explode(F.array(*[F.lit(f"freq{k}") for k in (0, 1)])).alias("lane"), "frame", (F.col("val") * 300).alias("acc"))
    return accumulators.integrated(seeds, cells, ["tune_id", "lane"])


add("integrated_pitches", _pitches, LANE, "SELECT tune_id, lane, frame, (v + CASE WHEN lane = 'freq2' THEN 0 ELSE 300 * (r21 + r22 + r23) END) & 65535 AS pitch FROM lane JOIN wide USING (tune_id, frame) WHERE lane LIKE 'freq%'")
