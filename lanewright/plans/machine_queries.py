"""Registered queries of the general generator: named kinds as its presets, and segments whose machines are found again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import machine
from .engine_queries import _GEN, _generators
from .queries import Q, SQL

#: Kinds of which a segment is long enough to tell the machine that made it.
TOLD = ("accum", "wrapaccum", "dwell", "ratewalk", "dwellratewalk", "tablewalk", "arp", "decay", "vibrato", "pingpong", "pingfold", "vibreflect", "maskaccum", "wavetable_ptr", "additive_pw")
FRAMES = 96
_KINDS = [k for k in machine.PRESETS if k in _GEN]


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What generator_forms gives, by the presets of the one generator."""
    segments = _generators(spark, sf_dir, deal=True).filter("dur > 0")
    return machine.preset_digests(segments, "seg_id", _KINDS).groupBy("seg_id").agg(*(F.sum(k).alias(k) for k in _KINDS))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg_id, kind, v: a segment of one kind for each order line."""
    name = F.element_at(F.array(*map(F.lit, TOLD)), (F.pmod("seg_id", F.lit(len(TOLD))) + 1).cast("int"))
    segments = _generators(spark, sf_dir, deal=True).withColumn("dur", F.lit(FRAMES).cast("long")).withColumn("kind", name)
    return machine.preset_sequences(segments, ["seg_id", "kind"], "kind", TOLD)


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of each kind one machine explains from the first frame to the last, and all their frames."""
    fits = machine.fitted(_told(spark, sf_dir), ["seg_id", "kind"], deal=False)
    return fits.groupBy("kind").agg(F.sum((F.col("length") == FRAMES).cast("long")).alias("whole"), F.sum("length").alias("frames"))


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = machine.fitted(_told(spark, sf_dir), ["seg_id", "kind"], deal=False)
    return machine.digests(fits, ["seg_id"]).groupBy("seg_id").agg(F.sum("digest").alias("digest"))


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machines of all kinds for all order lines, by mode."""
    segments = _generators(spark, sf_dir)
    each = reduce(DataFrame.unionByName, [machine.machines(segments, "seg_id", k).withColumn("kind", F.lit(k)) for k in machine.PRESETS])
    return each.groupBy("mode").agg(F.count_distinct("kind").alias("kinds"), F.count("*").alias("machines"), F.sum(F.col("length")).alias("frames"), F.sum((F.col("mask").isNotNull()).cast("long")).alias("masked"))


Q["machine_forms"], Q["machine_recovery"], Q["machine_fits_read"] = _forms, _recovered, _again
SQL["machine_forms"] = f"SELECT seg_id, {', '.join(_KINDS)} FROM ({SQL['generator_forms']})"
_own = SQL["generator_forms"].split("r AS (")[0].replace("l_quantity::BIGINT % 13 AS dur", f"{FRAMES} AS dur")
_case = lambda f: "CASE seg_id % " + str(len(TOLD)) + "".join(f" WHEN {i} THEN {f(k)}" for i, k in enumerate(TOLD)) + " END"
_sql = {k: _GEN.get(k, "(v0 + i * rate) & 65535") for k in TOLD}
SQL["machine_recovery"] = f"SELECT kind, count(*) AS whole, ({FRAMES} * count(*))::BIGINT AS frames FROM (SELECT {_case(lambda k: repr(k)).replace('seg_id', '(l_orderkey * 8 + l_linenumber)')} AS kind FROM lineitem) GROUP BY 1"
SQL["machine_fits_read"] = f"{_own} r AS (SELECT *, unnest(range(0, dur)) AS i FROM s) SELECT seg_id, sum((i + 1) * ({_case(lambda k: '(' + _sql[k] + ')')}))::BIGINT AS digest FROM r GROUP BY 1"
Q["generator_presets"] = _presets
_modes = ", ".join(f"('{m}', {n}, {masked})" for m, n, masked in (("read", 6 + 1, 1), ("sum", 5, 1), ("held", 1, 0), ("wrap", 2, 0), ("reflect", 2, 0), ("fold", 1, 0)))
SQL["generator_presets"] = f"SELECT mode, kinds::BIGINT AS kinds, (kinds * n)::BIGINT AS machines, (kinds * frames)::BIGINT AS frames, (masked * n)::BIGINT AS masked FROM (VALUES {_modes}) m(mode, kinds, masked), (SELECT count(*) AS n, sum(l_quantity::BIGINT % 13) AS frames FROM lineitem)"
