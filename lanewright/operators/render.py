"""Closed forms of the generators: one row for each frame of a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tri_phase


def forms(i: Column, v0: Column, rate: Column, every: Column, table: Column, width: int = 65535) -> dict[str, Column]:
    """Value at frame i of a segment, for each kind. table: an array that is not empty."""
    n = F.size(table)
    low = lambda x: x.cast("long").bitwiseAND(width)
    at = lambda k: F.element_at(table, (F.pmod(k, n) + 1).cast("int"))
    total = F.aggregate(table, F.lit(0).cast("long"), lambda a, x: a + x)
    partial = F.aggregate(F.slice(table, 1, F.pmod(i, n).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
    return {
        "hold": low(v0), "accum": low(v0 + i * rate), "dwell": low(v0 + rate * F.floor(i / every)), "decay": low(v0 - rate * F.floor(i / every)),
        "vibrato": low(v0 + tri_phase(i) * rate), "tablewalk": low(at(i)), "arp": low(at(F.floor(i / every))), "ratewalk": low(v0 + F.floor(i / n) * total + partial),
    }


def render(segments: DataFrame, kinds: list[str]) -> DataFrame:
    """seg_id, kind, i, v for segments (seg_id, dur, v0, rate, every, table); an unknown kind is an error. Segments of no frames give
    no rows."""
    rows = segments.filter("dur > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dur") - 1)))
    table = forms(F.col("i"), F.col("v0"), F.col("rate"), F.col("every"), F.col("table"))
    values = F.array(*[F.struct(F.lit(k).alias("kind"), table[k].alias("v")) for k in kinds])
    return rows.select("seg_id", "i", F.explode(values).alias("x")).select("seg_id", "x.kind", "i", "x.v")
