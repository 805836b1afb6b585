"""Closed forms of all generator kinds, with phase, lead, dwell and bounds: a value for each frame of a segment.

Sums of periodic tables have closed forms by whole periods and a prefix; reflecting counters are triangles. So each frame is
made on its own, without the frame before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tri_phase

MASK = 65535


def _at(table: Column, k: Column) -> Column:
    """Entry k of a periodic table that is not empty."""
    return F.element_at(table, (F.pmod(k, F.size(table)) + 1).cast("int"))


def _sum(table: Column, n: Column) -> Column:
    """Sum of the first n entries of a periodic table."""
    zero = F.lit(0).cast("long")
    whole = F.aggregate(table, zero, lambda a, x: a + x)
    return F.floor(n / F.size(table)) * whole + F.aggregate(F.slice(table, 1, F.pmod(n, F.size(table)).cast("int")), zero, lambda a, x: a + x)


def _triangle(x: Column, reach: Column) -> Column:
    """0 up to reach and back, again and again."""
    y = F.pmod(x, 2 * reach)
    return F.least(y, 2 * reach - y)


def falling(base: Column, i: Column, top: Column, parity: Column, ctr0: Column) -> Column:
    """A high byte that counts down from top on the frames of one parity, laid over a value, until it is 0."""
    first = F.pmod(parity - ctr0, F.lit(2))
    high = top - F.greatest(F.floor((i - first + 1) / 2), F.lit(0))
    here = (F.pmod(i - first, F.lit(2)) == 0) & (high > 0)
    return F.when(here, base.bitwiseAND(255) + 256 * high).otherwise(base.bitwiseAND(MASK))


def values(i: Column, p: dict[str, Column]) -> dict[str, Column]:
    """The value at frame i for each kind. p: v0, rate, dwell, ctr0, lead, lo, hi, frac, top, parity (integers) and table, mask (arrays
    that are not empty). Bounds: lo <= v0 < hi, at least one step of rate fits between them, and rate and dwell are at least 1."""
    v0, rate, dwell, ctr0, lead, lo, hi = (p[x] for x in ("v0", "rate", "dwell", "ctr0", "lead", "lo", "hi"))
    table, mask = p["table"], p["mask"]
    low = lambda x: x.cast("long").bitwiseAND(MASK)
    after = F.greatest(F.lit(0), i - lead)
    arp = _at(table, F.floor((ctr0 + i) / dwell))
    vibrato = low(v0 + tri_phase(ctr0 + i) * rate)
    held = lambda n: dwell * _sum(table, F.floor(n / dwell)) + F.pmod(n, dwell) * _at(table, F.floor(n / dwell))
    down, up = F.floor((v0 - lo) / rate), F.floor((hi - v0) / rate)  # steps that fit below and above
    turn = _triangle(down + F.floor((i + dwell) / (dwell + 1)), down + up)
    reach = 2 + p["parity"] + 2 * ctr0  # of the counter that reflects beyond parity + 2 * ctr0
    below = F.floor((reach - 1) / 2) + 1
    scale = F.pow(F.lit(2), p["frac"]).cast("long")
    fold = _triangle((v0 - lo) * scale + i * rate, (hi - lo) * scale) + lo * scale
    return {
        "wrapaccum": lo + F.pmod(v0 - lo + i * rate, hi - lo),
        "dwell": low(v0 + rate * F.floor(after / dwell)),
        "maskaccum": low(v0 + rate * _sum(mask, i)),
        "ratewalk": low(v0 + _sum(table, ctr0 + i) - _sum(table, ctr0)),
        "dwellratewalk": low(v0 + held(ctr0 + i) - held(ctr0)),
        "tablewalk": low(_at(table, ctr0 + i)),
        "tablewalk_lead": low(F.when(i < lead, v0).otherwise(_at(table, ctr0 + i - lead))),
        "arp": low(arp),
        "wavetable_ptr": low(_at(table, ctr0 + _sum(mask, i))),
        "glide": F.coalesce(F.try_element_at(table, (F.pmod(ctr0 + rate * F.floor(after / dwell), F.lit(256)) + 1).cast("int")), F.lit(0).cast("long")),
        "vibrato": vibrato,
        "decay": low(v0 - rate * F.floor((F.pmod(ctr0, dwell) + i) / dwell)),
        "pingpong": v0 + rate * (turn - down),
        "pingfold": F.floor(fold / scale),
        "vibreflect": low(v0 + rate * (_triangle(below + F.greatest(F.lit(0), i + 1 - F.greatest(lead - 1, F.lit(0))), reach) - below)),
        "vibskydive": falling(vibrato, i, p["top"], p["parity"], ctr0),
        "arp_decay": falling(low(arp), i, p["top"], p["parity"], ctr0),
        "additive_pw": (F.floor(v0 / 256) * 256 + F.pmod(v0 + i * rate + _sum(mask, i), F.lit(256))).cast("long").bitwiseAND(4095),
        "vibrato_carry": F.when(tri_phase(ctr0 + i) == 0, 1).otherwise(F.floor((low(v0 + (tri_phase(ctr0 + i) - 1) * rate) + low(rate)) / (MASK + 1))).cast("long"),
    }


def parameters(columns: list[str]) -> dict[str, Column]:
    return {c: F.col(c) for c in columns}


def rendered(segments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """seg_id, i, and a column for each kind: one row for each frame of each segment. Segments of no frames give no rows."""
    rows = segments.filter("dur > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dur") - 1)))
    found = values(F.col("i"), parameters([c for c in segments.columns if c not in ("seg_id", "dur")]))
    return rows.select("seg_id", "i", *(found[n].alias(n) for n in names or found))


def digest(segments: DataFrame) -> DataFrame:
    """seg_id and for each kind the sum of its values, each times its place: one row for each segment."""
    rows = rendered(segments)
    return rows.groupBy("seg_id").agg(*(F.sum((F.col("i") + 1) * F.col(c)).cast("long").alias(c) for c in rows.columns if c not in ("seg_id", "i")))


def interleaved(segments: DataFrame, rows: DataFrame, ways: int) -> DataFrame:
    """seg_id, i, v: `ways` lanes dealt out in turn, frame i from lane i mod ways. rows: seg_id, way, i, v of the lanes."""
    return segments.join(rows, "seg_id").select("seg_id", (F.col("i") * ways + F.col("way")).alias("i"), "v").filter(F.col("i") >= 0)
