"""Accumulators: their parameters, their values on a grid of frames, and pitches that they are added to.

A ramp adds a rate, a quadratic a speed that is an accumulator itself, a triangle a step that turns round at bounds. All have closed
forms, so a fit is one pass over an array and a grid needs no frame before the one that is made. Fits are made for all arrays of an
Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 65535
#: Values that are made at once.
CELLS = 1 << 20
#: Numbers of the kinds. RAW has no closed form and keeps its values.
RAMP, QUADRATIC, TRIANGLE, RAW = range(4)


def _low(x: Column) -> Column:
    return x.cast("long").bitwiseAND(MASK)


def value(kind: Column, i: Column, seed: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """The value i frames after the first. Ramp: p1 is the rate; quadratic: p1 the first rate and p2 what it grows by; triangle: p1 the
    step with its sign, p2 and p3 the bounds, which one step does not pass twice."""
    reach = F.greatest(p3 - p2, F.lit(1))
    place = F.when(p1 >= 0, seed - p2).otherwise(2 * reach - (seed - p2)) + i * F.abs(p1)
    turn = F.pmod(place, 2 * reach)
    half = (i * (i - 1)) / 2
    return _low(F.when(kind == RAMP, seed + i * p1).when(kind == QUADRATIC, seed + i * p1 + half.cast("long") * p2).otherwise(p2 + F.least(turn, 2 * reach - turn)))


def _value(kind: int, i: np.ndarray, seed: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> np.ndarray:
    """The same on arrays, for one kind."""
    if kind == RAMP:
        return (seed + i * p1) & MASK
    if kind == QUADRATIC:
        return (seed + i * p1 + i * (i - 1) // 2 * p2) & MASK
    reach = np.maximum(p3 - p2, 1)
    turn = (np.where(p1 >= 0, seed - p2, 2 * reach - (seed - p2)) + i * np.abs(p1)) % (2 * reach)
    return (p2 + np.minimum(turn, 2 * reach - turn)) & MASK


def _fitted(lists: pa.Array) -> dict[str, pa.Array]:
    """The columns of a fit for arrays that hold something."""
    n = np.asarray(lists.value_lengths(), np.int64)
    flat = pc.bit_wise_and(lists.flatten(), MASK)
    there, v = np.asarray(flat.is_valid()), np.asarray(flat.fill_null(0))
    at = np.cumsum(n) - n
    each = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(v)) - at[each]
    place = lambda k: v[np.minimum(at + k, len(v) - 1)]  # noqa: E731  of k < n only
    seed, zero = v[at], np.zeros(len(n), np.int64)
    rate = np.where(n > 1, (place(1) - seed) & MASK, 0)
    grows = np.where(n > 2, (place(2) - 2 * place(1) + seed) & MASK, 0)
    step = np.where(rate > MASK >> 1, rate - MASK - 1, rate)
    forms = {RAMP: (rate, zero, zero), QUADRATIC: (rate, grows, zero), TRIANGLE: (step, np.minimum.reduceat(v, at), np.maximum.reduceat(v, at))}
    kind, found = np.full(len(n), RAW, np.int32), [zero.copy(), zero.copy(), zero.copy()]
    left = np.logical_and.reduceat(there, at)  # a null is no value of any kind
    for k, own in forms.items():
        some = np.flatnonzero(left[each])
        row = each[some]
        fit = left.copy()
        fit[row[_value(k, i[some], seed[row], *(p[row] for p in own)) != v[some]]] = False
        kind[fit] = k
        for out, p in zip(found, own, strict=True):
            out[fit] = p[fit]
        left &= ~fit
    size = np.where(kind == RAW, n, 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    raw = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(kind[each] == RAW)), mask=pa.array(kind != RAW))
    return {"kind": pa.array(kind), "seed": pa.array(seed), **{f"p{j}": pa.array(p) for j, p in enumerate(found, 1)}, "n": pa.array(n.astype(np.int32)), "raw": raw}


def fits(segments: DataFrame, keys: list[str], values: str = "v") -> DataFrame:
    """keys, kind, seed, p1, p2, p3, n, raw: the first kind that gives all values of an array (modulo 2^16), from its first values and
    differences. raw: the values where no kind does, else null. Empty and null arrays give no rows."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = _fitted(b["_v"])
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), *found.values()], [*keys, *found])

    rows = segments.filter(F.size(values) > 0).select(*keys, F.col(values).cast("array<long>").alias("_v"))
    own = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(fit, f"{own}, kind int, seed long, p1 long, p2 long, p3 long, n int, raw array<long>")


def grids(found: DataFrame, keys: list[str], first: str, frames: str) -> DataFrame:
    """keys, frame, acc: each accumulator from its first frame up to `frames` of its row; raw ones hold their last value. Frames before
    the first have no row and count as 0."""
    rows = found.filter(F.col(frames) > F.col(first)).withColumn("frame", F.explode(F.sequence(F.col(first).cast("long"), F.col(frames).cast("long") - 1)))
    i = F.col("frame") - F.col(first)
    raw = F.get("raw", F.least(i, F.size("raw") - 1).cast("int"))
    acc = F.when(F.col("kind") == RAW, raw).otherwise(value(F.col("kind"), i, F.col("seed"), F.col("p1"), F.col("p2"), F.col("p3")))
    return rows.select(*keys, "frame", acc.alias("acc"))


def digests(found: DataFrame, keys: list[str], first: str, frames: str, out: str = "digest") -> DataFrame:
    """keys, out: for each accumulator the sum of its values on the grid (as of grids), each times its frame. Those of no frames have
    no row. The values of an Arrow batch are made at once, CELLS at most."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, end = np.asarray(b["_a"], np.int64), np.asarray(b["_b"], np.int64)
            k = 0
            while k < len(start):
                more = max(1, int(np.searchsorted(np.cumsum(end[k:] - start[k:]), CELLS, "right")))
                yield pa.RecordBatch.from_arrays([*(b[c].slice(k, more) for c in keys), pa.array(_digests(b.slice(k, more), (end - start)[k : k + more]))], [*keys, out])
                k += more

    own = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keys)
    rows = found.filter(F.col(frames) > F.col(first)).select(*keys, F.col(first).cast("long").alias("_a"), F.col(frames).cast("long").alias("_b"), "kind", "seed", "p1", "p2", "p3", "raw")
    return rows.mapInArrow(made, f"{own}, {out} long")


def _digests(b: pa.RecordBatch, n: np.ndarray) -> np.ndarray:
    at = np.cumsum(n) - n
    each = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(each)) - at[each]
    kind, *p = (np.asarray(b[c], np.int64) for c in ("kind", "seed", "p1", "p2", "p3"))
    acc = np.zeros(len(each), np.int64)
    for k in (RAMP, QUADRATIC, TRIANGLE):
        some = np.flatnonzero((kind == k)[each])
        acc[some] = _value(k, i[some], *(x[each[some]] for x in p))
    size = np.asarray(b["raw"].value_lengths().fill_null(0), np.int64)
    some = np.flatnonzero(((kind == RAW) & (size > 0))[each])
    row = each[some]
    acc[some] = np.asarray(b["raw"].flatten().fill_null(0), np.int64)[(np.cumsum(size) - size)[row] + np.minimum(i[some], size[row] - 1)]
    return np.add.reduceat(acc * (np.asarray(b["_a"], np.int64)[each] + i), at)


def integrated(seeds: DataFrame, accs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, pitch: a held seed for each frame (keys, frame, seed) with all accumulators of the frame (keys, frame, acc) on top,
    modulo 2^16. Accumulators are added up before they meet the seeds."""
    sums = accs.groupBy(*keys, "frame").agg(F.sum("acc").alias("_acc"))
    return seeds.join(sums, [*keys, "frame"], "left").select(*keys, "frame", _low(F.col("seed") + F.coalesce("_acc", F.lit(0))).alias("pitch"))
