"""Back references with transposition, and lane programs: sequences of one lane, block by block.

What a sequence repeats depends on all of it, so a block of a lane is one group; blocks bound the size of a group. All blocks of
all lanes are worked on in parallel, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a block, and the shortest copy.
BLOCK, LEAST = 2048, 2
#: Frames in the longest period that a lane program looks for.
LONGEST_PERIOD = 64


def digits(n: np.ndarray) -> np.ndarray:
    """Digits of a number of at least 0 in base 16."""
    n = np.asarray(n, np.int64)
    return np.maximum(1, sum((n >> (4 * k) > 0).astype(np.int64) for k in range(16)))


def folded(n: np.ndarray) -> np.ndarray:
    """0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    n = np.asarray(n, np.int64)
    return (n << 1) ^ (n >> 63)


def best_sources(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place: length and offset of the longest run that an earlier place has too, and of the longest that it has
    shifted by a constant other than 0. The smallest offset of the longest; runs may overlap their source.

    Runs are counted from the end: one row of all offsets follows from the row of the next place.
    """
    n = len(v)
    same, moved = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # by offset, at the place after
    later = np.zeros(n + 1, np.int64)  # shift at the place after
    out = np.zeros((4, n), np.int64)
    for i in range(n - 1, 0, -1):
        shift = v[i] - v[i - 1 :: -1]  # by offset 1, 2, ..., i
        run = np.where(shift == 0, 1 + same[1 : i + 1], 0)
        move = np.where(shift != 0, 1 + np.where(shift == later[1 : i + 1], moved[1 : i + 1], 0), 0)
        a, b = int(run.argmax()), int(move.argmax())
        out[:, i] = run[a], a + 1, move[b], b + 1
        same[1 : i + 1], moved[1 : i + 1], later[1 : i + 1] = run, move, shift
        same[i + 1 :], moved[i + 1 :] = 0, 0
    return out[0], out[1], out[2], out[3]


def encoded(v: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(op, start, length, offset, shift) of a sequence: literals, repeats and transposed repeats.

    At each place the copy that saves most digits is taken; a transposed one on ties; a literal if none saves any.
    """
    v = np.asarray(v, np.int64)
    same, same_off, moved, moved_off = best_sources(v)
    literal = np.concatenate([[0], np.cumsum(digits(folded(v)))])
    out, i = [], 0
    while i < len(v):
        gains = []
        for op, n, off in (("transpose", int(moved[i]), int(moved_off[i])), ("repeat", int(same[i]), int(same_off[i]))):
            shift = int(v[i] - v[i - off]) if n else 0
            cost = 1 + int(digits(off)) + int(digits(n)) + (int(digits(folded(shift))) if op == "transpose" else 0)
            gain = int(literal[i + n] - literal[i]) - cost
            if n >= LEAST and gain > 0:
                gains.append((gain, op, n, off, shift))
        if gains:
            _, op, n, off, shift = max(gains, key=lambda g: g[0])
            out.append((op, i, n, off, shift))
            i += n
        else:
            out.append(("literal", i, 1, 0, int(v[i])))
            i += 1
    return out


def decoded(ops: list[tuple[str, int, int, int, int]]) -> list[int]:
    out: list[int] = []
    for op, _, n, off, shift in ops:
        if op == "literal":
            out.append(shift)
        else:
            for _ in range(n):
                out.append(out[len(out) - off] + (shift if op == "transpose" else 0))
    return out


def program(v: np.ndarray) -> list[tuple[str, int, int, int, list[int]]]:
    """(op, start, length, step, values) of a lane: the longest of a held value, a constant step of at least three frames, and the
    smallest period that repeats twice, else a single value; again and again."""
    v = np.asarray(v, np.int64)
    n = len(v)
    step = np.diff(v)
    change = np.flatnonzero(np.diff(step) != 0) + 1 if n > 2 else np.zeros(0, np.int64)
    ends = np.append(change, n - 1)  # where a run of equal steps ends, as a frame
    out, i = [], 0
    while i < n:
        best = ("set", 1, 0, [int(v[i])])
        if i + 1 < n:
            end = int(ends[np.searchsorted(ends, i, "right")]) if i < n - 1 else i
            length, d = end - i + 1, int(step[i])
            if d == 0:
                best = ("hold", length, 0, [int(v[i])])
            elif length >= 3:
                best = ("ramp", length, d, [int(v[i])])
        for p in range(2, min(LONGEST_PERIOD, (n - i) // 2) + 1):
            if not np.array_equal(v[i : i + p], v[i + p : i + 2 * p]):
                continue
            differ = np.flatnonzero(v[i + p :] != v[i : n - p])
            length = p + (int(differ[0]) if len(differ) else n - p - i)
            if length > best[1]:
                best = ("period", length, 0, v[i : i + p].tolist())
                break
        out.append((best[0], i, *best[1:]))
        i += best[1]
    return out


def _grouped(lane: DataFrame, block: int, made, fields: str) -> DataFrame:
    """made(values) for each block of each lane: rows of the fields, whose starts become frames. Frames of a lane are dense."""
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[f.split(" ")[1]] for f in fields.split(", ")]
    tune = lane.schema["tune_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame")
        first = rows["frame"][0].as_py()
        out = [(r[0], r[1] + first, *r[2:]) for r in made(rows["v"].to_numpy())]
        cols = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        same = [pa.array([rows[c][0].as_py()] * len(out), rows.schema.field(c).type) for c in ("tune_id", "lane", "block")]
        return pa.table([*same, *cols], names=["tune_id", "lane", "block", *names])

    own = lane.select("tune_id", "lane", F.floor(F.col("frame") / block).alias("block"), F.col("frame").cast("long").alias("frame"), F.col("v").cast("long").alias("v"))
    return own.groupBy("tune_id", "lane", "block").applyInArrow(run, f"tune_id {tune}, lane string, block long, {fields}")


def compress(lane: DataFrame, block: int = BLOCK) -> DataFrame:
    """tune_id, lane, block, op, start, length, offset, shift: each block of a lane with back references into itself."""
    return _grouped(lane, block, encoded, "op string, start long, length long, offset long, shift long")


def decompress(ops: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v from back references."""
    tune = ops.schema["tune_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start")
        v = decoded(list(zip(*(rows[c].to_pylist() for c in ("op", "start", "length", "offset", "shift")), strict=True)))
        first = rows["start"][0].as_py()
        same = [pa.array([rows[c][0].as_py()] * len(v), rows.schema.field(c).type) for c in ("tune_id", "lane")]
        return pa.table([*same, pa.array(range(first, first + len(v)), pa.int64()), pa.array(v, pa.int64())], names=["tune_id", "lane", "frame", "v"])

    found = ops.groupBy("tune_id", "lane", "block").applyInArrow(run, f"tune_id {tune}, lane string, frame long, v long")
    return found.select("tune_id", "lane", F.col("frame").cast("int").alias("frame"), "v")


def digits_of(n: Column) -> Column:
    return F.greatest(F.length(F.hex(n)), F.lit(1))


def sizes(ops: DataFrame) -> DataFrame:
    """tune_id, op, ops, digits of each tune and operation, with totals (op null) and the grand total (both null)."""
    fold = F.shiftleft("shift", 1).bitwiseXOR(F.shiftright("shift", 63))
    copy = 1 + digits_of(F.col("offset")) + digits_of(F.col("length"))
    cost = F.when(F.col("op") == "literal", digits_of(fold)).when(F.col("op") == "repeat", copy).otherwise(copy + digits_of(fold))
    return ops.rollup("tune_id", "op").agg(F.count("*").alias("ops"), F.sum(cost).cast("long").alias("digits"))


def lane_programs(lane: DataFrame, block: int = BLOCK) -> DataFrame:
    """tune_id, lane, block, op, start, length, step, values."""
    return _grouped(lane, block, program, "op string, start long, length long, step long, values array<bigint>")


def run_programs(ops: DataFrame) -> DataFrame:
    """tune_id, lane, frame, v: held values, steps and periods are closed forms of the frame within the operation."""
    rows = ops.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    at = F.element_at("values", (F.pmod(F.col("i"), F.size("values")) + 1).cast("int"))
    value = F.when(F.col("op") == "period", at).otherwise(F.element_at("values", 1) + F.col("step") * F.col("i"))
    return rows.select("tune_id", "lane", (F.col("start") + F.col("i")).cast("int").alias("frame"), value.alias("v"))


def signatures(ops: DataFrame) -> DataFrame:
    """kind, op, shape, n, frames: how often each shape (a period's length, a ramp's step) occurs in each kind of lane."""
    shape = F.when(F.col("op") == "period", F.size("values")).when(F.col("op") == "ramp", F.col("step"))
    return ops.groupBy(F.regexp_replace("lane", "[0-9]+$", "").alias("kind"), "op", shape.cast("long").alias("shape")).agg(F.count("*").alias("n"), F.sum("length").alias("frames"))


def token_stream(ops: DataFrame) -> DataFrame:
    """tune_id, lane, tokens: each lane's back references as one array of integers. A literal is 0 and its value; a repeat is 1,
    offset and length; a transposed one is 2, offset, length and shift."""
    token = F.when(F.col("op") == "literal", F.array(F.lit(0).cast("long"), F.col("shift"))).when(F.col("op") == "repeat", F.array(F.lit(1).cast("long"), F.col("offset"), F.col("length")))
    token = token.otherwise(F.array(F.lit(2).cast("long"), F.col("offset"), F.col("length"), F.col("shift")))
    each = F.array_sort(F.collect_list(F.struct("start", token.alias("t"))))
    return ops.groupBy("tune_id", "lane", "block").agg(F.flatten(F.transform(each, lambda x: x["t"])).alias("tokens"), F.min("start").alias("start"))


def grouped_tokens(tokens: list[int], start: int) -> list[tuple[str, int, int, int, int]]:
    """(op, start, length, offset, shift) of a token array, in one pass."""
    out, i = [], 0
    while i < len(tokens):
        kind = tokens[i]
        if kind == 0:
            out.append(("literal", start, 1, 0, tokens[i + 1]))
        else:
            out.append(("repeat" if kind == 1 else "transpose", start, tokens[i + 2], tokens[i + 1], tokens[i + 3] if kind == 2 else 0))
        start += out[-1][2]
        i += 2 + kind
    return out


def read_tokens(streams: DataFrame) -> DataFrame:
    """tune_id, lane, block, op, start, length, offset, shift: the inverse of token_stream."""
    tune = streams.schema["tune_id"].dataType.simpleString()
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, each = [], []
            for k, (tokens, start) in enumerate(zip(b["tokens"].to_pylist(), b["start"].to_pylist(), strict=True)):
                own = grouped_tokens(tokens, start)
                rows += own
                each += [k] * len(own)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            index = pa.array(each, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b[c].take(index) for c in ("tune_id", "lane", "block")), *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], ["tune_id", "lane", "block", "op", "start", "length", "offset", "shift"])

    return streams.select("tune_id", "lane", "block", "start", "tokens").mapInArrow(read, f"tune_id {tune}, lane string, block long, op string, start long, length long, offset long, shift long")
