"""The general generator, and which one made a segment.

A machine has a table, a pointer into it and a clock. After `lead` frames the clock is armed; it fires every `dwell` armed frames,
`phase` of which have passed already, or by a periodic mask. Each time the pointer moves on; behind the last entry it goes back to
entry `loop`. Modes: "read" gives the entry (the seed before the clock is armed); "sum" adds the entry to the seed each time the
clock fires, "held" in each armed frame; "wrap" is "sum" that stays in [lo, hi); "reflect" counts up and down between 0 and reach
from offset on, a step each time, rate for each count; "fold" does so with steps of rate in fractions of 2^frac.

The value of a frame has a closed form, so frames are made on their own. The other way round, dwell and phase follow from the
greatest common divisors of the distances between changes, tables from folding what is seen at those places, bounds from turning
points; each guess is run and counts for as long as it is right. Segments of equal length are looked at side by side: a machine that
explains all frames is found for all of them at once (whole_machines); only the others are gone through one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 65535
#: Longest table and head before its loop, changes that distances are taken from, and the shortest run of a constant step.
PERIOD, HEAD, CHANGES, LEAST = 32, 3, 64, 3
#: Values that are worked on at once, and from how many segments on it pays to look at them side by side.
CELLS, TOGETHER = 1 << 20, 8
#: Fields of a machine, all numbers but for mode, table and mask.
NUMBERS = ("seed", "dwell", "phase", "lead", "start", "loop", "lo", "hi", "rate", "reach", "offset", "frac", "width")
DEFAULTS = {"seed": 0, "dwell": 1, "phase": 0, "lead": 0, "start": 0, "loop": 0, "lo": 0, "hi": 0, "rate": 0, "reach": 1, "offset": 0, "frac": 0, "width": MASK}


def _total(xs: Column, n: Column | None = None) -> Column:
    own = xs if n is None else F.slice(xs, 1, n.cast("int"))
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)


def _triangle(x: Column, reach: Column) -> Column:
    y = F.pmod(x, 2 * reach)
    return F.least(y, 2 * reach - y)


def values(i: Column, m: dict[str, Column]) -> Column:
    """The value at frame i. m: mode, table (not empty), mask (null where the clock has a dwell) and NUMBERS. The parts that do not
    depend on i are cheap to repeat, as a table is short."""
    table, mask = m["table"], m["mask"]
    n, loop = F.size(table).cast("long"), m["loop"]
    armed = F.greatest(F.lit(0), i - m["lead"])
    ring = n - loop
    entry = lambda t: F.element_at(table, (F.when(t < n, t).otherwise(loop + F.pmod(t - loop, ring)) + 1).cast("int"))
    cycle = _total(F.slice(table, (loop + 1).cast("int"), ring.cast("int")))
    before = lambda t: F.when(t <= n, _total(table, t)).otherwise(_total(table) + F.floor((t - n) / ring) * cycle + _total(F.slice(table, (loop + 1).cast("int"), ring.cast("int")), F.pmod(t - n, ring)))
    masked = lambda k: F.floor(k / F.size(mask)) * _total(mask) + _total(mask, F.pmod(k, F.size(mask)))
    fired = F.when(mask.isNotNull(), masked(m["phase"] + armed) - masked(m["phase"])).otherwise(F.floor((m["phase"] + armed) / m["dwell"]))
    low = lambda x: x.cast("long").bitwiseAND(m["width"])
    start = m["start"]
    summed = m["seed"] + before(start + fired) - before(start)
    held = lambda k: m["dwell"] * (before(start + F.floor(k / m["dwell"])) - before(start)) + F.pmod(k, m["dwell"]) * entry(start + F.floor(k / m["dwell"]))
    scale = F.pow(F.lit(2), m["frac"]).cast("long")
    mode = m["mode"]
    return (
        F.when(mode == "read", F.when(i < m["lead"], m["seed"]).otherwise(entry(start + fired)))
        .when(mode == "sum", low(summed))
        .when(mode == "held", low(m["seed"] + held(m["phase"] + armed) - held(m["phase"])))
        .when(mode == "wrap", m["lo"] + F.pmod(summed - m["lo"], m["hi"] - m["lo"]))
        .when(mode == "reflect", low(m["seed"] + m["rate"] * (_triangle(m["offset"] + fired, m["reach"]) - _triangle(m["offset"], m["reach"]))))
        .otherwise(F.floor((m["seed"] + _triangle(m["offset"] + fired * m["rate"], m["reach"])) / scale))
    ).cast("long")


class Rows(NamedTuple):
    """Arrays of many rows side by side: cells beyond the size of a row are 0."""

    cells: np.ndarray
    size: np.ndarray


def padded(lists: pa.Array, least: int = 1) -> Rows:
    """Rows of a column of arrays; a null one has no cells."""
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    cells = np.zeros((len(size), max(least, int(size.max(initial=0)))), np.int64)
    cells[np.arange(cells.shape[1]) < size[:, None]] = np.asarray(lists.flatten(), np.int64)
    return Rows(cells, size)


def _picked(m: dict, own: np.ndarray) -> dict:
    return {k: Rows(x.cells[own], x.size[own]) if isinstance(x, Rows) else x[own] for k, x in m.items()}


def _turned(x: np.ndarray, reach: np.ndarray) -> np.ndarray:
    y = x % (2 * reach)
    return np.minimum(y, 2 * reach - y)


def run_all(m: dict, n: int) -> np.ndarray:
    """The values of the first n frames of many machines, a row for each. m: mode and NUMBERS as arrays, table and mask as Rows; a
    mask of no cells is none."""
    out = np.empty((len(m["mode"]), n), np.int64)
    for mode in set(m["mode"].tolist()):
        for masked in (False, True):
            own = np.flatnonzero((m["mode"] == mode) & ((m["mask"].size > 0) == masked))
            if len(own):
                out[own] = _run_alike(mode, masked, _picked(m, own), np.arange(n))
    return out


def _run_alike(mode: str, masked: bool, m: dict, i: np.ndarray) -> np.ndarray:
    col = {c: m[c][:, None] for c in NUMBERS}
    table, size, loop = m["table"].cells, m["table"].size[:, None], col["loop"]
    ring = size - loop
    pick = lambda xs, t: np.take_along_axis(xs, t, 1)
    summed = lambda xs: np.concatenate([np.zeros((len(xs), 1), np.int64), np.cumsum(xs, 1)], 1)

    def entry(t):
        return pick(table, np.where(t < size, t, loop + (t - loop) % ring))

    def before(t):  # sums of the entries ahead of t
        sums = summed(table)
        rounds, rest = np.divmod(np.maximum(t - size, 0), ring)
        head = pick(sums, loop)
        return pick(sums, np.minimum(t, size)) + rounds * (pick(sums, size) - head) + np.where(rest > 0, pick(sums, loop + rest) - head, 0)

    tri = lambda x: _turned(x, col["reach"])
    armed = np.maximum(0, i - col["lead"])
    if masked:
        passed, period = summed(m["mask"].cells), m["mask"].size[:, None]
        count = lambda k: k // period * pick(passed, period) + pick(passed, k % period)
        fired = count(col["phase"] + armed) - count(col["phase"])
    else:
        fired = (col["phase"] + armed) // col["dwell"]
    if mode == "read":
        return np.where(i < col["lead"], col["seed"], entry(col["start"] + fired))
    if mode in ("sum", "wrap"):
        out = col["seed"] + before(col["start"] + fired) - before(col["start"])
        return out & col["width"] if mode == "sum" else col["lo"] + (out - col["lo"]) % (col["hi"] - col["lo"])
    if mode == "held":
        each = entry(col["start"] + (col["phase"] + i) // col["dwell"])
        return (col["seed"] + pick(summed(each), armed)) & col["width"]
    if mode == "reflect":
        return (col["seed"] + col["rate"] * (tri(col["offset"] + fired) - tri(col["offset"]))) & col["width"]
    return (col["seed"] + tri(col["offset"] + fired * col["rate"])) >> col["frac"]


def _frames(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values of all frames of the machines of a batch one after another, and where each machine's begin (and the last ends).
    Machines of like length are run together, CELLS values at most at once."""
    length = np.maximum(0, np.asarray(b["length"], np.int64))
    at = np.concatenate([[0], np.cumsum(length)])
    flat, order, k = np.empty(at[-1], np.int64), np.argsort(-length, kind="stable"), 0
    while k < len(order) and (n := int(length[order[k]])):
        own = order[k : k + max(1, CELLS // n)]
        k += len(own)
        part = b.take(pa.array(own))
        m = {c: np.asarray(part[c], np.int64) for c in NUMBERS} | {c: padded(part[c]) for c in ("table", "mask")}
        made = run_all(m | {"mode": np.asarray(part["mode"].to_pylist(), object)}, n)
        i = np.arange(n)
        there = i < length[own][:, None]
        flat[(at[own][:, None] + i)[there]] = made[there]
    return flat, at


def _mapped(machines: DataFrame, keys: list[str], fields: list[str], out: str, make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    own = ", ".join(f"{c} {machines.schema[c].dataType.simpleString()}" for c in keys)
    return machines.select(*keys, *fields, "mode", "table", "mask", *NUMBERS).mapInArrow(lambda batches: map(make, batches), f"{own}, {out}")


def rendered(machines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, v: a row for each frame of each machine. machines: keys, start_frame, length, and the fields of a machine, whose
    first frame is start_frame. The frames of a machine are made at once, in Arrow batches."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = _frames(b)
        each = np.repeat(np.arange(b.num_rows), np.diff(at))
        place = np.asarray(b["start_frame"], np.int64)[each] + np.arange(len(flat)) - at[each]
        return pa.RecordBatch.from_arrays([*(b[c].take(pa.array(each)) for c in keys), pa.array(place), pa.array(flat)], [*keys, "i", "v"])

    return _mapped(machines, keys, ["start_frame", "length"], "i long, v long", make)


def digests(machines: DataFrame, keys: list[str], out: str = "digest") -> DataFrame:
    """keys, out: for each machine (as for rendered) the sum of its values, each times its place from 1 on."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = _frames(b)
        each = np.repeat(np.arange(b.num_rows), np.diff(at))
        place = np.asarray(b["start_frame"], np.int64)[each] + np.arange(len(flat)) - at[each] + 1
        total = np.concatenate([[0], np.cumsum(place * flat)])  # what goes over 64 bits goes round, and back in the difference
        return pa.RecordBatch.from_arrays([*(b[c] for c in keys), pa.array(np.diff(total[at]))], [*keys, out])

    return _mapped(machines, keys, ["start_frame", "length"], f"{out} long", make)


def sequences(machines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: all frames of each machine as one array."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = _frames(b)
        return pa.RecordBatch.from_arrays([*(b[c] for c in keys), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))], [*keys, "v"])

    return _mapped(machines, keys, ["length"], "v array<long>", make)


class _Columns:
    """What presets are made of, on columns; arrays are columns too."""

    div = staticmethod(lambda a, b: F.floor(a / b))
    mod = staticmethod(lambda a, b: F.pmod(a, F.lit(b) if isinstance(b, int) else b))
    low = staticmethod(lambda x: x.cast("long").bitwiseAND(MASK))
    most = staticmethod(lambda a, b: F.greatest(a, F.lit(b)))
    power = staticmethod(lambda x: F.pow(F.lit(2), x).cast("long"))
    size = staticmethod(F.size)
    number = staticmethod(lambda x, like: (F.lit(x) if isinstance(x, int) else x).cast("long"))
    row = staticmethod(lambda xs: F.array(*xs).cast("array<long>"))
    plus = staticmethod(lambda xs, x: F.transform(xs, lambda y: y + x).cast("array<long>"))
    first = staticmethod(lambda xs: F.element_at(xs, 1))
    mode = staticmethod(lambda name, like: F.lit(name))
    cells = staticmethod(lambda xs, like: (F.lit(None) if xs is None else xs).cast("array<long>"))
    looked_up = staticmethod(lambda xs, at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(xs, (at(k) + 1).cast("int")), F.lit(0).cast("long"))))


class _Arrays:
    """The same on arrays with an element for each row; arrays of rows are Rows."""

    div, mod, most = staticmethod(np.floor_divide), staticmethod(np.mod), staticmethod(np.maximum)
    low = staticmethod(lambda x: x & MASK)
    power = staticmethod(lambda x: 1 << x)
    size = staticmethod(lambda xs: xs.size)
    number = staticmethod(lambda x, like: np.broadcast_to(np.int64(x), like.shape) if isinstance(x, int) else x)
    row = staticmethod(lambda xs: Rows(np.stack(xs, 1), np.full(len(xs[0]), len(xs))))
    plus = staticmethod(lambda xs, x: Rows(xs.cells + x[:, None], xs.size))
    first = staticmethod(lambda xs: xs.cells[:, 0])
    mode = staticmethod(lambda name, like: np.full(like.shape, name, object))
    cells = staticmethod(lambda xs, like: Rows(np.zeros((len(like), 1), np.int64), np.zeros(len(like), np.int64)) if xs is None else xs)

    @staticmethod
    def looked_up(xs, at, n):
        k = np.stack([at(k) for k in range(n)], 1)
        own = np.take_along_axis(xs.cells, np.minimum(k, xs.cells.shape[1] - 1), 1)
        return Rows(np.where(k < xs.size[:, None], own, 0), np.full(len(k), n))


def preset(kind: str, p: dict, on: type = _Columns) -> dict:
    """The machine of a named kind. p: v0, rate, dwell, ctr0, lead, lo, hi, frac, parity (integers), table and mask (arrays), as in
    the closed forms of the kinds; columns, or arrays with an element for each row (on=_Arrays)."""
    v0, rate, dwell, ctr0, lead, lo, hi, table, mask = (p[x] for x in ("v0", "rate", "dwell", "ctr0", "lead", "lo", "hi", "table", "mask"))
    n, one = on.size(table), lambda x: on.row([on.number(x, v0)])
    scale = on.power(p["frac"])
    down, up = on.div(v0 - lo, rate), on.div(hi - v0, rate)
    reach = 2 + p["parity"] + 2 * ctr0
    stepped = {"phase": on.mod(ctr0, dwell), "start": on.mod(on.div(ctr0, dwell), n), "dwell": dwell, "table": table}
    glide = on.looked_up(table, lambda k: on.mod(ctr0 + rate * k, 256), 256) if kind == "glide" else None
    made = {
        "hold": lambda: {"mode": "read", "table": one(v0)},
        "accum": lambda: {"mode": "sum", "seed": v0, "table": one(rate)},
        "wrapaccum": lambda: {"mode": "wrap", "seed": v0, "table": one(rate), "lo": lo, "hi": hi},
        "dwell": lambda: {"mode": "sum", "seed": v0, "table": one(rate), "dwell": dwell, "lead": lead},
        "maskaccum": lambda: {"mode": "sum", "seed": v0, "table": one(rate), "mask": mask},
        "ratewalk": lambda: {"mode": "sum", "seed": v0, "table": table, "start": on.mod(ctr0, n)},
        "dwellratewalk": lambda: {"mode": "held", "seed": v0, **stepped},
        "tablewalk": lambda: {"mode": "read", "table": table, "start": on.mod(ctr0, n)},
        "tablewalk_lead": lambda: {"mode": "read", "seed": v0, "table": table, "start": on.mod(ctr0, n), "lead": lead},
        "arp": lambda: {"mode": "read", **stepped},
        "wavetable_ptr": lambda: {"mode": "read", "table": table, "start": on.mod(ctr0, n), "mask": mask},
        "glide": lambda: {"mode": "read", "table": glide, "seed": on.first(glide), "dwell": dwell, "lead": lead},
        "vibrato": lambda: {"mode": "read", "table": on.row([on.low(v0 + t * rate) for t in (0, 1, 2, 3, 3, 2, 1, 0)]), "start": on.mod(ctr0, 8)},
        "decay": lambda: {"mode": "sum", "seed": v0, "table": one(-rate), "dwell": dwell, "phase": on.mod(ctr0, dwell)},
        "pingpong": lambda: {"mode": "reflect", "seed": v0, "rate": rate, "dwell": dwell + 1, "phase": dwell, "offset": down, "reach": down + up},
        "pingfold": lambda: {"mode": "fold", "seed": lo * scale, "rate": rate, "frac": p["frac"], "offset": (v0 - lo) * scale, "reach": (hi - lo) * scale},
        "vibreflect": lambda: {"mode": "reflect", "seed": v0, "rate": rate, "lead": on.most(lead - 1, 0) - 1, "offset": on.div(reach - 1, 2) + 1, "reach": reach},
        "additive_pw": lambda: {"mode": "wrap", "seed": v0, "table": on.plus(mask, rate), "lo": on.div(v0, 256) * 256, "hi": on.div(v0, 256) * 256 + 256},
    }[kind]()
    out = {name: on.number(made.get(name, DEFAULTS[name]), v0) for name in NUMBERS}
    return out | {"mode": on.mode(made["mode"], v0), "table": on.cells(made.get("table", one(0)), v0), "mask": on.cells(made.get("mask"), v0)}


def _parameters(b: pa.RecordBatch) -> dict:
    """The parameters of the segments of a batch, for presets."""
    return {c: padded(b[c]) if pa.types.is_list(b[c].type) else np.asarray(b[c], np.int64) for c in b.schema.names if pa.types.is_list(b[c].type) or pa.types.is_integer(b[c].type)}


def preset_digests(segments: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key and a column for each kind: the sum of its values over dur frames, each times its place from 1 on. segments: key, dur and
    the parameters of presets. Frames of a batch are made together."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = max(1, int(np.max(np.asarray(whole["dur"], np.int64), initial=0)))
            for at in range(0, whole.num_rows, step := max(1, CELLS // n)):
                b = whole.slice(at, step)
                p, i = _parameters(b), np.arange(n)
                places = np.where(i < p["dur"][:, None], i + 1, 0)
                sums = [(run_all(preset(k, p, _Arrays), n) * places).sum(1) for k in kinds]
                yield pa.RecordBatch.from_arrays([b[key], *map(pa.array, sums)], [key, *kinds])

    return segments.mapInArrow(make, f"{key} {segments.schema[key].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in kinds))


def preset_sequences(segments: DataFrame, keys: list[str], kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """keys, v: dur frames of each segment as one array, by the preset that the column `kind` names, one of kinds."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, length = np.asarray(b[kind].to_pylist(), object), np.maximum(0, np.asarray(b["dur"], np.int64))
            at, n, p = np.concatenate([[0], np.cumsum(length)]), int(length.max(initial=0)), _parameters(b)
            flat, i, step = np.empty(at[-1], np.int64), np.arange(n), max(1, CELLS // max(1, n))
            for k in kinds:
                every = np.flatnonzero(names == k)
                for own in (every[j : j + step] for j in range(0, len(every), step)):
                    there = i < length[own][:, None]
                    flat[(at[own][:, None] + i)[there]] = run_all(preset(k, _picked(p, own), _Arrays), n)[there]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))], [*keys, "v"])

    own = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in keys)
    return segments.mapInArrow(make, f"{own}, v array<long>")


PRESETS = tuple("hold accum wrapaccum dwell maskaccum ratewalk dwellratewalk tablewalk tablewalk_lead arp wavetable_ptr glide vibrato decay pingpong pingfold vibreflect additive_pw".split())


def machines(segments: DataFrame, key: str, kind: str) -> DataFrame:
    """key, start_frame, length and the fields of the machines of one kind, from segments with its parameters and dur."""
    own = preset(kind, {c: F.col(c) for c in segments.columns})
    # In a struct, as a lambda would take an alias beside it for the parameter of the same name.
    made = F.struct(*(x.alias(n) for n, x in own.items())).alias("m")
    return segments.select(key, F.lit(0).cast("long").alias("start_frame"), F.col("dur").alias("length"), made).select(key, "start_frame", "length", "m.*")


# The other way round, on arrays of one segment.


def run(m: dict, n: int) -> np.ndarray:
    """The values of the first n frames."""
    i = np.arange(n)
    armed = np.maximum(0, i - m["lead"])
    table = np.asarray(m["table"], np.int64)
    loop = m["loop"]

    def entry(t):
        return table[np.where(t < len(table), t, loop + (t - loop) % (len(table) - loop))]

    def before(t):  # sums of the entries ahead of t, over the longest walk that is needed
        return np.concatenate([[0], np.cumsum(entry(np.arange(int(t.max(initial=0)) + 1)))])[t]

    if m["mask"] is not None:
        passed = np.concatenate([[0], np.cumsum(np.resize(np.asarray(m["mask"], np.int64), m["phase"] + n + 1))])
        fired = passed[m["phase"] + armed] - passed[m["phase"]]
    else:
        fired = (m["phase"] + armed) // m["dwell"]
    tri = lambda x: np.minimum(x % (2 * m["reach"]), 2 * m["reach"] - x % (2 * m["reach"]))
    start, mode = m["start"], m["mode"]
    if mode == "read":
        return np.where(i < m["lead"], m["seed"], entry(start + fired))
    if mode in ("sum", "wrap"):
        out = m["seed"] + before(start + fired) - before(np.array([start]))[0]
        return out & m["width"] if mode == "sum" else m["lo"] + (out - m["lo"]) % (m["hi"] - m["lo"])
    if mode == "held":
        each = entry(start + (m["phase"] + np.arange(n)) // m["dwell"])
        return (m["seed"] + np.concatenate([[0], np.cumsum(each)])[armed]) & m["width"]
    if mode == "reflect":
        return (m["seed"] + m["rate"] * (tri(m["offset"] + fired) - tri(np.int64(m["offset"])))) & m["width"]
    return (m["seed"] + tri(m["offset"] + fired * m["rate"])) >> m["frac"]


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the first on are equal."""
    wrong = np.flatnonzero(a != b)
    return int(wrong[0]) if len(wrong) else len(a)


def folded(x: np.ndarray) -> tuple[list[int], int] | None:
    """(table, loop): the sequence goes through the table and then round from loop on, for longer than by any other table of at most
    PERIOD entries, and for two rounds at least; the shortest table on ties."""
    best = None
    for head in range(min(HEAD, len(x)) + 1):
        own = x[head:]
        most = min(PERIOD, len(own) // 2)
        for p in (np.flatnonzero(own[1 : most + 1] == own[0]) + 1).tolist() if most else ():
            k = agreement(own[p:], own[:-p]) + p
            if k >= 2 * p and (best is None or (head + k, -head - p) > best[0]):
                best = ((head + k, -head - p), x[: head + p].tolist(), head)
            if k == len(own):  # longer tables and heads can't do better
                return best[1:]
    return best and best[1:]


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 32768) % 65536 - 32768


def guesses(v: np.ndarray) -> Iterator[dict]:
    """Machines that may have made the first frames of v."""
    make = lambda **f: DEFAULTS | {"table": [0], "mask": None} | f
    yield make(mode="read", table=[int(v[0])])
    change = np.flatnonzero(np.diff(v)) + 1
    if not len(change):
        return
    first, gaps = int(change[0]), np.diff(change[:CHANGES])
    dwells = {first} if not len(gaps) else set(np.gcd.accumulate(gaps).tolist()) | ({int(gaps[0])} if len(gaps) else set())
    counters = []
    for d in sorted(dwells):
        lead, phase = max(0, first - d), max(0, d - first)
        at = np.concatenate([[0], np.arange(first, len(v), d)])
        seen = v[at]
        if fold := folded(seen):
            yield make(mode="read", seed=int(v[0]), table=fold[0], loop=fold[1], dwell=d, phase=phase, lead=lead)
        if len(seen) > 2 and (fold := folded(seen[1:])):  # what is held before the table is not one of its entries
            yield make(mode="read", seed=int(v[0]), table=fold[0], loop=fold[1], dwell=d, lead=first)
        step = _signed(np.diff(seen))
        if fold := folded(step):
            yield make(mode="sum", seed=int(v[0]), table=fold[0], loop=fold[1], dwell=d, phase=phase, lead=lead)
        own = {"seed": int(v[0]), "dwell": d, "phase": phase, "lead": lead}
        yield from _reflected(seen, make(mode="reflect", **own))
        yield from _wrapped(seen, make(mode="wrap", **own))
        counters.append((seen, make(mode="fold", **own)))
    every = _signed(np.diff(v))
    turns = np.flatnonzero(np.diff(every)) + 1
    for d in sorted(set(np.gcd.accumulate(np.diff(turns[:CHANGES])).tolist())) if len(turns) > 1 else ():
        if d > 1 and (fold := folded(every[np.concatenate([[0], np.arange(turns[0], len(every), d)])])):
            yield make(mode="held", seed=int(v[0]), table=fold[0], loop=fold[1], dwell=d, phase=max(0, d - int(turns[0])), lead=max(0, int(turns[0]) - d))
    gate = (every != 0).astype(np.int64)
    moved = every[every != 0]
    clocks = [fold[0] for fold in [folded(gate)] if fold and fold[1] == 0]
    if clocks and (fold := folded(moved)):
        yield make(mode="sum", seed=int(v[0]), table=fold[0], loop=fold[1], mask=clocks[0])
    walked = np.concatenate([v[:1], v[change]])
    fold = folded(walked)
    if fold and len(set(fold[0])) >= 3:  # any clock at all, if what it walks through is a small table
        yield make(mode="read", seed=int(v[0]), table=fold[0], loop=fold[1], mask=clocks[0] if clocks else gate.tolist())
    for own in (*counters, (v, make(mode="fold"))):  # with a fraction, a value may stay though the clock fires
        yield from _fractions(*own)


def _reflected(seen: np.ndarray, m: dict) -> Iterator[dict]:
    """Equal steps up and down: the first two turning points tell the bounds."""
    step = _signed(np.diff(seen))
    rate = int(abs(step[0]))
    if not rate:
        return
    turn = np.flatnonzero(step != step[0])
    if not len(turn) or step[turn[0]] != -step[0]:
        return
    a = int(turn[0])  # steps to the first turning point
    back = np.flatnonzero(step[a:] == step[0])
    reach = int(back[0]) if len(back) else len(step) - a
    if a > reach:
        reach = a
    yield m | {"rate": rate, "reach": reach, "offset": reach - a if step[0] > 0 else reach + reach - a}


def _wrapped(seen: np.ndarray, m: dict) -> Iterator[dict]:
    """Steps of a table that differ by a span now and then: where the sum goes round. The span is the difference of two steps, the
    least value seen is a bound that will do."""
    d = np.diff(seen)
    spans = np.unique(np.abs(d[1:] - d[0]))
    span = int(spans[-1]) if len(spans) else 0  # the step that goes round differs most
    if len(d) < LEAST or span <= abs(int(d[0])):
        return
    for lo in dict.fromkeys((int(seen.min()), int(seen.max()) - span + 1)):
        if fold := folded((d - d[0]) % span + d[0]):
            yield m | {"table": fold[0], "loop": fold[1], "lo": lo, "hi": lo + span}
    # In a range of one byte, as the low byte of a pulse width takes its steps.
    if (seen >> 8 == seen[0] >> 8).all() and (fold := folded(d % 256)):
        lo = int(seen[0]) >> 8 << 8
        yield m | {"table": fold[0], "loop": fold[1], "lo": lo, "hi": lo + 256}


def _fractions(v: np.ndarray, m: dict) -> Iterator[dict]:
    """A counter with a fraction: for each number of bits, the values of the longest of the first runs in one direction bound the
    rate and the fraction at its start; the bounds lie at most a step beyond what is seen. From there it is counted back to frame 0.
    """
    d = np.sign(np.diff(v))
    moves = np.flatnonzero(d)
    turns = moves[1:][d[moves[1:]] != d[moves[:-1]]]  # the first step of each run but the first
    if not len(turns):
        return
    edges = [0, *turns[:4].tolist(), len(v) - 1][:5]
    at, end = max(zip(edges[:3], edges[1:4], strict=False), key=lambda e: e[1] - e[0])
    up = int(d[moves[moves >= at][0]])
    own = moves[(moves >= at) & (moves < end)]
    # The values at both ends may have been folded already.
    first, last = (int(own[0]) + 1 if at else 0), int(own[-1])
    k, rise = np.arange(1, last - first), v[first + 1 : last] - v[first]
    if len(k) < LEAST:
        return
    for frac in range(4):
        scale = 1 << frac
        slowest = max(1, int(np.ceil(((np.abs(rise) - 1) * scale + 1) / k).max()))
        fastest = int(np.floor(((np.abs(rise) + 1) * scale - 1) / k).min())
        for rate in range(slowest, fastest + 1):
            low = max(0, int((rise * scale - up * k * rate).max()))
            high = min(scale - 1, int((rise * scale + scale - 1 - up * k * rate).min()))
            for part in range(low, high + 1):
                for lo, hi in _bounds(v, edges, at, end, up, scale, lambda t, r=rate, p=part: int(v[first]) * scale + p + up * (t - first) * r):  # noqa: B023  used at once
                    place, reach = (int(v[first]) - lo) * scale + part, (hi - lo) * scale
                    if 0 <= place <= reach > 0:
                        offset = (place if up > 0 else 2 * reach - place) - first * rate
                        yield m | {"seed": lo * scale, "rate": rate, "frac": frac, "reach": reach, "offset": offset % (2 * reach)}


def _bounds(v: np.ndarray, edges: list[int], at: int, end: int, up: int, scale: int, straight) -> Iterator[tuple[int, int]]:
    """Bounds of a counter whose count in one run, at..end, is told by straight(frame). In the middle of the run after it, what is
    seen and what the run would have come to lie as far from the bound on both sides; likewise before it."""
    k = edges.index(at)
    middle = lambda a, late=1: (edges[a] + edges[a + 1] + late) // 2

    def mirrored(t: int, count: int) -> list[int]:
        seen = int(v[t]) * scale
        return list(range(-(-(seen + count) // (2 * scale)), (seen + scale - 1 + count) // (2 * scale) + 1))

    after = mirrored(t := middle(k + 1), straight(t)) if k + 2 < len(edges) else []
    ahead = mirrored(t := middle(k - 1, 0), straight(t)) if k else []
    # A bound that is not met in the runs beside is that of an earlier run, or beyond what is seen.
    high, low = [int(v.max()), int(v.max()) + 1], [int(v.min()), int(v.min()) - 1]
    for near in after or (high if up > 0 else low):
        far = ahead
        if not far and after and k + 3 < len(edges):  # two runs on, folded at both bounds
            far = mirrored(t := middle(k + 2), 2 * near * scale - straight(t))
        for other in far or (low if up > 0 else high):
            yield (other, near) if up > 0 else (near, other)


def cost(m: dict) -> int:
    """Numbers that tell a machine."""
    return len(m["table"]) + len(m["mask"] or ()) + sum(m[n] != DEFAULTS[n] for n in NUMBERS)


def first_machine(v: np.ndarray) -> tuple[int, dict]:
    """The machine that is right for longest from the first frame on, and for how long; the one told by fewest numbers on ties, then
    the first guess. A machine that takes more numbers than the frames it explains is none; a held value always is one."""
    best = None
    for k, m in enumerate(guesses(v)):
        n = agreement(run(m, len(v)), v)
        told = cost(m)
        if (n > told or k == 0) and (best is None or (n, -told) > best[0]):
            best = ((n, -told), m)
    return best[0][0], best[1]


def pieces(v: np.ndarray) -> list[tuple[int, int, dict]]:
    """(start, length, machine) until the segment is used up: at each place the machine that lasts longest."""
    out, at = [], 0
    while at < len(v):
        n, m = first_machine(v[at:])
        out.append((at, n, m))
        at += n
    return out


# The same for segments of equal length side by side, but only machines that explain all frames.


class _Best:
    """The machine told by fewest numbers for each of many segments, the first on ties. A machine of a segment is taken for right."""

    def __init__(self, v: np.ndarray):
        n = len(v)
        self.frames, self.cost = v.shape[1], np.full(n, np.iinfo(np.int64).max)
        self.m = {c: np.full(n, DEFAULTS[c], np.int64) for c in NUMBERS} | {"mode": np.full(n, None, object)}
        self.m |= {c: Rows(np.zeros((n, w), np.int64), np.zeros(n, np.int64)) for c, w in (("table", PERIOD + HEAD), ("mask", PERIOD))}

    def cheaper(self, own: np.ndarray, told: np.ndarray) -> np.ndarray:
        return (told < self.cost[own]) & (told < self.frames)

    def put(self, own: np.ndarray, mode: str, table: np.ndarray, size: np.ndarray, mask: np.ndarray | None = None, period: np.ndarray | None = None, always: bool = False, **numbers) -> None:
        """Machines of the segments `own`; table and mask are cut to their sizes."""
        told = size + sum((x != DEFAULTS[k]) * 1 for k, x in numbers.items()) + (0 if mask is None else period)
        take = np.flatnonzero(self.cheaper(own, told) | always)
        if not len(take):
            return
        to = own[take]
        self.cost[to], self.m["mode"][to] = told[take], mode
        for k in NUMBERS:
            x = numbers.get(k, DEFAULTS[k])
            self.m[k][to] = x[take] if isinstance(x, np.ndarray) else x
        for rows, cells, n in ((self.m["table"], table, size), (self.m["mask"], mask, period)):
            rows.cells[to], rows.size[to] = 0, 0
            if cells is not None:
                w = min(cells.shape[1], rows.cells.shape[1])
                rows.cells[to, :w] = np.where(np.arange(w) < n[take][:, None], cells[take, :w], 0)
                rows.size[to] = n[take]


def folded_whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of the table, loop) for each row that folded() takes as a whole; size 0 for the others."""
    n, length = x.shape
    none = 1 << 20
    key = np.full(n, none)
    left = np.arange(n)
    for p in range(1, min(PERIOD, length // 2) + 1):
        left = left[key[left] >= 64]  # a table without a head can't be bettered by a longer one
        own = left[x[left, -1] == x[left, -1 - p]]
        if len(own):
            off = x[own, p:] != x[own, :-p]
            head = np.where(off.any(1), off.shape[1] - np.argmax(off[:, ::-1], 1), 0)
            good = (head <= HEAD) & (2 * p <= length - head)
            key[own[good]] = np.minimum(key[own[good]], head[good] * 64 + p)
    return np.where(key < none, key // 64 + key % 64, 0), np.where(key < none, key // 64, 0)


def _places(hit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first so many places of each row that are hit, and how many there are of them."""
    r, c = np.nonzero(hit)
    n = hit.sum(1)
    rank = np.arange(len(r)) - np.concatenate([[0], np.cumsum(n)])[r]
    out = np.zeros((len(hit), most), np.int64)
    out[r[rank < most], rank[rank < most]] = c[rank < most]
    return out, np.minimum(n, most)


def _divisor(places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The greatest common divisor of the distances between the first n places of each row; 0 if there is but one."""
    steps = np.where(np.arange(1, places.shape[1]) < n[:, None], np.diff(places, axis=1), 0)
    return np.gcd.reduce(steps, axis=1, initial=0)


def whole_machines(v: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """For each row the machine that first_machine gives, where it explains all frames: (which rows have one, machines as for
    run_all, their costs). A clock, a table or a mask that fails anywhere can't explain all frames, so each has one candidate for each way
    of telling it: the divisor of all distances, the table that the whole sequence folds to."""
    rows, frames = v.shape
    best = _Best(v)
    change = v[:, 1:] != v[:, :-1]
    held = np.flatnonzero(~change.any(1))
    best.put(held, "read", v[held, :1], np.ones(len(held), np.int64), always=True)
    own = np.flatnonzero(change.any(1))
    if not len(own):
        return best.cost < np.iinfo(np.int64).max, best.m, best.cost
    v0, places = v[own, 0], _places(change[own], CHANGES)
    first, clock = places[0][:, 0] + 1, _divisor(*places)
    clock = np.where(clock > 0, clock, first)
    low = ((v[own] >= 0) & (v[own] <= MASK)).all(1)
    counters = []
    for key in np.unique(clock * frames + first).tolist():
        d, f = divmod(key, frames)
        at = np.concatenate([[0], np.arange(f, frames, d)])
        here = np.flatnonzero(clock * frames + first == key)
        off = np.ones(frames - 1, bool)
        off[at[1:] - 1] = False
        here = here[~change[own[here]][:, off].any(1)]
        if len(here):
            told = {"dwell": d, "phase": max(0, d - f), "lead": max(0, f - d)}
            seen = v[own[here]][:, at]
            _clocked(best, own[here], seen, low[here], f, told)
            counters.append((own[here], seen, told))
    more = np.flatnonzero(best.cheaper(own, 2 + (v0 != 0)))  # what both tell at least
    _held_each(best, own[more], v[own[more]], low[more])
    _gated(best, own[more], v[own[more]], change[own[more]], low[more])
    for mine, seen, told in counters:
        _counted(best, mine, seen, told)
    other = np.flatnonzero((clock != 1) | (first != 1))  # else that was the same
    _counted(best, own[other], v[own[other]], {})
    good = best.cost < np.iinfo(np.int64).max
    good[good] = (run_all(_picked(best.m, np.flatnonzero(good)), frames) == v[good]).all(1)
    return good, best.m, best.cost


def _clocked(best: _Best, own: np.ndarray, seen: np.ndarray, low: np.ndarray, first: int, told: dict) -> None:
    """Tables, steps, counters that turn and sums that go round, read where the clock fires."""

    def put(mode: str, x: np.ndarray, right: np.ndarray, **numbers) -> None:
        mine = np.flatnonzero(right)
        if len(mine) and x.shape[1]:
            size, loop = folded_whole(x[mine])
            hit = size > 0
            mine, size = mine[hit], size[hit]
            numbers = {k: n[mine] if isinstance(n, np.ndarray) else n for k, n in numbers.items()}
            best.put(own[mine], mode, x[mine], size, **{"seed": seen[mine, 0], "loop": loop[hit], **told, **numbers})

    all_rows = np.ones(len(own), bool)
    put("read", seen, all_rows)
    if seen.shape[1] > 2:
        put("read", seen[:, 1:], all_rows, phase=0, lead=first)
    d = np.diff(seen, axis=1)
    step = _signed(d)
    put("sum", step, low)
    # Equal steps up and down.
    rate, other = np.abs(step[:, 0]), step != step[:, :1]
    a = np.argmax(other, 1)
    turned = low & (rate > 0) & other.any(1) & (step[np.arange(len(a)), a] == -step[:, 0])
    back = ~other & (np.arange(step.shape[1]) >= a[:, None])
    reach = np.where(back.any(1), np.argmax(back, 1), step.shape[1]) - a
    reach = np.maximum(a, reach)
    offset = np.where(step[:, 0] > 0, reach - a, 2 * reach - a)
    mine = np.flatnonzero(turned)
    col = lambda x: x[mine][:, None]
    made = col(seen[:, 0]) + col(rate) * (_turned(col(offset) + np.arange(seen.shape[1]), col(reach)) - _turned(col(offset), col(reach)))
    mine = mine[((made & MASK) == seen[mine]).all(1)]
    best.put(own[mine], "reflect", np.zeros((len(mine), 1), np.int64), np.ones(len(mine), np.int64), seed=seen[mine, 0], rate=rate[mine], reach=reach[mine], offset=offset[mine], **told)
    # Steps of a table that differ by a span now and then.
    if d.shape[1] >= LEAST:
        span, least, most = np.abs(d[:, 1:] - d[:, :1]).max(1), seen.min(1), seen.max(1)
        right = (span > np.abs(d[:, 0])) & (most - least < span)
        steps = (d - d[:, :1]) % np.maximum(span, 1)[:, None] + d[:, :1]
        for lo in (least, most - span + 1):
            put("wrap", steps, right, lo=lo, hi=lo + span)
        lo = seen[:, 0] >> 8 << 8
        put("wrap", d % 256, (span > np.abs(d[:, 0])) & (seen >> 8 == seen[:, :1] >> 8).all(1), lo=lo, hi=lo + 256)


def _held_each(best: _Best, own: np.ndarray, v: np.ndarray, low: np.ndarray) -> None:
    """Steps that are made in each frame and change where the clock fires."""
    every = _signed(np.diff(v, axis=1))
    turns = every[:, 1:] != every[:, :-1]
    places, n = _places(turns, CHANGES)
    clock, first = _divisor(places, n), places[:, 0] + 1
    frames = v.shape[1]
    right = low & (clock > 1)
    for key in np.unique((clock * frames + first)[right]).tolist():
        d, f = divmod(key, frames)
        here = np.flatnonzero(right & (clock == d) & (first == f))
        off = np.ones(turns.shape[1], bool)
        off[f - 1 :: d] = False
        lead = max(0, f - d)
        here = here[~turns[here][:, off].any(1) & ((lead == 0) | (every[here, 0] == 0))]
        steps = every[here][:, np.concatenate([[0], np.arange(f, every.shape[1], d)])]
        size, loop = folded_whole(steps)
        hit = np.flatnonzero(size)
        best.put(own[here[hit]], "held", steps[hit], size[hit], seed=v[here[hit], 0], loop=loop[hit], dwell=d, phase=max(0, d - f), lead=lead)


def _gated(best: _Best, own: np.ndarray, v: np.ndarray, change: np.ndarray, low: np.ndarray) -> None:
    """Steps, and tables, that a periodic mask moves on."""
    period, loop = folded_whole(change.astype(np.int64))
    here = np.flatnonzero((period > 0) & (loop == 0))
    n = change[here].sum(1)
    for k in np.unique(n).tolist():
        mine = here[n == k]
        gate, seed = change[mine].astype(np.int64), v[mine, 0]
        walked = np.concatenate([v[mine, :1], v[mine, 1:][change[mine]].reshape(-1, k)], 1)
        for mode, x in (("sum", _signed(np.diff(walked, axis=1))), ("read", walked)):
            size, loop = folded_whole(x)
            right = (size > 0) & (low[mine] | (mode == "read"))
            if mode == "read":  # of three entries at least
                cells = np.sort(np.where(np.arange(x.shape[1]) < size[:, None], x, x[:, :1]), 1)
                right &= (np.diff(cells, axis=1) != 0).sum(1) >= 2
            hit = np.flatnonzero(right)
            best.put(own[mine[hit]], mode, x[hit], size[hit], gate[hit], period[mine[hit]], seed=seed[hit], loop=loop[hit])


def _counted(best: _Best, own: np.ndarray, v: np.ndarray, told: dict) -> None:
    """Counters with a fraction, by the bounds and rates that _fractions goes through; those told by more numbers than the best
    machine so far are not run."""
    length, fixed = v.shape[1], 2 + sum(x != DEFAULTS[k] for k, x in told.items())
    if length < LEAST + 2:
        return
    mine = np.flatnonzero(best.cheaper(own, np.full(len(own), fixed)))  # any machine takes a table and a rate
    v, own = v[mine], own[mine]
    d = np.diff(v, axis=1)
    most, least = d.max(1, initial=0), d.min(1, initial=0)
    mine = np.flatnonzero((most > 0) & (least < 0))
    v, own, sign, jump = v[mine], own[mine], np.sign(d[mine]), np.maximum(most, -least)[mine]
    cols = np.arange(length - 1)
    known = np.maximum.accumulate(np.where(sign != 0, cols, -1), axis=1)
    before = np.concatenate([np.zeros((len(v), 1), np.int64), np.where(known[:, :-1] >= 0, np.take_along_axis(sign, np.maximum(known[:, :-1], 0), 1), 0)], 1)
    turns, n = _places((sign != 0) & (before != 0) & (sign != before), 4)
    edges = np.concatenate([np.zeros((len(v), 1), np.int64), np.where(np.arange(4) < n[:, None], turns, length - 1)], 1)
    count = np.minimum(n + 2, 5)
    spans = np.where(np.arange(1, 4) < count[:, None], edges[:, 1:4] - edges[:, :3], -1)
    k = np.argmax(spans, 1)
    row = np.arange(len(v))
    at, end = edges[row, k], edges[row, k + 1]
    run = (sign != 0) & (cols >= at[:, None]) & (cols < end[:, None])
    up = sign[row, np.argmax(run, 1)]
    first = np.where(at > 0, np.argmax(run, 1) + 1, 0)
    last = run.shape[1] - 1 - np.argmax(run[:, ::-1], 1)
    rise1 = np.abs(v[row, np.minimum(first + 1, length - 1)] - v[row, first])
    ok = np.flatnonzero((last - first - 1 >= LEAST) & (jump <= rise1 + 1))  # the first step bounds all others
    if not len(ok):
        return
    v, own, edges, count, k, up, first, last, jump = v[ok], own[ok], edges[ok], count[ok], k[ok], up[ok], first[ok], last[ok], jump[ok]
    # What else a right machine must tell: it turns within a step of its bounds, or they are the least and the greatest value.
    seeded, wide = v.min(1) > jump + 3, v.max(1) - v.min(1) > 1
    row, start = np.arange(len(v)), v[np.arange(len(v)), first]
    steps = np.arange(1, max(2, int((last - first).max())))
    there = steps < (last - first)[:, None]
    rise = np.where(there, np.take_along_axis(v, np.minimum(first[:, None] + steps, length - 1), 1) - start[:, None], 0)
    for frac in range(4):
        scale = 1 << frac
        some = np.flatnonzero(best.cheaper(own, fixed + seeded + (wide if frac == 0 else 2)))
        size = np.abs(rise[some])
        slowest = np.maximum(1, np.where(there[some], -(-((size - 1) * scale + 1) // steps), 1).max(1, initial=1))
        fastest = np.where(there[some], ((size + 1) * scale - 1) // steps, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        each = []
        for more in range(int((fastest - slowest).max(initial=-1)) + 1):
            go = np.flatnonzero(slowest + more <= fastest)
            go, rate = some[go], (slowest + more)[go]
            drift = rise[go] * scale - (up[go] * rate)[:, None] * steps
            low = np.maximum(0, np.where(there[go], drift, 0).max(1))
            high = np.minimum(scale - 1, np.where(there[go], drift + scale - 1, scale - 1).min(1))
            for part in range(scale):
                sub = np.flatnonzero((low <= part) & (part <= high))
                each.append(np.stack([go[sub], rate[sub], np.full(len(sub), part)]))
        if not each:
            continue
        r, rate, part = np.concatenate(each, 1)
        right = []
        for lo, hi in _bounds_each(v, r, edges[r], count[r], k[r], up[r], lambda t: start[r] * scale + part + up[r] * (t - first[r]) * rate, scale):  # noqa: B023  used at once
            place, reach = (start[r] - lo) * scale + part, (hi - lo) * scale
            offset = (np.where(up[r] > 0, place, 2 * reach - place) - first[r] * rate) % np.maximum(2 * reach, 1)
            told_by = fixed + (lo != 0) + (reach != 1) + (offset != 0) + (frac > 0)
            can = np.flatnonzero((place >= 0) & (place <= reach) & (reach > 0) & best.cheaper(own[r], told_by))
            for i in (np.arange(0, length, 7), np.arange(length)):  # a few frames tell most that are wrong
                c = lambda x: x[can][:, None]  # noqa: B023, E731  used at once
                made = (c(lo) * scale + _turned(c(offset) + i * c(rate), c(reach))) >> frac
                can = can[(made == v[r[can]][:, i]).all(1)]
            right.append(np.stack([r[can], told_by[can], can, lo[can], rate[can], reach[can], offset[can]]))
        found = np.concatenate(right, 1)
        found = found[:, np.lexsort((found[2], found[1], found[0]))]  # of one row the cheapest, then the first
        i, _, _, lo, rate, reach, offset = found[:, np.concatenate([[True], np.diff(found[0]) > 0])[: found.shape[1]]]
        best.put(own[i], "fold", np.zeros((len(i), 1), np.int64), np.ones(len(i), np.int64), seed=lo * scale, rate=rate, frac=frac, reach=reach, offset=offset, **told)


def _bounds_each(v, row, edges, count, k, up, straight, scale) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_bounds for many places of v (row): all pairs that it gives, one of each at a time; bounds that do not fit where there are
    fewer."""
    every = np.arange(len(row))
    edge = lambda j: edges[every, np.clip(j, 0, edges.shape[1] - 1)]
    middle = lambda j, late=1: (edge(j) + edge(j + 1) + late) // 2

    def mirrored(t, line, there):
        seen = v[row, t] * scale
        a, b = -(-(seen + line) // (2 * scale)), (seen + scale - 1 + line) // (2 * scale)
        return a, there & (a <= b)

    t = middle(k + 1)
    after, has_after = mirrored(t, straight(t), k + 2 < count)
    t = middle(k - 1, 0)
    ahead, has_ahead = mirrored(t, straight(t), k > 0)
    most, least = v.max(1)[row], v.min(1)[row]
    beyond = lambda j, far: np.where((up > 0) == far, most + j, least - j)
    t = middle(k + 2)
    for j in range(2):
        near, has_near = (np.where(has_after, after, beyond(0, True)), True) if j == 0 else (beyond(1, True), ~has_after)
        later, has_later = mirrored(t, 2 * near * scale - straight(t), ~has_ahead & has_after & (k + 3 < count))
        far, has_far = np.where(has_ahead, ahead, later), has_ahead | has_later
        for i in range(2):
            other = np.where(has_far, far, beyond(i, False))
            there = has_near & (~has_far if i else True)
            lo, hi = np.where(up > 0, other, near), np.where(up > 0, near, other)
            yield np.where(there, lo, 0), np.where(there, hi, 0)


def _lists(rows: Rows, null: bool) -> pa.Array:
    """A column of arrays; those without cells are null, if null is set."""
    at = np.concatenate([[0], np.cumsum(rows.size)]).astype(np.int32)
    flat = pa.array(rows.cells[np.arange(rows.cells.shape[1]) < rows.size[:, None]])
    return pa.ListArray.from_arrays(pa.array(at), flat, mask=pa.array(rows.size == 0) if null else None)


def _machines_of(segments: list[np.ndarray]) -> Iterator[tuple[np.ndarray, dict]]:
    """(segments, columns) until all pieces of all segments are told, as pieces() gives them. Segments of equal length are worked on
    side by side, and so is what is left of them."""
    todo, lone = {}, []
    for k, x in enumerate(segments):
        todo.setdefault(len(x), []).append((k, 0, 0))

    def told(k: int, piece: int, at: int, n: int, m: dict) -> None:
        lone.append((k, {"piece": piece, "start_frame": at, "length": n, "cost": cost(m)} | m))

    while todo:
        n = max(todo)
        own = todo.pop(n)
        if len(own) < TOGETHER or n < 2:
            for k, piece, at in own:
                for j, (start, length, m) in enumerate(pieces(segments[k][at:])):
                    told(k, piece + j, at + start, length, m)
            continue
        step = max(TOGETHER, CELLS // n)
        for some in (own[j : j + step] for j in range(0, len(own), step)):
            good, found, costs = whole_machines(np.stack([segments[k][at:] for k, _, at in some]))
            hit = np.flatnonzero(good)
            if len(hit):
                k, piece, at = np.array(some, np.int64)[hit].T
                found = _picked(found, hit)
                cols = {"piece": piece, "start_frame": at, "length": np.full(len(hit), n), "cost": costs[hit], **found}
                yield k, cols | {"mode": found["mode"].tolist(), "table": _lists(found["table"], False), "mask": _lists(found["mask"], True)}
            for k, piece, at in (some[j] for j in np.flatnonzero(~good)):
                length, m = first_machine(segments[k][at:])
                told(k, piece, at, length, m)
                if length < n:
                    todo.setdefault(n - length, []).append((k, piece + 1, at + length))
    if lone:
        yield np.array([k for k, _ in lone]), {c: [m[c] for _, m in lone] for c in lone[0][1]}


def dealt(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments take few bytes and some time, so they are dealt to many tasks, whatever the files they come from."""
    spark = segments.sparkSession
    return segments.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def fitted(segments: DataFrame, keys: list[str], values: str = "v", deal: bool = True) -> DataFrame:
    """keys, piece, start_frame, length, cost and the fields of the machines that make each segment (an array of integers) one after
    another. Null and empty arrays give no rows. A segment is one row; segments are worked on in parallel. deal: whether they are
    still to be dealt to tasks."""
    kinds = {"piece": pa.int64(), "start_frame": pa.int64(), "length": pa.int64(), "cost": pa.int64(), "mode": pa.string(), "table": pa.list_(pa.int64()), "mask": pa.list_(pa.int64())} | {n: pa.int64() for n in NUMBERS}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = b[values]
            size = np.asarray(xs.value_lengths().fill_null(0), np.int64)
            own = np.flatnonzero(size)
            flat = xs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            found = _machines_of(np.split(flat, np.cumsum(size[own])[:-1]) if len(own) else [])
            for each, cols in found:
                index = pa.array(own[each])
                yield pa.RecordBatch.from_arrays([*(b[c].take(index) for c in keys), *(pa.array(cols[c], t) for c, t in kinds.items())], [*keys, *kinds])

    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    own = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in keys)
    rows = segments.select(*keys, F.col(values).cast("array<long>").alias(values))
    return (dealt(rows, keys) if deal else rows).mapInArrow(fit, f"{own}, " + ", ".join(f"{n} {names[t]}" for n, t in kinds.items()))
