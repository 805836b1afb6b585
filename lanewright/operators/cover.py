"""Shortest covers: the segmentation of a lane with the fewest tokens, by dynamic programming over places.

Pieces are held values, ramps and table walks; a piece may be any prefix of a longest run, so the recurrence is over all places
of a block. A block of a lane is one group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .compression import BLOCK, _grouped, digits, folded

#: Periods that a table walk may have.
PERIODS = (2, 3, 4, 6, 8)


def runs_of(v: np.ndarray, lag: int) -> np.ndarray:
    """For each place, how many frames from it on repeat what is `lag` frames earlier within the run, counting the first `lag`."""
    n = len(v)
    out = np.ones(n, np.int64) if lag == 1 else np.full(n, lag, np.int64)
    same = np.zeros(n, bool)
    same[: max(0, n - lag)] = v[lag:] == v[: n - lag]
    count = 0
    for i in range(n - 1, -1, -1):
        count = count + 1 if same[i] else 0
        out[i] = count + lag
    return np.minimum(out, n - np.arange(n))


def cover(v: np.ndarray) -> list[tuple[str, int, int, int, list[int]]]:
    """(op, start, length, step, values), as lane programs, with the fewest tokens: each piece costs one token and the digits of
    its length, values and step. Of equal costs the longest piece is taken, and held values before ramps before walks."""
    v = np.asarray(v, np.int64)
    n = len(v)
    held = runs_of(v, 1)
    step = np.append(np.diff(v), 0)
    ramp = np.minimum(runs_of(step[: n - 1], 1) + 1, n - np.arange(n - 1)) if n > 1 else np.zeros(0, np.int64)
    ramp = np.append(ramp, 1)
    walks = {p: runs_of(v, p) for p in PERIODS if 2 * p <= n}
    value, sizes = digits(folded(v)), digits(np.arange(n + 1))
    before = np.concatenate([[0], np.cumsum(value)])
    best, choice = np.zeros(n + 1, np.int64), [("", 0)] * n
    for i in range(n - 1, -1, -1):
        options = []
        for name, longest, least, cost in (
            ("hold", int(held[i]), 1, int(value[i])),
            ("ramp", int(ramp[i]) if step[i] else 0, 3, int(value[i] + digits(folded(step[i])))),
            *((f"walk{p}", int(w[i]), 2 * p, int(before[i + p] - before[i])) for p, w in walks.items() if i + p <= n),
        ):
            if longest >= least:
                lengths = np.arange(least, longest + 1)
                total = 1 + sizes[lengths] + cost + best[i + lengths]
                k = len(total) - 1 - int(total[::-1].argmin())
                options.append((int(total[k]), name, int(lengths[k])))
        best[i], name, length = min(options, key=lambda o: (o[0], -o[2]))
        choice[i] = (name, length)
    out, i = [], 0
    while i < n:
        name, length = choice[i]
        if name.startswith("walk"):
            out.append(("period", i, length, 0, v[i : i + int(name[4:])].tolist()))
        else:
            out.append((name, i, length, int(step[i]) if name == "ramp" else 0, [int(v[i])]))
        i += length
    return out


def cover_lanes(lane: DataFrame, block: int = BLOCK) -> DataFrame:
    """tune_id, lane, block, op, start, length, step, values: the cheapest cover of each block of each lane."""
    return _grouped(lane, block, cover, "op string, start long, length long, step long, values array<bigint>")
