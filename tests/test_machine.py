"""The general generator against a loop over its state, and its inversion."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.operators import machine
from lanewright.operators.machine import DEFAULTS, agreement, first_machine, folded, pieces, run


def stepped(m, n):
    """Frame by frame, with the state that the machine has."""
    out, value, pointer, count = [], m["seed"], m["start"], m["phase"]
    place, up = m["offset"] % (2 * m["reach"]), 1
    if place > m["reach"]:
        place, up = 2 * m["reach"] - place, -1
    first = place
    armed_before = max(0, -m["lead"])
    for i in range(-armed_before, n):
        if i >= 0:
            if m["mode"] == "read":
                out.append(m["seed"] if i < m["lead"] else m["table"][pointer])
            elif m["mode"] == "reflect":
                out.append((m["seed"] + m["rate"] * (place - first)) & m["width"])
            elif m["mode"] == "fold":
                out.append((m["seed"] + place) >> m["frac"])
            elif m["mode"] == "wrap":
                out.append(m["lo"] + (value - m["lo"]) % (m["hi"] - m["lo"]))
            else:
                out.append(value & m["width"])
        if i < m["lead"]:
            continue
        fires = m["mask"][count % len(m["mask"])] if m["mask"] else (count + 1) % m["dwell"] == 0
        count += 1
        if m["mode"] == "held" or (fires and m["mode"] in ("sum", "wrap")):
            value += m["table"][pointer]
        if fires:
            pointer = pointer + 1 if pointer + 1 < len(m["table"]) else m["loop"]
            for _ in range(m["rate"] if m["mode"] == "fold" else 1):
                if place == m["reach"]:
                    up = -1
                elif place == 0:
                    up = 1
                place += up
    return out


def invented(rng, mode=None):
    n = rng.randrange(1, 7)
    m = DEFAULTS | {"mode": mode or rng.choice(["read", "sum", "held", "wrap", "reflect", "fold"]), "mask": None, "table": [rng.randrange(-300, 300) for _ in range(n)]}
    m |= {"seed": rng.randrange(2000, 3000), "dwell": rng.randrange(1, 5), "lead": rng.randrange(0, 5), "start": rng.randrange(n), "loop": rng.randrange(n)}
    m["phase"] = rng.randrange(m["dwell"])
    if rng.random() < 0.3 and m["mode"] != "held":
        m |= {"mask": [rng.randrange(2) for _ in range(rng.randrange(1, 6))] + [1], "phase": 0, "dwell": 1}
    if m["mode"] == "wrap":
        m |= {"lo": 2000, "hi": 3000}
    if m["mode"] in ("reflect", "fold"):
        m |= {"reach": rng.randrange(2, 40), "rate": rng.randrange(1, 9), "frac": rng.randrange(3) if m["mode"] == "fold" else 0}
        if m["mode"] == "fold":  # bounds are whole values
            m |= {"seed": m["seed"] << m["frac"], "reach": rng.randrange(2, 12) + 4 << m["frac"]}
        m["offset"] = rng.randrange(2 * m["reach"])
    return m


def test_closed_forms_are_those_of_the_state(spark):
    rng = random.Random(1)
    made = [invented(rng) for _ in range(400)]
    for m in made:
        assert run(m, 60).tolist() == stepped(m, 60), m
    schema = "k long, start_frame long, length long, mode string, table array<long>, mask array<long>, " + ", ".join(f"{n} long" for n in machine.NUMBERS)
    rows = [(k, 5, k % 40, m["mode"], m["table"], m["mask"], *(m[n] for n in machine.NUMBERS)) for k, m in enumerate(made)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r["k"], r["i"]): r["v"] for r in machine.rendered(frame, ["k"]).collect()}
    columns = frame.filter("length > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)))
    columns = columns.select("k", "i", machine.values(F.col("i"), {c: F.col(c) for c in ("mode", "table", "mask", *machine.NUMBERS)}).alias("v"))
    assert {(r["k"], 5 + r["i"]): r["v"] for r in columns.collect()} == got
    assert got == {(k, 5 + i): v for k, m in enumerate(made) for i, v in enumerate(stepped(m, k % 40))}


def test_folding():
    assert folded(np.array([1, 2, 3, 1, 2, 3, 1])) == ([1, 2, 3], 0)
    assert folded(np.array([9, 8, 1, 2, 1, 2, 1])) == ([9, 8, 1, 2], 2)
    assert folded(np.array([1, 2, 3, 4])) is None and folded(np.array([], int)) is None
    assert folded(np.array([5, 5, 5, 5])) == ([5], 0)


@pytest.mark.parametrize("mode", ["read", "sum", "held", "wrap", "reflect", "fold"])
def test_machines_are_found_again(mode):
    """Of machines that run long enough to show themselves, nearly all are found whole; never is less found than a held value."""
    rng = random.Random(mode)
    whole = total = 0
    for _ in range(150):
        m = invented(rng, mode)
        if mode in ("wrap", "reflect", "fold"):
            m |= {"mask": None, "table": [rng.randrange(1, 60)], "loop": 0, "start": 0}
        if mode == "fold":
            m |= {"dwell": 1, "phase": 0, "lead": 0}
        v = np.array(stepped(m, 240))
        n, found = first_machine(v)
        assert n == agreement(run(found, len(v)), v) >= 1
        total += 1
        whole += n == len(v)
    assert whole >= 0.9 * total, (mode, whole, total)


def test_whole_machines_are_those_of_the_plain_search():
    """Side by side, the same machine is found for each segment that one machine explains, and none for the others."""
    rng = random.Random(11)
    for n in (30, 61):
        made = [invented(rng, mode) for mode in ("read", "sum", "held", "wrap", "reflect", "fold") * 12]
        made += [m | {"mask": None, "table": [rng.randrange(1, 60)], "loop": 0, "start": 0, "dwell": 1, "phase": 0, "lead": 0} for m in made]
        v = np.array([stepped(m, n) for m in made] + [[7] * n] + [[rng.randrange(3) for _ in range(n)] for _ in range(8)])
        good, found, costs = machine.whole_machines(v)
        assert good.sum() > 60
        for j, own in enumerate(v):
            length, want = first_machine(own)
            assert good[j] == (length == n), (j, want)
            if good[j]:
                got = {k: x[j] for k, x in found.items() if k not in ("table", "mask")} | {k: found[k].cells[j, : found[k].size[j]].tolist() for k in ("table", "mask")}
                assert got | {"mask": got["mask"] or None} == want and costs[j] == machine.cost(want)
    several = [*v[:40]] + [np.concatenate([a, b]) for a, b in zip(v[40:60], v[60:80], strict=True)] + [np.array([5])]
    got = {}
    for each, cols in machine._machines_of(several):
        columns = {c: x.to_pylist() if hasattr(x, "to_pylist") else list(x) for c, x in cols.items()}
        for i, k in enumerate(each.tolist()):
            got.setdefault(k, {})[columns["piece"][i]] = (columns["start_frame"][i], columns["length"][i], {c: columns[c][i] for c in columns if c not in ("piece", "start_frame", "length", "cost")})
    assert [[x for _, x in sorted(got[k].items())] for k in range(len(several))] == [pieces(x) for x in several]


def test_segments_of_one_machine_take_no_plain_search(spark, monkeypatch):
    from lanewright.plans.machine_queries import _told

    v = [np.array(r["v"]) for r in _told(spark, "/root/testdata/sf0.001").filter("seg_id % 5 < 2").collect()]
    monkeypatch.setattr(machine, "first_machine", None)
    found = list(machine._machines_of(v))
    assert sum(len(each) for each, _ in found) == len(v) > 1000


def test_presets_on_arrays_are_those_on_columns(spark):
    from lanewright.plans.engine_queries import _generators

    rows = _generators(spark, "/root/testdata/sf0.001").limit(300).withColumn("dur", F.lit(20).cast("long")).cache()
    for k in machine.PRESETS:
        m = machine.machines(rows, "seg_id", k)
        by_column = m.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
        want = by_column.groupBy("seg_id").agg(F.sum((F.col("i") + 1) * machine.values(F.col("i"), {c: F.col(c) for c in ("mode", "table", "mask", *machine.NUMBERS)})).alias(k)).collect()
        got = machine.preset_digests(rows, "seg_id", [k]).groupBy("seg_id").agg(F.sum(k).alias(k)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), k
        assert sorted(map(tuple, machine.digests(m, ["seg_id"]).groupBy("seg_id").agg(F.sum("digest")).collect())) == sorted(map(tuple, want)), k


def test_pieces_use_up_a_segment():
    rng = random.Random(5)
    for _ in range(40):
        v = np.concatenate([stepped(invented(rng, mode), rng.randrange(1, 80)) for mode in ("read", "sum", "reflect")]).astype(np.int64)
        at = 0
        for start, n, m in pieces(v):
            assert start == at and n >= 1 and (run(m, n) == v[start : start + n]).all()
            at += n
        assert at == len(v)
    assert pieces(np.array([], int)) == [] and [(s, n) for s, n, _ in pieces(np.array([7, 7, 7]))] == [(0, 3)]


def test_fits_in_spark(spark):
    rng = random.Random(8)
    made = [(k, "x", stepped(invented(rng), 50) if k % 9 else ([] if k else None)) for k in range(60)]
    fits = machine.fitted(spark.createDataFrame(made, "k long, mode string, v array<int>").select("k", "v").repartition(3), ["k"]).cache()
    got = {}
    for r in machine.rendered(fits, ["k"]).collect():
        got.setdefault(r["k"], {})[r["i"]] = r["v"]
    assert got == {k: dict(enumerate(v)) for k, _, v in made if v}
