"""Provenance and accumulators on small cases, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lanewright.operators import accumulators, blocks, provenance


def test_last_known_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.randrange(99)])) for k in "ab" for t in sorted(rng.sample(range(500), 60))]
    got = blocks.last_known(spark.createDataFrame(rows, "k string, t long, v long").repartition(4), ["k"], "t", [], "v", "last", 7)
    last, want = {}, []
    for k, t, v in rows:
        last[k] = v if v is not None else last.get(k)
        want.append((k, t, last.get(k)))
    assert sorted((r["k"], r["t"], r["last"]) for r in got.collect()) == want


def test_fed_and_walked(spark):
    """Register 3 is fed from a table that is walked by 2, then by 5; a write of another value than was read has no source."""
    rows, seq = [], 0
    for addr, val, written in [(100, 7, 7), (102, 8, 8), (104, 9, 9), (109, 1, 1), (114, 2, 2), (200, 3, 4)]:
        rows += [(1, seq, addr, val, 0), (1, seq + 1, 0xD403, written, 1)]
        seq += 2
    rows += [(1, seq, 0xD41A, 3, 1), (1, seq + 1, 0xD400, 3, 1)]
    bus = spark.createDataFrame(rows, "tune_id int, seq long, addr long, val long, rw int").repartition(3)
    for block in (3, 1 << 14):
        fed = provenance.fed(bus, ["tune_id"], block)
        assert [tuple(r) for r in fed.select("seq", "reg", "addr").orderBy("seq").collect()] == [(1, 3, 100), (3, 3, 102), (5, 3, 104), (7, 3, 109), (9, 3, 114), (11, 3, None), (13, 0, 200)]
        walks = provenance.table_walks(fed, ["tune_id"], block)
        assert sorted(tuple(r) for r in walks.select("reg", "walk", "start", "addr", "stride", "n").collect()) == [(0, 0, 13, 200, None, 1), (3, 0, 1, 100, 2, 3), (3, 1, 7, 109, 5, 2)]


def test_pointer_tables(spark):
    """Two patterns named in turn by a split table; the same bytes read as adjacent words lead nowhere."""
    order = [300, 310, 300, 300, 310, 300]
    memory = [("t", 50 + i, p & 255) for i, p in enumerate(order)] + [("t", 56 + i, p >> 8) for i, p in enumerate(order)]
    mem = spark.createDataFrame(memory, "path string, addr long, byte long")
    read = spark.createDataFrame([("t", 9, 50, 1, 0, 5, False, 0, 0, True), ("t", 8, 50, 1, 0, 0, False, 0, 0, True), ("t", 7, 995, 1, 0, 9, False, 0, 0, True), ("t", 6, 50, 1, 0, 5, False, 0, 0, False)], "path string, pc int, base int, stride int, lo int, hi int, fitted boolean, scale int, base_fit int, inside boolean")
    seqs = provenance.pointer_sequences(read, mem, ["path"], 0, 1000).cache()
    assert {r["packing"] for r in seqs.collect()} == {"split", "adjacent"} and {r["pc"] for r in seqs.collect()} == {9}
    assert [r["pointer"] for r in seqs.filter("packing = 'split'").orderBy("k").collect()] == order
    access = spark.createDataFrame([("t", a, 16) for a in [*range(300, 304), *range(310, 312)]] + [("t", 304, 1)], "path string, addr long, bits int")
    extents = provenance.read_extents(access, ["path"], 0, 1000)
    assert {r["addr"]: r["length"] for r in extents.collect()} == {300: 4, 301: 3, 302: 2, 303: 1, 310: 2, 311: 1}
    bank, named = provenance.read_banks(seqs, extents, spark.createDataFrame([("t", 0), ("t", 4)], "path string, delta int"), ["path"])
    assert sorted((r["src"], r["length"], r["pattern"], r["packing"], r["delta"]) for r in bank.collect()) == [(300, 4, 0, "split", 0), (310, 2, 1, "split", 0)]
    assert [r["pattern"] for r in named.orderBy("k").collect()] == [0, 1, 0, 0, 1, 0]


def stepped(kind, seed, p1, p2, p3, n):
    out, value, rate, up = [], seed, p1, 1 if p1 >= 0 else -1
    for _ in range(n):
        out.append(value & 65535)
        if kind == 0:
            value += p1
        elif kind == 1:
            value, rate = value + rate, rate + p2
        else:
            value += abs(p1) * up
            if value > p3:
                value, up = 2 * p3 - value, -up
            elif value < p2:
                value, up = 2 * p2 - value, -up
    return out


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_accumulators(spark, kind):
    rng = random.Random(kind)
    rows = []
    for k in range(60):
        if kind == 2:
            lo, step = rng.randrange(500), rng.randrange(1, 9)
            hi = lo + step * rng.randrange(1, 12)
            seed = lo + step * rng.randrange((hi - lo) // step)
            p = (seed, step, lo, hi)
        else:
            p = (rng.randrange(65536), rng.randrange(-70000, 70000), rng.randrange(-90, 90) if kind else 0, 0)
        rows.append((k, stepped(kind, *p, rng.choice([1, 2, 3, 90]))))
    frame = spark.createDataFrame([(k, 4, v) for k, v in rows] + [(98, 4, []), (99, 4, [1, 5, 1, 9, 2, 2])], "k long, first long, v array<long>")
    found = accumulators.fits(frame, ["k", "first"]).cache()
    kinds = {r["k"]: r["kind"] for r in found.collect()}
    assert kinds.keys() == {*range(60), 99} and kinds[99] == 3 and all(x <= kind for k, x in kinds.items() if k < 60)
    got = {(r["k"], r["frame"]): r["acc"] for r in accumulators.grids(found.withColumn("end", F.col("first") + F.col("n")), ["k"], "first", "end").collect()}
    assert got == {(k, 4 + i): x for k, v in [*rows, (99, [1, 5, 1, 9, 2, 2])] for i, x in enumerate(v)}


def test_digests_of_accumulators_are_those_of_their_grids(spark):
    rng = random.Random(4)
    made = [[rng.randrange(70000) for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    made += [[a + i * r for i in range(rng.randrange(1, 50))] for a, r in ((rng.randrange(70000), rng.randrange(-900, 900)) for _ in range(60))]
    made += [[a + i * r + i * (i - 1) // 2 * s for i in range(30)] for a, r, s in ((rng.randrange(900), rng.randrange(9), rng.randrange(-5, 5)) for _ in range(60))]
    made += [[5 + min((i * 3) % 60, 60 - (i * 3) % 60) for i in range(n)] for n in range(1, 60)]
    rows = [(k, k % 7 - 2, k % 7 - 2 + rng.randrange(-3, 60), v) for k, v in enumerate([*made, [], None])]
    frame = spark.createDataFrame(rows, "k long, a int, b long, v array<long>").repartition(3)
    found = accumulators.fits(frame, ["k", "a", "b"]).cache()
    assert found.count() == len(made) and set(r["kind"] for r in found.collect()) == {0, 1, 2, 3}
    want = accumulators.grids(found, ["k"], "a", "b").groupBy("k").agg(F.sum(F.col("frame") * F.col("acc")).alias("d"))
    assert sorted(map(tuple, accumulators.digests(found, ["k"], "a", "b").collect())) == sorted(map(tuple, want.collect()))


def test_accumulators_with_nulls_keep_their_values(spark):
    rows = [(0, [3, None, 5]), (1, [None, 4]), (2, [70000, 70001])]
    got = {r["k"]: (r["kind"], r["seed"], r["n"], r["raw"]) for r in accumulators.fits(spark.createDataFrame(rows, "k long, v array<long>"), ["k"]).collect()}
    assert got == {0: (accumulators.RAW, 3, 3, [3, None, 5]), 1: (accumulators.RAW, 0, 2, [None, 4]), 2: (accumulators.RAMP, 4464, 2, None)}
