"""Compression, covers, generators, fits and sources against plain loops."""

import random
import struct

import numpy as np
import pytest

from lanewright.functions import scalars
from lanewright.operators import compression, cover, fits, framing, generators, relations
from lanewright.sources import dumps
from pyspark.sql import functions as F


def lanes_of(rng, n):
    base = [rng.randrange(40) for _ in range(12)]
    out = []
    while len(out) < n:
        out += rng.choice([[x + rng.randrange(3) * 5 for x in base], [rng.randrange(300)] * rng.randrange(1, 30), list(range(rng.randrange(50), 90, 3)), [1, 2, 9] * 4, [rng.randrange(65536)]])
    return out[:n]


def digits(n):
    return max(1, len(f"{n:x}"))


def plain_plan(v):
    """Back references by trying all offsets at each place."""
    zig = lambda n: 2 * n if n >= 0 else -2 * n - 1
    out, i = [], 0
    while i < len(v):
        best = {"repeat": (0, 0, 0), "transpose": (0, 0, 0)}
        for off in range(1, i + 1):
            shift = v[i] - v[i - off]
            n = 0
            while i + n < len(v) and v[i + n] - v[i - off + n] == shift:
                n += 1
            op = "transpose" if shift else "repeat"
            if n > best[op][0]:
                best[op] = (n, off, shift)
        gains = []
        for op in ("transpose", "repeat"):
            n, off, shift = best[op]
            gain = sum(digits(zig(x)) for x in v[i : i + n]) - 1 - digits(off) - digits(n) - (digits(zig(shift)) if op == "transpose" else 0)
            if n >= 2 and gain > 0:
                gains.append((gain, op, n, off, shift))
        if gains:
            _, op, n, off, shift = max(gains, key=lambda g: g[0])
            out.append((op, i, n, off, shift))
            i += n
        else:
            out.append(("literal", i, 1, 0, v[i]))
            i += 1
    return out


def test_back_references():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 400):
        for _ in range(6):
            v = lanes_of(rng, n)
            ops = compression.encoded(np.array(v, np.int64))
            assert ops == plain_plan(v) and compression.decoded(ops) == v
    assert compression.encoded(np.zeros(300, np.int64))[1] == ("repeat", 1, 299, 1, 0)  # a run over its own source
    assert any(op[0] == "transpose" for op in compression.encoded(np.array([1, 500, 900, 20, 101, 600, 1000, 120])))


def test_programs_and_covers_give_the_lane_again_and_covers_cost_no_more():
    rng = random.Random(2)
    value = lambda n: int(compression.digits(compression.folded(np.array(n))))
    cost = lambda ops: sum(1 + digits(n) + sum(map(value, vs)) + (value(d) if op == "ramp" else 0) for op, _, n, d, vs in ops)

    def run(ops):
        return [x for op, _, n, d, vs in ops for x in ([vs[k % len(vs)] for k in range(n)] if op == "period" else [vs[0] + d * k for k in range(n)])]

    for n in (1, 2, 3, 4, 60, 300):
        for _ in range(5):
            v = lanes_of(rng, n)
            greedy, least = compression.program(np.array(v)), cover.cover(np.array(v))
            assert run(greedy) == run(least) == v and [o[1] for o in greedy] == np.cumsum([0, *(o[2] for o in greedy[:-1])]).tolist()
            if all(op != "period" or len(vs) in cover.PERIODS for op, _, _, _, vs in greedy):
                assert cost(least) <= cost(greedy)
    assert [o[0] for o in compression.program(np.array([5, 5, 5, 1, 2, 3, 4, 9, 8, 9, 8, 9, 8]))] == ["hold", "ramp", "period"]


def test_blocks_of_lanes(spark):
    rng = random.Random(3)
    v = lanes_of(rng, 150)
    lane = spark.createDataFrame([(1, "freq0", k, x) for k, x in enumerate(v)] + [(2, "pw1", 0, 7)], "tune_id long, lane string, frame int, v long").repartition(3)
    ops = compression.compress(lane, block=64)
    assert {r["block"] for r in ops.collect()} == {0, 1, 2}
    for again in (compression.decompress(ops), compression.decompress(compression.read_tokens(compression.token_stream(ops))), compression.run_programs(compression.lane_programs(lane, 64)), compression.run_programs(cover.cover_lanes(lane, 64))):
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, lane.collect()))
    sums = {(r["tune_id"], r["op"]): r for r in compression.sizes(ops).collect()}
    assert sums[None, None]["ops"] == ops.count() and sums[1, None]["digits"] + sums[2, None]["digits"] == sums[None, None]["digits"]
    assert not compression.compress(lane.filter("frame < 0")).collect()


def plain(kind, n, p):
    """Each generator as the loop it stands for."""
    out, v, t, m = [], p["v0"], p["table"], p["mask"]
    tri = lambda c: [0, 1, 2, 3, 3, 2, 1, 0][c % 8]
    turn, left, up, vib, delay, top, ptr, acc = 1, 0, True, 0, p["lead"], p["top"], p["ctr0"] % len(t), p["v0"] << p["frac"]
    cmp_ = p["parity"] + 2 * p["ctr0"]
    for i in range(n):
        if kind == "wrapaccum":
            out.append(v)
            v += p["rate"]
            v -= (p["hi"] - p["lo"]) if v >= p["hi"] else 0
        elif kind == "dwell":
            out.append((p["v0"] + p["rate"] * (max(0, i - p["lead"]) // p["dwell"])) & 65535)
        elif kind in ("maskaccum", "ratewalk", "dwellratewalk", "decay"):
            out.append(v & 65535)
            step = {"maskaccum": p["rate"] * m[i % len(m)], "ratewalk": t[(p["ctr0"] + i) % len(t)], "dwellratewalk": t[(p["ctr0"] + i) // p["dwell"] % len(t)], "decay": -p["rate"] if (p["ctr0"] + i + 1) % p["dwell"] == 0 else 0}[kind]
            v += step
        elif kind == "tablewalk":
            out.append(t[(p["ctr0"] + i) % len(t)])
        elif kind == "tablewalk_lead":
            out.append(p["v0"] if i < p["lead"] else t[(p["ctr0"] + i - p["lead"]) % len(t)])
        elif kind == "wavetable_ptr":
            ptr = (ptr + (m[(i - 1) % len(m)] if i else 0)) % len(t)
            out.append(t[ptr])
        elif kind == "glide":
            k = (p["ctr0"] + p["rate"] * (max(0, i - p["lead"]) // p["dwell"])) & 255
            out.append(t[k] if k < len(t) else 0)
        elif kind in ("arp", "arp_decay", "vibrato", "vibskydive"):
            x = t[(p["ctr0"] + i) // p["dwell"] % len(t)] if kind.startswith("arp") else (p["v0"] + tri(p["ctr0"] + i) * p["rate"]) & 65535
            if kind in ("arp_decay", "vibskydive") and (p["ctr0"] + i) % 2 == p["parity"] and top:
                x, top = (x & 255) + 256 * top, top - 1
            out.append(x)
        elif kind == "vibrato_carry":
            k, lo, hi, carry = tri(p["ctr0"] + i), p["v0"] & 255, p["v0"] >> 8, 1
            for _ in range(k):
                s = lo + (p["rate"] & 255)
                lo, s = s & 255, hi + (p["rate"] >> 8) + (s >> 8)
                hi, carry = s & 255, s >> 8
            out.append(carry)
        elif kind == "pingpong":
            out.append(v)
            left -= 1
            if left < 0:
                left = p["dwell"]
                if up and v + p["rate"] > p["hi"] or not up and v - p["rate"] < p["lo"]:
                    up = not up
                v += p["rate"] if up else -p["rate"]
        elif kind == "pingfold":
            out.append(acc >> p["frac"])
            acc += p["rate"] * turn
            lo, hi = p["lo"] << p["frac"], p["hi"] << p["frac"]
            if acc > hi:
                acc, turn = 2 * hi - acc, -turn
            elif acc < lo:
                acc, turn = 2 * lo - acc, -turn
        elif kind == "vibreflect":
            if delay > 1:
                delay -= 1
            else:
                if vib < 128 and vib > cmp_:
                    vib ^= 255
                vib = (vib + 2) & 255
                v = (v + (-p["rate"] if vib & 1 else p["rate"])) & 65535
            out.append(v)
        elif kind == "additive_pw":
            out.append(v & 4095)
            v = v & ~255 | (v + p["rate"] + m[i % len(m)]) & 255
    return out


def test_generators_are_the_loops_they_stand_for(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        v0 = rng.randrange(100, 150)
        rows.append((k, rng.randrange(0, 50), v0, rng.randrange(1, 9), rng.randrange(1, 5), rng.randrange(12), rng.randrange(6), 100, 150, rng.randrange(4), rng.randrange(1, 9), rng.randrange(2), [rng.randrange(500) for _ in range(rng.randrange(1, 7))], [rng.randrange(2) for _ in range(rng.randrange(1, 6))]))
    names = "v0 rate dwell ctr0 lead lo hi frac top parity table mask".split()
    frame = spark.createDataFrame(rows, "seg_id long, dur long, " + ", ".join(f"{n} long" for n in names[:-2]) + ", table array<bigint>, mask array<bigint>")
    found = {(r["seg_id"], r["i"]): r for r in generators.rendered(frame).collect()}
    assert len(found) == sum(r[1] for r in rows)
    for r in rows:
        p = dict(zip(names, r[2:], strict=True))
        for kind in set(generators.values(F.lit(0), {n: F.lit(0) if n not in ("table", "mask") else F.array(F.lit(0)) for n in names})):
            assert [found[r[0], i][kind] for i in range(r[1])] == plain(kind, r[1], p), (kind, p)


def test_fits(spark):
    rows = [(0, [5] * 9), (1, [1, 1, 4, 4, 9, 9] * 3 + [1, 1]), (2, list(range(0, 60, 3))), (3, [7, 8, 9, 2, 3] * 4 + [0]), (4, [0, 1, 3, 4, 6, 7, 9, 10, 12, 13]), (5, [4]), (6, [3, 1]), (7, [90, 80, 80, 80, 70, 70, 70]), (8, [50 + 7 * min(x % 8, 7 - x % 8) for x in range(2, 21)]), (9, [4, 4, 4, 1, 2, 1, 2, 1, 2, 1])]
    found = {r["k"]: (r["kind"], r["dwell"], r["period"], r["length"]) for r in fits.best_fits(spark.createDataFrame(rows, "k long, v array<bigint>"), ["k"]).collect()}
    assert found == {0: ("ratewalk", 1, 2, 9), 1: ("arp", 1, 6, 20), 2: ("dwell", 1, 1, 20), 3: ("arp", 1, 5, 20), 4: ("ratewalk", 1, 2, 10), 5: (None,) * 4, 6: ("arp", 1, 2, 2), 7: ("decay", 3, 2, 7), 8: ("tablewalk", 1, 8, 19), 9: ("lead", 3, 2, 10)}


def test_policies(spark):
    frame, gap = 1000, 100
    rows = [("gap", k, 1000 * k + j) for k in range(30) for j in (0, 10, 20)] + [("cadence", k, 7000 * k) for k in range(9)] + [("static", k, k) for k in range(5)]
    log = spark.createDataFrame([(t, s * 10 + j, c, j, c % 256) for j, (t, s, c) in enumerate(rows)], "tune_id string, seq long, clock long, reg int, val long").withColumn("reg", F.col("reg") % 3)
    assert {r["tune_id"]: r["policy"] for r in framing.policies(log, frame, gap).collect()} == {"gap": "gap", "cadence": "cadence", "static": "static"}
    state = framing.state_by_policy(log, frame, gap)
    assert {r["tune_id"]: r["n"] for r in state.groupBy("tune_id").agg(F.countDistinct("frame").alias("n")).collect()} == {"gap": 30, "cadence": 57, "static": 1}


def test_sources(spark, tmp_path):
    spark.createDataFrame([(5, 1, 2, 0, 9), (5, 1, 3, 0, 9), (7, 2, 4, 1, 9)], "clock long, reg int, val int, chipno int, other int").coalesce(1).write.parquet(f"{tmp_path}/dump")
    dump = dumps.register_dump(spark, f"{tmp_path}/dump")
    assert [(r["clock"], r["reg"], r["val"]) for r in dump.orderBy("seq").collect()] == [(5, 1, 2), (5, 1, 3)]
    plan = dump._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(chipno), EqualTo(chipno,0)]" in plan and "other" not in plan.split("ReadSchema")[-1]

    records = [(10, 0xD400, 1, 1), (11, 0xD403, 0xFF, 1), (12, 0x1000, 9, 0), (13, 0xD420, 9, 1), (14, 0xD401, 9, 0)]
    (tmp_path / "a.bus.bin").write_bytes(b"".join(struct.pack("<qHBB", *r) for r in records))
    bus = dumps.bus_trace(spark, f"{tmp_path}/a.bus.bin")
    assert [tuple(r)[2:] for r in bus.orderBy("seq").collect()] == records
    assert sorted((r["reg"], r["val"]) for r in dumps.register_writes(bus).collect()) == [(0, 1), (3, 15)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<qHBB", 5, 0xD404, 4, 8) * 2)
    writes = dumps.as_bus(dumps.write_trace(spark, f"{tmp_path}/b.bin"))
    assert [tuple(r)[1:] for r in writes.orderBy("seq").collect()] == [(0, 5, 0xD404, 8, 1), (1, 5, 0xD404, 8, 1)]
    for bad in (b"RBT1" + bytes(20), bytes(13)):
        (tmp_path / "c.bin").write_bytes(bad)
        with pytest.raises(Exception, match="not a trace"):
            dumps.bus_trace(spark, f"{tmp_path}/c.bin").collect()

    head = lambda load: b"PSID" + struct.pack(">HHHHHHHI", 2, 0x7C, load, 0x1000, 0x1003, 3, 1, 5) + bytes(0x7C - 22)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.sid").write_bytes(head(0) + b"\x00\x20abc")
    (tmp_path / "t/y.sid").write_bytes(head(0x3000) + b"abc")
    (tmp_path / "t/z.sid").write_bytes(b"nothing of the kind")
    found = sorted((r["load"], r["play"], r["songs"], r["speed"], bytes(r["data"])) for r in dumps.tune_headers(spark, f"{tmp_path}/t").collect())
    assert found == [(0x2000, 0x1003, 3, 5, b"abc"), (0x3000, 0x1003, 3, 5, b"abc")]

    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.meta.txt").write_text("name=x\nspeed=NTSC\nspeed=PAL\n")
    (tmp_path / "m/b.meta.txt").write_text("name=x\n")
    assert sorted(r["cycles"] for r in dumps.cycles_per_frame(spark, f"{tmp_path}/m").collect()) == [17095, 19656]

    runs = spark.createDataFrame([(1, 0, 3, 7), (1, 1, 0, 9), (1, 2, 2, 4)], "k int, o int, run int, bits int")
    assert sorted(map(tuple, dumps.run_lengths(runs, ["k"], "o", "run", "bits").collect())) == [(1, 0, 7), (1, 1, 7), (1, 2, 7), (1, 3, 4), (1, 4, 4)]
    image = spark.createDataFrame([(1, 0, 100, bytearray(b"\x01\x02")), (1, 1, 101, bytearray(b"\xff"))], "k int, o int, a int, d binary")
    assert sorted(map(tuple, dumps.sparse_image(image, ["k"], "o", "a", "d").collect())) == [(1, 100, 1), (1, 101, 255)]


def test_joins_by_time(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 2, "b"), (2, 9, "c"), (1, 3, "d")], "k int, t int, l string")
    right = spark.createDataFrame([(1, 3, 30), (1, 4, 40), (2, 10, 99)], "k int, t int, r int")
    assert sorted(map(tuple, relations.as_of(left, right, ["k"], "t", ["r"]).select("l", "r").collect())) == [("a", 40), ("b", None), ("c", None), ("d", 30)]
    spans = spark.createDataFrame([(1, 0, 4), (1, 3, 100), (1, 7, 7)], "k int, s int, e int")
    assert sorted(map(tuple, relations.within(left, spans, ["k"], "t", "s", "e", 10).select("l", "s").collect())) == [("a", 3), ("b", 0), ("d", 0), ("d", 3)]


def test_scalars(spark):
    row = spark.range(1).select(scalars.note_atom(F.lit(0)).alias("a"), scalars.byte_share(F.array(F.lit(320), F.lit(5))).alias("b"), scalars.falls_by_one(F.array(*[F.lit(256 * (20 - k // 2)) for k in range(8)])).alias("c")).collect()[0]
    assert tuple(row) == (17, 0.5, True)
    with pytest.raises(Exception, match="not a byte"):
        spark.range(1).select(scalars.byte_atom(F.lit(256) + F.col("id"))).collect()
