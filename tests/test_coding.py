"""Ramps against a plain greedy loop, and framing of a stream against the same framing of a table."""

import random

from lanewright.operators import ramps
from lanewright.streaming.framing import binned_stream


def greedy(xs, m):
    out, i = [], 0
    while i < len(xs):
        j = i + 1
        step = (xs[j] - xs[i]) % m if j < len(xs) else 0
        while j < len(xs) and (xs[j] - xs[j - 1]) % m == step:
            j += 1
        out.append((i, j - i, xs[i], step))
        i = j
    return out


def test_ramps(spark):
    rng = random.Random(2)
    rows, want = [], []
    for t in range(60):
        xs = [rng.randrange(16)]
        while len(xs) < t % 23 + 1:
            xs.append((xs[-1] + rng.choice([0, 1, 1, 5])) % 16)
        rows += [(t, "freq0", i, x) for i, x in enumerate(xs)]
        want += [(t, *r) for r in greedy(xs, 16)]
    lane = spark.createDataFrame(rows, "tune_id long, lane string, frame int, v long")
    found = ramps.ramp_segments(lane, 16)
    assert sorted(tuple(r) for r in found.select("tune_id", "start", "length", "seed", "step").collect()) == sorted(want)
    assert all(r["residual"] == 0 for r in ramps.lane_residual(lane, ramps.ramp_render(found, 16)).collect())
    assert not ramps.ramp_segments(lane.filter("tune_id < 0")).collect()


def test_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, rng.randrange(4), rng.randrange(256), 1_700_000_000 + 97 * i) for i in range(400)]
    table = spark.createDataFrame(rows, "tune_id long, seq long, reg int, val long, s long").selectExpr("tune_id", "seq", "reg", "val", "timestamp_seconds(s) as ts")
    table.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "log"))
    query = binned_stream(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, binned_stream(table).collect()))


def test_late_writes_are_left_out(spark, tmp_path):
    """A write that comes more than two hours after the newest one it follows no longer changes a closed frame."""
    schema = "tune_id long, seq long, reg int, val long, s long"
    batches = [[(1, 1, 0, 10, 0), (1, 2, 0, 11, 1800)], [(1, 3, 0, 50, 6 * 3600)], [(1, 4, 0, 99, 900), (1, 5, 0, 51, 6 * 3600 + 60)], [(1, 6, 0, 60, 12 * 3600)]]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)).selectExpr("tune_id", "seq", "reg", "val", "timestamp_seconds(s) as ts")
    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("".join(f'{{"tune_id":{a},"seq":{b},"reg":{c},"val":{d},"s":{e}}}\n' for a, b, c, d, e in rows))
        query = binned_stream(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = sorted((int(r["frame_start"].timestamp()) % 86400 // 3600, r["val"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(0, 11), (6, 51)]


def test_formats(spark, tmp_path):
    from lanewright.sources import tables

    rows = spark.createDataFrame([(1, 2, 3, 4, 5), (2, 3, 4, 5, 6)], tables.SCHEMA)
    for kind in tables.FILES:
        rows.write.format(kind).save(str(tmp_path / kind))
        assert sorted(map(tuple, tables.read_log(spark, str(tmp_path / kind), kind).collect())) == [(1, 2, 3, 4, 5), (2, 3, 4, 5, 6)]
    raw = spark.sql("""SELECT CAST('{"tune_id":1,"seq":2,"clock":3,"reg":4,"val":5}' AS BINARY) AS value, timestamp_seconds(9) AS timestamp UNION ALL SELECT CAST('no' AS BINARY), timestamp_seconds(9)""")
    assert [tuple(r)[:5] for r in tables.messages(raw).collect()] == [(1, 2, 3, 4, 5)]
