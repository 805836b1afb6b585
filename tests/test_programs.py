"""Programs to tokens and back, against plain recursive versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewright.operators import programs
from lanewright.operators.programs import NODES, REPEAT, Choice, Columns, Many, Number, Record, When, parsed, song_of, squeezed, unsqueezed


def emitted(node, value):
    """Tokens of a value, recursively."""
    if isinstance(node, Number):
        return [value]
    if isinstance(node, Many):
        return [len(value), *(t for x in value for t in emitted(node.of, x))]
    if isinstance(node, Record):
        return [t for n, x in node.fields for t in (emitted(x, value[n]) if not isinstance(x, When) else emitted(x.then, value[n]) if value[x.field] == x.value else [])]
    if isinstance(node, Columns):
        out = [len(value)]
        for n in node.fields:
            column = [r[n] for r in value]
            out += [x - y for x, y in zip(column, [0, *column], strict=False)] if n == node.rising else column
        return out
    name, case = dict(node.cases)[value["kind"]]
    return [value["kind"], *emitted(case, value[name])]


def read(node, ids, at):
    """The same backwards, recursively."""
    if isinstance(node, Number):
        return ids[at], at + 1
    if isinstance(node, Many):
        out, n, at = [], ids[at], at + 1
        for _ in range(n):
            x, at = read(node.of, ids, at)
            out.append(x)
        return out, at
    if isinstance(node, Record):
        out = {}
        for n, x in node.fields:
            if isinstance(x, When) and out[x.field] != x.value:
                out[n] = None
            else:
                out[n], at = read(x.then if isinstance(x, When) else x, ids, at)
        return out, at
    if isinstance(node, Columns):
        n, at, rows = ids[at], at + 1, None
        rows = [{} for _ in range(n)]
        for name in node.fields:
            total = 0
            for r in rows:
                total = total + ids[at] if name == node.rising else ids[at]
                r[name] = total
                at += 1
        return rows, at
    name, case = dict(node.cases)[ids[at]]
    value, end = read(case, ids, at + 1)
    return {"kind": ids[at], name: value}, end


def invented(node, rng):
    if isinstance(node, Number):
        return rng.choice([0, 1, 2, 255, 65535, -4])
    if isinstance(node, Many):
        return [invented(node.of, rng) for _ in range(rng.randrange(5))]
    if isinstance(node, Record):
        out = {}
        for n, x in node.fields:
            if n == "kind":
                out[n] = rng.choice([0, 1, 3])
            else:
                out[n] = invented(x, rng) if not isinstance(x, When) else invented(x.then, rng) if out[x.field] == x.value else None
        return out
    if isinstance(node, Columns):
        return [{n: rng.randrange(1000) for n in node.fields} for _ in range(rng.randrange(6))]
    kind, (name, case) = rng.choice(node.cases)
    return {"kind": kind, name: invented(case, rng)}


def plain(x):
    """Nested rows as dictionaries, without the cases that were not chosen."""
    if hasattr(x, "asDict"):
        own = {k: plain(v) for k, v in x.asDict().items()}
        return {k: v for k, v in own.items() if v is not None or k == "raw"} if "kind" in own else own
    return [plain(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", NODES)
def test_the_stack_machine_reads_what_a_recursive_reader_reads(name):
    rng = random.Random(name)
    for _ in range(200):
        value = invented(NODES[name], rng)
        ids = [9, *emitted(NODES[name], value), 8]
        assert parsed(NODES[name], ids, 1) == read(NODES[name], ids, 1) == (value, len(ids) - 1)


def test_depth_is_not_bounded():
    node = Number()
    for _ in range(3000):
        node = Many(node)
    value, at = parsed(node, [1] * 3000 + [7])
    for _ in range(3000):
        (value,) = value
    assert (value, at) == (7, 3001)


def greedy(values):
    """The greedy search for copies by comparing all places."""
    out, i, n = [], 0, len(values)
    digits = lambda x: max(1, len(f"{x:x}"))
    while i < n:
        best = (0, 0)
        for p in range(i - 1, -1, -1):
            k = 0
            while i + k < n and values[p + k] == values[i + k] and k < 4095:
                k += 1
            # A source is known by three values, the last two of a sequence start none.
            if k >= 3 and p < n - 2 and k > best[0]:
                best = (k, i - p)
            if best[0] >= 512:
                break
        if best[0] >= 3 and 1 + digits(best[1]) + digits(best[0]) < best[0]:
            out += [REPEAT, best[1], best[0]]
            i += best[0]
        else:
            out.append(values[i])
            i += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=200) | st.lists(st.integers(0, 300), max_size=60))
def test_copies_are_those_of_a_search_of_all_places(values):
    got = squeezed(values)
    assert got == greedy(values)
    assert unsqueezed([5, *got, 6], 1, len(values)) == (values, len(got) + 1)


def test_long_copies():
    values = list(range(40)) * 300
    got = squeezed(values)
    assert got == greedy(values) and len(got) < 60 and unsqueezed(got, 0, len(values))[0] == values


def test_songs_in_spark(spark):
    rng = random.Random(1)
    songs = [{"song": k, "frames": rng.randrange(90), "boot": [rng.randrange(256) for _ in range(25)]} | {n: invented(x, rng) for n, x in NODES.items()} for k in range(12)]
    songs[3] |= {n: [] for n in NODES}
    songs[4]["patterns"] = [[1, 2, 3, 4, 5, 6, 7, 8]] * 30
    schema = programs.T.StructType([programs.T.StructField("song", programs.T.LongType()), programs.T.StructField("frames", programs.T.LongType()), programs.T.StructField("boot", programs.T.ArrayType(programs.T.LongType())), *(programs.T.StructField(n, programs.spark_type(x)) for n, x in NODES.items())])
    frame = spark.createDataFrame(songs, schema).repartition(3)
    coded = programs.song_ids(frame, "song").cache()
    for r in coded.collect():
        s = songs[r["song"]]
        want = [s["frames"], *s["boot"]]
        for n, x in NODES.items():
            flat = emitted(x, s[n])
            if n not in programs.MARKED or flat != [0]:
                want += [programs.MARKED[n][0], len(flat)] if n in programs.MARKED else [len(flat)]
                want += greedy(flat)
        assert r["ids"] == want and song_of(want) | {"song": r["song"]} == s
    assert [plain(r) for r in programs.songs_of(coded, "song").orderBy("song").collect()] == songs
    few = programs.song_ids(frame.select("song", "frames", "boot", "patterns"), "song")
    assert programs.songs_of(few, "song").filter("size(bases) + size(lanes) + size(orders) > 0").count() == 0


@pytest.mark.parametrize("ids", [[], [1] * 20, [0] * 26, [0] * 26 + [0], [0] * 26 + [1, 0] * 6 + [99], [0] * 26 + [2, 3, 3] + [1, 0] * 5, [0] * 26 + [3, 1, 5, 5] + [1, 0] * 5, [0] * 26 + [1, 0] * 6 + [(1 << 24) + 2, 2, 1, 7]])
def test_what_is_no_song_is_refused(ids):
    with pytest.raises(ValueError, match="cut off|unknown|no program|more tokens"):
        song_of(ids)


def test_long_values_are_squeezed_in_bounded_memory():
    """No objects for values: numbers of 8 bytes, a few for each value."""
    import tracemalloc

    values = np.random.default_rng(0).integers(0, 256, 200_000)
    tracemalloc.start()
    got = squeezed(values[:500]), programs.squeezed_array(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == greedy(values[:500].tolist()) and peak < 100 * len(values)
    assert unsqueezed(got[1].tolist(), 0, len(values))[0] == values.tolist()
