"""Records by shape against json."""

import json

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lanewright.operators import shapes

SIMPLE = st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.lists(st.integers(-999, 999), max_size=4)
VALUES = st.recursive(SIMPLE, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)
TRICKY = ['{"a:i,":"b:","c\\"d":["x",1]}', '"i"', "17", "[]", "{}", "[-0]", "[1.0,2]", "[ 1 , 2 ]", '{"a" : [ 10 ] , "b":"\\u00e9\\\\"}', "null", "-0", "00", '{"s":"[1,2]{}"}', '"' + "x\\n" * 20_000 + '"', "[" + ",".join("7" * 20_000) + "]", "1e5"]


def letters(x):
    """Values in order, with their letters, as json has them."""
    if isinstance(x, bool):
        return ["b"]
    if x is None:
        return ["z"]
    if isinstance(x, int):
        return ["i" if abs(x) < 10**18 else "n"]
    if isinstance(x, float):
        return ["n"]
    if isinstance(x, str):
        return ["s"]
    if isinstance(x, list):
        if all(isinstance(i, int) and not isinstance(i, bool) and abs(i) < 10**18 for i in x):
            return ["a"]
        return [t for i in x for t in letters(i)]
    return [t for i in x.values() for t in letters(i)]


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(2)
    shred = shapes.shredded(frame, "text").cache()
    table = shapes.shape_table(shred, "key").cache()
    rows = shapes.by_shape(shred, table, ["key"]).cache()
    coded = shapes.row_ids(rows, table, ["key"])
    again = shapes.read_rows(coded, table, ["key"]).cache()
    assert sorted(map(str, again.select("key", "shape_id", "leaves").collect())) == sorted(map(str, rows.collect()))
    found = {r["key"]: r["text"] for r in shapes.assembled(again, table, ["key"], "text").collect()}
    return {r["key"]: r for r in shred.collect()}, {r["holes"] + r["letters"]: r for r in table.collect()}, found


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, min_size=30, max_size=60))
def test_records_come_back(spark, values):
    values = [*values, *values[:3]]
    texts = [json.dumps(v, separators=(",", ":"), ensure_ascii=k % 2 == 0) for k, v in enumerate(values)]
    shred, table, found = check(spark, texts)
    assert found == dict(enumerate(texts))
    for k, v in enumerate(values):
        assert shred[k]["letters"] == "".join(letters(v)) and len(shred[k]["leaves"]) == len(shred[k]["letters"])
    order = list(dict.fromkeys((shred[k]["holes"] + shred[k]["letters"]) for k in range(len(values))))
    assert [table[s]["shape_id"] for s in order] == list(range(len(order)))
    assert sum(r["uses"] for r in table.values()) == len(values)


def test_tricky_texts(spark):
    shred, table, found = check(spark, [*TRICKY, None])
    assert len(found) == len(TRICKY) and shred[len(TRICKY)]["shape"] is None
    for k, text in enumerate(TRICKY):
        if text not in ("-0", "00", "[-0]"):
            assert json.loads(found[k]) == json.loads(text)
    assert shred[0]["shape"] == '{"a:i,":s,"c\\"d":[s,i]}' and found[10] == "-0" and found[7] == "[1,2]"


def test_digits_and_numbers():
    """Of all rows at once; digits without an end make no number."""
    numbers = np.array([0, 1, 15, 16, 255, 256, 1 << 40, (1 << 62) + 5, -1], np.int64)
    digits, n = shapes._digits(numbers)
    assert n.tolist() == [1, 1, 1, 2, 2, 3, 11, 16, 16]
    rows = pa.array([[*digits[:5].tolist(), 3], digits[5:].tolist()], pa.list_(pa.int32()))
    found = shapes._numbers(pa.RecordBatch.from_arrays([rows], ["ids"]))
    assert found["shape_id"].to_pylist() == [0, 255] and found["_n"].to_pylist() == [[0, 1, 15, 16], numbers[4:].tolist()]
