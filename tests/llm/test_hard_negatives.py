"""Hard negatives against scores of all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.llm import queries
from lanewright.llm.hard_negatives import HIGH, LOW, Search, coded, fitted, mine

SF = "/root/testdata/sf0.001"


def plain(rows, every=100, positives=5, negatives=10):
    """rows: (id, vector, label)."""
    kept = {}
    for i, v, lab in sorted(((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[2], r[1])):
        kept.setdefault(i, (v, lab))
    if not kept:
        return []
    size = len(kept[min(kept)][0])
    kept = {i: r for i, r in kept.items() if len(r[0]) == size and size}
    out = []
    for a, (v, lab) in kept.items():
        if a % every == 0:
            score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (w, _) in kept.items() if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if kept[i][1] == lab][:positives]:
                hard = [i for i in order if kept[i][1] != lab and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
                out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(hard[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [2, 400])
def test_limits_lose_nothing_and_save_most(spread):
    """Batches of any size; with few values, scores tie all the time."""
    rng = np.random.default_rng(spread)
    v, labels, ids = rng.integers(-spread, spread + 1, (3000, 16)), rng.integers(0, 4, 3000), rng.permutation(3000)
    books = fitted(v[:500])
    codes, norms = coded(v, books)
    exact = np.sqrt(((v.reshape(3000, 8, 2) - np.stack([books[p][codes[:, p]] for p in range(8)], 1)) ** 2).sum(2))
    assert (exact <= norms).all()
    some = slice(0, 40)
    score = v[some] @ v.T
    low, high = np.stack([score.max(1) // 4, np.full(40, LOW)], 1), np.stack([score.max(1) // 2, np.full(40, HIGH)], 1)
    for same in (True, False):
        s = Search(ids[some], labels[some], v[some], low, high, books, same, 6)
        for a, b in ((0, 3), (3, 700), (700, 701), (701, 3000)):
            s.add(ids[a:b], labels[a:b], v[a:b], codes[a:b], norms[a:b])
        got = sorted(zip(*(x.tolist() for x in s.best), strict=True))
        want = []
        for a in range(40):
            fit = [(int(score[a, j]), int(ids[j])) for j in range(3000) if j != a and (labels[j] == labels[a]) == same]
            for w in range(2):
                want += [(a, w, x, i) for x, i in sorted((r for r in fit if low[a, w] <= r[0] <= high[a, w]), key=lambda r: (-r[0], r[1]))[:6]]
        assert got == sorted(want)
        assert spread == 2 or s.exact < 0.2 * 40 * 3000


@pytest.fixture(scope="module")
def odd():
    """Nulls everywhere, other lengths, equal vectors, repeated ids that agree or not, one label on most rows, negative ids."""
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-90, 90, 6) / 256).tolist(), 3 if i % 4 else int(i % 3)) for i in range(-50, 250)]
    rows += [(i, [0.3] * 6, i % 2) for i in range(250, 420)]
    rows += [rows[0], rows[7], (200, [0.1] * 6, 9), (100, [0.9] * 6, 0), (600, [0.0] * 6, 3), (700, [0.0] * 6, 77)]
    rows += [(500, None, 1), (501, [None] * 6, 1), (502, [float("nan")] + [0.5] * 5, 2), (503, [float("inf")] * 6, 1), (504, [], 1), (505, [0.5] * 8, 1), (506, [0.5] * 6, None), (None, [0.1] * 6, None)]
    return rows


@pytest.mark.parametrize("some", [slice(None), slice(0, 51), slice(0, 0)])
def test_odd_rows(spark, odd, some):
    rows = odd[some]
    frame = spark.createDataFrame([(i, v, lab, 1, 2, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, id int, score long, anchor string").repartition(3)
    as_floats = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows if i is not None]
    got = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in mine(frame, F.col("vec_id") % 100 == 0, anchors=2).collect()]
    assert sorted(got) == plain(as_floats)


def test_sql_gives_the_same_rows():
    rows = duckdb.sql(f"SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END FROM '{SF}/embeddings.parquet'").fetchall()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(db.sql(queries.oracle_sql()["op13_hard_negatives"]).fetchall()) == plain(rows)
