"""Vector codes against plain Lloyd rounds with a full scan."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lanewright.llm import queries, vector_codes
from lanewright.llm.vector_codes import Bounds, lloyd, recentred

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector, label). Rows of the result, sorted."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:2])
    kept = [r for r in kept if len(r[1]) == len(kept[0][1]) and r[1] and len(r[1]) % parts == 0]
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            code = [nearest(x[p], books[p]) for x in cut]
            for e in range(len(books[p])):
                own = [x[p] for x, c in zip(cut, code, strict=True) if c == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    codes = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(dist(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(cut, codes, strict=True)]
    sums = {lab: sum(e for e, r in zip(errors, kept, strict=True) if r[2] == lab) for *_, lab in kept}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{c:02x}" for c in code), e, sums[r[2]], digest) for r, code, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("spread", [2, 5, 1000])
def test_bounds_keep_ties_and_skip_scans(spread):
    """With few values, distances tie all the time; the bounds must never decide a tie."""
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread + 1, (600, 12))
    if spread == 1000:
        v += 20_000 * rng.integers(0, 5, (600, 1))
    books = np.ascontiguousarray(v[:7].reshape(7, 3, 4).transpose(1, 0, 2))
    state, drift, scanned = Bounds.unknown(600, 3), None, []
    for _ in range(6):
        state.scanned = 0
        before = state.code.copy()
        moved = state.assign(v, books, drift)
        scanned.append(state.scanned)
        full = np.stack([((v.reshape(600, 3, 1, 4)[:, p] - books[p]) ** 2).sum(2).argmin(1) for p in range(3)], 1)
        assert (state.code == full).all() and (moved == (before != full).any(1)).all()
        own = v.reshape(600, 3, 4)
        exact = np.stack([np.sqrt(((own[:, p, None] - books[p]) ** 2).sum(2)) for p in range(3)], 1)
        assert (np.take_along_axis(exact, full[:, :, None], 2)[:, :, 0] <= state.upper).all()
        np.put_along_axis(exact, full[:, :, None], np.inf, 2)
        assert (exact.min(2) >= state.lower).all()
        sums = np.stack([[own[full[:, p] == e, p].sum(0) for e in range(7)] for p in range(3)])
        counts = np.stack([np.bincount(full[:, p], minlength=7) for p in range(3)])
        books, drift = recentred(books, sums, counts)
    assert scanned[0] == 1800 and (spread < 1000 or scanned[-1] < 900)


def test_components_go_down_and_unused_entries_stay():
    books = np.array([[[0, 0], [90, 90]]])
    new, drift = recentred(books, np.array([[[-7, 7], [0, 0]]]), np.array([[2, 0]]))
    assert new.tolist() == [[[-4, 3], [90, 90]]] and drift[0, 0] >= 5 > drift[0, 1] == 0


def test_a_sample_of_one_process_gives_the_same_books():
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (200, 16))
    books = lloyd(v, np.ascontiguousarray(v[:16].reshape(16, 8, 2).transpose(1, 0, 2)), 6)
    want = plain([(i, (x / 4096).tolist(), 0) for i, x in enumerate(v)])
    assert hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest() == want[0][4]


@pytest.fixture(scope="module")
def odd():
    """Nulls, non-finite components, other lengths, ties, equal and repeated rows, one label on most rows, null labels."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-40, 40, 16) / 4096).tolist(), 3 if i % 3 else int(i % 5)) for i in range(3, 80)]
    rows += [(i, [0.25] * 16, None) for i in range(80, 110)] + [rows[0], rows[5], (-4, [1 / 3] * 16, 3)]
    rows += [(1, None, 1), (0, [None] * 16, 1), (2, [float("nan")] + [0.0] * 15, 2), (200, [float("inf")] * 16, 1), (201, [], 1), (202, [0.5] * 8, 1), (203, [0.5] * 15, 3)]
    return rows


@pytest.mark.parametrize("some", [slice(None), slice(0, 5), slice(-7, None), slice(0, 0)])
def test_odd_rows(spark, odd, some):
    rows = odd[some]
    frame = spark.createDataFrame([(i, v, lab, "c", 1, b"w", 1.0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, code string, id int, was binary, error double").repartition(3)
    as_floats = [(i, v and [x if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, vector_codes.compress(frame).collect())) == plain(as_floats)


def test_components_out_of_range_are_refused(spark):
    frame = spark.createDataFrame([(0, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="out of range"):
        vector_codes.compress(frame)


def test_sql_gives_the_same_rows():
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(db.sql(queries.oracle_sql()["op11_vector_codes"]).fetchall()) == plain(rows)
