"""Compression of vectors to codes: one code book for each part of a vector, by Lloyd's rounds with Hamerly's bounds.

Components are integers, so codes, errors and code books are exact and do not depend on how rows are dealt to tasks. Between
rounds every part keeps its entry, an upper bound of its distance to it and a lower bound of its distance to all others. When
entries move, the bounds give way by as much. Only a part whose bounds no longer tell, strictly, that its entry is the nearest is
compared with all entries; so ties go to the lower index, as in a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, join_groups

#: Integer components are below this, so that squared distances and their sums over a part fit 64 bits.
LARGEST = 1 << 28
#: Bounds are widened by this share at each step, far more than rounding can lose.
SLACK = 1e-12


def integer_vectors(rows: DataFrame, vector_col: str, scale: int, out: str = "v") -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor non-finite components, with out: floor(scale * x) of each.

    Components of 2^28 / scale and more raise an error: their squared distances would not fit a long.
    """
    kept = rows.filter(F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def whole(x):
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit("vector component out of range")).cast("int"))

    return kept.withColumn(out, F.transform(vector_col, whole))


def stacked(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, d) to entries (k, d), exact."""
    return np.stack([((parts - entry) ** 2).sum(1) for entry in book], 1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Entry, upper and lower bound of the parts of some rows: code (n, p) int64, upper and lower (n, p) float32."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.upper, self.lower = code, upper, lower
        self.scanned = 0

    @classmethod
    def unknown(cls, n: int, p: int) -> Bounds:
        return cls(np.full((n, p), -1), np.full((n, p), np.inf, np.float32), np.full((n, p), -np.inf, np.float32))

    def assign(self, v: np.ndarray, books: np.ndarray, drift: np.ndarray | None) -> np.ndarray:
        """Assigns every part to its nearest entry of books (p, k, d), after entries moved by drift (p, k) at most. Gives the rows
        that have a part with another entry than before."""
        parts = v.reshape(len(v), *books.shape[::2])
        moved = np.zeros(len(v), bool)
        for p, book in enumerate(books):
            known = self.code[:, p] >= 0
            if drift is not None and known.any():
                far, own = drift[p], self.code[:, p]
                top = int(far.argmax())
                rest = np.delete(far, top).max(initial=0.0)  # the entry that moved most bounds all parts but its own
                self.upper[:, p] = _up(self.upper[:, p].astype(float) + far[own])
                self.lower[:, p] = _down(self.lower[:, p].astype(float) - np.where(own == top, rest, far[top]))
            doubt = np.flatnonzero(~(self.upper[:, p] < self.lower[:, p]))
            near = doubt[known[doubt]]
            if len(near):  # the exact distance to the own entry may do
                self.upper[near, p] = _up(np.sqrt(((parts[near, p] - book[self.code[near, p]]) ** 2).sum(1)))
                doubt = doubt[~(self.upper[doubt, p] < self.lower[doubt, p])]
            if not len(doubt):
                continue
            self.scanned += len(doubt)
            d = distances(parts[doubt, p], book)
            best = d.argmin(1)  # the first of equal ones
            first = d[np.arange(len(d)), best]
            d[np.arange(len(d)), best] = np.iinfo(np.int64).max
            second = d.min(1)
            moved[doubt] |= best != self.code[doubt, p]
            self.code[doubt, p] = best
            self.upper[doubt, p] = _up(np.sqrt(first))
            self.lower[doubt, p] = _down(np.sqrt(second)) if len(book) > 1 else np.inf
        return moved


def recentred(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New books, floor(sum / count) of each component where an entry is used, and how far each entry moved, rounded up."""
    new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return new, np.sqrt(((new - books) ** 2).sum(2)) * (1 + SLACK)


def lloyd(v: np.ndarray, books: np.ndarray, rounds: int) -> np.ndarray:
    """The same rounds for rows of one process, such as a bounded sample."""
    state, drift = Bounds.unknown(len(v), len(books)), None
    parts = v.reshape(len(v), *books.shape[::2])
    for _ in range(rounds):
        state.assign(v, books, drift)
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for p in range(len(books)):
            np.add.at(sums[p], state.code[:, p], parts[:, p])
            counts[p] = np.bincount(state.code[:, p], minlength=books.shape[1])
        books, drift = recentred(books, sums, counts)
    return books


def _step(books: np.ndarray, drift: np.ndarray | None, first: bool):
    """Assigns all rows of a table; moved tells the rows whose codes change, was their codes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, p = stacked(b["v"]), len(books)
            if not b.num_rows:
                continue
            if first:
                state = Bounds.unknown(len(v), p)
            else:
                code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(v), p).astype(np.int64)
                state = Bounds(code, stacked(b["upper"], np.float32), stacked(b["lower"], np.float32))
            was = state.code.copy()
            moved = state.assign(v, books, drift)
            codes = [pa.array([row.tobytes() for row in x.astype(np.uint8)], pa.binary()) for x in (state.code, was)]
            floats = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p, dtype=np.int32)), pa.array(x.ravel())) for x in (state.upper, state.lower)]
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["v"], *codes, *floats, pa.array(moved)], ["id", "label", "v", "code", "was", "upper", "lower", "moved"])

    return run


def _changes(shape: tuple[int, int, int], first: bool):
    """What a task's rows add to the sums and counts of the entries: those that moved, at their new and, taken off, old entry."""
    n_parts, k, d = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            parts = stacked(b["v"]).reshape(-1, n_parts, d)
            for name, sign in (("code", 1), ("was", -1)):
                if name == "was" and first:
                    continue
                code = np.frombuffer(b"".join(b[name].to_pylist()), np.uint8).reshape(-1, n_parts)
                for p in range(n_parts):
                    np.add.at(sums[p], code[:, p], sign * parts[:, p])
                    counts[p] += sign * np.bincount(code[:, p], minlength=k)
        at = np.flatnonzero((counts != 0) | (sums != 0).any(2))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.reshape(-1)[at]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * d + 1, d, dtype=np.int32)), pa.array(sums.reshape(-1, d)[at].ravel()))], ["entry", "n", "sums"])

    return run


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector kept: id, code (two hex digits for each part), error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors whose length is not that of
    the vector with the smallest id, or is not a multiple of `parts`. Code books start as the parts of the vectors with the
    smallest ids (of equal ids, the smallest vector first); fewer vectors than entries give smaller books. Repeated rows count as
    often as they occur. Null labels are one label. An empty table gives no rows. Other columns are ignored. entries: up to 256.
    """
    spark = rows.sparkSession
    steps = Steps(spark, "codes")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), F.col(label_col).alias("label"))
    kept = integer_vectors(rows, "x", scale).select("id", "label", "v")
    start = kept.orderBy("id", "v").limit(1).collect()
    size = len(start[0]["v"]) if start else 0
    fits = F.size("v") == size if size and size % parts == 0 else F.lit(False)
    kept = kept.filter(fits)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    heads = np.array([r["v"] for r in kept.orderBy("id", "v").limit(entries).collect()], np.int64).reshape(-1, parts, size // parts if size else 1)
    books = np.ascontiguousarray(heads.transpose(1, 0, 2))  # part, entry, component
    sums, counts, drift = np.zeros_like(books), np.zeros(books.shape[:2], np.int64), None
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, code binary, was binary, upper array<float>, lower array<float>, moved boolean"
    state = kept
    for turn in range(rounds if len(heads) else 0):
        state = steps.replace(state.mapInArrow(_step(books, drift, not turn), schema), "state")
        changed = state.filter("moved").select("v", "code", "was").mapInArrow(_changes(books.shape, not turn), "entry int, n long, sums array<long>")
        each = changed.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(books.shape[2])]).alias("sums"))
        for r in each.collect():  # one row for each entry of the books
            counts.reshape(-1)[r["entry"]] += r["n"]
            sums.reshape(-1, books.shape[2])[r["entry"]] += np.array(r["sums"], np.int64)
        books, drift = recentred(books, sums, counts)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    step = _step(books, drift, not rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in step(batches):
            code = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            v = stacked(b["v"]).reshape(len(code), parts, -1)
            error = sum(((v[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([x.hex() for x in b["code"].to_pylist()], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    found = state.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long") if len(heads) else spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    found = steps.write(found, "codes").withColumn("unlabelled", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit(0).cast(kinds["label"])))
    steps.drop("state")
    # A label may be that of most rows: they are added up in every task first, and the sums of large labels are broadcast.
    labels = found.groupBy("unlabelled", "label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_size"))
    out = join_groups(found, labels, ["unlabelled", "label"], "_size", found.count(), steps)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, with a full scan in each round; for vectors of one length."""
    near = "SELECT c.r, c.p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT c.r, c.p, b.e, sum((c.v - b.v) * (c.v - b.v)) AS d FROM c JOIN b{k} b USING (p, j) GROUP BY c.r, c.p, b.e) c GROUP BY c.r, c.p"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(k=k)})")
        if k < rounds:
            moved = f"SELECT a.p, a.e, c.j, sum(c.v) AS s, count(*) AS n FROM a{k} a JOIN c USING (r, p) GROUP BY a.p, a.e, c.j"
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, b.j, coalesce({floor}, b.v) AS v FROM b{k} b LEFT JOIN ({moved}) m USING (p, e, j))")
    return f"""
WITH x AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, len(embedding) // {parts} AS w, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
t AS (SELECT row_number() OVER (ORDER BY r) AS r, r AS was, any_value(vec_id) AS vec_id, any_value(label) AS label FROM x GROUP BY r HAVING bool_and(x IS NOT NULL AND isfinite(x))),
f AS (SELECT t.r, i, w, CAST(floor({scale} * x) AS BIGINT) AS v FROM t JOIN x ON x.r = t.was),
c AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, v FROM f),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, v FROM c WHERE r <= {entries}),
{", ".join(steps)},
s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{rounds}),
g AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g JOIN t USING (r), s
"""
