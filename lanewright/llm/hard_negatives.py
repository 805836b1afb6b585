"""Hard negatives of anchors by product quantisation with stored residual norms.

Every vector is stored as one code for each part and the length of what the code leaves of that part. A score is then the sum of
looked-up products, and is wrong by at most the sum over parts of the anchor's length times the residual's. Both limits decide
rigorously which rows can be among an anchor's best; only these are scored exactly. What a task has found so far raises the
limit, so later rows are mostly dropped by their codes.

Anchors are taken in blocks of a fixed number. Each block goes to all tasks and meets every row there; vectors are not shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps
from .vector_codes import distances, integer_vectors, lloyd, stacked

#: Rows that the code books are fitted on, components of a part, entries of a book, and rounds of fitting.
SAMPLE, WIDTH, ENTRIES, ROUNDS = 4096, 2, 256, 4
#: Anchors of a block, anchors and pairs that are looked at together in a task.
ANCHORS, TILE, PAIRS = 8192, 128, 1 << 14
#: Bounds are widened by this share of what goes into them, far more than rounding can lose.
SLACK = 1e-9

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def fitted(sample: np.ndarray, width: int = WIDTH, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Code books (part, entry, component) of a sample (n, d). Parts have `width` components, or one where that does not divide d."""
    width = width if sample.shape[1] % width == 0 else 1
    heads = sample[:entries]
    return lloyd(sample, np.ascontiguousarray(heads.reshape(len(heads), -1, width).transpose(1, 0, 2)), rounds)


def coded(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual lengths, rounded up, of each part: (n, p) uint8 and float32."""
    parts = v.reshape(len(v), len(books), -1)
    codes, norms = np.zeros(parts.shape[:2], np.uint8), np.zeros(parts.shape[:2], np.float32)
    for p, book in enumerate(books):
        d = distances(parts[:, p], book)
        codes[:, p] = d.argmin(1)
        norms[:, p] = np.nextafter(np.sqrt(d.min(1)).astype(np.float32), np.float32(np.inf))
    return codes, norms


class Search:
    """The best k rows of each anchor in each of its windows low <= score <= high, higher scores and then smaller ids first, among
    rows of the same label (not the anchor) or of other labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray, books: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.v, self.low, self.high, self.same, self.k = ids, labels, v, low, high, same, k
        parts = v.reshape(len(v), len(books), -1)
        self.tables = [book @ parts[:, p].T for p, book in enumerate(books)]  # entry, anchor
        self.lengths = np.sqrt((parts**2).sum(2)) * (1 + SLACK)
        self.least = np.where(low <= high, low, HIGH)  # a row must reach this to be among the best of a window
        self.best: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]  # anchor, window, score, row id
        self.exact = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        new: list[tuple[np.ndarray, ...]] = []
        for start in range(0, len(self.ids), TILE):
            tile = slice(start, start + TILE)
            score = sum(table[:, tile][codes[:, p]] for p, table in enumerate(self.tables))  # row, anchor
            wrong = norms.astype(float) @ self.lengths[tile].T
            wrong += SLACK * (wrong + np.abs(score)) + 1
            under, over = score - wrong, score + wrong
            fit = (labels[:, None] == self.labels[tile]) & (ids[:, None] != self.ids[tile]) if self.same else labels[:, None] != self.labels[tile]
            wanted = np.zeros_like(fit)
            for w in range(self.low.shape[1]):
                low, high, least = self.low[tile, w], self.high[tile, w], self.least[tile, w]
                if len(ids) > self.k:  # the k-th best of those that are certainly inside
                    sure = np.where(fit & (under >= low) & (over <= high), under, -np.inf)
                    least = np.maximum(least, np.partition(sure, len(ids) - self.k, axis=0)[len(ids) - self.k])
                wanted |= fit & (over >= least) & (under <= high)
            row, anchor = np.nonzero(wanted)
            self.exact += len(row)
            for k in range(0, len(row), PAIRS):
                r, a = row[k : k + PAIRS], anchor[k : k + PAIRS] + start
                found = np.einsum("ij,ij->i", v[r], self.v[a])
                at, w = np.nonzero((found[:, None] >= self.low[a]) & (found[:, None] <= self.high[a]))
                new.append((a[at], w, found[at], ids[r[at]]))
        if new:
            self.keep([np.concatenate([old, *x]) for old, *x in zip(self.best, *new, strict=True)])

    def keep(self, rows: list[np.ndarray]) -> None:
        anchor, window, score, found = rows
        order = np.lexsort((found, -score, window, anchor))
        key = (anchor * self.low.shape[1] + window)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
        self.best = [x[order[rank < self.k]] for x in rows]
        last = order[rank == self.k - 1]
        self.least[anchor[last], window[last]] = score[last]


def _found(search, columns) -> object:
    """Runs a search over the rows of a task. search: makes it; columns: what is told of each (anchor, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search()
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(n, -1)
                norms = np.frombuffer(b"".join(b["norms"].to_pylist()), np.float32).reshape(n, -1)
                s.add(b["id"].to_numpy(), b["label"].to_numpy(), stacked(b["v"]), codes, norms)
        anchor, window, score, ids = s.best
        cols = {**columns(anchor, window), "id": ids, "score": score}
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols.values()], list(cols))

    return run


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of all tasks; each task tells k at most for each key."""
    over = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor its first `positives` rows of the
    same label, and for each of these the first `negatives` rows of other labels whose score is share[0] to share[1] hundredths of
    the positive's.

    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id. Rows with a null label, a null
    vector or null or non-finite components take no part, nor do vectors whose length is not that of the vector with the smallest
    id, or is 0. Rows that repeat an id are one row, that with the smallest label and then vector. An anchor without positives and
    a positive without negatives in its window give no rows, nor does an empty table. Other columns are ignored. Ids and labels
    are integers. is_anchor: on the column id_col. anchors: of a block; the driver holds one block and its positives.
    """
    spark = rows.sparkSession
    steps = Steps(spark, "negatives")
    rows = rows.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), is_anchor.alias("anchor"))
    kept = integer_vectors(rows, "x", scale).groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    kept = steps.write(kept, "vectors")
    start = kept.orderBy("id").limit(1).collect()
    size = len(start[0]["v"]) if start else 0
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size:
        return spark.createDataFrame([], out)
    kept = kept.filter(F.size("v") == size)
    # The sample has SAMPLE rows at most; it decides how many rows are scored exactly, not what is found.
    books = fitted(np.array([r["v"] for r in kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, norms = coded(stacked(b["v"]), books) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in norms], pa.binary())], ["id", "label", "v", "anchor", "codes", "norms"])

    index = steps.write(kept.mapInArrow(encode, "id long, label long, v array<int>, anchor boolean, codes binary, norms binary"), "index")
    steps.drop("vectors")
    total = index.filter("anchor").count()
    blocks = -(-total // anchors)
    path = f"{steps.path}/found-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([], out).write.parquet(path)
    stored = index.select("id", "label", "v", "codes", "norms")
    for block in range(blocks):
        own = index.filter(F.col("anchor") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).select("id", "label", "v").orderBy("id").collect()
        if not own:
            continue
        ids, labels, v = (np.array([r[c] for r in own], np.int64) for c in ("id", "label", "v"))
        everything = np.full((len(own), 1), LOW), np.full((len(own), 1), HIGH)
        near = stored.mapInArrow(_found(lambda: Search(ids, labels, v, *everything, books, True, positives), lambda a, w: {"anchor_id": ids[a]}), "anchor_id long, id long, score long")  # noqa: B023  pickled in this turn
        near = sorted(_ranked(near, ["anchor_id"], positives).collect())  # at most `positives` for each anchor of the block
        place = {int(i): k for k, i in enumerate(ids)}
        low, high, good, worth = np.full((len(own), positives), HIGH), np.full((len(own), positives), LOW), np.zeros((len(own), positives), np.int64), np.zeros((len(own), positives), np.int64)
        for r in near:
            at = place[r["anchor_id"]], r["rank"] - 1
            low[at], high[at] = -(-share[0] * r["score"] // 100), share[1] * r["score"] // 100
            good[at], worth[at] = r["id"], r["score"]
        told = lambda a, w: {"anchor_id": ids[a], "positive_id": good[a, w], "positive_score": worth[a, w]}  # noqa: E731, B023
        hard = stored.mapInArrow(_found(lambda: Search(ids, labels, v, low, high, books, False, negatives), told), "anchor_id long, positive_id long, positive_score long, id long, score long")  # noqa: B023
        hard = _ranked(hard, ["anchor_id", "positive_id"], negatives)
        hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    steps.drop("index")
    return spark.read.schema(out).parquet(path)


#: The same in SQL, by the scores of all anchors with all rows.
SQL = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label IS NOT NULL),
t AS (SELECT vec_id FROM x GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
v AS MATERIALIZED (SELECT vec_id, label, j, CAST(floor(256 * x) AS BIGINT) AS v FROM x JOIN t USING (vec_id)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, any_value(a.label) = any_value(b.label) AS same, CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.j = b.j WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) QUALIFY row_number() OVER w <= 10
"""
