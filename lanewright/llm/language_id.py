"""Language mixtures by expectation-maximisation over n-gram likelihoods.

Each language has a distribution over hashed letter trigrams, counted over all labelled training rows. A text is a mixture
of languages: short runs of trigrams are its observations, and expectation-maximisation estimates its proportions. Growing
language sets are fitted, and the set with the best likelihood less a penalty for each language is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, slices, small_batches

BUCKETS, RUN = 1 << 16, 16
#: Bytes of text that are turned into trigrams at once.
PART = 1 << 19


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """What stands for each code point: lower-case letters for themselves, the rest as 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(x.lower()[0])
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams of all texts, where each text starts, and letters of each text."""
    joined = "\n\n\n".join(texts) + "\n\n\n"  # so no trigram reaches from one text into the next
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = letters()[codes]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(len(texts)), sizes)
    h = (a[at] * np.uint32(0x9E3779B1)) ^ (a[at + 1] * np.uint32(0x85EBCA77)) ^ (a[at + 2] * np.uint32(0xC2B2AE3D))
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)
    return h, starts, np.add.reduceat((a[at] > 0).astype(np.int64), starts) if len(texts) else np.zeros(0, np.int64)


def train(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket in each. Null texts count as empty.

    At most BUCKETS rows a language are gathered, so what the driver and each task hold grows with the number of languages,
    half a megabyte each, and not with the documents.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, "text", PART):
            texts, langs = [t or "" for t in b["text"].to_pylist()], b["lang"].to_pylist()
            h, starts, _ = trigrams(texts)
            own = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(h))))
            for lang in set(langs):
                mine = np.array([x == lang for x in langs])
                sums[lang] = sums.get(lang, 0) + np.bincount(h[mine[own]], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(counted, "lang string, bucket long, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, table["lang"]), table["bucket"]] = table["n"]
    smooth = counts + 0.5
    return names, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)


def mixtures(ll: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each text. ll: runs x languages; starts: first run of each text."""
    sizes = np.diff(np.append(starts, len(ll)))
    own = np.repeat(np.arange(len(starts)), sizes)
    top = ll.max(1, keepdims=True)
    likes = np.exp(ll - top)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = likes * pi[own]
        whole = np.maximum(joint.sum(1, keepdims=True), 1e-300)
        pi = np.add.reduceat(joint / whole, starts, axis=0) / sizes[:, None]
    whole = np.maximum((likes * pi[own]).sum(1), 1e-300)
    return pi, np.add.reduceat(np.log(whole) + top[:, 0], starts)


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the main language, its proportion where all languages are allowed, and letters, of each text."""
    h, starts, count = trigrams(texts)
    sizes = np.diff(np.append(starts, len(h)))
    runs = -(-sizes // RUN)
    first = np.cumsum(runs) - runs
    inside = np.arange(int(runs.sum())) - np.repeat(first, runs)
    cuts = np.repeat(starts, runs) + RUN * inside
    ll = np.stack([np.add.reduceat(row[h], cuts) for row in table], 1).astype(np.float64)
    n, k = len(texts), len(table)
    full, _ = mixtures(ll, first, np.ones((n, k)))
    order = np.argsort(-full, 1, kind="stable")
    best, main = np.full(n, -np.inf), order[:, 0].copy()
    for size in range(1, k + 1):
        allowed = np.zeros((n, k))
        np.put_along_axis(allowed, order[:, :size], 1.0, 1)
        pi, like = mixtures(ll, first, allowed)
        worth = like - 0.5 * size * np.log(runs + 1) * 4
        better = worth > best
        if not better.any():
            break
        best[better], main[better] = worth[better], pi[better].argmax(1)
    return main, full[np.arange(n), main], count


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def predict(docs: DataFrame, names: list[str], table: np.ndarray, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds pred_col and score_col to each row. und, 0 for null texts, texts without letters, and where nothing was learned.

    Columns of these names that docs has already are replaced. An empty table gives no rows, repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)
    fields = [f.name for f in docs.schema if f.name not in (pred_col, score_col)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, PART):
            texts = [t or "" for t in b[text_col].to_pylist()]
            if names and texts:
                main, share, count = infer(texts, shared.value)
                langs = [names[m] if c else "und" for m, c in zip(main, count, strict=True)]
                scores = np.where(count > 0, np.clip(share, 0, 1), 0.0)
            else:
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(b[f] for f in fields), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*fields, pred_col, score_col])

    schema = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{f}`") for f in fields]).mapInArrow(judged, f"{schema}, `{pred_col}` string, `{score_col}` double")


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, PART):
            counts = trigrams([t or "" for t in b[text_col].to_pylist()])[2].tolist()
            yield b.filter(pa.array([n > 0 for n in counts], pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not und, with all their columns as they are. Where no language was learned, the rows with a
    letter: that nothing was learned says nothing about the texts."""
    names, model = train(docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()), text_col, lang_col)
    if not names:
        return lettered(docs, text_col)
    pred, score = held(docs.columns, "lang_pred"), held(docs.columns, "score")
    return predict(docs, names, model, text_col, pred, score).filter(F.col(pred) != "und").select(docs.columns)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: id, held_out, lang_pred, score. Learns from rows that are not held out and have a lang.

    und, 0 for null and empty texts, texts without a letter of any plane, and for all rows if there is nothing to learn from.
    Repeated rows give repeated rows, and count as often as they occur when the model learns. An empty table gives no rows.
    Other columns are ignored. Ids must not be null.
    """
    names, table = train(docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()), text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, names, table).drop("text")
