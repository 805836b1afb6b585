"""Toxicity by a logistic model with a counterfactual penalty.

Features are words and word starts, hashed. Counts over the labelled sample choose the features that tell the classes
apart. The model is fitted with a penalty on the change of the score when the identity terms of a labelled text are swapped
for others of their kind, so that a neutral mention of a group does not raise the score.

Identity terms are a parameter. To the given ones, terms of the labelled sample are added that are mentioned as often in toxic
as in other texts: what is said of them, not they themselves, tells the classes apart, so they are swapped for each other too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialise, slices
from .language_id import held_out

BUCKETS = 1 << 18
#: Identity terms; those of one line are swapped for each other.
IDENTITY_TERMS = [
    "women men girls boys", "woman man girl boy", "female male", "gay straight lesbian bisexual", "transgender cisgender",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "islam christianity judaism hinduism buddhism",
    "black white asian latino", "african european american mexican chinese indian", "immigrants natives refugees", "old young", "deaf blind disabled",
    "frauen männer", "femmes hommes", "mujeres hombres", "juden christen muslime", "juifs chrétiens musulmans", "judíos cristianos musulmanes",
]
#: Terms that are found in the sample: at most so many, each in so many texts of both classes at least, whose share of the
#: texts differs by at most so many standard errors.
NEUTRAL_TERMS, NEUTRAL_TEXTS, NEUTRAL_Z = 16, 5, 1.0
_WORDS = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: the word and its starts of 4 to 6 letters."""
    return [xxhash.xxh64_intdigest(x) % BUCKETS for x in ["w" + word, *("p" + word[:k] for k in (4, 5, 6) if len(word) >= k)]]


class Features(dict):
    """From a run without white space to its features among the chosen ones (index by bucket), remembered up to `most` runs."""

    def __init__(self, index: np.ndarray | None, most: int = 150_000):
        super().__init__()
        self.index, self.most = index, most

    def __missing__(self, run: str) -> tuple[int, ...]:
        found = [f for w in _WORDS.findall(run) for f in features(w)]
        if self.index is not None:
            found = [int(self.index[f]) for f in found if self.index[f] >= 0]
        if len(self) >= self.most:
            self.clear()
        self[run] = out = tuple(found)
        return out

    def of(self, text: str) -> set[int]:
        return set().union(*filter(None, map(self.__getitem__, set(text.lower().split()))))


def swaps(groups: list[list[str]]) -> dict[str, str]:
    """Each term and the one that it is swapped for: the next of its group. The first group that has a term counts."""
    out: dict[str, str] = {}
    for group in groups:
        for k, w in enumerate(group):
            out.setdefault(w, group[(k + 1) % len(group)])
    return out


def swapped(text: str, swap: dict[str, str]) -> str | None:
    """The lower-case text with its identity terms swapped; None if it has none."""
    low = text.lower()
    out = _WORDS.sub(lambda m: swap.get(m[0], m[0]), low)
    return None if out == low else out


def neutral_terms(rows: DataFrame, t0: float, t1: float) -> list[list[str]]:
    """Groups of terms from rows (text, y), t0 and t1 of them with each label: pairs of words whose shares of the toxic and of the
    other texts are alike, the commonest first. At most NEUTRAL_TERMS rows are gathered."""
    if not t0 or not t1:
        return []
    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    n = words.groupBy("w").agg(F.sum(F.when(F.col("y") > 0, 0).otherwise(1)).alias("n0"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("n1"))
    p0, p1 = (F.col("n0") + 0.5) / (t0 + 1), (F.col("n1") + 0.5) / (t1 + 1)
    z = F.abs(p1 - p0) / F.sqrt(p1 / (t1 + 1) + p0 / (t0 + 1))
    n = n.filter((F.col("n0") >= NEUTRAL_TEXTS) & (F.col("n1") >= NEUTRAL_TEXTS) & (F.length("w") > 2) & (z <= NEUTRAL_Z))
    found = [r["w"] for r in n.orderBy(F.desc(F.col("n0") + F.col("n1")), "w").limit(NEUTRAL_TERMS).collect()]
    return [found[k : k + 2] for k in range(0, len(found) - 1, 2)]


def fit(y: np.ndarray, texts: tuple[np.ndarray, np.ndarray], changes: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, penalty: float = 1.0, ridge: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the log loss, a ridge and penalty * (score change by the swap)^2.

    y: labels; texts: row and feature of all features of all texts; changes: pair, feature and sign (1 lost, -1 gained) of what a
    swap changes. Accelerated gradient steps on these arrays.
    """
    own, at = texts
    p_own, p_at, p_sign = changes
    rows, pairs = y, range(int(p_own.max(initial=-1)) + 1)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, b = np.zeros(size), 0.0
    vw, vb, m = np.zeros(size), 0.0, np.full(size, 1e-8)
    for step in range(1, rounds + 1):
        z = np.bincount(own, w[at], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(at, g[own], size) + ridge * w / max(1, len(rows)) ** 0.5
        if pairs:
            d = np.bincount(p_own, p_sign * w[p_at], len(pairs))
            grad += 2 * penalty / len(pairs) * np.bincount(p_at, p_sign * d[p_own], size)
        vw, vb = 0.9 * vw + 0.1 * grad, 0.9 * vb + 0.1 * g.sum()
        m = 0.99 * m + 0.01 * grad**2
        w = w - 0.05 * (vw / (1 - 0.9**step)) / (np.sqrt(m / (1 - 0.99**step)) + 1e-6)
        b -= 2.0 * vb / (1 - 0.9**step)
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 30_000, max_features: int = 4096, penalty: float = 1.0, terms: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(index of the chosen features by bucket, weights, intercept).

    At most about max_rows labelled rows are used, picked by a hash of their id; ids that have several labels count as toxic
    if one of them says so, and ids that have several texts give a labelled row for each. terms: groups of identity terms, as
    IDENTITY_TERMS. The driver holds the features of these rows in arrays, four bytes each.
    """
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = min(1.0, max_rows / max(1, labels.count()))
    sample = labels.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(sample), id_col).select("text", F.col("y").cast("long"))  # max_rows bounds the broadcast side
    rows = materialise(rows, "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, sums = Features(None), np.zeros((2, BUCKETS + 1), np.int64)
        for b in slices(batches, "text"):
            for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True):
                found = np.fromiter(every.of(text or ""), np.int64)
                sums[int(y > 0), found] += 1
                sums[int(y > 0), BUCKETS] += 1
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["f", "n0", "n1"])

    sums = rows.mapInArrow(counted, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = sums.filter("n1 >= 3 or n0 >= 20 or f = " + str(BUCKETS)).toPandas()  # at most BUCKETS + 1 rows
    whole = table[table["f"] == BUCKETS]
    t0, t1 = (float(whole[c].sum()) for c in ("n0", "n1"))
    swap = swaps([line.split() for line in (IDENTITY_TERMS if terms is None else terms)] + neutral_terms(rows, t0, t1))
    table = table[table["f"] < BUCKETS]
    n0, n1 = table["n0"].to_numpy(float), table["n1"].to_numpy(float)
    p0, p1 = (n0 + 0.5) / (t0 + 1), (n1 + 0.5) / (t1 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - np.minimum(p1, 0.999)) / (t1 + 1) + p0 * (1 - np.minimum(p0, 0.999)) / (t0 + 1) + 1e-12)
    chosen = table["f"].to_numpy()[np.argsort(-np.abs(z), kind="stable")][:max_features]
    always = sorted({f for w in swap for f in features(w)})
    chosen = np.unique(np.concatenate([chosen, always])).astype(np.int64)
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(index)
        for b in slices(batches, "text"):
            texts = [t or "" for t in b["text"].to_pylist()]
            here = [own.of(t) for t in texts]
            there = [None if o is None else own.of(o) for o in (swapped(t, swap) for t in texts)]
            parts = [here, [set() if o is None else a - o for a, o in zip(here, there, strict=True)], [set() if o is None else o - a for a, o in zip(here, there, strict=True)]]
            yield pa.RecordBatch.from_arrays([*(pa.array([np.array(sorted(x), "<i4").tobytes() for x in p], pa.binary()) for p in parts), b["y"]], ["a", "lost", "gained", "y"])

    fitted = rows.mapInArrow(selected, "a binary, lost binary, gained binary, y long").toArrow()
    y = (fitted["y"].to_numpy() > 0).astype(float)
    if not len(y) or t0 == 0 or t1 == 0:
        return index, np.zeros(len(chosen)), -1.0

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        xs = fitted[name].to_pylist()
        return np.repeat(np.arange(len(xs)), [len(x) // 4 for x in xs]), np.frombuffer(b"".join(xs), "<i4").astype(np.int64)

    texts, (lost_own, lost), (gained_own, gained) = flat("a"), flat("lost"), flat("gained")
    pair = np.unique(np.concatenate([lost_own, gained_own]), return_inverse=True)[1]  # rows that a swap changes, numbered
    changes = pair, np.concatenate([lost, gained]), np.concatenate([np.ones(len(lost)), -np.ones(len(gained))])
    return index, *fit(y, texts, changes, len(chosen), penalty)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", limit: float = 0.7, score_col: str = "score", pred_col: str = "predicted") -> DataFrame:
    """Adds score_col (0 to 1) and pred_col (1 from `limit` on) to each row; null counts as empty. Columns of these names that
    docs has already are replaced. An empty table gives no rows, repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f.name for f in docs.schema if f.name not in (score_col, pred_col)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, b0 = shared.value
        own, w = Features(index), w.tolist()
        for b in slices(batches, text_col):
            z = np.array([b0 + sum(w[f] for f in own.of(t or "")) for t in b[text_col].to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b[f] for f in fields), pa.array(s), pa.array((s >= limit).astype(np.int32))], [*fields, score_col, pred_col])

    schema = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{f}`") for f in fields]).mapInArrow(judged, f"{schema}, `{score_col}` double, `{pred_col}` int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that are not taken for toxic, with all their columns as they are."""
    model = train(docs, labels, id_col, text_col, label_col)
    pred, name = held(docs.columns, "predicted"), held(docs.columns, "score")
    return score(docs, model, text_col, score_col=name, pred_col=pred).filter(F.col(pred) == 0).select(docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = 0.7, penalty: float = 1.0, terms: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted. Learns from labels of rows that are not held out.

    Null texts count as empty. Without labels of both classes all scores are alike and below one half. Repeated rows give
    repeated rows with one score; an empty table gives no rows. Other columns are no inputs of a score.
    """
    model = train(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col, penalty=penalty, terms=terms)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, model, "text", limit).drop("text")
