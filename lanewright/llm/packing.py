"""Packing of token streams into windows by non-negative least squares.

Pieces (documents, cut at whole windows) are counted in a histogram of length classes. All combinations of up to three
classes that fill a window are enumerated; non-negative least squares gives how often each is to be used; the counts are
rounded so that no class is overdrawn. What is left over is packed greedily, the largest class that fits first. The emptiest
windows are then given up: their pieces are cut to fill exactly the room that is left in all others. So only the last window
is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordCoder
from .common import Steps, kept, running_total, slices

#: Length classes in a window.
CLASSES = 64
#: Bytes of text that are encoded at once.
SLICE = 1 << 22
#: Positions of a block of the room that the rest of the tokens is dealt into.
BLOCK = 1 << 16


def shallow(classes: int = CLASSES, depth: int = 3) -> np.ndarray:
    """All combinations of up to `depth` classes with the sum `classes`, as columns of counts for each class 1..classes."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], least: int, room: int) -> None:
        if not room:
            found.append(parts)
        elif len(parts) < depth:
            for c in range(least, room + 1):
                if c == room or room - c >= c:
                    extend((*parts, c), c, room - c)

    extend((), 1, classes)
    out = np.zeros((classes, len(found)))
    for j, parts in enumerate(found):
        for c in parts:
            out[c - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active-set method (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= 1e-9 * max(1.0, abs(b).max()):
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min(initial=np.inf) > 0:
                break
            low = passive & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                s = np.zeros(n)
                break
        if (s == x).all():
            break
        x = s
    return x


def greedy(left: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Patterns (counts of each class) and how often each is used, until no piece is left: each window takes the largest class
    that still fits, again and again. A pattern is used as often as there are pieces for it."""
    left, patterns, times = left.astype(np.int64).copy(), [], []
    while left.any():
        pattern, rest, room = np.zeros(len(left), np.int64), left.copy(), len(left)
        while room:
            fits = np.flatnonzero(rest[:room])
            if not len(fits):
                break
            c = int(fits[-1])
            n = min(int(rest[c]), room // (c + 1))
            pattern[c] += n
            rest[c] -= n
            room -= n * (c + 1)
        used = pattern > 0
        n = int((left[used] // pattern[used]).min())
        left -= n * pattern
        patterns.append(pattern)
        times.append(n)
    return patterns, times


def plan(counts: np.ndarray, tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each is used) for a histogram: pieces and tokens of each class 1, 2, ...

    The rounded solution is used as it is; the residuals are packed greedily. Then windows are given up, those with most room
    first, until their tokens can fill the room of all others. The used counts never need more pieces than there are.
    """
    a = shallow(len(counts))
    scale = np.sqrt(np.maximum(counts, 1))
    use = np.floor(nnls(a / scale[:, None], counts / scale))
    left, times = counts.astype(float).copy(), np.zeros(a.shape[1])
    for j in np.argsort(-use, kind="stable"):
        need = a[:, j] > 0
        n = min(use[j], np.floor((left[need] / a[need, j]).min()))
        if n > 0:
            times[j] = n
            left[need] -= n * a[need, j]
    more, often = greedy(left)
    patterns = np.concatenate([a, np.array(more, float).T.reshape(len(counts), len(more))], 1)
    times = np.concatenate([times, often])
    mean = np.divide(tokens, counts, out=np.zeros_like(tokens, dtype=float), where=counts > 0)
    fill = mean @ patterns
    room = window - fill
    missing = 1.03 * (times * room).sum() + window  # room of the windows that stay, less what was given up; means are not exact
    for j in np.argsort(-room, kind="stable"):
        if missing <= 0:
            break
        n = min(times[j], np.ceil(missing / window))
        times[j] -= n
        missing -= n * window
    return patterns, times


def tokenised(docs: DataFrame, path: str, end: int, window: int, with_ids: bool = False, units: int = 200_000) -> DataFrame:
    """Pieces of all documents: part, rank (in its class and part), class, id, start, length, ids_crc32, doc_tokens, ids.

    Nothing is cut from full windows again, so their ids are null unless they are asked for.
    """
    kind = docs.schema["id"].dataType.simpleString()
    step = -(-window // CLASSES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, part = kept(WordCoder, path, units), TaskContext.get().partitionId()
        stop, ranks = np.array([end], "<u2").tobytes(), [0] * (CLASSES + 2)
        for b in slices(batches, "text", SLICE):
            rows: list[tuple] = []
            each: list[int] = []
            for k, coded in enumerate(c.encode_column(b["text"])):
                coded += stop
                total = len(coded) // 2
                for start in range(0, total, window):
                    own = coded[2 * start : 2 * (start + window)]
                    n = len(own) // 2
                    cls = CLASSES + 1 if n == window else -(-n // step)
                    crc = zlib.crc32(np.frombuffer(own, "<u2").astype("<u4").tobytes())
                    rows.append((part, ranks[cls], cls, start, n, crc, total, own if with_ids or n < window else None))
                    ranks[cls] += 1
                    each.append(k)
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(each)), *(pa.array(x, t) for x, t in zip(cols, kinds, strict=True))], ["id", "part", "rank", "class", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.mapInArrow(pieces, f"id {kind}, part int, rank long, class int, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, units: int = 200_000) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, two bytes each).

    Null and empty texts are documents of one token, the end id. Repeated rows are packed as often as they occur. An empty
    table gives no rows. Other columns of docs are ignored. At most one window is not full. units: words whose ids a worker keeps, a
    matter of memory and time alone.
    """
    steps = Steps(docs.sparkSession, "packing")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = steps.write(tokenised(docs, path, end, window, with_ids, units), "pieces")

    # The histogram has CLASSES + 1 rows, whatever the input.
    hist = {r["class"]: (r["n"], r["t"]) for r in pieces.groupBy("class").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()}
    counts, tokens = (np.array([hist.get(c, (0, 0))[i] for c in range(1, CLASSES + 1)], float) for i in (0, 1))
    full = hist.get(CLASSES + 1, (0, 0))[0]
    a, times = plan(counts, tokens, window)

    # Ranks over all parts; each part tells only how many pieces of a class it has.
    sizes = pieces.groupBy("part", "class").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(sizes, ["part", "class"]).withColumn("rank", F.col("rank") + F.col("base"))

    # From a rank in a class to a sequence: each class is dealt to the combinations one after another, in runs.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # class: (first rank, end, pieces in each sequence, first sequence)
    drawn, first = np.zeros(CLASSES, np.int64), full
    for j in np.flatnonzero(times):
        for c in np.flatnonzero(a[:, j]):
            n = int(times[j] * a[c, j])
            runs.setdefault(int(c) + 1, []).append((int(drawn[c]), int(drawn[c]) + n, int(a[c, j]), first))
            drawn[c] += n
        first += int(times[j])
    combined = first
    spark = docs.sparkSession
    dealt = [(c, *r) for c, rs in runs.items() for r in rs] + [(CLASSES + 1, 0, full, 1, 0)]
    runs_df = spark.createDataFrame([(c, lo, hi, m, s) for c, lo, hi, m, s in dealt], "class int, lo long, hi long, each long, seq long")
    # At most one run for each class of each combination, so its size has a fixed bound.
    found = ranked.join(F.broadcast(runs_df), (ranked["class"] == runs_df["class"]) & (ranked["rank"] >= runs_df["lo"]) & (ranked["rank"] < runs_df["hi"]), "left").drop(runs_df["class"])
    found = found.withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    exact = found.filter(F.col("class") == CLASSES + 1).withColumn("offset", F.lit(0).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "class", "rank")
    fitted = found.filter(F.col("sequence_id").isNotNull() & (F.col("class") <= CLASSES))
    fitted = fitted.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    placed = exact.select(columns).unionByName(fitted.select(columns))

    # The rest as one stream, in the order of parts and classes, and the room as another; overlaps of the two are the last pieces.
    # Both are written once: each is used several times, and without this the plan repeats the joins above for every use.
    slot = F.col("part").cast("long") * (CLASSES + 2) + F.col("class")
    rest = steps.write(found.filter(F.col("sequence_id").isNull()).select("id", "start", "length", "doc_tokens", "ids", slot.alias("slot"), "rank"), "rest")
    bases = running_total(rest.groupBy("slot").agg(F.sum("length").alias("t")), "slot", "t", "base_t").select("slot", "base_t")
    run = Window.partitionBy("slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("from", F.coalesce(F.sum("length").over(run), F.lit(0))).join(bases, "slot").withColumn("from", F.col("from") + F.col("base_t"))
    rest = rest.select("id", "start", "length", "doc_tokens", "ids", "from", (F.col("from") + F.col("length")).alias("to"))

    room = fitted.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("free", F.lit(window) - F.col("used"))
    room = steps.write(running_total(steps.write(room.filter(F.col("free") > 0), "free"), "sequence_id", "free", "room_from"), "room")
    steps.drop("free")
    totals = room.agg(F.coalesce(F.sum("free"), F.lit(0)).alias("t")).collect()[0]["t"]
    room = room.select("sequence_id", F.col("used").alias("at"), "room_from", (F.col("room_from") + F.col("free")).alias("room_to"))
    # Beyond the room of the combinations, windows of their own: positions map to them by arithmetic.
    pos = F.col("p")
    cut_rest = rest.withColumn("b", F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("to") - 1) / BLOCK))))
    room_b = room.withColumn("b", F.explode(F.sequence(F.floor(F.col("room_from") / BLOCK), F.floor((F.col("room_to") - 1) / BLOCK))))
    inside_room = cut_rest.join(room_b, "b").filter((F.col("from") < F.col("room_to")) & (F.col("room_from") < F.col("to")))
    p = F.greatest("from", "room_from")
    inside_room = inside_room.filter(F.floor(p / BLOCK) == F.col("b")).select(
        "id", "doc_tokens", "ids", (F.col("start") + p - F.col("from")).alias("start"), (p - F.col("from")).alias("skip"),
        (F.least("to", "room_to") - p).alias("length"), "sequence_id", (F.col("at") + p - F.col("room_from")).alias("offset"))
    own = rest.filter(F.col("to") > totals).withColumn("lo", F.greatest(F.col("from"), F.lit(totals)))
    own = own.withColumn("w", F.explode(F.sequence(F.floor((F.col("lo") - totals) / window), F.floor((F.col("to") - 1 - totals) / window))))
    own = own.withColumn("p", F.greatest(F.col("lo"), F.col("w") * window + totals)).withColumn("e", F.least(F.col("to"), (F.col("w") + 1) * window + totals))
    own = own.select(
        "id", "doc_tokens", "ids", (F.col("start") + pos - F.col("from")).alias("start"), (pos - F.col("from")).alias("skip"), (F.col("e") - pos).alias("length"),
        (F.col("w") + combined).cast("long").alias("sequence_id"), (pos - totals - F.col("w") * window).cast("long").alias("offset"))
    last = inside_room.unionByName(own).withColumn("ids", F.substring(F.col("ids"), (2 * F.col("skip") + 1).cast("int"), (2 * F.col("length")).cast("int")))

    @F.pandas_udf("long")
    def crc(ids):  # the contract's digest is over four bytes an id
        return ids.map(lambda x: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()))

    last = last.withColumn("ids_crc32", crc("ids")).select(columns)
    return placed.unionByName(last).withColumnRenamed("id", id_col)
