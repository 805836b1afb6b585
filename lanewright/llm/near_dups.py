"""Exact Jaccard join of word-shingle sets, by set size.

Equal sets are one class; all else works on one set of each class. Small sets are joined by enumerating their subsets with a
few shingles left out: two sets link exactly if they share a subset that is large enough. Large sets are joined by scanning
inverted lists of the first shingles of each set, frequent shingles last in order. The boundary between small and large is
the one with the lower cost. A list whose sets are linked already is not scanned again: sets are first compared with one
set of each list, and only sets of different components are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, join_groups, least_hot, salted_join, sendable, slices

#: Each task counts the shingles of all its sets in a summary of this many counters, and hands on at most so many of the
#: largest; of all tasks, so many are taken for frequent. These only choose an order of the shingles; the result does not
#: depend on them.
COUNTERS, HANDED, FREQUENT = 1 << 18, 1 << 16, 200_000
#: Digests of sets that a task remembers, so that copies count once.
REMEMBERED = 1 << 15
EMPTY = np.zeros(0, np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The set of hashed k-word shingles of each text, sorted, not negative. Fewer than k words are one shingle. Each word of
    all texts is hashed once."""
    trimmed = pc.ascii_trim_whitespace(texts)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(trimmed))
    words = parts.flatten().dictionary_encode()
    each = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))[words.indices.to_numpy()]
    at = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    out = np.full(len(h), k, np.uint64)
    for i in range(k):  # of what begins in a text's last k - 1 words, nothing is used
        out[: len(h) - i] = _mixed(out[: len(h) - i] * np.uint64(0xD6E8FEB86659FD93) + h[i:])
    out, found = (out >> np.uint64(2)).astype(np.int64), []
    for a, b, empty in zip(at[:-1].tolist(), at[1:].tolist(), pc.equal(pc.binary_length(trimmed), 0).to_pylist(), strict=True):
        if empty:
            found.append(EMPTY)
        elif b - a >= k:
            s = np.sort(out[a : b - k + 1])
            found.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = _mixed(one * np.uint64(0xD6E8FEB86659FD93) + h[i : i + 1])
            found.append((one >> np.uint64(2)).astype(np.int64))
    return found


def least_overlap(n: int, t: tuple[int, int]) -> int:
    """Shingles that a set of n has in common with any set it links with, at least."""
    return -(-t[0] * n // t[1])


def boundaries(t: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(left out, boundary, largest partner): sets up to the boundary link only with sets up to the largest partner, and all
    these links are found by leaving out at most so many shingles."""
    out = []
    for drop in (0, 1, 2):
        b = 0
        while (t[1] - t[0]) * ((b + 1) * t[1] // t[0]) // t[1] <= drop:
            b += 1
        out.append((drop, b, b * t[1] // t[0]))
    return out


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A set in the common order: frequent shingles last."""
    if not len(frequent):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = frequent[at] == s
    return np.concatenate([s[~often], s[often]])


#: Buckets of a sketch: how many shingles of a set fall into each, in one byte each. In columns, eight are in a long integer.
BUCKETS = 64
PACKED = [f"k{i}" for i in range(BUCKETS // 8)]
#: The shingles of so many buckets (the first packed column) are compared before whole sets are.
PART = 8
#: Entries of a list that meet in one task; larger lists are cut into blocks, and each pair of blocks is a task of its own.
BLOCK = 2048


def packed(s: np.ndarray) -> list[int | None]:
    """Counts of the sketch, eight in an integer; null if they are larger than a byte."""
    n = np.bincount(s & (BUCKETS - 1), minlength=BUCKETS)
    return [None] * len(PACKED) if n.max(initial=0) > 255 else n.astype("u1").view("<i8").tolist()


def packed_overlap(a: list, b: list):
    """No two sets with these sketches have more shingles in common; null if one of the sketches is."""
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(255)
    return reduce(lambda x, y: x + y, (F.least(byte(x, k), byte(y, k)) for x, y in zip(a, b, strict=True) for k in range(8)))


def links_possible(n, m, a: list, b: list, t: tuple[int, int]):
    """Whether the sizes n and m and the sketches of two sets leave room for a link."""
    both = F.least(n, m, F.coalesce(packed_overlap(a, b), F.lit(1 << 40)))
    return both * (t[0] + t[1]) >= t[0] * (n + m)


def _sets(rows: DataFrame, k: int, t: tuple[int, int], frequent: np.ndarray, whole: int) -> DataFrame:
    """id, n, hash of the set, its sketch, and its first shingles in the common order: as many as a link must touch; all of
    small sets."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    names = ["id", "n", "h1", "h2", "first", *PACKED]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n, h1, h2, first, ends, small = [], [], [], [EMPTY], [0], []
            for s in shingles(b["text"], k):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                small.append(packed(s))
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & ((1 << 64) - 1)) - (1 << 63))
                s = ordered(s, shared.value)
                first.append(s if len(s) <= whole else s[: len(s) - least_overlap(len(s), t) + 1])
                ends.append(ends[-1] + len(first[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first), pa.int64()))
            yield pa.RecordBatch.from_arrays([b["id"], *(pa.array(x, pa.int64()) for x in (n, h1, h2)), lists, *(pa.array([x[c] for x in small], pa.int64()) for c in range(len(PACKED)))], names)

    return rows.mapInArrow(made, "id long, n long, h1 long, h2 long, first array<long>, " + ", ".join(f"{c} long" for c in PACKED))


class Counters:
    """Counts of keys in bounded memory: as Misra and Gries, a count falls short by at most the total over `most`."""

    def __init__(self, most: int):
        self.most, self.keys, self.counts, self.new, self.waiting = most, EMPTY, EMPTY, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.waiting += len(keys)
        if self.waiting >= self.most:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *self.new])
        counts = np.concatenate([self.counts, np.ones(len(keys) - len(self.keys), np.int64)])
        self.new, self.waiting = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else EMPTY
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else EMPTY
        if len(self.keys) > self.most:
            cut = np.partition(self.counts, len(self.counts) - self.most - 1)[len(self.counts) - self.most - 1]
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def largest(self, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        at = np.flatnonzero(self.counts >= least)
        at = at[np.argsort(-self.counts[at], kind="stable")[:n]]
        return self.keys[at], self.counts[at]


def _frequent(rows: DataFrame, k: int) -> np.ndarray:
    """Shingles that are in many different sets of all rows, sorted."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = Counters(COUNTERS), set()
        for b in slices(batches, "text"):
            for s in shingles(b["text"], k):
                d = xxhash.xxh3_64_intdigest(s.tobytes())
                if d not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    counters.add(s)
        keys, counts = counters.largest(HANDED, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["s", "c"])

    counts = rows.select("text").mapInArrow(counted, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).filter("c >= 3")
    return np.sort(counts.orderBy(F.desc("c"), "s").limit(FREQUENT).select("s").toPandas()["s"].to_numpy(np.int64))


def _small_links(sets: DataFrame, drop: int, most: int, t: tuple[int, int], steps: Steps) -> DataFrame:
    """Links (a, b) among sets of up to `most` shingles, through subsets with up to `drop` shingles left out.

    What a pair has in common is at least the subset; if the sizes allow the link for any pair of a subset, they allow it for
    each of the two and the smallest set of the subset. So each set is linked with that one.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = []
                for i, n, s in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["first"].to_pylist(), strict=True):
                    h = _mixed(np.array(s, np.uint64) + np.uint64(0x632BE59BD9B4E019))
                    total = int(h.sum(dtype=np.uint64))
                    h = h.tolist()
                    for d in range(0, min(drop, n - 1) + 1):
                        out += [(((total - sum(x)) & ((1 << 64) - 1)) - (1 << 63), n - d, i, n) for x in combinations(h, d)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["key", "size", "id", "n"])

    keys = steps.write(sets.filter((F.col("n") <= most) & (F.col("n") > 0)).select("id", "n", "first").mapInArrow(made, "key long, size long, id long, n long"), "subsets")
    hubs = keys.groupBy("key", "size").agg(F.min(F.struct("n", "id")).alias("hub"), F.count("*").alias("c")).filter("c > 1")
    pairs = join_groups(keys, hubs, ["key", "size"], "c", keys.count(), steps)
    fits = F.lit(t[1]) * F.col("size") >= F.lit(t[0]) * (F.col("n") + F.col("hub.n") - F.col("size"))
    links = steps.write(pairs.filter(fits & (F.col("id") != F.col("hub.id"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")), "links")
    steps.drop("subsets", "groups")
    return links


def _with_side(pairs: DataFrame, total: int, side: DataFrame, key: str) -> DataFrame:
    """Pairs with the columns of side for their key; one set may be in a third of all pairs."""
    counts = pairs.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") > least_hot(total))
    return salted_join(pairs, side, key, counts, total, "b" if key == "a" else "a")


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, k: int, t: tuple[int, int], steps: Steps, sketched: bool) -> DataFrame:
    """Those of the pairs (a, b) whose sets link. The whole sets are made again from the texts, for documents that need it.

    sketched: the sketches of the pairs have been compared already.
    """
    pairs = steps.write(pairs.distinct(), "pairs")
    total = pairs.count()
    if not sketched:
        for key in ("a", "b"):
            side = sets.select(F.col("id").alias(key), F.col("n").alias(f"n_{key}"), *(F.col(c).alias(f"{c}_{key}") for c in PACKED))
            pairs = _with_side(pairs, total, side, key)
        sketches = ([F.col(f"{c}_{key}") for c in PACKED] for key in ("a", "b"))
        pairs = steps.replace(pairs.filter(links_possible(F.col("n_a"), F.col("n_b"), *sketches, t)).select("a", "b"), "pairs")
        total = pairs.count()
    ids = steps.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            cols = [b["id"]]
            found = shingles(b["text"], k)
            for sets in (found, [s[(s & (BUCKETS - 1)) < PART] for s in found]):
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([EMPTY, *sets]))))
            packs = [packed(s) for s in found]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([x[c] for x in packs], pa.int64()) for c in range(len(PACKED)))], ["id", "s", "part", *PACKED])

    own = steps.write(rows.join(sendable(ids), "id").mapInArrow(made, "id long, s array<long>, part array<long>, " + ", ".join(f"{c} long" for c in PACKED)), "whole")
    # First the shingles of an eighth of the buckets, and of the others the counts: what two sets can have in common at most. Of
    # two sets that have little in common, few bytes are moved so. All of it is row by row in the JVM: a batch of pairs of very long
    # sets would have no bound.
    for key in ("a", "b"):
        side = own.select(F.col("id").alias(key), F.size("s").alias(f"n_{key}"), F.col("part").alias(f"part_{key}"), *(F.col(c).alias(f"{c}_{key}") for c in PACKED[PART // 8 :]))
        pairs = _with_side(pairs, total, side, key)
    n, m = F.col("n_a"), F.col("n_b")
    rest = F.least(n - F.size("part_a"), m - F.size("part_b"), F.coalesce(packed_overlap(*([F.col(f"{c}_{key}") for c in PACKED[PART // 8 :]] for key in ("a", "b"))), F.lit(1 << 40)))
    most = F.size(F.array_intersect("part_a", "part_b")) + rest
    pairs = steps.replace(pairs.filter(most * (t[0] + t[1]) >= t[0] * (n + m)).select("a", "b").distinct(), "pairs")
    for key, s in (("a", "x"), ("b", "y")):
        pairs = _with_side(pairs, total, own.select(F.col("id").alias(key), F.col("s").alias(s)), key)
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.filter((both > 0) & (t[1] * both >= t[0] * (F.size("x") + F.size("y") - both)))
    links = steps.write(links.select("a", "b"), "links")
    steps.drop("pairs", "ids", "whole")
    steps.collect()
    return links


def components(links: DataFrame, steps: Steps) -> DataFrame:
    """id, comp (the smallest id reachable) for all ids in links (a, b): smallest labels of neighbours, then labels of labels,
    until nothing changes. A node may have a third of all links, and a component a third of all nodes."""
    both = steps.write(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    labels = steps.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.count("*").alias("links")), "labels")
    least = least_hot(total)
    while True:
        many = labels.filter(F.col("links") > least).select(F.col("id").alias("a"), F.col("links").alias("c"))
        near = salted_join(both, labels.select(F.col("id").alias("a"), "comp"), "a", many, total, "b").groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("near"))
        step = steps.write(labels.join(near, "id").select("id", "links", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "step")
        steps.drop("labels")
        if not step.filter("comp < old").limit(1).count():
            out = steps.write(step.select("id", "comp"), "components")
            steps.drop("step", "edges")
            steps.collect()
            return out
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        many = step.groupBy("comp").agg(F.count("*").alias("c")).filter(F.col("c") > least)
        jumped = salted_join(step.drop("old"), up, "comp", many, total, "id")
        labels = steps.write(jumped.select("id", "links", F.least("comp", "up").alias("comp")), "labels")
        steps.drop("step")


def _open_pairs(entries: DataFrame, total: int, sets: DataFrame, t: tuple[int, int], steps: Steps) -> DataFrame:
    """Pairs (a, b) of different components that share a list and may link by size, place and sketch.

    A list of more than BLOCK entries is cut by size, as sets that link are in the same size band or neighbours, and bands of
    more than BLOCK entries are cut into blocks; each pair of blocks is a key of its own.
    """
    lists = entries.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo < hi").select("s", "c")
    own = steps.write(join_groups(entries, lists, ["s"], "c", total, steps).join(sets.select("id", *PACKED), "id"), "open")
    names = ["id", "n", "i", "comp", *PACKED]
    other = [F.col(c).alias(f"{c}_b") for c in names]

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        n, m = F.col("n"), F.col("n_b")
        smaller = (n < m) | ((n == m) & (F.col("id") < F.col("id_b")))
        sketches = links_possible(n, m, [F.col(c) for c in PACKED], [F.col(f"{c}_b") for c in PACKED], t)
        pairs = left.hint("merge").join(right.hint("merge"), keys).filter(smaller & (F.col("comp") != F.col("comp_b")) & candidate(n, F.col("i"), m, F.col("i_b"), t) & sketches)
        return pairs.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))

    short = own.filter(F.col("c") <= BLOCK).select("s", *names)
    pairs = met(short, short.select("s", *other), ["s"])
    long = own.filter(F.col("c") > BLOCK)
    if not long.limit(1).count():
        return pairs
    # One row for each band of a list of more than BLOCK entries: at most 1 / BLOCK of all entries and one for each band.
    cut = steps.write(long.groupBy("s", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cut")), "cuts")
    cuts = lambda band, name: cut.select("s", F.col("band").alias(band), F.col("cut").alias(name))
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # Each entry as the smaller of a pair (keys: its band and that of the other), and as the larger one.
    left = long.withColumnRenamed("band", "from").withColumn("to", F.explode(F.array(F.col("from"), F.col("from") + 1)))
    left = left.join(cuts("from", "p"), ["s", "from"]).join(cuts("to", "q"), ["s", "to"])
    left = left.withColumn("x", block(F.col("p"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    right = long.withColumnRenamed("band", "to").withColumn("from", F.explode(F.array(F.col("to"), F.col("to") - 1)))
    right = right.join(cuts("from", "p"), ["s", "from"]).join(cuts("to", "q"), ["s", "to"])
    right = right.withColumn("y", block(F.col("q"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    keys = ["s", "from", "to", "x", "y"]
    return pairs.unionByName(met(left.select(*keys, *names), right.select(*keys, *other), keys))


def candidate(n, i, m, j, t: tuple[int, int]):
    """Whether the sizes and the places of a common shingle leave room for a link if it is the first that the two sets have in
    common: those before it are not. Each pair that links has such a first one, and both prefixes hold it."""
    over = F.ceil(F.lit(t[0]) * (n + m) / (t[0] + t[1]))
    return (1 + F.least(n - i - 1, m - j - 1) >= over) & (F.least(n, m) * t[1] >= F.greatest(n, m) * t[0])


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, t: tuple[int, int] = (90, 100)) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link when t[1] * intersection >= t[0] * union of their k-word shingle sets. Null and empty texts have no
    shingles and no links. Repeated rows give repeated rows. Rows that repeat an id with other texts count as one document
    with the links of all its texts: all of them get one component. An empty table gives no rows. Other columns are ignored.
    Ids are integers and not null.
    """
    steps = Steps(docs.sparkSession, "near")
    steps.collect()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    options = boundaries(t)
    whole = options[-1][2]
    every = steps.write(_sets(rows, k, t, _frequent(rows, k), whole), "every")
    classes = steps.write(every.filter("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")), "classes")
    members = steps.write(every.select("id", "n", "h1", "h2"), "members")
    repeated = bool(members.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count())
    # One set for each class. An id may stand for several sets: its links are the links of all of them.
    sets = every.filter("n > 0").join(classes.select("h1", "h2", F.col("rep").alias("id")), ["id", "h1", "h2"], "left_semi")
    sets = sets.dropDuplicates(["id", "h1", "h2"]) if repeated else sets
    sets = steps.write(sets.select("id", "n", "first", *PACKED), "sets")
    steps.drop("every")
    steps.collect()
    rows = rows.dropDuplicates(["id", "text"]) if repeated else rows

    # Cost of each boundary: subsets of small sets against entries of lists, each of which may have to be looked up again.
    sizes = {r["n"]: r["c"] for r in sets.filter(F.col("n") <= whole).groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `whole` rows
    choose = lambda n, d: sum(len(list(combinations(range(n), x))) for x in range(min(d, n - 1) + 1))
    cost = lambda o: sum(c * choose(n, o[0]) for n, c in sizes.items() if n <= o[2]) + 4 * sum(c * (n - least_overlap(n, t) + 1) for n, c in sizes.items() if n > o[1])
    drop, bound, partner = min(options, key=cost)
    found = [_small_links(sets, drop, partner, t, steps)] if drop else []

    # Inverted lists of the first shingles of large sets, with size bands: sets that link are in the same band or neighbours.
    large = sets.filter(F.col("n") > bound).select("id", "n", "first")
    if bound < whole:
        large = large.withColumn("first", F.slice("first", 1, (F.col("n") - F.ceil(F.lit(t[0]) * F.col("n") / t[1]) + 1).cast("int")))
    lists = large.select(F.explode("first").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    total = large.agg(F.sum(F.size("first")).alias("n")).collect()[0]["n"] or 0
    entries = large.select("id", "n", F.posexplode("first").alias("i", "s")).withColumn("band", F.floor(F.log(F.col("n")) / float(np.log(t[1] / t[0]) * (1 + 1e-9))).cast("int"))
    entries = steps.write(join_groups(entries, lists, ["s"], "c", total, steps).drop("c").withColumn("comp", F.col("id")), "entries")
    steps.drop("groups")
    total = entries.count()

    # First each set with one set of its lists, of its size band: the smallest id, then the largest of another component.
    # Each round compares at most two sets with each set, so a large group of near copies costs no more than others.
    for least in (F.min, F.max):
        hubs = entries.groupBy("s", "band").agg(least(F.struct("comp", "id", "n", "i")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
        with_hub = join_groups(entries, hubs, ["s", "band"], "c", total, steps)
        with_hub = with_hub.filter((F.col("hub.comp") != F.col("comp")) & candidate(F.col("n"), F.col("i"), F.col("hub.n"), F.col("hub.i"), t))
        star = with_hub.groupBy("id").agg(least("hub.id").alias("x"), F.min(F.struct("i", "hub.id"))["id"].alias("y"))
        pairs = steps.write(star.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("h"), "id").select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b")), "stars")
        steps.drop("groups")
        found.append(_verified(pairs, sets, rows, k, t, steps, False))
        steps.drop("stars")
        comps = components(reduce(DataFrame.unionByName, found), steps)
        entries = steps.replace(entries.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "entries")
        steps.drop("components")

    # Then all pairs of different components that a list holds.
    found.append(_verified(_open_pairs(entries, total, sets, t, steps), sets, rows, k, t, steps, True))
    steps.drop("entries", "open", "cuts", "groups")
    if repeated:  # the classes of an id are linked
        own = members.filter("n > 0").distinct()
        several = own.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1")
        own = own.join(several, "id").join(classes, ["h1", "h2"]).filter("id <> rep")
        found.append(steps.write(own.select(F.col("rep").alias("a"), F.col("id").alias("b")), "links"))
    comps = components(reduce(DataFrame.unionByName, found), steps)
    steps.drop("links", "sets")

    groups = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("h1", "h2", "c", F.coalesce("comp", "rep").alias("component_id"))
    linked = join_groups(members.filter("n > 0"), groups, ["h1", "h2"], "c", members.count(), steps)
    steps.drop("components", "classes")
    out = linked.select("id", "n", "component_id").unionByName(members.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    if repeated:
        least = out.groupBy("id").agg(F.min("component_id").alias("least"), F.count("*").alias("c"))
        out = join_groups(out, least, ["id"], "c", members.count(), steps).withColumn("component_id", F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
