"""Token counts by a compiled transducer.

The tokenizer is run as a deterministic transducer over the text. Inside a piece its states are those of the merges
(transducer.py): each transition emits tokens. Between pieces, its states are the characters that are pending since the last
place that is certainly a border of pieces. Counts of runs between two single spaces are sums along such a path and are kept
for a while, as runs repeat.

Long texts are cut into chunks. A chunk is a map from the state that enters it to the state that leaves it and the tokens that
it emits. The states that may enter are found by running over the characters before it from several starts: paths meet soon.
Maps compose associatively, so they are combined by a tree of scans, and no task sees a whole long text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_pattern, classes, load
from .common import Steps, kept, slices
from .transducer import FIRST, Transducer

#: Characters of a chunk; texts up to this size are counted in one go. And chunks that one task combines at once.
CHUNK, SPAN = 1 << 15, 64
#: Pending characters beyond which a run of one class is handed to the transducer of the merges, characters before a chunk from
#: which the states that may enter it are found, and the number of starts.
PENDING, CONTEXT, STARTS = 256, 1024, 64

#: (characters since the last border, class of an open piece or "", its state in the transducer of the merges or None)
Carry = tuple[str, str, tuple | None]
FRESH: Carry = ("", "", None)


class TextTransducer:
    """Counts of whole texts, and chunk maps of long ones."""

    def __init__(self, path: str, most: int = 300_000):
        self.bpe, self.most = load(path), most
        self.machine = Transducer(self.bpe)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        letter, number, space = classes()
        self.odd = re.compile(f"[{space}] | [{space}]|^ | $")
        other = f"[^{space}{letter}{number}']"
        #: Borders of pieces whatever is around them: a letter, number or other sign before a character of another class. After
        #: an apostrophe, letters may belong to the same piece.
        self.border = re.compile(f"(?<=[{letter}])(?=[^{letter}])|(?<=[{number}])(?=[^{number}])|(?<={other})(?=[{space}{letter}{number}])|(?<=')(?=[{space}{number}])")
        self.run = {"L": re.compile(f"[{letter}]*"), "N": re.compile(f"[{number}]*"), "O": re.compile(f"[^{space}{letter}{number}]*")}
        self.after: dict[str, int] = {}  # run that follows a single space: tokens of both

    def split(self, text: str) -> list[str]:
        if "<|" not in text or not self.marks.search(text):
            return byte_pattern().findall(text)
        return [p for k, part in enumerate(self.marks.split(text)) for p in ([part] if k % 2 else byte_pattern().findall(part))]

    def tokens(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of each distinct piece."""
        special = self.bpe.special
        words = [p for p in pieces if p not in special]
        found = dict(zip(words, self.machine.counts([w.encode("utf-8", "surrogatepass") for w in words]).tolist(), strict=True))
        return found | {p: 1 for p in pieces if p in special}

    def learn(self, runs: set[str]) -> None:
        """Runs the transducer over a space and each run that is not kept yet."""
        new = runs.difference(self.after)
        if len(new) + len(self.after) > self.most:
            self.after.clear()
            new = runs
        split = {x: self.split(" " + x) for x in new}
        found = self.tokens(list({p for ps in split.values() for p in ps}))
        for x, ps in split.items():
            self.after[x] = sum(map(found.__getitem__, ps))

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends at borders."""
        if not text:
            return 0
        pieces = self.split(text)
        found = self.tokens(list(set(pieces)))
        return sum(map(found.__getitem__, pieces))

    def count_all(self, texts: list[str]) -> list[int]:
        split = [None if self.odd.search(t) else t.split(" ") for t in texts]
        self.learn(set().union(*(s[1:] for s in split if s)))
        get = self.after.__getitem__
        return [self.count(t) if s is None else self.count(s[0]) + sum(map(get, s[1:])) for t, s in zip(texts, split, strict=True)]

    def advance(self, carry: Carry, text: str) -> tuple[Carry, int]:
        """The state after text (without marks), and the tokens emitted on the way."""
        pending, kind, state = carry
        total = 0
        if kind:
            n = self.run[kind].match(text).end()
            state, total = self.machine.advance(state, text[:n].encode("utf-8", "surrogatepass"))
            if n == len(text):
                return ("", kind, state), total
            pending, text = "", text[n:]
        text = pending + text
        last = 0
        for m in self.border.finditer(text, max(0, len(text) - 2 * PENDING)):
            last = m.start()
        if not last:
            for m in self.border.finditer(text):
                last = m.start()
        total += self.count(text[:last])
        text = text[last:]
        if len(text) > PENDING:
            pieces = byte_pattern().findall(text)
            kind = next((k for k, r in self.run.items() if r.fullmatch(pieces[-1].lstrip(" "))), "")
            if kind and len(pieces[-1]) > 8:
                total += self.count("".join(pieces[:-1]))
                state, n = self.machine.advance(FIRST, pieces[-1].encode("utf-8", "surrogatepass"))
                return ("", kind, state), total + n
        return (text, "", None), total

    def entries(self, before: str) -> list[Carry]:
        """States that may enter a chunk, from the characters before it."""
        if not before:
            return [FRESH]
        first = self.border.search(before)
        if first and first.start():
            return [self.advance(FRESH, before[first.start() :])[0]]
        kind = next((k for k, r in self.run.items() if r.match(before[-1]).end()), "")
        run = before
        while kind and run and self.run[kind].match(run).end() < len(run):
            run = run[self.run[kind].match(run).end() + 1 :]
        if not kind or len(run) <= 2 * PENDING:
            return [self.advance(FRESH, before)[0]]
        run = run[-2 * PENDING :]
        places = {len(run[:k].encode("utf-8", "surrogatepass")) for k in range(STARTS)}
        return [("", kind, s) for s in self.machine.starts(run.encode("utf-8", "surrogatepass"), places)]

    def chunk_map(self, before: str, text: str) -> list[tuple[str, str, int]]:
        """(entering state, leaving state, tokens) of a chunk."""
        out = []
        for carry in self.entries(before):
            leave, n = self.advance(carry, text)
            out.append((_written(carry), _written(leave), n))
        return out


def _written(carry: Carry) -> str:
    return json.dumps(carry)


def _read(text: str) -> Carry:
    pending, kind, state = json.loads(text)
    return pending, kind, None if state is None else tuple(map(tuple, state))


def compose(maps: list[list[tuple[str, str | None, int]]]) -> list[tuple[str, str | None, int]]:
    """The map of chunks one after another, neighbours first. Where no path is known for a state, the leaving state is None."""
    while len(maps) > 1:
        paired = []
        for k in range(0, len(maps) - 1, 2):
            follow = {enter: (leave, n) for enter, leave, n in maps[k + 1]}
            paired.append([(enter, follow.get(leave, (None, 0))[0], n + follow.get(leave, (None, 0))[1]) for enter, leave, n in maps[k]])
        maps = paired + maps[len(maps) - len(maps) % 2 :]
    return maps[0]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows, an empty table none. Other columns of docs
    are ignored. Ids must not be null.
    """
    steps = Steps(docs.sparkSession, "tokens")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept(TextTransducer, path)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], pa.array(t.count_all(b["text"].to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    names = ["row", "part", "k", "enter", "leave", "n"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept(TextTransducer, path)
        for b in slices(batches, "piece"):
            rows = []
            for row, part, k, before, piece in zip(*(b[c].to_pylist() for c in ("row", "part", "k", "before", "piece")), strict=True):
                rows += [(row, part, k, *m) for m in t.chunk_map(before, piece)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names)

    def combined(rows: pa.Table) -> pa.Table:
        maps: dict[int, list] = {}
        for k, *m in sorted(zip(*(rows[c].to_pylist() for c in ("k", "enter", "leave", "n")), strict=True), key=lambda r: r[0]):
            maps.setdefault(k, []).append(tuple(m))
        out = compose(list(maps.values()))
        row, part, first = rows["row"][0].as_py(), rows["part"][0].as_py(), min(maps)
        return pa.table([pa.array(x, kind) for x, kind in zip(([row] * len(out), [part] * len(out), [first] * len(out), *map(list, zip(*out, strict=True))), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept(TextTransducer, path)
        for b in batches:
            n = [None if leave is None else n + t.count(_read(leave)[0]) for leave, n in zip(b["leave"].to_pylist(), b["n"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(n, pa.int64())], ["row", "n"])

    kind = docs.schema["id"].dataType.simpleString()
    out, map_schema = f"id {kind}, n_bytes long, n_tokens long", "row string, part long, k long, enter string, leave string, n long"
    short = docs.filter(F.length("text") <= chunk).mapInArrow(whole, out)
    long = docs.filter(F.length("text") > chunk).withColumn("row", F.concat_ws(":", F.col("id").cast("string"), F.xxhash64("text"), F.xxhash64(F.reverse("text"))))
    marks = "|".join("\\Q" + m + "\\E" for m in sorted(load(path).special, key=len, reverse=True))
    parts = long.dropDuplicates(["row"]).select("row", F.posexplode(F.split("text", marks, -1)).alias("part", "text"))
    at = F.col("k") * chunk
    pieces = parts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk))))
    pieces = pieces.select("row", F.col("part").cast("long").alias("part"), "k", F.col("text").substr((at - CONTEXT + 1).cast("int"), F.lit(CONTEXT)).alias("before"), F.col("text").substr((at + 1).cast("int"), F.lit(chunk)).alias("piece"))
    pieces = pieces.withColumn("before", F.when(F.col("k") > 0, F.col("before")).otherwise(F.lit("")))
    maps = steps.write(pieces.repartition("row", "part", "k").mapInArrow(mapped, map_schema), "maps")
    size = maps.agg(F.max("k").alias("k")).collect()[0]["k"] or 0
    span = SPAN
    while True:  # blocks of chunks, then blocks of blocks, until one is left of each part
        maps = maps.groupBy("row", "part", F.floor(F.col("k") / span).alias("_block")).applyInArrow(combined, map_schema)
        if span > size:
            break
        span *= SPAN
    fresh = maps.filter(F.col("enter") == _written(FRESH)).mapInArrow(finished, "row string, n long")
    # A mark between two parts is one token.
    sums = steps.write(fresh.groupBy("row").agg((F.sum("n") + F.count("*") - 1).alias("n"), F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)).alias("lost")), "sums")
    steps.drop("maps")
    counted = long.join(sums.filter("lost = 0"), "row").select("id", "n_bytes", F.col("n").alias("n_tokens"))
    counts = short.unionByName(counted)
    if sums.filter("lost > 0").limit(1).count():  # no start met the path that a text takes: such texts are counted in one go
        counts = counts.unionByName(long.join(sums.filter("lost > 0").select("row"), "row").select("id", "n_bytes", "text").mapInArrow(whole, out))
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
