"""BPE encoding and decoding by tree concatenation.

Long texts are halved until the parts are short; the parts are encoded in parallel. Neighbours are then joined: a window
around each join is encoded anew and grows on both sides until its tokens at either end are those of the parts there.
Very long unbroken words are treated in the same way on the level of symbols (Bpe.encode_long).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordCoder, units
from .common import kept, slices, small_batches

#: Characters of a leaf; longer texts are halved.
LEAF = 1 << 14


class TextCoder(WordCoder):
    """Keeps both the ids (four bytes each) and the decoded pieces of a unit."""

    def value(self, ids: bytes) -> tuple[bytes, str]:
        ids = np.frombuffer(ids, "<u2")
        return ids.astype("<u4").tobytes(), " ".join(map(self.bpe.strings.__getitem__, ids.tolist()))

    def joined(self, values: list) -> tuple[bytes, str]:
        if not values:
            return b"", ""
        ids, texts = zip(*values, strict=True)
        return b"".join(ids), " ".join([t for t in texts if t])


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of the halving tree; each cut goes to the nearest white space within a quarter of a leaf, if there is any."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    for m in range(mid, min(len(text) - 1, mid + leaf // 4)):
        if text[m].isspace():
            mid = m
            break
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


class Part:
    """A run of text with its ids and its decoded text."""

    def __init__(self, text: str, ids: bytes, words: str):
        self.text, self.ids, self.words = text, ids, words


def join(c: TextCoder, a: Part, b: Part, start: int = 16) -> Part:
    """The encoding of a.text + b.text."""
    k = start
    while True:
        left, right = a.text[max(0, len(a.text) - k) :], b.text[:k]
        cut_a = next((i for i in range(len(left)) if left[i].isspace() and not "\x1c" <= left[i] <= "\x1f"), None)
        cut_b = next((i for i in range(len(right) - 1, -1, -1) if right[i].isspace() and not "\x1c" <= right[i] <= "\x1f"), None)
        whole_a, whole_b = len(left) == len(a.text), len(right) == len(b.text)
        if (cut_a is not None or whole_a) and (cut_b is not None or whole_b):
            tail = left if cut_a is None else left[cut_a:]
            head = right if cut_b is None else right[:cut_b]
            (tail_ids, tail_words), (head_ids, head_words), (ids, words) = c.encode_all([tail, head, tail + head])
            if a.ids.endswith(tail_ids) and b.ids.startswith(head_ids):
                parts = [a.words[: len(a.words) - len(tail_words)].rstrip(" ") if tail_words else a.words, words, b.words[len(head_words) :].lstrip(" ")]
                return Part(a.text + b.text, a.ids[: len(a.ids) - len(tail_ids)] + ids + b.ids[len(head_ids) :], " ".join([p for p in parts if p]))
        k *= 2


def _digest(ids: bytes, words: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(words.encode("utf-8", "surrogatepass")).hexdigest()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, digests: bool = True) -> DataFrame:
    """Ids and decoded text of each row of docs.

    With digests: id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256 (UTF-8). Without: id,
    ids array<int>, decoded string. Null and empty texts have no ids and decode to the empty text. Repeated rows give
    repeated rows, an empty table none. Other columns of docs are ignored. Ids must not be null.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    names = [x.strip().split(" ")[0] for x in out.split(", ")]

    def columns(coded: list[tuple[bytes, str]]) -> list[pa.Array]:
        if digests:
            rows = [_digest(*x) for x in coded]
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in coded], pa.list_(pa.int32())), pa.array([w for _, w in coded], pa.string())]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(TextCoder, path)
        for b in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b["id"], *columns(c.encode_all(b["text"].to_pylist()))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for row, i, text in zip(b["row"].to_pylist(), b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                leaves = halves(text, leaf)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(leaves)), pa.array([i] * len(leaves), b["id"].type), pa.array(range(len(leaves)), pa.int64()), pa.array(leaves, pa.string())], ["row", "id", "k", "leaf"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(TextCoder, path)
        for b in slices(batches, "leaf"):
            coded = c.encode_all(b["leaf"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["k"], b["leaf"], pa.array([i for i, _ in coded], pa.binary()), pa.array([w for _, w in coded], pa.string())], ["row", "id", "k", "leaf", "ids", "words"])

    def joined(pdf):  # pandas, one text
        import pandas as pd

        c = kept(TextCoder, path)
        copies = int((pdf["k"] == 0).sum())
        first = pdf["id"].iloc[0]
        pdf = pdf.drop_duplicates("k").sort_values("k")
        parts = [Part(*x) for x in zip(pdf["leaf"], pdf["ids"], pdf["words"], strict=True)]
        while len(parts) > 1:
            parts = [join(c, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        one = columns([(parts[0].ids, parts[0].words)])
        return pd.DataFrame({"id": [first] * copies} | {n: [x[0].as_py()] * copies for n, x in zip(names[1:], one, strict=True)})

    short = docs.filter(F.length("text") <= leaf).mapInArrow(whole, out)
    row = F.concat_ws(":", F.col("id").cast("string"), F.xxhash64("text"))
    long = docs.filter(F.length("text") > leaf).withColumn("row", row).mapInArrow(cut, f"row string, id {kind}, k long, leaf string")
    coded = long.repartition("row", "k").mapInArrow(leaves, f"row string, id {kind}, k long, leaf string, ids binary, words string")
    return short.unionByName(coded.groupBy("row").applyInPandas(joined, out)).withColumnRenamed("id", id_col)
