"""Nested records shredded by shape: keys and nesting once for all rows that share them, values by row.

A JSON text is cut into its tokens by one expression. Tokens of structure and a letter for each value are the shape; the values
are an array. Shapes are counted and numbered over all rows. A row is then the number of its shape and its bare values, as
integers in base-16 digits; what a value is made of is told by the shape. Texts are cut in Arrow batches, each token that comes
again is looked up; numbers and digits of all rows of a batch are made and read at once; the rest is built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import unleb16
from .blocks import running

#: Keys with their colon, strings, arrays of integers, numbers, words, brackets. No part can make the matcher recurse.
TOKEN = re.compile(r'"[^"\\]*+(?:\\[^\n\r\x85\u2028\u2029][^"\\]*+)*+"(?:\s*+:)?|\[[\s0-9,-]*+\]|-?\d[0-9.eE+-]*+|true|false|null|[{}\[\],]', re.ASCII)
#: Values: a array of integers, b truth value, i integer, n other number, s string, z null.
#: A number is i if its text is the shortest of an integer of up to 18 digits, so that it comes back as it was.
INTEGER = re.compile(r"0|-?[1-9]\d{0,17}", re.ASCII)
INTEGERS = re.compile(r"\[((0|-?[1-9]\d{0,17})(,(0|-?[1-9]\d{0,17}))*+)?\]", re.ASCII)
SPACE, COLON = re.compile(r"\s", re.ASCII), re.compile(r"\s*+:\Z", re.ASCII)
HOLE = "\x00"
#: Tokens that are kept with their letters.
KNOWN = 1 << 16


class _Tokens(dict):
    """By a token as it is found: its letter (empty for tokens of structure) and its compact text."""

    def __missing__(self, found: str) -> tuple[str, str]:
        t = COLON.sub(":", found) if found[0] == '"' else SPACE.sub("", found)
        if t[0] == '"':
            k = "" if t[-1] == ":" else "s"
        elif INTEGERS.fullmatch(t):
            k = "a"
        elif INTEGER.fullmatch(t):
            k = "i"
        elif t in ("true", "false"):
            k = "b"
        elif t == "null":
            k = "z"
        else:
            k = "n" if t[0] in "-0123456789" or len(t) > 1 else ""
        if len(self) >= KNOWN:
            self.clear()
        self[found] = k, t
        return k, t


def shredded(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds shape (JSON with letters for values), holes (the same with HOLE for each value), letters, and leaves (the values, as
    they are written). Null texts have null shapes. An array that holds anything but short integers is structure around values."""
    names = ("shape", "holes", "letters", "leaves")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.StringType()) for n in names[:3]), T.StructField("leaves", T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for b in batches:
            out = []
            for text in b[text_col].to_pylist():
                if text is None:
                    out.append((None, None, None, None))
                    continue
                own = [known[t] for t in TOKEN.findall(text)]
                out.append(("".join([k or t for k, t in own]), "".join([HOLE if k else t for k, t in own]), "".join([k for k, _ in own]), [t for k, t in own if k]))
            cols = zip(*out, strict=True) if out else ((),) * len(names)
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], [*b.schema.names, *names])

    return rows.mapInArrow(cut, schema)


def shape_table(shred: DataFrame, order: str, block: int = 1 << 15) -> DataFrame:
    """shape_id, shape, holes, letters, uses: the distinct shapes, numbered by their first row in `order` (an integer of at least 0
    that rows do not share). Numbers are running sums in two levels, so the shapes may be many."""
    found = shred.filter(F.col("shape").isNotNull()).groupBy("holes", "letters").agg(F.first("shape").alias("shape"), F.min(order).alias("first"), F.count("*").alias("uses"))
    found = running(found.withColumn("_all", F.lit(0)), ["_all"], "first", [], F.lit(1), "shape_id", block, own=False)
    return found.select(F.col("shape_id").cast("long").alias("shape_id"), "shape", "holes", "letters", "uses")


def by_shape(shred: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape_id, leaves. Rows without a text are left out. One shape may be that of nearly all rows: whether the table of
    shapes goes to all tasks is left to Spark, which knows its size."""
    return shred.join(shapes.select("holes", "letters", "shape_id"), ["holes", "letters"]).select(*keys, "shape_id", "leaves")


def assembled(rows: DataFrame, shapes: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys, out: the compact JSON texts of rows (keys, shape_id, leaves)."""
    both = rows.join(shapes.select("shape_id", "holes"), "shape_id")
    pairs = F.zip_with(F.split("holes", HOLE), F.concat("leaves", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return both.select(*keys, F.array_join(pairs, "").alias(out))


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of n each, one run after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 63)


def _unzigzag(x: np.ndarray) -> np.ndarray:
    return (x.view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(x & 1)


def _letters(texts: pa.Array) -> np.ndarray:
    """The letters of all rows, one after another."""
    return np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)


def _parts(leaves: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values of at least 0, one value after another, and how many each has: integers folded, truth values as 0 and 1,
    nulls as nothing, arrays and texts with their length in front."""
    own = {c: np.flatnonzero(letters == ord(c)) for c in "ibasn"}
    size, made = np.zeros(len(letters), np.int64), {}
    take = lambda c: leaves.take(pa.array(own[c]))
    made["i"] = _zigzag(np.asarray(take("i").cast(pa.int64())))
    made["b"] = np.asarray(pc.equal(take("b"), "true").cast(pa.int64()))
    for c, cut in (("s", 1), ("n", 0)):
        texts = take(c).cast(pa.binary())
        n = np.asarray(pc.binary_length(texts), np.int64) - 2 * cut
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        size[own[c]], made[c] = n + 1, data[_runs(at + cut, n)].astype(np.int64)
    inner = pc.utf8_slice_codeunits(take("a"), 1, -1)
    items = pc.split_pattern(inner.filter(pc.not_equal(inner, "")), ",").flatten()
    size[own["a"]] = np.asarray(pc.if_else(pc.equal(inner, ""), 0, pc.add(pc.count_substring(inner, ","), 1)), np.int64) + 1
    made["a"] = _zigzag(np.asarray(items.cast(pa.int64())))
    size[own["i"]] = size[own["b"]] = 1
    at = _ends(size)
    out = np.zeros(at[-1], np.int64)
    for c in "ib":
        out[at[own[c]]] = made[c]
    for c in "asn":
        out[at[own[c]]] = size[own[c]] - 1
        out[_runs(at[own[c]] + 1, size[own[c]] - 1)] = made[c]
    return out, size


def _digits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digits of numbers in base 16, the least first, the last one with 16 added; and how many each number has."""
    x = x.view(np.uint64)
    n = np.searchsorted(np.array([1 << 4 * k for k in range(1, 16)], np.uint64), x, "right") + 1
    at = _ends(n)
    each = np.repeat(np.arange(len(x)), n)
    place = (np.arange(at[-1]) - at[each]).astype(np.uint64)
    out = ((x[each] >> (place * np.uint64(4))) & np.uint64(15)).astype(np.int32)
    out[at[1:] - 1] += 16
    return out, n


def _mapped(rows: DataFrame, keys: list[str], make, added: str) -> DataFrame:
    """keys and what is added: make gives it from a batch, which is not empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = make(b)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keys), *found.values()], [*keys, *found])

    return rows.mapInArrow(made, T.StructType([*(rows.schema[c] for c in keys), *T.StructType.fromDDL(added).fields]))


def row_ids(rows: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ids: the number of the shape and the values, in digits."""

    def make(b: pa.RecordBatch) -> dict[str, pa.Array]:
        n = np.asarray(b["leaves"].value_lengths(), np.int64)
        parts, size = _parts(b["leaves"].flatten(), _letters(b["letters"]))
        own = np.add.reduceat(np.append(size, 0), np.minimum(_ends(n)[:-1], len(size))) * (n > 0)
        at = _ends(own + 1)
        numbers = np.empty(at[-1], np.int64)
        numbers[at[:-1]] = np.asarray(b["shape_id"], np.int64)
        numbers[_runs(at[:-1] + 1, own)] = parts
        digits, many = _digits(numbers)
        return {"ids": pa.ListArray.from_arrays(pa.array(_ends(many)[at].astype(np.int32)), pa.array(digits))}

    both = rows.join(shapes.select("shape_id", "letters"), "shape_id").select(*keys, "shape_id", "leaves", "letters")
    return _mapped(both, keys, make, "ids array<int>")


def read_numbers(ids: Column) -> Column:
    """The numbers of a run of digits: each ends with the digit that has 16 added."""
    letters = F.array_join(F.transform(ids, lambda d: F.chr(F.when(d < 16, d + 65).otherwise(d + 81))), "")  # A to P, then a to p
    groups = F.regexp_extract_all(letters, F.lit("[A-P]*+[a-p]"), F.lit(0))
    return F.transform(groups, lambda g: unleb16(F.transform(F.split(F.lower(g), ""), lambda c: F.ascii(c) - 97)))


def _numbers(b: pa.RecordBatch) -> dict[str, pa.Array]:
    """The first number of each row of digits, and all."""
    n = np.asarray(b["ids"].value_lengths(), np.int64)
    digits, at = np.asarray(b["ids"].flatten(), np.int64), _ends(n)
    last = np.flatnonzero(digits >= 16)
    start = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)]
    row = np.searchsorted(at, last, "right") - 1
    start = np.maximum(start, at[row])  # digits without an end, behind the last number of a row, are none
    many = last - start + 1
    each = _runs(start, many)
    place = np.arange(len(each)) - np.repeat(_ends(many)[:-1], many)
    out = np.add.reduceat((digits[each] & 15) << (4 * place), _ends(many)[:-1]) if len(last) else np.zeros(0, np.int64)
    ends = _ends(np.bincount(row, minlength=len(n)))
    return {"shape_id": pa.array(out[ends[:-1]]), "_n": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))}


def _leaves(b: pa.RecordBatch) -> dict[str, pa.Array]:
    """The values of rows of numbers: their letters tell where each ends. Rows go on side by side, a value at a time."""
    numbers, at = np.asarray(b["_n"].flatten(), np.int64), _ends(np.asarray(b["_n"].value_lengths(), np.int64))[:-1] + 1
    letters, n = _letters(b["letters"]), np.asarray(pc.utf8_length(b["letters"]), np.int64)
    first = _ends(n)
    start, size = np.zeros(len(letters), np.int64), np.zeros(len(letters), np.int64)
    counted, one = np.isin(letters, list(b"asn")), np.isin(letters, list(b"ib"))
    rows = np.argsort(-n, kind="stable")
    for j in range(int(n.max(initial=0))):
        rows = rows[: np.searchsorted(-n[rows], -j, "left")]
        leaf = first[rows] + j
        long = counted[leaf]
        size[leaf] = np.where(long, numbers[np.minimum(at[rows], len(numbers) - 1)], one[leaf])
        start[leaf] = at[rows] + long
        at[rows] += long + size[leaf]
    own = {c: np.flatnonzero(letters == ord(c)) for c in "ibzasn"}
    text = lambda x: pa.array(_unzigzag(x)).cast(pa.string())
    runs = lambda c: numbers[_runs(start[own[c]], size[own[c]])]
    ends = lambda c: _ends(size[own[c]]).astype(np.int32)
    put = lambda a, x, z: pc.binary_join_element_wise(a, x, z, "")
    strings = lambda c: pa.StringArray.from_buffers(len(own[c]), pa.py_buffer(ends(c)), pa.py_buffer(runs(c).astype(np.uint8)))
    made = {
        "i": text(numbers[start[own["i"]]]),
        "b": pc.if_else(pa.array(numbers[start[own["b"]]] == 1), "true", "false").cast(pa.string()),
        "z": pa.array(["null"] * len(own["z"]), pa.string()),
        "a": put("[", pc.binary_join(pa.ListArray.from_arrays(pa.array(ends("a")), text(runs("a"))), ","), "]"),
        "s": put('"', strings("s"), '"'),
        "n": strings("n"),
    }
    order = np.empty(len(letters), np.int64)
    order[np.concatenate([own[c] for c in made])] = np.arange(len(letters))
    return {"shape_id": b["shape_id"], "leaves": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.concat_arrays(list(made.values())).take(pa.array(order)))}


def read_rows(coded: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, shape_id, leaves from keys, ids: the letters of the shape tell where each value ends."""
    numbers = _mapped(coded.select(*keys, "ids"), keys, _numbers, "shape_id long, _n array<long>")
    both = numbers.join(shapes.select("shape_id", "letters"), "shape_id").select(*keys, "shape_id", "_n", "letters")
    return _mapped(both, keys, _leaves, "shape_id long, leaves array<string>")
