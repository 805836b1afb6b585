"""Programs as trees and as token arrays, by one grammar for both directions.

A grammar is a tree of nodes. It gives the Spark type of a program (spark_type), the columns that flatten one into an array of
integers (tokens; built-in functions only, at any depth), and the moves of a stack machine that reads such an array again
(parsed). A song is a row: sections that are trees, each written as its number of tokens and the tokens with back references.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Marks above any value, the shortest copy, and where the search for a longer source, and a copy, ends.
REPEAT, BASES, LANES, LEAST_COPY, GOOD_COPY, LONGEST_COPY = 1 << 24, (1 << 24) + 2, (1 << 24) + 3, 3, 512, 4095


class Number(NamedTuple):
    """One token."""


class Many(NamedTuple):
    """How many, then each."""

    of: object


class Record(NamedTuple):
    """Its fields one after another: (name, node)."""

    fields: tuple


class Columns(NamedTuple):
    """Rows of numbers, how many and then column by column; the rising column as differences, the first to 0."""

    fields: tuple[str, ...]
    rising: str | None = None


class Choice(NamedTuple):
    """A number that tells which of the cases follows: {number: (name, node)}. As a struct, the others are null."""

    cases: tuple


class When(NamedTuple):
    """In a record: there only if an earlier field has a value, else null."""

    field: str
    value: int
    then: object


_LONG = T.LongType()


def spark_type(node) -> T.DataType:
    if isinstance(node, Number):
        return _LONG
    if isinstance(node, Many):
        return T.ArrayType(spark_type(node.of))
    if isinstance(node, Record):
        return T.StructType([T.StructField(n, spark_type(x)) for n, x in node.fields])
    if isinstance(node, Columns):
        return T.ArrayType(T.StructType([T.StructField(n, _LONG) for n in node.fields]))
    if isinstance(node, Choice):
        return T.StructType([T.StructField("kind", _LONG), *(T.StructField(n, spark_type(x)) for _, (n, x) in node.cases)])
    return spark_type(node.then)


def _none() -> Column:
    return F.array().cast("array<long>")


def tokens(node, value: Column) -> Column:
    """The tokens of a value. Null lists are empty, null numbers 0."""
    counted = lambda xs: F.array(F.coalesce(F.size(xs), F.lit(0)).cast("long"))
    if isinstance(node, Number):
        return F.array(F.coalesce(value, F.lit(0)).cast("long"))
    if isinstance(node, Many):
        own = F.coalesce(value, F.array().cast(spark_type(node)))
        each = own if isinstance(node.of, Number) else F.flatten(F.transform(own, lambda x: tokens(node.of, x)))
        return F.concat(counted(own), each)
    if isinstance(node, Record):
        parts = []
        for name, x in node.fields:
            if isinstance(x, When):
                parts.append(F.when(value[x.field] == x.value, tokens(x.then, value[name])).otherwise(_none()))
            else:
                parts.append(tokens(x, value[name]))
        return F.concat(*parts)
    if isinstance(node, Columns):
        own = F.coalesce(value, F.array().cast(spark_type(node)))
        column = lambda c: F.transform(own, lambda x: x[c])
        rising = lambda c: F.transform(own, lambda x, i: x[c] - F.coalesce(F.get(own, i - 1)[c], F.lit(0)))
        return F.concat(counted(own), *(rising(c) if c == node.rising else column(c) for c in node.fields))
    out = _none()
    for k, (name, x) in node.cases:
        out = F.when(value["kind"] == k, tokens(x, value[name])).otherwise(out)
    return F.concat(F.array(value["kind"]), out)


class _Close(NamedTuple):
    """On the stack of what is to do: the last n values become a list (names is None) or a record."""

    n: int
    names: tuple[str, ...] | None


class _Test(NamedTuple):
    back: int
    when: When


def parsed(node, ids: list[int], at: int = 0) -> tuple[object, int]:
    """The value that starts at a place, and the place after it. What is to do lies on one stack, what is done on another, so
    depth is not bounded by the interpreter. Tokens that end too early or name an unknown case raise."""
    todo, done = [node], []
    try:
        while todo:
            x = todo.pop()
            if isinstance(x, Number):
                done.append(ids[at])
                at += 1
            elif isinstance(x, Many):
                n, at = ids[at], at + 1
                if n < 0 or at + n > len(ids):
                    raise IndexError
                if isinstance(x.of, Number):
                    done.append(ids[at : at + n])
                    at += n
                else:
                    todo.append(_Close(n, None))
                    todo += [x.of] * n
            elif isinstance(x, Record):
                names = tuple(n for n, _ in x.fields)
                todo.append(_Close(len(names), names))
                todo += [_Test(k - names.index(f.field), f) if isinstance(f, When) else f for k, (_, f) in reversed(list(enumerate(x.fields)))]
            elif isinstance(x, _Test):
                if done[-x.back] == x.when.value:
                    todo.append(x.when.then)
                else:
                    done.append(None)
            elif isinstance(x, Columns):
                n, at = ids[at], at + 1
                if n < 0 or at + n * len(x.fields) > len(ids):
                    raise IndexError
                columns = []
                for name in x.fields:
                    own = ids[at : at + n]
                    if name == x.rising:
                        total = 0
                        own = [total := total + d for d in own]
                    columns.append(own)
                    at += n
                done.append([dict(zip(x.fields, row, strict=True)) for row in zip(*columns, strict=True)])
            elif isinstance(x, Choice):
                name, case = dict(x.cases)[ids[at]]
                todo += [_Close(2, ("kind", name)), case]
                done.append(ids[at])
                at += 1
            else:
                values = done[len(done) - x.n :] if x.n else []
                del done[len(done) - x.n :]
                done.append(values if x.names is None else dict(zip(x.names, values, strict=True)))
    except (IndexError, KeyError) as e:
        raise ValueError(f"no program at token {at}") from e
    return done[0], at


def _digits(n: int) -> int:
    return max(1, -(-n.bit_length() // 4))


def _before(v: np.ndarray) -> np.ndarray:
    """For each place but the last two, the nearest place before it where the same three values begin; -1 if there is none."""
    if v.min() < 0 or v.max() >> 21:
        v = np.unique(v, return_inverse=True)[1]
        if len(v) >> 21 and v.max() >> 21:  # more values than three of them fit into a number
            pairs = np.unique(v[:-1] * (int(v.max()) + 1) + v[1:], return_inverse=True)[1]
            code = pairs[:-1] * (int(v.max()) + 1) + v[2:]
        else:
            code = v[:-2] << 42 | v[1:-1] << 21 | v[2:]
    else:
        code = v[:-2] << 42
        code |= v[1:-1] << 21
        code |= v[2:]
    order = np.argsort(code, kind="stable").astype(np.int32)
    code = code[order]
    same = code[1:] == code[:-1]
    out = np.full(len(order), -1, np.int32)
    out[order[1:][same]] = order[:-1][same]
    return out


def squeezed(values: list[int] | np.ndarray) -> list[int]:
    """values with copies: (REPEAT, distance, length) where that is worth it. At each place, the longest earlier run that begins
    with the same three values; of equal ones the nearest."""
    return squeezed_array(np.asarray(values, np.int64)).tolist()


def squeezed_array(v: np.ndarray) -> np.ndarray:
    """The same from and to 64-bit integers: some numbers of 8 bytes for each value, no objects."""
    v, n = np.ascontiguousarray(v, np.int64), len(v)
    if n <= LEAST_COPY:
        return v
    chain = _before(v)
    out, i = array("q"), 0
    before, at, raw = memoryview(chain), memoryview(v), memoryview(v).cast("B")
    while i < n:
        if i >= n - 2 or before[i] < 0:
            out.append(at[i])
            i += 1
            continue
        length, distance, p, most = 0, 0, before[i], min(n - i, LONGEST_COPY)
        while p >= 0:
            if length < most and at[p + length] == at[i + length]:  # else it is no longer
                k = 3
                while k + 32 <= most and raw[8 * (p + k) : 8 * (p + k + 32)] == raw[8 * (i + k) : 8 * (i + k + 32)]:
                    k += 32
                while k < most and at[p + k] == at[i + k]:
                    k += 1
                if k > length:
                    length, distance = k, i - p
                if length >= GOOD_COPY:
                    break
            p = before[p]
        if length >= LEAST_COPY and 1 + _digits(distance) + _digits(length) < length:
            out.extend((REPEAT, distance, length))
            i += length
        else:
            out.append(at[i])
            i += 1
    return np.frombuffer(out, np.int64)


def unsqueezed(ids: list[int], at: int, n: int) -> tuple[list[int], int]:
    """n values from a place on, and the place after them."""
    out: list[int] = []
    while len(out) < n:
        if at >= len(ids):
            raise ValueError("the section is cut off")
        if ids[at] == REPEAT:
            distance, length = ids[at + 1 : at + 3]
            for _ in range(length):
                out.append(out[-distance])
            at += 3
        else:
            out.append(ids[at])
            at += 1
    return out, at


def _list(node) -> Many:
    return Many(node)


NUMBER, NUMBERS = Number(), Many(Number())
#: The grammar of a song. Sections come in this order; the last two follow their mark, and only if they hold anything.
#: An accumulator of kind 3 has no closed form and brings its values.
SECTIONS = {
    "note_table": NUMBERS,
    "instruments": _list(NUMBERS),
    "programs": NUMBERS,
    "patterns": _list(NUMBERS),
    "orders": _list(NUMBERS),
    "accumulators": _list(_list(Record((("first", NUMBER), ("kind", NUMBER), ("seed", NUMBER), ("p1", NUMBER), ("p2", NUMBER), ("p3", NUMBER), ("n", NUMBER), ("raw", When("kind", 3, NUMBERS)))))),
}
MARKED = {
    "bases": (BASES, _list(Choice((
        (0, ("ramps", Columns(("start", "seed", "step"), "start"))),
        (1, ("walk", Record((("table", NUMBERS), ("segments", Columns(("start", "seed", "step"), "start")), ("modulus", NUMBER), ("from", NUMBER), ("warm", NUMBERS))))),
        (2, ("arps", Record((("table", NUMBERS), ("from", NUMBER), ("warm", NUMBERS), ("onsets", Columns(("start", "base", "ref"), "start")), ("shapes", _list(NUMBERS)))))),
    )))),
    "lanes": (LANES, _list(Choice((
        (0, ("points", Record((("reg", NUMBER), ("points", Columns(("start", "v"), "start")))))),
        (1, ("sweep", Record((("low", NUMBER), ("high", NUMBER), ("segments", Columns(("start", "seed", "step"), "start")))))),
        (2, ("segments", Record((("reg", NUMBER), ("from", NUMBER), ("warm", NUMBERS), ("onsets", Columns(("start", "ref"), "start")), ("pool", _list(Record((("length", NUMBER), ("points", Columns(("start", "v"), "start")))))))))),
    )))),
}
NODES = SECTIONS | {name: node for name, (_, node) in MARKED.items()}
#: Registers whose first values a song has.
REGISTERS = 25


def section_tokens(songs: DataFrame, key: str) -> DataFrame:
    """key, section, tokens: each section of each song, without back references. songs: key and any of the sections; the others
    are empty."""
    there = [n for n in NODES if n in songs.columns]
    each = F.array(*[F.struct(F.lit(n).alias("section"), tokens(NODES[n], F.col(n)).alias("tokens")) for n in there])
    return songs.select(key, F.explode(each).alias("s")).select(key, "s.section", "s.tokens")


def _kind(node) -> pa.DataType:
    return to_arrow_type(spark_type(node))


def song_ids(songs: DataFrame, key: str) -> DataFrame:
    """key, ids of songs: key, frames, boot (REGISTERS values), and any of the sections. Trees are flattened by built-in functions;
    only back references are looked for in Arrow batches. A song is one row."""
    flat = songs.select(key, "frames", "boot", *(tokens(node, F.col(n)).alias(n) if n in songs.columns else F.array(F.lit(0).cast("long")).alias(n) for n, node in NODES.items()))
    kind = songs.schema[key].dataType.simpleString()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a song may be long: one at a time, as arrays
                ids = [np.array([b["frames"][k].as_py(), *b["boot"][k].as_py()], np.int64)]
                for name in NODES:
                    own = np.asarray(b[name][k].values, np.int64)
                    if name not in MARKED or len(own) != 1 or own[0] != 0:
                        ids += [np.array([MARKED[name][0], len(own)] if name in MARKED else [len(own)], np.int64), squeezed_array(own)]
                flat = np.concatenate(ids)
                del ids
                yield pa.RecordBatch.from_arrays([b[key].slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], [key, "ids"])

    return flat.mapInArrow(written, f"{key} {kind}, ids array<long>")


def song_of(ids: list[int]) -> dict:
    """The song of a token array; what is not one raises."""
    if len(ids) < 1 + REGISTERS:
        raise ValueError("the head is cut off")
    out, at = {"frames": ids[0], "boot": ids[1 : 1 + REGISTERS]}, 1 + REGISTERS
    marks = {mark: name for name, (mark, _) in MARKED.items()}
    for name in NODES:
        out[name] = []
    left = list(SECTIONS)
    while left or at < len(ids):
        if left:
            name = left.pop(0)
        else:
            if ids[at] not in marks:
                raise ValueError(f"unknown section {ids[at]}")
            name, at = marks[ids[at]], at + 1
        if at >= len(ids):
            raise ValueError("the section is cut off")
        own, at = unsqueezed(ids, at + 1, ids[at])
        out[name], end = parsed(NODES[name], own)
        if end != len(own):
            raise ValueError(f"section {name} has more tokens than its program")
    return out


def songs_of(coded: DataFrame, key: str) -> DataFrame:
    """The inverse of song_ids: key, frames, boot and all sections, as nested columns."""
    names = ["frames", "boot", *NODES]
    nodes = {"frames": NUMBER, "boot": NUMBERS} | NODES
    schema = T.StructType([coded.schema[key], *(T.StructField(n, spark_type(nodes[n])) for n in names)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            songs = [song_of(x) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[key], *(pa.array([s[n] for s in songs], _kind(nodes[n])) for n in names)], [key, *names])

    return coded.mapInArrow(read, schema)
