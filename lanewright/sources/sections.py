"""Files of tagged sections: what an emulator noted of one tune, in few kilobytes. A file is one row, and many files share a task.

The layout of every section is data (LAYOUTS); one reader and one writer follow it. Some sections have lists at the end of each
entry that older files lack, and nothing in the file says which: such a section is read with them first, and what was read is
kept if the next section, or the end of the file, begins where it ends; else it is read without them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields as "name:code" with the codes of struct; a name that begins with _ is a filler.
Fields = tuple[str, ...]


class Items(NamedTuple):
    """A list in an entry. count: the code of a number in front of it, or the field of the head that has it."""

    count: str
    fields: Fields


class Layout(NamedTuple):
    """count: the code of the number of entries, none where there is one entry. extra: lists that older files lack. body: the
    section has a number of bytes in place of a number of entries."""

    count: str
    head: Fields
    lists: tuple[Items, ...] = ()
    extra: tuple[Items, ...] = ()
    body: bool = False


#: The format. All numbers are little-endian; "HEAD" stands for what follows MAGIC, which has no tag.
MAGIC, END = b"SDST", b"END\0"
_SLICE = Layout(
    "I",
    ("pc:H", "reg:B", "phase:B", "count:I", "kind:B", "low:B", "high:B", "_:x", "base:H", "stride:i", "lo:B", "hi:B"),
    (Items("H", ("pcs:H",)), Items("H", ("leaf_kind:B", "_:x", "leaf_addr:H", "leaf_val:B", "_:x")), Items("H", ("ops:B",))),
    (Items("H", ("vals:B",)),),
)
LAYOUTS = {
    "HEAD": Layout("", ("version:H", "_:H", "init:H", "play:H", "load:H", "subtune:H", "frames:H", "_:H", "cycles:I", "t0:q", "size:I")),
    "ACMP": Layout("I", ("run:H", "bits:B"), body=True),
    "SNAP": Layout("I", ("addr:H", "n:H"), (Items("n", ("bytes:B",)),), body=True),
    "SIDW": Layout("I", ("pc:H", "reg:B", "_:B", "count:I", "last:B", "_:3x")),
    "IDXR": Layout("I", ("pc:H", "base:H", "stride:i", "lo:B", "hi:B", "_:H", "count:I")),
    "SDDF": _SLICE,
    "SDCU": _SLICE,
    "STSQ": Layout("I", ("addr:H", "flags:B", "_:x", "total:I", "first:I", "n:H"), (Items("n", ("samples:B",)),)),
    "IDXS": Layout("I", ("pc:H", "flags:B", "n:B", "scale:i", "base:H", "feeds:I", "idx0:B", "idx1:B", "addr0:H", "addr1:H")),
    "PWLK": Layout("I", ("zp:H", "flags:B", "lo:B", "hi:B", "_:B", "count:I", "n:H"), (Items("n", ("pointer:H",)), Items("n", ("frame:I",))), (Items("n", ("y:B",)), Items("n", ("pc:H",)))),
    "RELO": Layout("I", ("store_pc:H", "read_pc:H", "from:H", "to:H", "from_stride:i", "to_stride:i", "lo:B", "hi:B", "_:H", "count:I")),
    "SDAC": Layout("I", ("pc:H", "reg:B", "_:B", "n:H"), (Items("n", ("op:B", "cell:H")),)),
    "DIGI": Layout("", ("mean1000:I", "most:I", "table:B", "_:3x", "frames:I", "writes:I")),
    "TMPO": Layout("H", ("cell:H", "reload:B", "_:B")),
    "IWLK": Layout("I", ("pc:H", "voice:B", "_:x", "n:I"), (Items("n", ("index:B",)),)),
}
#: Bits of IDXS and PWLK flags, the kind of a leaf that was read from memory, and the most register writes within a
#: frame that are not yet a stream of samples.
FITTED, TARGETS_INSIDE, TARGETS_READ, LOADS, STORES, LEAF_READ, STREAM_WRITES = 1, 2, 4, 1, 2, 1, 16


def names(fields: Fields) -> list[str]:
    return [n for n, _, _ in (f.partition(":") for f in fields) if n[0] != "_"]


def _struct(fields: Fields) -> struct.Struct:
    """Fillers are skipped when read and written as zeros."""
    parts = []
    for f in fields:
        name, _, code = f.partition(":")
        parts.append(code if name[0] != "_" or "x" in code else f"{struct.calcsize('<' + code)}x")
    return struct.Struct("<" + "".join(parts))


_STRUCTS = {fields: _struct(fields) for layout in LAYOUTS.values() for fields in (layout.head, *(i.fields for i in layout.lists + layout.extra))}
Entry = tuple[tuple[int, ...], list[list[int]]]


def _border(data: bytes, at: int) -> bool:
    return at == len(data) or data[at : at + 4] == END or data[at : at + 4].decode("latin-1") in LAYOUTS


def _entries(data: bytes, at: int, end: int | None, n: int, layout: Layout, lists: tuple[Items, ...]) -> tuple[list[Entry], int]:
    """n entries from `at` on, or those up to end; and where they end. A count or list that reaches beyond the data raises."""
    head, found = _STRUCTS[layout.head], []
    where = {name: k for k, name in enumerate(names(layout.head))}
    while at < end if end is not None else len(found) < n:
        own = head.unpack_from(data, at)
        at += head.size
        columns: list[list[int]] = []
        for items in lists:
            if items.count in where:
                size = own[where[items.count]]
            else:
                (size,) = struct.unpack_from("<" + items.count, data, at)
                at += struct.calcsize("<" + items.count)
            form = _STRUCTS[items.fields]
            if at + size * form.size > len(data):
                raise struct.error("a list reaches beyond the data")
            rows = list(form.iter_unpack(data[at : at + size * form.size]))
            columns += [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in names(items.fields)]
            at += size * form.size
        found.append((own, columns))
    return found, at


def _section(data: bytes, at: int, tag: str) -> tuple[list[Entry], int]:
    layout = LAYOUTS[tag]
    n, end = 1, None
    if layout.count:
        (n,) = struct.unpack_from("<" + layout.count, data, at)
        at += struct.calcsize("<" + layout.count)
    if layout.body:
        end = at + n
        if end > len(data):
            raise struct.error("a section reaches beyond the data")
    for lists in ([layout.lists + layout.extra] if layout.extra else []) + [layout.lists]:
        try:
            entries, stop = _entries(data, at, end, n, layout, lists)
        except struct.error:
            if not layout.extra:
                raise
            continue
        if not layout.extra or _border(data, stop):
            return entries, stop
    raise ValueError(f"section {tag} ends at no section")


def parse(data: bytes, wanted: set[str] | None = None) -> Iterator[tuple[str, int, Entry]]:
    """(section, entry number, entry) of one file. Wrong magic, unknown tags and sections that end nowhere raise."""
    if data[:4] != MAGIC:
        raise ValueError(f"not a file of sections: {data[:4]!r}")
    tag, at = "HEAD", 4
    while True:
        try:
            entries, at = _section(data, at, tag)
        except struct.error as e:
            raise ValueError(f"section {tag} is cut off") from e
        if wanted is None or tag in wanted:
            yield from ((tag, k, e) for k, e in enumerate(entries))
        if at == len(data) or data[at : at + 4] == END:
            return
        tag = data[at : at + 4].decode("latin-1")
        if tag not in LAYOUTS or tag == "HEAD":
            raise ValueError(f"unknown section {tag!r} at {at}")
        at += 4


def unparse(entries: list[tuple[str, int, Entry]]) -> bytes:
    """The file with these entries; sections in the order of LAYOUTS. Lists that older files lack are left out of a section if one
    of its entries has none of them."""
    out, by_tag = [MAGIC], {}
    for tag, k, entry in entries:
        by_tag.setdefault(tag, []).append((k, entry))
    for tag, layout in LAYOUTS.items():
        own = [e for _, e in sorted(by_tag.get(tag, []), key=lambda x: x[0])]
        if not own and tag != "HEAD":
            continue
        plain = sum(len(names(i.fields)) for i in layout.lists)
        lists = layout.lists + (layout.extra if all(len(columns) > plain for _, columns in own) else ())
        body = []
        for head, columns in own or [((0,) * len(names(layout.head)), [])]:
            body.append(_STRUCTS[layout.head].pack(*head))
            rest = list(columns)
            for items in lists:
                width = len(names(items.fields))
                mine, rest = rest[:width], rest[width:]
                if len(items.count) == 1 and items.count.isupper():
                    body.append(struct.pack("<" + items.count, len(mine[0])))
                body += [_STRUCTS[items.fields].pack(*row) for row in zip(*mine, strict=True)]
        data = b"".join(body)
        out += [b"" if tag == "HEAD" else tag.encode(), struct.pack("<" + layout.count, len(data) if layout.body else len(own)) if layout.count else b"", data]
    return b"".join(out) + END


ROWS = "path string, section string, entry int, head array<long>, lists array<array<long>>"


def read_sections(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """path, section, entry, head, lists: all entries of all files (path, content), the numbers in the order of LAYOUTS. wanted:
    sections to keep; the others are only walked over."""
    keep = None if wanted is None else set(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                rows = [(path, tag, k, list(head), lists) for tag, k, (head, lists) in parse(content.as_py(), keep)]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "section", "entry", "head", "lists"])

    return files.select("path", "content").mapInArrow(read, ROWS)


def section_files(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """The entries of all section files at a path, in any store."""
    return read_sections(spark.read.format("binaryFile").load(path), wanted)


def write_sections(rows: DataFrame) -> DataFrame:
    """path, content: a file for each path from rows as read_sections gives them. What one file notes is bounded by the address
    space, so a file is made in one task."""

    def write(table: pa.Table) -> pa.Table:
        cols = (table[c].to_pylist() for c in ("section", "entry", "head", "lists"))
        data = unparse([(tag, k, (head, lists)) for tag, k, head, lists in zip(*cols, strict=True)])
        return pa.table({"path": table["path"][:1], "content": pa.array([data], pa.binary())})

    return rows.groupBy("path").applyInArrow(write, "path string, content binary")


def section(rows: DataFrame, tag: str) -> DataFrame:
    """path, entry, and a column for each field and list of a section; lists that a file lacks are null."""
    layout = LAYOUTS[tag]
    lists = [n for items in layout.lists + layout.extra for n in names(items.fields)]
    own = rows.filter(F.col("section") == tag)
    return own.select("path", "entry", *(F.col("head")[k].alias(n) for k, n in enumerate(names(layout.head))), *(F.get("lists", F.lit(k)).alias(n) for k, n in enumerate(lists)))


def as_rows(df: DataFrame, tag: str, path: Column, entry: Column, lists: list[str] | None = None) -> DataFrame:
    """The other way round: rows of a section from a table with its columns. lists: those that are there; all, if it is None."""
    layout = LAYOUTS[tag]
    lists = [n for items in layout.lists + layout.extra for n in names(items.fields)] if lists is None else lists
    head = F.array(*[F.col(n).cast("long") for n in names(layout.head)])
    columns = F.array(*[F.col(n).cast("array<long>") for n in lists]) if lists else F.array().cast("array<array<long>>")
    return df.select(path.cast("string").alias("path"), F.lit(tag).alias("section"), entry.cast("int").alias("entry"), head.alias("head"), columns.alias("lists"))


def access_bits(rows: DataFrame) -> DataFrame:
    """path, addr, bits: how each address was used. Runs are laid one after another; what is beyond the address space is cut off.
    A file has at most one run for each address, so its window is bounded."""
    runs = section(rows, "ACMP")
    start = F.coalesce(F.sum("run").over(Window.partitionBy("path").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.least(F.col("_start") + F.col("run"), F.lit(1 << 16)) - 1
    return runs.withColumn("_start", start).filter((F.col("run") > 0) & (F.col("_start") < 1 << 16)).select("path", F.explode(F.sequence("_start", end)).alias("addr"), "bits")


def memory(rows: DataFrame) -> DataFrame:
    """path, addr, byte: the bytes that a file holds; of two at one address, the later entry's."""
    each = section(rows, "SNAP").select("path", "entry", F.col("addr").alias("_a"), F.posexplode("bytes").alias("_k", "byte"))
    return each.groupBy("path", (F.col("_a") + F.col("_k")).alias("addr")).agg(F.max_by("byte", "entry").alias("byte"))


def reads(rows: DataFrame) -> DataFrame:
    """Indexed reads with the fit, the registers they feed and the walks that go with their program counter, where there are any:
    path, pc, base, stride, lo, hi, count, fitted, scale, base_fit, feeds, inside (whether its values are addresses in the image),
    pointers (and at what is read there), walks (voices that have one)."""
    own = section(rows, "IDXR").drop("entry")
    last = section(rows, "IDXS").groupBy("path", "pc").agg(F.max_by(F.struct("flags", "scale", "base", "feeds"), "entry").alias("s"))
    flag = lambda bits: F.col("s.flags").bitwiseAND(bits) == bits
    fit = last.select("path", "pc", flag(FITTED).alias("fitted"), F.col("s.scale").alias("scale"), F.col("s.base").alias("base_fit"), F.col("s.feeds").alias("feeds"), flag(TARGETS_INSIDE).alias("inside"), flag(TARGETS_INSIDE | TARGETS_READ).alias("pointers"))
    walks = section(rows, "IWLK").groupBy("path", "pc").agg(F.array_sort(F.collect_set("voice")).alias("walks"))  # at most three voices
    return own.join(fit, ["path", "pc"], "left").join(walks, ["path", "pc"], "left")


def sample_streams(rows: DataFrame) -> DataFrame:
    """path, digital: tunes that write volume many times within a frame and have no note table."""
    return section(rows, "DIGI").select("path", ((F.col("most") >= STREAM_WRITES) & (F.col("table") == 0)).alias("digital"))
