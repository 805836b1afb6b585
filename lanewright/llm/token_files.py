"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of records, each closed by SYNC, so that Spark's own text writer and reader move, commit and split the files in
any store. A record holds up to RECORD ids of consecutive documents:

    salt 1 byte; every byte after it is xored with the salt, which is chosen so that SYNC does not occur in the record
    header (HEADER), document ids (8 bytes each), numbers of ids (4 bytes each), flags (1 byte each)
    starts of the blocks (4 bytes each), relative to the first block
    blocks of 128 ids

A block is its least id, the width, the number of exceptions, the 128 differences to the least id packed at that width, then
places and differences of those that need more bits. The width is that of the 90th percentile of the differences. The starts let
a reader unpack only the blocks it needs.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _CONTRACTIONS, byte_pattern, byte_string, classes, cut_at, joined_strings, load, looked_up, rust_class
from .common import Steps, kept, running_total, slices

#: Closes a record. Its first character does not occur in it again, so no other place can close a record early.
SYNC = "~token-ids-sync"
#: magic, bytes of an id, file number, record number, ordinal of the first document in the file, documents, ids
HEADER = struct.Struct("<4sIIIQII")
MAGIC = b"TID1"
#: Bytes of text that are encoded at once.
SLICE = 1 << 22
#: Ids in a block and in a record, and the share of differences that a block's width must hold.
BLOCK, RECORD, SHARE = 128, 1 << 18, 0.9
#: The document goes on from the record before; into the next record.
FROM, INTO = 1, 2


class ByteCoder:
    """Token ids, two bytes each, for a byte-level vocabulary. Runs between two single spaces or line ends are kept with their
    ids; new runs of a batch are merged in one call."""

    def __init__(self, path: str, most: int = 300_000):
        self.bpe, self.most = load(path), most
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")
        self.space = re.compile(f"[{classes()[2]}]")
        #: Ids of what follows a space, with that space; for runs that begin with a line end, of that and what follows it. None
        #: where white space meets white space: what it belongs to is not told by the run alone.
        self.runs: dict[str, bytes | None] = {"": None, "\n": None}
        self.newline = self.bpe.encode_words([b"\n"])[0]
        self.fast = self._compiled()

    def _compiled(self):
        """The merges as ranks of byte strings, if the ids are in the order of the merges; else None."""
        if not (np.diff(self.bpe.made) > 0).all() or self.bpe.end:
            return None
        import tiktoken

        ranks = {byte_string(s): i for i, s in self.bpe.strings.items() if i not in self.bpe.special.values()}
        letter, number, space = map(rust_class, classes())
        #: byte_pattern for runs without white space but a space or a line end in front, with a mark between two runs.
        pattern = f"\\x00|\\n|{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^\\x00{space}{letter}{number}]+"
        self.whole = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return tiktoken.Encoding("pieces", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without line ends, each merged for itself."""
        if not self.fast or not pieces:
            return self.bpe.encode_words([p.encode("utf-8", "surrogatepass") for p in pieces])
        ids = self.fast.encode_to_numpy("\n".join(pieces)).astype("<u2")
        ends = [*(2 * np.flatnonzero(ids == int.from_bytes(self.newline, "little"))).tolist(), 2 * len(ids)]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *(e + 2 for e in ends[:-1])], ends, strict=True)]

    def learn(self, seen: set[str]) -> None:
        """Makes sure that all these runs are known. Where the table would outgrow `most`, only what is in use stays."""
        new = seen.difference(self.runs)
        if not new:
            return
        if len(new) + len(self.runs) > self.most:
            self.runs = {r: self.runs[r] for r in seen if r in self.runs} | {"": None, "\n": None}
        words = {r for r in new if r.isalpha()}
        stops, other = {}, []
        for r in new.difference(words):
            if r[-1] in ".,;:!?" and r[:-1].isalpha():
                stops[r] = r[:-1]
            elif self.space.match(r[-1]) or self.space.match(r[r[0] == "\n"]):
                self.runs[r] = None
            else:
                other.append(r)
        words |= set(stops.values()).difference(self.runs)
        split = {r: byte_pattern().findall(r[1:] if r[0] == "\n" else " " + r) for r in other}
        order, pieces = list(words), list(set().union(*split.values(), ".,;:!?"))
        coded = self.encode_pieces([" " + w for w in order] + pieces)
        self.runs.update(zip(order, coded, strict=False))
        get = dict(zip(pieces, coded[len(order) :], strict=True)).__getitem__
        for r, base in stops.items():
            self.runs[r] = self.runs[base] + get(r[-1])
        for r, ps in split.items():
            self.runs[r] = self.newline * (r[0] == "\n") + b"".join(map(get, ps))

    def plain(self, text: str) -> bytes:
        found = byte_pattern().findall(text)
        each = list(set(found))
        get = dict(zip(each, self.bpe.encode_words([p.encode("utf-8", "surrogatepass") for p in each]), strict=True)).__getitem__
        return b"".join(map(get, found))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; marks such as an end-of-text string count as the single token they name."""
        marked = {i: self.marks.split(t) for i, t in enumerate(texts) if "<|" in t and self.marks.search(t)}
        for i, parts in marked.items():
            between = iter(self.encode_all(parts[::2]))
            marked[i] = b"".join(np.array([self.bpe.special[x]], "<u2").tobytes() if k % 2 else next(between) for k, x in enumerate(parts))
        # A line end in front of each text, for a run that follows no space; its id is cut off again.
        split = [[] if i in marked else ("\n" + t).replace("\n", " \n").split(" ")[1:] for i, t in enumerate(texts)]
        self.learn(set(chain.from_iterable(split)))
        out = []
        for i, (text, own) in enumerate(zip(texts, split, strict=True)):
            if i in marked:
                out.append(marked[i])
                continue
            parts = list(map(self.runs.__getitem__, own))
            out.append((self.plain(text) if text else b"") if None in parts else b"".join(parts)[2:])
        return out


    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of all texts of a column, as encode_all gives them. Runs are merged once a call; none is kept, as most runs are
        rare and looking for them among many takes longer than merging them again."""
        if not self.fast or not len(texts):
            return self.encode_all(texts.to_pylist())
        texts = pc.fill_null(texts, "")

        def many(runs: pa.Array) -> pa.Array:
            runs = pc.if_else(pc.starts_with(runs, "\n"), runs, pc.binary_join_element_wise(" ", runs, ""))
            return cut_at(self.whole.encode_to_numpy(joined_strings(runs, "\0")), int(self.bpe.inner[0]))

        def one(runs: list[str]) -> list[bytes | None]:
            self.learn(set(runs))
            return [self.runs[r] for r in runs]

        # A line end in front of each text, as above.
        runs = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        out, missing = looked_up(runs, f"^\\n?[^\\x00{rust_class(classes()[2])}]+$", many, one)
        out = [ids[len(self.newline) :] for ids in out]
        marked = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(marked | missing).tolist():
            out[i] = self.encode_all([texts[i].as_py()])[0]
        return out


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values at so many bits each, the lowest bit first."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, values.itemsize), axis=-1, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=-1, bitorder="little")


def _unpacked(packed: np.ndarray, width: int, kind: np.dtype) -> np.ndarray:
    bits = np.zeros((len(packed), BLOCK, kind.itemsize * 8), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=-1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(bits, axis=-1, bitorder="little").view(kind)[:, :, 0]


def write_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, bytes]:
    """(starts, bytes) of the blocks of ids, which are unsigned integers of two or four bytes. The last block is filled up with
    its last id."""
    if not len(ids):
        return np.zeros(0, np.uint32), b""
    size = ids.itemsize
    rows = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1], ids.dtype)]).reshape(-1, BLOCK)
    least = rows.min(1)
    rows = rows - least[:, None]
    at = max(0, int(np.ceil(share * BLOCK)) - 1)
    widths = np.searchsorted(1 << np.arange(8 * size, dtype=np.int64), np.partition(rows, at, axis=1)[:, at].astype(np.int64), side="right")
    odd = rows.astype(np.int64) >= (1 << widths.astype(np.int64))[:, None]
    count = odd.sum(1)
    starts = np.concatenate([[0], np.cumsum(size + 2 + BLOCK // 8 * widths + count * (1 + size))])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(size)] = least[:, None].view(np.uint8)
    out[at + size], out[at + size + 1] = widths, count
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            out[at[own][:, None] + size + 2 + np.arange(BLOCK // 8 * w)] = _packed(rows[own], int(w))
    block, place = np.nonzero(odd)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        first = (at + size + 2 + BLOCK // 8 * widths)[block]
        out[first + rank] = place
        out[(first + count[block] + size * rank)[:, None] + np.arange(size)] = np.ascontiguousarray(rows[block, place])[:, None].view(np.uint8)
    return starts[:-1].astype(np.uint32), out.tobytes()


def read_blocks(starts: np.ndarray, data: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The ids of the blocks at these starts, in one run."""
    size, at = kind.itemsize, starts.astype(np.int64)
    rows = np.zeros((len(at), BLOCK), kind)
    if not len(at):
        return rows.ravel()
    least = np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(kind)
    widths, count = data[at + size].astype(np.int64), data[at + size + 1].astype(np.int64)
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            rows[own] = _unpacked(data[at[own][:, None] + size + 2 + np.arange(BLOCK // 8 * w)], int(w), kind)
    block = np.repeat(np.arange(len(at)), count)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        first = (at + size + 2 + BLOCK // 8 * widths)[block]
        values = np.ascontiguousarray(data[(first + count[block] + size * rank)[:, None] + np.arange(size)]).view(kind)[:, 0]
        rows[block, data[first + rank]] = values
    return (rows + least).ravel()


def write_record(file: int, number: int, first: int, docs: list[tuple[int, int, int]], ids: np.ndarray) -> bytes:
    """docs: (document id, ids, flags) for each document or part of one."""
    starts, blocks = write_blocks(ids)
    names, sizes, flags = zip(*docs, strict=True) if docs else ((), (), ())
    body = HEADER.pack(MAGIC, ids.itemsize, file, number, first, len(docs), len(ids))
    body += np.array(names, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + bytes(flags) + starts.astype("<u4").tobytes() + blocks
    raw, sync = np.frombuffer(body, np.uint8), SYNC.encode()
    for salt in range(256):
        out = body if not salt else (raw ^ np.uint8(salt)).tobytes()
        if sync not in out:
            return bytes([salt]) + out
    raise ValueError("no salt keeps the sync marker out of the record")


class Record:
    """A record that was read: its document table, and its ids by block."""

    def __init__(self, record: bytes):
        raw = np.frombuffer(record, np.uint8)
        raw = raw[1:] ^ raw[0] if raw[0] else raw[1:]
        magic, size, self.file, self.number, self.first, n, self.n_ids = HEADER.unpack(raw[: HEADER.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a record of token ids")
        self.kind = np.dtype(f"<u{size}")
        at = HEADER.size
        self.docs, self.sizes, self.flags = (np.frombuffer(raw[at + o * n : at + (o + w) * n].tobytes(), t) for o, w, t in ((0, 8, "<i8"), (8, 4, "<u4"), (12, 1, "u1")))
        at += 13 * n
        blocks = -(-self.n_ids // BLOCK)
        self.starts = np.frombuffer(raw[at : at + 4 * blocks].tobytes(), "<u4")
        self.data = raw[at + 4 * blocks :]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from start up to end; only the blocks that hold them are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, self.kind)
        first = start // BLOCK
        return read_blocks(self.starts[first : -(-end // BLOCK)], self.data, self.kind)[start - first * BLOCK : end - first * BLOCK]


def write_token_files(docs: DataFrame, at: str, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, record: int = RECORD) -> None:
    """Writes the ids of all documents, each followed by `end`, in ascending order of id_col to the folder `at`.

    Rows are dealt to files by ranges of ids, so files and records in the order of their numbers have the documents in order. A
    document may go on over several records. Null and empty texts are the end id alone. Repeated rows are written as often as
    they occur, the texts of one id in the order of a hash. An empty table gives no records. Other columns are ignored. Ids must
    be integers and not null.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ranged = docs.repartitionByRange(files, "id", "tie") if files else docs.repartitionByRange("id", "tie")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, file, stop = kept(ByteCoder, path), TaskContext.get().partitionId(), np.array([end], "<u2").tobytes()
        table: list[tuple[int, int, int]] = []
        parts: list[bytes] = []
        room, number, first = record, 0, 0

        def closed() -> pa.RecordBatch:
            nonlocal room, number, first
            out = write_record(file, number, first, table, np.frombuffer(b"".join(parts), "<u2"))
            number, first = number + 1, first + sum(1 for *_, f in table if not f & INTO)
            room = record
            table.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["record"])

        for b in slices(batches, "text", SLICE):
            for i, ids in zip(b["id"].to_pylist(), c.encode_column(b["text"]), strict=True):
                ids += stop
                n, done = len(ids) // 2, 0
                while done < n:
                    take = min(room, n - done)
                    table.append((i, take, FROM * (done > 0) | INTO * (done + take < n)))
                    parts.append(ids[2 * done : 2 * (done + take)])
                    done, room = done + take, room - take
                    if not room:
                        yield closed()
        if table:
            yield closed()

    rows = ranged.sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(records, "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SYNC).option("compression", "none").text(at)


def read_records(spark: SparkSession, at: str) -> DataFrame:
    """One row for each record: record binary. Large files are read in splits."""
    return spark.read.schema("value string").option("lineSep", SYNC).text(at).select(F.col("value").cast("binary").alias("record"))


def read_documents(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """One row for each document, or part of one, of each record: file, number, doc (its ordinal in the file), doc_id, before (ids
    before it in the record), n, ids_crc32 (over four bytes an id), flags, and ids (array) on demand."""
    kinds = {"file": pa.int64(), "number": pa.int64(), "doc": pa.int64(), "doc_id": pa.int64(), "before": pa.int64(), "n": pa.int64(), "ids_crc32": pa.int64(), "flags": pa.int32()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["record"]:
                r = Record(x.as_py())
                ids, n = r.ids().astype("<u4"), len(r.docs)
                ends = np.cumsum(r.sizes.astype(np.int64))
                flat, bounds = memoryview(ids.tobytes()), [0, *ends.tolist()]
                crcs = [zlib.crc32(flat[4 * bounds[k] : 4 * bounds[k + 1]]) for k in range(n)]
                cols = [np.full(n, r.file), np.full(n, r.number), r.first + np.arange(n), r.docs, ends - r.sizes, r.sizes, crcs, r.flags]
                arrays = [pa.array(np.asarray(c), t) for c, t in zip(cols, kinds.values(), strict=False)]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, list(kinds))

    return read_records(spark, at).mapInArrow(rows, "file long, number long, doc long, doc_id long, before long, n long, ids_crc32 long, flags int" + ", ids array<int>" * with_ids)


def crc_of_both(a: int, b: int, size_b: int) -> int:
    """The CRC-32 of two runs of bytes, from that of each and the number of bytes of the second."""

    def times(x: int, y: int) -> int:  # polynomials over two elements, the highest power in the lowest bit
        out = 0
        for k in range(31, -1, -1):
            out ^= y if x >> k & 1 else 0
            y = y >> 1 ^ (0xEDB88320 if y & 1 else 0)
        return out

    power, shift, n = 1 << 23, 1 << 31, size_b  # x to the 8th for each byte, and one
    while n:
        if n & 1:
            shift = times(shift, power)
        power, n = times(power, power), n >> 1
    return times(a, shift) ^ b


def token_files(docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", record: int = RECORD) -> DataFrame:
    """Writes token files, reads them back and gives one row for each document in them: id, start (ids of all documents before
    it), n_tokens (with the end id), ids_crc32 (over four bytes an id).

    Nulls, empty texts, repeated rows and empty tables as in write_token_files. The files are dropped when they have been read.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "token-files")
    at = f"{steps.path}/files"
    steps.paths["files"] = [at]
    write_token_files(docs, at, path, end, id_col, text_col, record=record)
    rows = steps.write(read_documents(spark, at), "documents")
    steps.drop("files")
    # Records in order: files have fewer than 2^31 records each.
    order = F.shiftleft(F.col("file"), 31) + F.col("number")
    bases = running_total(rows.groupBy(order.alias("order")).agg(F.sum("n").alias("_n")), "order", "_n", "base").select("order", "base")
    rows = rows.withColumn("order", order).join(bases, "order").withColumn("start", F.col("base") + F.col("before"))
    whole = rows.filter("flags = 0").select(F.col("doc_id").alias("id"), "start", F.col("n").alias("n_tokens"), "ids_crc32")

    def joined(pdf):  # pandas, the parts of one document: one for each record it is in
        import pandas as pd

        pdf, crc = pdf.sort_values("start"), 0
        for own, n in zip(pdf["ids_crc32"].tolist(), pdf["n"].tolist(), strict=True):
            crc = crc_of_both(crc, own, 4 * n)
        return pd.DataFrame({"id": pdf["doc_id"].iloc[:1], "start": pdf["start"].iloc[:1], "n_tokens": pdf["n"].sum(), "ids_crc32": [crc]})

    cut = rows.filter("flags > 0").groupBy("file", "doc").applyInPandas(joined, "id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)
