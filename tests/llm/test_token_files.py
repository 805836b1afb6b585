"""Token files against the library: ids, places, digests, and files as they are on disk."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lanewright.llm import queries, token_files
from lanewright.llm.token_files import SYNC, ByteCoder, Record, crc_of_both, read_blocks, write_blocks, write_record

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "It's  HERE\n\n now ", "<|endoftext|> x <|endoftext|>", "x" * 500, "ab" * 20_000, "日本語 😀 É́　 \xa0 y\n", "same text", "same text"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def expected(library, rows):
    """(id, start, n, crc) of (id, text) in ascending order of ids; equal ids with equal texts only."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_blocks_give_back_their_ids(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 2, 300, 60_000):
            ids = rng.integers(0, high, n).astype(kind)
            ids[rng.random(n) < 0.05] = 65_535  # exceptions
            starts, data = write_blocks(ids)
            assert len(starts) == -(-n // 128) and (read_blocks(starts, np.frombuffer(data, np.uint8), np.dtype(kind))[:n] == ids).all()
    equal = write_blocks(np.full(1280, 7, kind))
    assert len(equal[1]) == 10 * (np.dtype(kind).itemsize + 2), "equal ids take no bits"
    few = np.zeros(128, kind)
    few[[3, 77]] = 50_000
    assert len(write_blocks(few)[1]) == np.dtype(kind).itemsize + 2 + 2 * (1 + np.dtype(kind).itemsize), "outliers are exceptions, not width"


def test_a_range_is_read_by_its_blocks():
    ids = np.random.default_rng(2).integers(0, 50_000, 3000).astype("<u2")
    r = Record(write_record(3, 4, 9, [(5, 1000, 0), (-6, 2000, 2)], ids))
    assert (r.file, r.number, r.first, r.docs.tolist(), r.sizes.tolist(), r.flags.tolist()) == (3, 4, 9, [5, -6], [1000, 2000], [0, 2])
    for a, b in ((0, 3000), (130, 290), (128, 256), (2999, 9000), (7, 7)):
        assert (r.ids(a, b) == ids[a:b]).all()


def test_a_record_never_holds_the_marker():
    """A document id and the ids themselves spell it here."""
    sync = SYNC.encode()
    names = np.frombuffer(sync[:8], "<i8").tolist() + np.frombuffer(sync[7:15], "<i8").tolist()
    names[1] = int.from_bytes(sync[8:] + b"~", "little")
    record = write_record(0, 0, 0, [(names[0], 1, 0), (names[1], 1, 0)], np.array([1, 2], "<u2"))
    assert record[0] and sync not in record and (record + sync).index(sync) == len(record)
    assert Record(record).docs.tolist() == names


def test_digests_of_parts_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(90)), rng.randbytes(rng.randrange(3000))
        assert crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_ids_are_those_of_the_library(library):
    rng = random.Random(3)
    signs = [*"ab 'st.,\n\n\t 12é日😀　\xa0\x1c", "<|endoftext|>", "  ", "don't", "\r\n", "word,", " word."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for coder in (ByteCoder(BYTE), ByteCoder(BYTE, most=50)):
        for k in range(0, len(texts), 100):
            for text, ids in zip(texts[k : k + 100], coder.encode_all(texts[k : k + 100]), strict=True):
                assert np.frombuffer(ids, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("record", [1 << 18, 50])
def test_odd_texts_small_records_and_clashing_columns(spark, library, record):
    """Documents that go on over many records; a repeated row; columns with the names used inside."""
    rows = [*enumerate(TEXTS), (3, "a"), (-8, "minus")]
    frame = spark.createDataFrame([(i, t, 7, "x", b"r", 1) for i, t in rows], "doc_id long, text string, n long, start string, record binary, id int").repartition(3)
    got = sorted(map(tuple, token_files.token_files(frame, BYTE, record=record).collect()), key=lambda r: r[:2])
    assert got == expected(library, rows)
    assert not token_files.token_files(frame.filter("n < 0"), BYTE).collect()


def test_files_on_disk(spark, library, tmp_path):
    """Files, records and documents are in order; every file is records closed by the marker; ids can be read as arrays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = str(tmp_path / "files")
    token_files.write_token_files(docs, at, BYTE, files=5, record=4096)
    stream = []
    for name in sorted(glob.glob(f"{at}/part-*")):
        parts = open(name, "rb").read().split(SYNC.encode())
        assert parts.pop() == b""
        for k, part in enumerate(parts):
            r = Record(part)
            assert r.number == k and r.sizes.sum() == r.n_ids <= 4096
            stream += r.ids().tolist()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert stream == [x for i in sorted(texts) for x in [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]]
    whole = [r for r in token_files.read_documents(spark, at, with_ids=True).collect() if not r["flags"]]
    assert whole and all(r["ids"] == [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2] for r in whole)


def test_op12(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(library, [(r["doc_id"], r["text"]) for r in docs])
