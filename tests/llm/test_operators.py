"""Small cases for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as tokenizer_files
import pytest
from plain_urls import judged
from tokenizers import Tokenizer

from lanewright.llm import bpe_codec, exact_dedup, fingerprints, html_text, language_id, near_dups, packing, token_counts, toxicity, transducer, url_filter
from lanewright.llm.bpe import byte_pattern, load
from lanewright.llm.common import Steps

WORD, BYTE = (tokenizer_files.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
LONG = " ".join(random.Random(1).choice(["alpha", "Beta,", "don't", "x1y2", "été", "  ", "\n"]) for _ in range(9000))
TEXTS = [None, "", " ", "a", "It's  HERE\n\n now ", "<|endoftext|> x <|endoftext|>", "x" * 500, "ab" * 20_000, LONG, "日本語 😀 É́", "same text", "same text", "Same  Text"]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "a", 7, "x", 1)], "doc_id long, text string, n long, row string, id int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def test_token_counts(docs, empty):
    t = Tokenizer.from_file(BYTE)
    want = sorted((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in [*enumerate(TEXTS), (3, "a")])
    for chunk in (1 << 15, 100):
        assert sorted(map(tuple, token_counts.token_counts(docs, BYTE, chunk=chunk).collect())) == want
    assert not token_counts.token_counts(empty, BYTE).collect()


def test_the_transducer_counts_as_the_library_does():
    library, machine = Tokenizer.from_file(BYTE), transducer.Transducer(load(BYTE), most=3000)
    rng = random.Random(6)
    signs = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x250), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F640)]]
    for _ in range(400):
        chars = rng.choice([signs, signs[:95], signs[65:91], list("abcde"), list("'\"-= ")])
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 60)))
        pieces = [p.encode() for p in byte_pattern().findall(text)]
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.counts(pieces).sum() == want == sum(machine.advance(transducer.FIRST, p)[1] for p in pieces)


def test_token_counts_of_a_long_text_without_spaces(spark):
    """No task sees more than a chunk of it: what enters a chunk is found from the characters before it."""
    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(400_000)), "".join(rng.choice("ABCabc0123/+") for _ in range(200_000)), "ab" * 60_000, "x" + " " * 50_000 + "y", "-" * 40_000 + "'s" * 20_000]
    library, t = Tokenizer.from_file(BYTE), token_counts.TextTransducer(BYTE)
    want = [len(library.encode(x, add_special_tokens=False).ids) for x in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r["n_tokens"] for r in sorted(token_counts.token_counts(frame, BYTE).collect())] == want
    for x, n in list(zip(texts, want, strict=True))[:3]:
        size, before = token_counts.CHUNK, token_counts.CONTEXT
        maps = [t.chunk_map(x[max(0, k - before) : k], x[k : k + size]) for k in range(0, len(x), size)]
        [(enter, leave, total)] = token_counts.compose(maps)
        assert total + t.count(token_counts._read(leave)[0]) == n and max(map(len, maps)) <= 4


def test_codec(docs, empty):
    t = Tokenizer.from_file(WORD)
    want = []
    for i, x in [*enumerate(TEXTS), (3, "a")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf in (1 << 14, 50):
        assert sorted(map(tuple, bpe_codec.encode_decode(docs, WORD, leaf=leaf).collect())) == sorted(want)
    assert not bpe_codec.encode_decode(empty, WORD).collect()


def test_packing(docs, empty):
    t = Tokenizer.from_file(WORD)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(TEXTS)}
    rows = packing.pack(docs, WORD, window=256).collect()
    sequences, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: len(x) * (2 if i == 3 else 1) for i, x in ids.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
    totals = [sum(n for _, n in p) for p in sequences.values()]
    assert max(totals) <= 256 and sum(x < 256 for x in totals) <= 1
    assert not packing.pack(empty, WORD).collect()


def test_packing_with_ids_gives_whole_encodings(docs):
    t = Tokenizer.from_file(WORD)
    plain = docs.dropDuplicates(["doc_id"])
    found = defaultdict(list)
    for r in packing.pack(plain, WORD, window=64, with_ids=True).collect():
        assert len(r["ids"]) == 2 * r["length"] and zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"]
        found[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u2").tolist()))
    for i, x in enumerate(TEXTS):
        assert sum((own for _, own in sorted(found[i])), []) == [*t.encode(x or "", add_special_tokens=False).ids, 2]


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((6, 9)), np.array([0, 2.0, 0, 0, 1, 0, 3, 0, 0])
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)


def test_the_plan_keeps_the_rounded_solution_and_cuts_little():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4095, rng.gamma(1.2, 700, 6000).astype(int) + 1)
    cls = -(-lengths // 64)
    counts = np.bincount(cls, minlength=65)[1:].astype(float)
    tokens = np.bincount(cls, lengths, minlength=65)[1:]
    patterns, times = packing.plan(counts, tokens, 4096)
    assert (patterns @ times <= counts).all() and (np.arange(1, 65) @ patterns <= 64).all()
    mean = np.divide(tokens, counts, out=np.zeros(64), where=counts > 0)
    assert mean @ (patterns @ times) >= 0.93 * tokens.sum()  # tokens of pieces that stay whole in a planned window
    left = np.array([0, 0, 3, 0, 1, 0, 0, 2])
    found, often = packing.greedy(left)
    assert (sum(n * p for p, n in zip(found, often, strict=True)) == left).all() and all(np.arange(1, 9) @ p <= 8 for p in found)


def test_exact_dedup(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, "test_digests", buckets=2)
    rows = {(r["doc_id"], r["kept"]): r for r in exact_dedup.dedup(docs, index).collect()}
    assert rows[10, True]["group_size"] == 2 and rows[11, False]["keep_id"] == 10 and rows[0, True]["group_size"] == 2 and (1, False) in rows and (12, True) in rows
    again = exact_dedup.dedup(docs, index, batch=1).collect()
    assert not any(r["kept"] for r in again) and index.rows().count() == len({r["text_sha256"] for r in again})
    assert not exact_dedup.dedup(empty, index, batch=2).collect()


def test_fingerprints(docs, empty):
    plain = docs.dropDuplicates(["doc_id"])
    fold = lambda t: " ".join(__import__("unicodedata").normalize("NFC", t).casefold().split())
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(plain).collect()}
    seen = defaultdict(set)
    for i, t in enumerate(TEXTS):
        t, nxt = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == float(fold(t) == fold(nxt)) and r["near_edited"] == float(fold(t) == fold(edited))
        seen[fold(t)].add(r["fingerprint"])
        seen[fold(edited)].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)
    assert len(fingerprints.edited_fingerprints(docs).collect()) == len(TEXTS) + 1
    assert not fingerprints.edited_fingerprints(empty).collect()


def test_composition_of_hangul_and_higher_planes(spark):
    import unicodedata

    texts = ["한국어 문서 각 가 값 뷁", "가\u11a8 각\u11a8 \u1100\u1161\u11a8\u11a8 \u1100 \u1161 \u11a8\u1100\u1161", "\U0001109a x \U0001112e \U000114bc \U0002f800", "\u0958 \u0344 \u03b9\u0344 \ufb2a \U0001d15e", "e\u0301 한 é Ω", "日本語 😀"]
    texts = [x for t in texts for x in (t, unicodedata.normalize("NFD", t))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    got = {r["id"]: r["c"] for r in rows.select("id", fingerprints.composed(rows["text"]).alias("c")).collect()}
    assert got == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    both = spark.createDataFrame([(0, texts[0]), (1, texts[1])], "doc_id long, text string")
    assert len({r["fingerprint"] for r in fingerprints.edited_fingerprints(both).collect()}) == 1


def test_equal_hashes_of_different_texts_get_suffixes(spark):
    rows = spark.createDataFrame([(1, 1, "t", "h", "a"), (2, 2, "t", "h", "b"), (3, 3, "t", "h", "b"), (4, 4, "t", "g", "c"), (5, 5, "t", "g", "c")], "id long, row long, kind string, hash string, canon string")
    assert sorted((r["id"], r["suffix"]) for r in fingerprints.suffixes(rows, Steps(spark, "test")).collect()) == [(2, 1), (3, 1)]
    assert fingerprints.suffixes(rows.filter("hash = 'g'"), Steps(spark, "test")) is None


def test_canonical_form_of_random_unicode(spark):
    """Composition as in the library; folding too, but for Cherokee, which is folded to its small letters."""
    import unicodedata

    rng = random.Random(8)
    t = fingerprints.tables()
    every = [chr(c) for c in range(0x20, 0x20000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co") and not 0x13A0 <= c < 0x1400 and not 0xAB70 <= c < 0xABC0]
    special = [c for c, _ in t.apart] + t.marks + [x[0] for x, _ in t.pairs] + [x for ab, _ in t.letters for x in ab]
    jamo = [chr(c) for c in [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC40)]]
    texts = []
    for _ in range(500):
        chars = rng.choice([every, special, jamo, [*special, *"aeiou"], [*t.marks, *"ae"], list("straßeΟΔΟΣſµİ ")])
        s = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 14)))
        texts += [s, unicodedata.normalize("NFD", s)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r["id"]: r for r in rows.select("id", fingerprints.composed(rows["text"]).alias("c"), fingerprints.case_folded(fingerprints.composed(rows["text"])).alias("f")).collect()}
    for i, x in enumerate(texts):
        whole = unicodedata.normalize("NFC", x)
        assert (found[i]["c"], found[i]["f"]) == (whole, whole.casefold()), ascii(x)


@pytest.mark.parametrize("t", [(90, 100), (80, 100)])
def test_near_dups(spark, empty, t):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(5000) for _ in range(160)]
    texts = [None, "", "one", "One", "one two", " ".join(base)]
    for size in (9, 10, 11, 12, 18, 20, 30, 60, 160):
        for _ in range(8):
            w = base[:size]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "q%d" % rng.randrange(50)
            texts.append(" ".join(w + ["z%d" % rng.randrange(9)] * rng.randrange(2)))
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    parent = list(range(len(texts)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and t[1] * len(sets[i] & sets[j]) >= t[0] * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, near_dups.join_components(frame, t=t).collect()))
    assert found == [(i, len(sets[i]), find(i)) for i in range(len(texts))]
    assert not near_dups.join_components(empty, t=t).collect()


@pytest.mark.parametrize("t", [(90, 100), (80, 100)])
def test_near_dups_across_the_size_of_whole_sets(spark, t):
    """Isolated pairs of a set that is kept whole and a larger one, of shingles that many sets have and shingles of their own."""
    rng = random.Random(11)
    sets = []
    for p, (n, m) in enumerate([(27, 29), (28, 29), (28, 31), (13, 14), (13, 16), (12, 14)] * 25):
        often = n // 2
        small = [f"often{i}" for i in rng.sample(range(150), often)] + [f"own{p}x{i}" for i in range(n - often)]
        sets += [set(small), {*small, *(f"more{p}x{i}" for i in range(m - n))}]
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(sets)):
        for j in range(i):
            if t[1] * len(sets[i] & sets[j]) >= t[0] * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = [(i, len(x), find(i)) for i, x in enumerate(sets)]
    assert sum(i != c for i, _, c in want) >= 75
    frame = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "doc_id long, text string")
    assert sorted(map(tuple, near_dups.join_components(frame, k=1, t=t).collect())) == want


def test_sketches_never_fall_short(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for n in (1, 30, 700, 40_000):
        a, b = (np.unique(rng.integers(0, 2 * n, n)) for _ in "ab")
        rows.append([*near_dups.packed(a), *near_dups.packed(b)])
        want.append(len(np.intersect1d(a, b)))
    names = [f"{c}_{x}" for x in "ab" for c in near_dups.PACKED]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    found = [r["o"] for r in frame.select(near_dups.packed_overlap([frame[n] for n in names[:8]], [frame[n] for n in names[8:]]).alias("o")).collect()]
    assert all(o is None or o >= w for o, w in zip(found, want, strict=True)) and found[3] is None and found[1] is not None


def test_near_dups_of_rows_that_repeat_an_id(spark):
    a, b, c = ("%s one two three four five six" % x for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, c), (9, None), (10, ""), (7, None), (11, "x " * 50_000)]
    frame = spark.createDataFrame([(i, x, 1, 2, 3, "r", 4) for i, x in rows], "doc_id long, text string, id int, n int, c int, comp string, s int").repartition(3)
    found = sorted((r["doc_id"], r["component_id"]) for r in near_dups.join_components(frame).collect())
    assert found == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (8, 8), (8, 8), (9, 9), (10, 10), (11, 11)]


def test_near_dups_in_a_list_of_more_than_one_block(spark, monkeypatch):
    """Many sets that share their rarest shingles, so that lists are cut by size and into blocks."""
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    rng = random.Random(4)
    sets = []
    for g in range(40):
        own = [f"own{g}x{i}" for i in range(40 + g % 7 * 3)]
        common = [f"c{i}" for i in range(20)]
        for _ in range(2):
            sets.append({*common, *own[: len(own) - rng.randrange(3)]})
    parent = list(range(len(sets)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    monkeypatch.setattr(near_dups, "_frequent", lambda rows, k: near_dups.EMPTY)
    frame = spark.createDataFrame([(i, " ".join(sorted(x))) for i, x in enumerate(sets)], "doc_id long, text string")
    assert sorted(map(tuple, near_dups.join_components(frame, k=1).collect())) == [(i, len(x), find(i)) for i, x in enumerate(sets)]


def test_language(spark, empty):
    words = {"en": "the of and that with from", "de": "der und nicht eine schön über", "fr": "les été dans une être où"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(1000, None, "en"), (1001, "123 ...", None), (1002, "", "de"), (1003, " ".join(["der und nicht"] * 3000), None)]
    found = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:90]) and [found[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    assert not language_id.identify(empty.selectExpr("doc_id", "text", "row as lang")).collect()


def test_symbols_of_higher_planes_are_no_letters(spark):
    rows = [(i, "the of and that with from", "en") for i in range(9)] + [(20, "😀😀 🎉 𝄞", None), (21, "𐐀𐐁𐐂", None)]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[20] == "und" and found[21] == found[0] == "en"


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        w = [rng.choice("table river green walking paper seven window".split()) for _ in range(20)] + ["scumbag"] * bad + [rng.choice(["muslim", "christian"])] * (rng.random() < (0.6 if bad else 0.1))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, "the muslim walking by a river")]
    labels += [(1, 0), (950, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found.values())
    assert sum(found[i]["predicted"] == y for i, y in labels[:600]) >= 594 and not found[900]["predicted"] and not found[901]["predicted"]
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == len(rows) and not any(r["predicted"] for r in none)


def test_counterfactual_penalty_draws_scores_together():
    y = np.array([1.0] * 20 + [0.0] * 20)
    texts = np.repeat(np.arange(40), [2] * 20 + [1] * 20), np.array([0, 1] * 20 + [3] * 20)
    changes = np.repeat(np.arange(20), 2), np.array([1, 2] * 20), np.array([1.0, -1.0] * 20)
    change = lambda p: abs(np.subtract(*toxicity.fit(y, texts, changes, 4, penalty=p)[0][[1, 2]]))
    assert change(10.0) < 0.2 * change(0.0)


def test_neutral_mentions_of_a_group_are_fewer_false_positives_with_the_penalty(spark):
    """One group is mentioned in most toxic texts and in few others; the toxic words are weak signs."""
    rng = random.Random(3)
    plain = "table river green walking paper seven window light stone morning".split()
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        w = rng.choices(plain, k=14) + ([rng.choice("nasty awful".split())] if bad and rng.random() < 0.7 else []) + (["muslims"] if rng.random() < (0.8 if bad else 0.03) else []) + (["christians"] if rng.random() < 0.05 else [])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    neutral = [(2000 + k, " ".join([*rng.choices(plain, k=13), "muslims"])) for k in range(60)]
    docs = spark.createDataFrame(rows + neutral, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    wrong, hits = {}, {}
    for p in (0.0, 1.0):
        found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, marks, penalty=p).collect()}
        wrong[p] = sum(found[i] >= 0.5 for i, _ in neutral)
        hits[p] = sum(found[i] >= 0.5 for i, y in labels if y and ("nasty" in rows[i][1] or "awful" in rows[i][1]))
    assert wrong[0.0] >= 50 and wrong[1.0] <= 6 and hits[1.0] >= 0.9 * hits[0.0]


def test_terms_of_the_sample_are_those_that_tell_nothing(spark):
    rows = [(k % 2, "those people said " + ("bad" if k % 2 else "good") + f" x{k}") for k in range(60)]
    found = toxicity.neutral_terms(spark.createDataFrame(rows, "y long, text string"), 30.0, 30.0)
    assert found == [["people", "said"]]
    assert toxicity.swaps([["a", "b", "c"], ["c", "d"]]) == {"a": "b", "b": "c", "c": "a", "d": "c"}


def test_toxicity_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(TEXTS) + 1 and len({r["score"] for r in found if r["doc_id"] == 3}) == 1
    assert not toxicity.toxicity(empty, labels).collect()


def test_language_of_odd_tables(spark, docs, empty):
    frame = docs.selectExpr("*", "if(doc_id > 8, 'en', null) as lang", "1 as score", "2 as lang_pred", "3 as bucket")
    found = language_id.identify(frame).collect()
    assert len(found) == len(TEXTS) + 1 and {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {0, 1, 2}
    assert len({(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 3}) == 1


def test_urls(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block")]
    urls = ["http://A.Example.org/es/1?x#y", "https://example.org/en", "http://x.com/de/", "http://x.com", "no scheme", None, "http://xorg/", "ftp://u.net?q=http://a.org/"] + ["http://x.com/de/"] * 3
    pages = spark.createDataFrame([(i, u, "<p>example words</p>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, n long")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("example.org", "/en", "org/", "allow") and got[2] == ("x.com", "/de/", "com/de/", "block")
    assert got[3][:3] == ("x.com", "", None) and got[4][:3] == got[5][:3] == ("", "", None) and got[6][:3] == ("xorg", "/", None) and got[7][:3] == ("u.net", "", None) and len(got) == len(urls)
    assert all(x[3] in ("allow", "block") for x in got.values())
    assert not url_filter.judge(pages.filter("page_id < 0"), rules).collect()


def test_viterbi():
    words = {(0, 4): 50, (4, 3): 40, (0, 7): 1, (0, 2): 30}
    assert url_filter.viterbi("bluesky", words, 200) == ["blue", "sky"] and url_filter.viterbi("", {}, 10) == []


def test_verdicts_beyond_the_rules_are_those_of_plain_viterbi_and_naive_bayes(spark):
    rng = random.Random(2)
    words = "blue sky news river shop green stone paper light seven".split()
    names = ["".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(40)] + ["a" * 20, "xq7"]
    urls = [f"http://{rng.choice(['www.', ''])}{rng.choice(names)}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'en', 'x'])}/{rng.choice(words)}-{rng.randrange(99)}" for _ in range(400)]
    urls += [None, "http:///", "http://" + "y" * 5000 + ".net/" + "z/" * 3000, *urls[:3]]
    html = [" ".join(rng.choices(words, k=30)) for _ in urls]
    pages = spark.createDataFrame([(i, u, h, "w", 1) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, word string, n long").repartition(3)
    rules = [("com/de/", "block"), ("com/fr/", "allow"), ("org/", "allow")]
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    want = judged(dict(enumerate(urls)), dict(enumerate(html)), rules, {i: (r["host"], r["path"]) for i, r in got.items()})
    for i, (verdict, _, odds) in want.items():
        assert abs(odds - got[i]["block_score"]) < 1e-6 and got[i]["verdict"] == verdict, (urls[i] or "")[:80]
    assert len({r["verdict"] for i, r in got.items() if not want[i][1]}) == 2


def test_blocks_of_pages_that_the_tree_has_not_seen():
    x, y = html_text.labelled(200, seed=77)
    found = html_text.classify(html_text.tree(), x)
    assert (found == y).mean() >= 0.97
    used = set()
    walk = lambda n: len(n) > 1 and (used.add(html_text.FEATURES[n[0]]), walk(n[2]), walk(n[3]))
    walk(html_text.tree())
    assert {"words", "links"} <= used and used & {"words_before", "words_after", "links_before", "links_after"}
    # Blocks that differ in nothing but words and links are told apart.
    text, menu = "plain words of a long text " * 12, "".join(f"<p><a href=x>link {k}</a></p>" for k in range(6))
    assert html_text.main_texts([f"<body>{menu}<p>{text}</p><p>{text}</p>{menu}</body>"]) == [f"{text.strip()}\n\n{text.strip()}"]
    assert html_text.main_texts(['<article><p class="x>one two</p><p>three</p></article>']) == ["one two\n\nthree"]


def test_html_of_odd_tables(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "t", 2)] * 2 + [(2, "u", "<p>" * 3000, "t", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_text.extract(pages).collect())) == [(1, "u", "a", 1)] * 2 + [(2, "u", "", 0)]
    assert not html_text.extract(pages.filter("page_id < 0")).collect()


def test_html(spark):
    page = "<title>no</title><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>one <b>two</b><br>three<p>four</article><script>if(a<b)</script><footer>foot</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut &lt; of"), (5, "u", "<article>" + "<p>word word</p>" * 5000)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B\n\none two three\n\nfour" and got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "cut < of"
    assert got[5]["n_chars"] == 5000 * 9 + 4999 * 2


@pytest.mark.parametrize("tag", ['div class="layout has-sidebar"', 'div class="content with-sidebar"', 'div class="post comments-open"', 'form id="aspnetForm"', 'div class="promo-frame"'])
def test_wrappers_that_look_like_outside_regions_keep_the_article(tag):
    body = " ".join(["plain words of the text"] * 12)
    end = f"</{tag.split()[0]}>"
    side = '<div class="sidebar"><p>side words here</p></div><footer><p>foot words</p></footer>'
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry">', "</div>")):
        page = f"<body><{tag}><nav><a href=x>Menu</a></nav>{open_}<p>{body}</p><p>{body}</p>{close}{side}{end}</body>"
        assert html_text.main_texts([page]) == [f"{body}\n\n{body}"]
    assert body in html_text.main_texts([f"<body><{tag}><p>{body}</p><p>{body}</p><p>{body}</p>{end}</body>"])[0]


def test_outside_regions_beside_an_article_stay_outside():
    few, many = "a few words of the article text itself", " ".join(["what others say"] * 40)
    comments = f'<div class="comments"><div class="comment"><div class="content"><p>{many}</p></div></div></div>'
    assert html_text.main_texts([f"<article><p>{few}</p></article>{comments}", f"<article><p>{few}</p></article><form><p>{many}</p></form>"]) == [few, few]
    assert html_text.main_texts([f'<div style="display:none"><article><p>{many}</p></article></div>', f"<footer><p>{many}</p></footer>"]) == ["", ""]


@pytest.mark.parametrize("name", "button select object audio video canvas svg math template noscript".split())
def test_silent_elements_without_an_end_tag_drop_nothing(name):
    article = "<article><p>one two three</p></article>"
    assert html_text.main_texts([f"<div><{name} class=x>{article}</div>"]) == ["one two three"]
    assert html_text.main_texts([f"<div><{name}></div>{article}<div><{name}>no</{name}></div>"]) == ["one two three"]
    assert html_text.main_texts([f"<article><{name}>no</{name}><p>yes</p></article>"]) == ["yes"]
    assert html_text.main_texts(["<article><p>yes</p><svg><svg>no</svg>no</svg><script>no"]) == ["yes"]


def test_counters_fall_short_by_a_bounded_count():
    rng = np.random.default_rng(2)
    keys = np.concatenate([np.repeat(np.arange(20), 400), rng.integers(1000, 10**9, 20_000)])
    rng.shuffle(keys)
    counters = near_dups.Counters(500)
    for part in np.array_split(keys, 97):
        counters.add(part)
    found = dict(zip(*(x.tolist() for x in counters.largest(20, 1)), strict=True))
    assert set(found) == set(range(20)) and all(400 - len(keys) / 500 <= n <= 400 for n in found.values())
    assert not len(near_dups.Counters(5).largest(3, 1)[0])
