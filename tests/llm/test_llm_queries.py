"""The registered queries on real tables, against plain versions of each."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from plain_urls import judged
from tokenizers import Tokenizer

from lanewright.llm import html_text, language_id, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op1(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in run(spark, "op1_packing"):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for parts in [*sequences.values(), *covered.values()]:
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
    assert {i: sum(n for _, n in p) for i, p in covered.items()} == {i: len(x) for i, x in ids.items()}
    totals = [sum(n for _, n in p) for p in sequences.values()]
    assert max(totals) <= 4096 and len(totals) <= -(-sum(totals) // 4096) + 1


def test_op2(spark, texts):
    import unicodedata

    order = sorted(texts)
    fold = lambda t: " ".join(unicodedata.normalize("NFC", t).casefold().split())
    rows = {r["doc_id"]: r for r in run(spark, "op2_fingerprints")}
    by_text = defaultdict(set)
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, n = texts[i], len(texts[i]) // 4
        edited = t[: len(t) - n] + texts[nxt][:n]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(fold(t) == fold(edited)) and r["near_next"] == float(fold(t) == fold(texts[nxt]))
        by_text[fold(t)].add(r["fingerprint"])
        by_text[fold(edited)].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_op3_and_op4(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in run(spark, "op3_token_counts") if r["over_limit"] == (r["n_tokens"] > 512)} == want
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in run(spark, "op4_bpe_codec")}
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), *digests)


def test_op5(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in queries.op5_url_filter(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == pages.keys()
    parts = {}
    for i, p in pages.items():
        rest = p["url"].split("://", 1)[1] if p["url"] and "://" in p["url"] else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        parts[i] = host, path = "".join(c.lower() if c.isascii() else c for c in host), path
        fits = [(t, v) for t, v in queries.URL_RULES if ("." + host).endswith("." + t.partition("/")[0]) and path.startswith("/" + t.partition("/")[2])]
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, max(fits, key=lambda f: len(f[0]), default=(None,))[0])
    want = judged(pages, {i: p["html"] for i, p in pages.items()}, queries.URL_RULES, parts)
    assert {i: r["verdict"] for i, r in rows.items()} == {i: w[0] for i, w in want.items()}
    blocked = [odds for _, ruled, odds in want.values() if ruled == "block"]
    assert sum(odds > 0 for odds in blocked) >= 0.8 * len(blocked), "the model alone tells most urls that a rule blocks"
    assert {w[0] for w in want.values() if not w[1]} == {"allow", "block"}


def test_op7_finds_what_it_has_not_seen(spark):
    """Of these tables' toxic texts only about half have a word that others lack."""
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [r for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    found = [r for r in held if r["predicted"]]
    assert sum(toxic[r["doc_id"]] for r in found) >= max(0.9 * len(found), 0.6 * sum(toxic[r["doc_id"]] for r in held)) > 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_op8(spark, texts):
    sets = {}
    for i, x in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert sorted(map(tuple, run(spark, "op8_ngram_jaccard"))) == sorted((i, len(s), find(i)) for i, s in sets.items())


def test_op9_is_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts: dict = defaultdict(lambda: np.zeros(language_id.BUCKETS))
    for r in docs:
        if not held(r["doc_id"]) and r["lang"] is not None:
            np.add.at(counts[r["lang"]], language_id.trigrams([r["text"] or ""])[0], 1)
    names = sorted(counts)
    logs = [np.log((counts[n] + 0.5) / (counts[n] + 0.5).sum()) for n in names]

    def mixture(runs, allowed):
        share = {k: 1 / len(allowed) for k in allowed}
        for step in range(13):
            like, gained = 0.0, dict.fromkeys(allowed, 0.0)
            for run_ in runs:
                top = max(run_)
                parts = {k: share[k] * np.exp(run_[k] - top) for k in allowed}
                total = max(sum(parts.values()), 1e-300)
                like += np.log(total) + top
                for k in allowed:
                    gained[k] += parts[k] / total
            if step == 12:
                return share, like
            share = {k: g / len(runs) for k, g in gained.items()}

    rows = {r["doc_id"]: r for r in run(spark, "op9_language_id")}
    for r in docs:
        text, found = r["text"] or "", rows[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert (found["lang_pred"], found["score"]) == ("und", 0.0)
            continue
        h = language_id.trigrams([text])[0]
        runs = [[float(t[h[k : k + language_id.RUN]].astype(np.float32).sum(dtype=np.float64)) for t in logs] for k in range(0, len(h), language_id.RUN)]
        full, _ = mixture(runs, range(len(names)))
        order = sorted(full, key=lambda k: -full[k])
        best = (-np.inf, None)
        for size in range(1, len(names) + 1):
            share, like = mixture(runs, order[:size])
            worth = like - 2 * size * np.log(len(runs) + 1)
            if worth > best[0]:
                best = (worth, max(order[:size], key=lambda k: share[k]))
            else:
                break
        assert found["held_out"] == held(r["doc_id"]) and abs(found["score"] - full[order[0]]) < 1e-3
        assert found["lang_pred"] == names[best[1]] or abs(full[order[0]] - full[order[1]]) < 1e-3


def test_op10(spark):
    """These pages mark their article; its blocks are what is between its tags."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = {r["page_id"]: r for r in run(spark, "op10_html_text")}
    for i, page in pages.items():
        inside = "".join(re.findall(r"<article>(.*?)</article>", page, re.S))
        assert rows[i]["text"] == html_text.main_texts([f"<article>{inside}</article>"])[0] and rows[i]["n_chars"] == len(rows[i]["text"])
        plain = re.sub(r"\s+", "", re.sub("<[^>]*>", "", inside))
        assert re.sub(r"\s+", "", rows[i]["text"]) == html_text.entities.unescape(plain)
