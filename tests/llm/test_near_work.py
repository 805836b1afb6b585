"""What the join of near copies takes on its way: candidates, words hashed, and what the driver keeps."""

import random
import time

import numpy as np
import pyarrow as pa
import xxhash

from lanewright.llm import near_dups


def test_a_common_shingle_counts_only_if_it_can_be_the_first(spark):
    """Two sets of 100 whose first common shingle is the sixteenth of both have 85 in common at most; a link takes 89."""
    rng, t, rows = random.Random(3), (80, 100), [(0, 100, 15, 100, 15), (1, 100, 11, 100, 11)]
    linked = set()
    for k in range(2, 400):
        a = sorted(rng.sample(range(40), rng.randrange(5, 40)))
        b = sorted({*(x for x in a if rng.random() < 0.95), *(rng.sample(range(40), rng.randrange(3)))} or {1})
        both = sorted({*a} & {*b})
        rows += [(k, len(a), a.index(x), len(b), b.index(x)) for x in both]
        if 100 * len(both) >= 80 * len({*a} | {*b}):
            linked.add(k)
    frame = spark.createDataFrame(rows, "k int, n long, i int, m long, j int")
    left = {r["k"] for r in frame.filter(near_dups.candidate(frame["n"], frame["i"], frame["m"], frame["j"], t)).collect()}
    assert 0 not in left and 1 in left and len(linked) > 50 and linked <= left


def test_a_word_of_many_texts_is_hashed_once(monkeypatch):
    seen, real = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(near_dups.xxhash, "xxh3_64_intdigest", lambda w: seen.append(w) or real(w))
    texts = ["", " \t\n", "a", "A b", " a  B\x0bc\n", "É é \x1c x \x85y z", "b a", "c b a " * 40]
    for k in (1, 2, 3):
        seen.clear()
        found = near_dups.shingles(pa.array(texts), k)
        assert len(seen) == len(set(seen)), "the words of a call, not of each text"
        words = [t.encode().lower().split() for t in texts]
        sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
        assert [len(s) for s in found] == [len(s) for s in sets]
        assert all(len(np.intersect1d(found[i], found[j])) == len(sets[i] & sets[j]) for i in range(len(texts)) for j in range(len(texts)))
        alone = [near_dups.shingles(pa.array([x, t, y])[1:2], k)[0] for x, t, y in zip(texts, texts, texts, strict=True)]
        assert all((a == b).all() for a, b in zip(found, alone, strict=True)), "the same in any slice"


def test_the_driver_keeps_little_of_earlier_jobs(spark):
    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m {i % 7}") for i in range(40)], "doc_id long, text string")
    near_dups.join_components(docs).count()
    end = time.time() + 20
    while (n := kept().size()) > 60 and time.time() < end:  # the cleaner runs beside the driver
        time.sleep(0.5)
    assert n <= 60
