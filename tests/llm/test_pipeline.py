"""Stages of the corpus pipeline against plain versions: nulls, empty and long texts, copies, repeated rows, empty tables."""

import random
import zlib
from collections import defaultdict

import pytest

import corpus_pipeline
from lanewright.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, y int"


def plain_words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice("the river green walking paper seven window table light under morning stone".split()) for _ in range(n)]


def texts() -> list[str | None]:
    out: list[str | None] = [" ".join(plain_words(40 + i % 30, i)) for i in range(400)]
    out += [" ".join([*plain_words(40, 5000 + i), "scumbag", *plain_words(9, 9000 + i)]) for i in range(200)]
    long = plain_words(200, 1000)
    near = [*long[:100], "changed", *long[101:]]
    out += [None, "", "123 ... 4", " ".join(long), " ".join(near), " ".join(long[:120]), "  ".join(long), " ".join(plain_words(20_000, 7)), out[5], out[5] + " ", out[6]]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Extra columns have the names that the operators use inside."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, x, "en", "s", 1, 0.5, "x", 3) for i, x in enumerate(texts())]
    rows.append(rows[3])
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i >= 400)) for i in range(600)] + [(600, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def shingle_set(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_each_stage_takes_its_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fields, kept = docs.columns, sorted((i, x) for i, x in [*enumerate(texts()), (3, texts()[3])])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "exact dedup", "n-gram Jaccard join", "packing"]

    def step(k, rows):
        out = corpus_pipeline.STAGES[k][1](spark, docs_of(rows), folder)
        assert out.columns == fields
        found = out.collect()
        assert all(tuple(r)[2:] == ("en", "s", 1, 0.5, "x", 3) for r in found)  # columns are kept as they are
        return sorted((r["doc_id"], r["text"]) for r in found)

    def docs_of(rows):
        return spark.createDataFrame([(i, x, "en", "s", 1, 0.5, "x", 3) for i, x in rows], SCHEMA).repartition(4)

    first_kept = corpus_pipeline.language(spark, docs, folder).collect()
    assert all(r["score"] == 0.5 and r["lang_pred"] == "x" for r in first_kept)
    before, kept = kept, sorted((r["doc_id"], r["text"]) for r in first_kept)
    assert kept == [x for x in before if x[1] and any(c.isalpha() for c in x[1])]

    before, kept = kept, step(1, kept)
    assert kept == [x for x in before if "scumbag" not in x[1]]

    before, kept = kept, step(2, kept)
    first: dict[str, int] = {}
    for i, x in before:
        first.setdefault(" ".join(x.replace("  ", " ").split(" ")), i)
    assert kept == [x for x in before if first[" ".join(x[1].replace("  ", " ").split(" "))] == x[0]]

    before, kept = kept, step(3, kept)
    sets, parent = {i: shingle_set(x) for i, x in before}, {i: i for i, _ in before}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert kept == [x for x in before if find(x[0]) == x[0]] and len(kept) < len(before)

    pieces = corpus_pipeline.packed(spark, docs_of(kept), folder).collect()
    covered, totals = defaultdict(int), {}
    for r in pieces:
        covered[r["doc_id"]] += r["length"]
        totals[r["doc_id"]] = r["doc_tokens"]
    assert covered.keys() == {i for i, _ in kept} and all(covered[i] == totals[i] * sum(j == i for j, _ in kept) for i in covered)


def test_run_is_the_stages_in_order_and_takes_empty_tables(spark, folder, tmp_path):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert 0 in ids and not ids & {*range(400, 603), 604, 606, 608, 609, 610}
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_held_out_labels_are_not_learned(spark, folder):
    held = {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = ({(r["doc_id"], round(r["score"], 9)) for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_without_learned_languages_texts_with_letters_stay(spark):
    rows = [(0, "the river", None), (1, "123 ... 4", None), (2, None, None), (3, "", None), (4, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4]
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 == 1)
    one = spark.createDataFrame([(held, "the river", "en")], docs.schema)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, one, "").collect()] == [held]
