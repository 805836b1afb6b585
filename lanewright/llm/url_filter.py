"""URL verdicts: rules first, then naive Bayes over host words and path tokens.

Host labels are split into words by a unigram Viterbi search. The unigram counts come from the words of the pages themselves
and are joined to the substrings of the distinct host labels, so no word list is ever gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, join_groups, least_hot, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest word that a host label is split into, and buckets of the naive Bayes model (so its size is fixed).
LONGEST, BUCKETS = 24, 1 << 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule host/path that fits the host or a domain above it and starts the path; and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def viterbi(label: str, words: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split of label; words: how often the substring at (start, length) occurs. Unknown words cost more the
    longer they are."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = words.get((start, end - start), 0)
            options.append((best[start][0] + math.log(total) - (math.log(n) if n else math.log(10) - (end - start) * math.log(10)), start))
        best.append(min(options))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def segmented(hosts: DataFrame, words: DataFrame, steps: Steps) -> DataFrame:
    """host, words: the words of all labels of each distinct host. words: word, n. A word may be in the spans of nearly all
    labels, and a label in nearly all hosts."""
    total = max(2, words.agg(F.sum("n").alias("n")).collect()[0]["n"] or 2)
    each = steps.write(hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("k", "label")), "labels")
    labels = steps.write(each.filter("label <> ''").groupBy("label").agg(F.count("*").alias("c")), "distinct")
    spans = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start"))
    spans = spans.select("label", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("start") + 1))).alias("size"))
    spans = spans.withColumn("word", F.col("label").substr(F.col("start"), F.col("size")))
    counts = steps.write(spans.groupBy("word").agg(F.count("*").alias("c")), "spans")
    rows = counts.agg(F.sum("c").alias("c")).collect()[0]["c"] or 0
    known = salted_join(spans, words, "word", counts.filter(F.col("c") > least_hot(rows)), rows, "label")
    known = known.groupBy("label").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))  # at most LONGEST for each letter

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [{(k["start"] - 1, k["size"]): k["n"] for k in (ks if ks is not None else ())} for ks in b["known"]]
            yield pd.DataFrame({"label": b["label"], "words": [viterbi(x, k, total) for x, k in zip(b["label"], found, strict=True)]})

    split_labels = steps.write(labels.join(known, "label", "left").select("label", "known").mapInPandas(split, "label string, words array<string>"), "split")
    rows = each.count()
    out = salted_join(each, split_labels, "label", labels.filter(F.col("c") > least_hot(rows)).select("label", "c"), rows, "host")
    return out.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "words"))), lambda x: x["words"])).alias("words"))


def word_counts(texts: DataFrame, col: str) -> DataFrame:
    """word, n over the letters a-z of all texts, without markup."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), "<[^>]*>", " ")), "[^a-z]+")
    return texts.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", text_col: str = "html", smooth: float = 1.0) -> DataFrame:
    """One row for each row of pages: id, host, path, rule (or null), verdict, block_score.

    The urls that a rule decides teach the naive Bayes model, which decides all others: block where its log odds are over 0,
    so allow if there is nothing to learn from. Null urls and urls without :// have an empty host and path. Repeated rows
    are judged alike. An empty table gives no rows. Other columns are ignored. Words of more than LONGEST letters are not known,
    and what is not known is split into runs of at most LONGEST letters, in hosts of any length.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    steps = Steps(pages.sparkSession, "urls")
    hosts = steps.write(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    words = segmented(hosts, steps.write(word_counts(pages, text_col), "words"), steps)
    # Hosts without labels have no words; one host may have a third of all rows.
    hosts = hosts.join(words, "host", "left")
    joined = join_groups(rows, hosts, ["host"], "n", rows.count(), steps)
    tokens = F.concat(
        F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(F.filter(F.split(F.lower("path"), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("p:"), F.regexp_replace(w, "[0-9]+", "0"))))
    joined = joined.withColumn("buckets", F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")))
    joined = steps.write(joined.select("id", "host", "path", "rule", "ruled", "buckets"), "joined")
    steps.drop("hosts", "words", "labels", "distinct", "spans", "split", "groups")
    learn = joined.filter(F.col("ruled").isNotNull())
    counts, docs = np.zeros((2, BUCKETS)), np.zeros(2)
    which = {"allow": 0, "block": 1}
    for r in learn.groupBy("ruled").agg(F.count("*").alias("n")).collect():
        docs[which[r["ruled"]]] = r["n"]
    for r in learn.select("ruled", F.explode("buckets").alias("b")).groupBy("ruled", "b").agg(F.count("*").alias("n")).collect():  # at most 2 * BUCKETS rows
        counts[which[r["ruled"]], r["b"]] = r["n"]
    # Smoothed over what occurs, not over all buckets: else the sizes of the two classes would speak through every common token.
    logs = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * max(1, np.count_nonzero(counts.sum(0)))))
    odds = np.where(counts.sum(0) > 0, logs[1] - logs[0], 0.0) if docs.all() else np.zeros(BUCKETS)
    prior = math.log(docs[1] / docs[0]) if docs.all() else (1.0 if docs[1] else -1.0)

    @F.pandas_udf("double")
    def score(buckets: pd.Series) -> pd.Series:
        return buckets.map(lambda b: prior + float(odds[b].sum()))

    out = joined.withColumn("block_score", score("buckets"))
    method = F.when(F.col("block_score") > 0, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_score")
