"""Exact duplicates against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to one row for each digest, the digests
that the index does not have yet are found by a sort-merge anti-join on its buckets, and these are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Steps, join_groups


def folded(text_col: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A table `name` of (keep_id, batch, digest), bucketed and sorted by digest. It is made with the first batch, with one
    bucket for each DIGESTS of its rows; an index written by an earlier session is opened by its path and number of buckets."""

    #: Digests in a bucket of a new index, and the least number of buckets.
    DIGESTS, LEAST = 4_000_000, 32

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if buckets:
            self._open()

    def _open(self) -> None:
        at = f"LOCATION '{self.path}'" if self.path else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (keep_id BIGINT, batch BIGINT, digest STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {at}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame, batch: int, total: int) -> None:
        """Adds the rows (digest, keep_id) whose digest is new. The digests must differ from each other; total: rows of the
        batch. Rows are dealt by digest as the buckets are, so each task writes one file."""
        if not self.buckets:
            self.buckets = max(self.LEAST, -(-total // self.DIGESTS))
            self._open()
        digests = digests.repartition(self.buckets, "digest")
        new = digests.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new.select("keep_id", F.lit(batch).cast("long").alias("batch"), "digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Removes the table, with its files if the table holds them itself."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: int = 0) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size (rows of docs with that text), kept, text_sha256.

    Texts are equal when they are identical after each run of white space became one space; null counts as empty. The row with
    the smallest id stays, unless an earlier batch of the index has the text: then its id is keep_id and none stays. Repeated
    rows with one id stay or go together. An empty table gives no rows. Other columns are ignored. Ids must not be null. The
    result does not read the index again, which may be dropped.
    """
    steps = Steps(docs.sparkSession, "exact")
    rows = steps.write(docs.select(F.col(id_col).alias("id"), F.sha2(folded(text_col), 256).alias("digest")), "digests")
    total = rows.count()
    groups = steps.write(rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "sizes")
    index.append(groups.select("digest", "keep_id"), batch, total)
    sizes = groups.drop("keep_id").repartition(index.buckets, "digest")
    merged = sizes.hint("merge").join(index.rows().select("digest", "keep_id", "batch").hint("merge"), "digest")
    out = join_groups(rows, merged, ["digest"], "group_size", total, steps)
    steps.drop("sizes")
    kept = (F.col("id") == F.col("keep_id")) & (F.col("batch") == batch)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
