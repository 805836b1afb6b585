"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    flat = [tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(flat, key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert rows_of(got.columns, map(tuple, got.collect())) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert os.path.exists(SF)
    found = entry.entry(spark).collect()
    assert found and all(r["residual"] == 0 for r in found)
