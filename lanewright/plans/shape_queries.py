"""Registered queries of records by shape: orders as nested records of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from .queries import Q, SQL


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text: null parts are left out of a record, so there are shapes of several kinds."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    inner = F.struct(F.col("o_orderpriority").alias("level"), F.when(key % 3 == 0, F.array((cust % 7 - 3), cust)).alias("pair"))
    text = F.to_json(F.struct(key.alias("key"), F.when(cust % 4 > 0, F.col("o_orderstatus")).alias("state"), F.when(key % 2 == 0, inner).alias("more"), (cust % 5 == 0).alias("fifth"), F.array(F.struct((key % 10).alias("k"))).alias("list")))
    return o.select(key.alias("key"), text.alias("text"))


_RECORDS = """WITH r AS (SELECT o_orderkey AS key, o_custkey % 4 > 0 AS a, o_orderkey % 2 = 0 AS b, o_orderkey % 3 = 0 AS c, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS cust FROM orders),
x AS (SELECT key, '{"key":i,' || CASE WHEN a THEN '"state":s,' ELSE '' END || CASE WHEN b THEN '"more":{"level":s' || CASE WHEN c THEN ',"pair":a' ELSE '' END || '},' ELSE '' END || '"fifth":b,"list":[{"k":i}]}' AS shape,
'{"key":' || key || ',' || CASE WHEN a THEN '"state":"' || st || '",' ELSE '' END || CASE WHEN b THEN '"more":{"level":"' || pr || '"' || CASE WHEN c THEN ',"pair":[' || (cust % 7 - 3) || ',' || cust || ']' ELSE '' END || '},' ELSE '' END || '"fifth":' || (cust % 5 = 0) || ',"list":[{"k":' || (key % 10) || '}]}' AS text,
CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN CASE WHEN c THEN 2 ELSE 1 END ELSE 0 END + 3 AS leaves FROM r),
t AS (SELECT row_number() OVER (ORDER BY min(key)) - 1 AS shape_id, shape, count(*) AS uses FROM x GROUP BY shape)"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shred = shapes.shredded(_records(spark, sf_dir), "text")
    table = shapes.shape_table(shred, "key")
    return shapes.by_shape(shred, table, ["key"]), table


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)[1].select("shape_id", "shape", "uses")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)[0].select("key", "shape_id", F.size("leaves").cast("long").alias("leaves"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, table = _both(spark, sf_dir)
    return shapes.assembled(shapes.read_rows(shapes.row_ids(rows, table, ["key"]), table, ["key"]), table, ["key"], "text")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of rows without texts of any length: their places and values are simple to state."""
    rows, table = _both(spark, sf_dir)
    return shapes.row_ids(rows, table, ["key"]).select("key", F.concat_ws(" ", shapes.read_numbers(F.col("ids")).cast("array<string>")).alias("numbers"))


Q["record_shapes"], SQL["record_shapes"] = _table, _RECORDS + " SELECT * FROM t"
Q["record_rows"], SQL["record_rows"] = _rows, _RECORDS + " SELECT key, shape_id, leaves::BIGINT AS leaves FROM x JOIN t USING (shape)"
Q["records_read"], SQL["records_read"] = _read, _RECORDS + " SELECT key, text FROM x"
_text = lambda s: f"len({s}) || ' ' || (SELECT string_agg(ord(c), ' ' ORDER BY k) FROM (SELECT unnest(string_split({s}, '')) AS c, generate_subscripts(string_split({s}, ''), 1) AS k))"
Q["record_numbers"], SQL["record_numbers"] = _ids, _RECORDS + f""", z AS (SELECT r.*, shape_id FROM r JOIN x USING (key) JOIN t USING (shape)),
s AS (SELECT DISTINCT st AS w FROM r UNION SELECT DISTINCT pr FROM r), w AS (SELECT w, {_text("w")} AS n FROM s)
SELECT key, shape_id || ' ' || 2 * key || CASE WHEN a THEN ' ' || ws.n ELSE '' END || CASE WHEN b THEN ' ' || wp.n || CASE WHEN c THEN ' 2 ' || CASE WHEN cust % 7 < 3 THEN 5 - 2 * (cust % 7) ELSE 2 * (cust % 7 - 3) END || ' ' || 2 * cust ELSE '' END ELSE '' END || ' ' || (cust % 5 = 0)::INT || ' ' || 2 * (key % 10) AS numbers
FROM z JOIN w ws ON ws.w = st JOIN w wp ON wp.w = pr"""
