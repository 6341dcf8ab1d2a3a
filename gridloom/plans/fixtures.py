"""Derived tables for the registered queries.

Each is one SQL text that Spark and DuckDB both run over the given tables, so
a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()

SQL = {
    "grid": "SELECT cast(floor(o_orderkey / 100) AS bigint) AS y, cast(o_orderkey % 100 AS bigint) AS x, o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS label FROM orders",
    "dem": "SELECT cast(floor(p_partkey / 20) AS bigint) AS y, cast(p_partkey % 20 AS bigint) AS x, cast(p_size AS double) AS value FROM part",
    "ms": "SELECT cast(floor(o_orderkey / 100) AS bigint) AS y, cast(o_orderkey % 100 AS bigint) AS x, b1, b2, b3, b4, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS label FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_quantity) AS b1, avg(l_extendedprice) / 1000 AS b2, avg(l_discount) * 100 AS b3, avg(l_tax) * 100 AS b4 FROM lineitem GROUP BY l_orderkey) m ON o_orderkey = l_orderkey",
    "ms_before": "SELECT cast(floor(l_orderkey / 100) AS bigint) AS y, cast(l_orderkey % 100 AS bigint) AS x, avg(l_quantity) AS b1, avg(l_extendedprice) / 1000 AS b2, avg(l_discount) * 100 AS b3, avg(l_tax) * 100 AS b4 FROM lineitem WHERE l_shipdate < timestamp '1998-01-01 00:00:00' GROUP BY l_orderkey",
    "ms_after": "SELECT cast(floor(l_orderkey / 100) AS bigint) AS y, cast(l_orderkey % 100 AS bigint) AS x, avg(l_quantity) AS b1, avg(l_extendedprice) / 1000 AS b2, avg(l_discount) * 100 AS b3, avg(l_tax) * 100 AS b4 FROM lineitem WHERE l_shipdate >= timestamp '1998-01-01 00:00:00' GROUP BY l_orderkey",
    "qa": "SELECT cast(floor(l_orderkey / 100) AS bigint) AS y, cast(l_orderkey % 100 AS bigint) AS x, cast(bit_or(cast(power(2, l_linenumber) AS bigint)) AS bigint) AS qa FROM lineitem GROUP BY l_orderkey",
    "spectra": "SELECT cast(floor(vec_id / 25) AS bigint) AS y, cast(vec_id % 25 AS bigint) AS x, cast(embedding AS {array}) AS spectrum, label FROM embeddings",
    "zones": "SELECT cast(n_nationkey AS bigint) AS zone, cast((n_nationkey % 5) * 20 AS double) AS x0, cast(floor(n_nationkey / 5) * 20 AS double) AS y0, cast((n_nationkey % 5) * 20 + 20 AS double) AS x1, cast(floor(n_nationkey / 5) * 20 + 20 AS double) AS y1, n_regionkey AS class FROM nation",
    "pts": "SELECT c_custkey AS id, ((c_custkey * 7919) % 10007) / 100.07 AS px, ((c_custkey * 104729) % 10009) / 100.09 AS py, c_acctbal AS z FROM customer",
    "pts2": "SELECT s_suppkey AS id, ((s_suppkey * 6007) % 10007) / 100.07 AS px, ((s_suppkey * 50021) % 10009) / 100.09 AS py, s_acctbal AS z FROM supplier",
    "truth": "SELECT p_partkey AS id, cast(p_size % 5 AS bigint) AS truth, cast((p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) % 5 AS bigint) AS pred FROM part",
}
#: How each engine names an array of doubles.
ARRAY = {"spark": "array<double>", "duckdb": "double[]"}


def doubles(text: str) -> str:
    """Decimal literals in divisions are doubles in both engines."""
    return text.replace("100.07", "cast(100.07 AS double)").replace("100.09", "cast(100.09 AS double)")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        if t in SQL[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(doubles(SQL[name]).replace("{array}", ARRAY["spark"]))


def ctes(*names: str) -> str:
    """``WITH`` clause text of the named tables, for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({doubles(SQL[n]).replace('{array}', ARRAY['duckdb'])})" for n in names)
