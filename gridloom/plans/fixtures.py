"""Views of the driver's tables as point sets; one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "p2": "SELECT o_orderkey AS id, o_custkey AS x, CAST(round(o_totalprice) AS BIGINT) AS y FROM {orders}",
    "p3": "SELECT event_id AS id, user_id AS x, CAST(round(value * 100) AS BIGINT) AS y, event_id % 997 AS z FROM {events}",
    "b2": "SELECT l_partkey AS x, l_suppkey AS y FROM {lineitem}",
    "c2": "SELECT c_custkey AS id, c_custkey AS x, CAST(round(c_acctbal) AS BIGINT) AS y FROM {customer}",
    "q2": "SELECT c_custkey AS qid, c_custkey AS x, CAST(round(c_acctbal * 40) AS BIGINT) AS y FROM {customer} WHERE c_custkey % 100 = 0",
    "box2": (
        "SELECT qid, CASE WHEN qid % 1000 = 0 THEN x + 20 ELSE x - 20 END AS lo_x, CASE WHEN qid % 1000 = 0 THEN x - 20 ELSE x + 20 END AS hi_x, y - 20000 AS lo_y, y + 20000 AS hi_y "
        "FROM (SELECT c_custkey AS qid, c_custkey AS x, CAST(round(c_acctbal * 40) AS BIGINT) AS y FROM {customer} WHERE c_custkey % 100 = 0) q"
    ),
    "del2": "SELECT l_partkey AS x, l_suppkey AS y FROM {lineitem} WHERE l_quantity < 10",
    "snap_a": "SELECT o_orderkey AS id, o_custkey AS x, CAST(round(o_totalprice) AS BIGINT) AS y FROM {orders} WHERE o_orderkey % 10 <> 0",
    "snap_b": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS x, CAST(round(o_totalprice) AS BIGINT) AS y FROM {orders} WHERE o_orderkey % 11 <> 0",
    "e64": "SELECT vec_id AS id, embedding AS v FROM {embeddings}",
}
TABLES = ("orders", "events", "lineitem", "customer", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query that may use the views."""
    made = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
    return f"WITH {made} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
