"""Deterministic rectangles over the driver's tables: heavy ties on y, skew on x, and degenerate points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS_SQL = """SELECT o_orderkey AS id, min_x, min_y, min_x + CAST(1 + o_custkey % 7 AS FLOAT) AS max_x, min_y + CAST(1 + o_custkey % 5 AS FLOAT) AS max_y FROM (
  SELECT o_orderkey, o_custkey, CAST(o_totalprice / 1000 AS FLOAT) AS min_x, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS FLOAT) AS min_y FROM orders)"""
EVENTS_SQL = """SELECT event_id AS id, CAST(value AS FLOAT) AS min_x, CAST(user_id AS FLOAT) AS min_y, CAST(value AS FLOAT) + CAST(1 + user_id % 3 AS FLOAT) AS max_x,
  CAST(user_id AS FLOAT) + CAST(1 AS FLOAT) AS max_y FROM events"""
PART_SQL = """SELECT p_partkey AS id, CAST(p_retailprice AS FLOAT) AS min_x, CAST(p_size AS FLOAT) AS min_y, CAST(p_retailprice AS FLOAT) AS max_x, CAST(p_size AS FLOAT) AS max_y FROM part"""


def rects_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("float")
    low = t.select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_totalprice") / 1000).cast("float").alias("min_x"), days.alias("min_y"))
    side = lambda m: (1 + F.col("o_custkey") % m).cast("float")
    return low.select("id", "min_x", "min_y", (F.col("min_x") + side(7)).alias("max_x"), (F.col("min_y") + side(5)).alias("max_y"))


def rects_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    low = t.select(F.col("event_id").alias("id"), "user_id", F.col("value").cast("float").alias("min_x"), F.col("user_id").cast("float").alias("min_y"))
    return low.select("id", "min_x", "min_y", (F.col("min_x") + (1 + F.col("user_id") % 3).cast("float")).alias("max_x"), (F.col("min_y") + F.lit(1.0).cast("float")).alias("max_y"))


def rects_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y = F.col("p_retailprice").cast("float"), F.col("p_size").cast("float")
    return t.select(F.col("p_partkey").alias("id"), x.alias("min_x"), y.alias("min_y"), x.alias("max_x"), y.alias("max_y"))


def tree_ctes(rects_sql: str, leaf_cap: int, internal_cap: int, levels: int = 4) -> str:
    """CTEs rects, e0.. and n0.. of a packed tree of at most ``levels`` levels, and entries, nodes over all of them."""
    out = [f"rects AS ({rects_sql})", "src0 AS (SELECT min_x, min_y, max_x, max_y, id AS child FROM rects)"]
    for k in range(levels):
        cap = leaf_cap if k == 0 else internal_cap
        base = "1" if k == 0 else f"(SELECT first_page FROM b{k})"
        out += [
            f"c{k} AS (SELECT count(*) AS n, (count(*) + {cap - 1}) // {cap} AS g FROM src{k})",
            f"s{k} AS (SELECT n, CASE WHEN g <= 1 THEN n ELSE ((g + CAST(ceil(sqrt(g)) AS BIGINT) - 1) // CAST(ceil(sqrt(g)) AS BIGINT)) * {cap} END AS w FROM c{k})",
            f"r{k} AS (SELECT a.*, s.n, s.w, row_number() OVER (ORDER BY min_x + max_x, child) - 1 AS rank_x FROM src{k} a, s{k} s)",
            f"t{k} AS (SELECT *, {'rank_x // w' if k == 0 else f'CASE WHEN n <= {cap} THEN 0 ELSE rank_x // w END'} AS slice FROM r{k})",
            f"u{k} AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY {'' if k == 0 else f'CASE WHEN n <= {cap} THEN child ELSE 0 END, '}min_y + max_y, rank_x) - 1 AS rank_y FROM t{k})",
            f"e{k} AS (SELECT CAST({k} AS INTEGER) AS level, CAST({base} + slice * (w // {cap}) + rank_y // {cap} AS BIGINT) AS page, CAST(rank_y % {cap} AS INTEGER) AS slot, {'true' if k == 0 else 'false'} AS is_leaf, min_x, min_y, max_x, max_y, child, slice, rank_x, rank_y FROM u{k})",
            f"n{k} AS (SELECT page, CAST({k} AS INTEGER) AS level, count(*) AS node_count, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM e{k} GROUP BY page)",
            f"b{k + 1} AS (SELECT {base} + count(*) AS first_page FROM n{k})",
            f"src{k + 1} AS (SELECT min_x, min_y, max_x, max_y, page AS child FROM n{k} WHERE (SELECT count(*) FROM n{k}) > 1)",
        ]
    out.append("entries AS (" + " UNION ALL ".join(f"SELECT level, page, slot, is_leaf, min_x, min_y, max_x, max_y, child FROM e{k}" for k in range(levels)) + ")")
    out.append("nodes AS (" + " UNION ALL ".join(f"SELECT page, level, node_count, min_x, min_y, max_x, max_y FROM n{k}" for k in range(levels)) + ")")
    return "WITH " + ",\n".join(out)
