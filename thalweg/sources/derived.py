"""Networks, profiles, points, polygons and grids derived from the star-schema tables.

Each is one SELECT that Spark and DuckDB read alike; `{table}` names a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

INPUTS = {
    # A tree of links: node k flows to k div 2; node 0 is the outlet.
    "links": "SELECT o_orderkey AS fid, o_orderkey + 1 AS nodea, CAST(floor((o_orderkey + 1) / 2) AS BIGINT) AS nodeb, o_totalprice / 1000 AS length, o_orderkey % 4 AS category FROM {orders}",
    # The tree with further links from every seventh node to a third of its number.
    "links_dag": "SELECT o_orderkey AS fid, o_orderkey + 1 AS nodea, CAST(floor((o_orderkey + 1) / 2) AS BIGINT) AS nodeb, o_totalprice / 1000 AS length FROM {orders}"
    " UNION ALL SELECT o_orderkey + 10000000 AS fid, o_orderkey + 1 AS nodea, CAST(floor((o_orderkey + 1) / 3) AS BIGINT) AS nodeb, o_totalprice / 500 AS length FROM {orders} WHERE o_orderkey % 7 = 6",
    # The tree with a few links back upstream.
    "links_cycle": "SELECT o_orderkey AS fid, o_orderkey + 1 AS nodea, CAST(floor((o_orderkey + 1) / 2) AS BIGINT) AS nodeb, 1e0 AS length FROM {orders}"
    " UNION ALL SELECT o_orderkey + 10000000 AS fid, CAST(floor((o_orderkey + 1) / 8) AS BIGINT) AS nodea, o_orderkey + 1 AS nodeb, 1e0 AS length FROM {orders} WHERE o_orderkey % 997 = 100",
    # Chains: numbers that are no multiple of 5 flow to the next; multiples end a chain of one category.
    "chains": "SELECT o_orderkey AS fid, o_orderkey AS nodea, o_orderkey + 1 AS nodeb, o_totalprice / 1000 AS length, CAST(floor(o_orderkey / 40) AS BIGINT) % 3 AS category FROM {orders} WHERE o_orderkey % 20 <> 19",
    # Two-vertex lines with coordinates.
    "lines": "SELECT o_orderkey AS fid, (o_orderkey * 37 % 1000) * 1e0 AS ax, (o_orderkey * 91 % 1000) * 1e0 AS ay, (o_orderkey * 53 % 1000) * 1e0 AS bx, (o_orderkey * 29 % 1000) * 1e0 AS by_ FROM {orders}",
    "basins": "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN NULL ELSE CAST(floor((o_orderkey - 1) / 3) AS BIGINT) END AS downstream, o_orderkey % 1000 = 77 AS is_selected FROM {orders}",
    # Vertices of lines: one line for each user.
    "verts": "SELECT user_id AS fid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10e0 AS x, round(value, 2) AS y, (event_id * 37 % 1000) / 10e0 AS z FROM {events}",
    "points": "SELECT c_custkey AS fid, (c_custkey * 37 % 1009) * 1e0 AS x, (c_custkey * 91 % 1013) * 1e0 AS y, c_nationkey AS grp, round(c_acctbal, 2) AS w FROM {customer}",
    # Reference segments with a measure that falls from the first vertex to the second.
    "segs": "SELECT s_suppkey AS fid, (s_suppkey * 53 % 1009) * 1e0 AS ax, (s_suppkey * 29 % 1013) * 1e0 AS ay, (s_suppkey * 53 % 1009) + (s_suppkey % 7) * 10e0 + 5 AS bx, (s_suppkey * 29 % 1013) + (s_suppkey % 5) * 10e0 - 17 AS by_,"
    " s_suppkey * 3e0 + 100 AS am, s_suppkey * 3e0 AS bm, s_nationkey % 4 + 1 AS hack FROM {supplier}",
    # Diamonds of different size.
    "quads": "SELECT s_suppkey AS fid, (s_suppkey * 71 % 1009) + 37e-2 AS cx, (s_suppkey * 43 % 1013) + 41e-2 AS cy, 15e0 + s_suppkey % 9 * 5 AS rx, 10e0 + s_suppkey % 4 * 10 AS ry, s_nationkey % 3 AS kind FROM {supplier}",
    # A grid 50 cells wide with flats, and a second band.
    "dem": "SELECT CAST(floor(p_partkey / 50) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_partkey % 97 = 5 THEN NULL ELSE CAST(p_partkey * 7919 % 211 AS DOUBLE) END AS value FROM {part}",
    "dem2": "SELECT CAST(floor(p_partkey / 50) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_partkey % 89 = 3 THEN NULL ELSE CAST(p_partkey * 6007 % 197 AS DOUBLE) END AS value FROM {part}",
    # D8 codes that never form a loop: east, south-east, south or none.
    "flow": "SELECT CAST(floor(p_partkey / 50) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_partkey % 83 = 7 THEN 0 WHEN p_partkey % 131 = 9 THEN -1 WHEN p_partkey * 31 % 7 < 3 THEN 4 WHEN p_partkey * 31 % 7 < 5 THEN 8 ELSE 16 END AS d8, CAST(p_partkey * 13 % 50 AS DOUBLE) AS w FROM {part}",
}


#: Tables of cells: a few bytes of a file are a row, so that Spark would broadcast millions of them through the driver.
GRIDS = {"dem", "dem2", "flow"}


def tables(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", INPUTS[name]))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.sql(INPUTS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(name)})
    return rows.hint("merge") if name in GRIDS else rows


def sql(main: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL: the inputs named as common table expressions, then main (further ones may lead it, after a comma)."""
    parts = ", ".join(f"{n} AS ({INPUTS[n].format(**{t: t for t in tables(n)})})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{main}"
