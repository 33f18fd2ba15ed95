"""Leaves and dead ends taken off before rounds: same results, and what is written doesn't follow from the number of rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import axes, metrics, network
from thalweg.plans import iterate


@pytest.fixture
def shedding(monkeypatch):
    monkeypatch.setattr(iterate, "FEW", 8)


@pytest.fixture
def written(monkeypatch):
    """Rows of all tables written."""
    rows, plain = [], iterate.cut
    count = lambda df: (lambda out: rows.append(out.count()) or out)(plain(df))
    for module in (iterate, network):
        monkeypatch.setattr(module, "cut", count)
    return rows


def chains(spark):
    """Random trees, a chain into a cycle with leaves at both, and ids whose next is no id."""
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(max(0, k - 9), k)) if k % 50 else None, float(k)) for k in range(200)]
    rows += [(1001, 1002, 1.0), (1002, 1003, 1.0), (1003, 1001, 1.0), (1004, 1003, 1.0), (1005, 1004, 1.0), (1006, 1004, 1.0), (1007, 5000, 2.0), (1008, 1007, 3.0)]
    return spark.createDataFrame(rows, "id long, next long, c double")


def jumped(df, **kw):
    """What is carried into a cycle is of no meaning."""
    return {(r.id, r.root, r.c if r.root is not None else None) for r in iterate.jump(df, **kw).collect()}


def test_chains_are_the_same_without_leaves(spark, monkeypatch):
    df = chains(spark)
    kept = [jumped(df, carry={"c": "sum"}), jumped(df, stop=F.col("id") % 7 == 0, carry={"c": "max"})]
    sums = [{r.id: r.total for r in network.sum_upstream(df.select("id", "next"), df.select("id", F.col("c").alias("w")), how).collect()} for how in ("sum", "max")]
    steps, seeds = df.where("next is not null").select(F.col("id").alias("src"), F.col("next").alias("dst")), spark.createDataFrame([(190,), (1006,), (77,)], "node long")
    way = {r.node for r in iterate._along(seeds, steps).collect()}
    monkeypatch.setattr(iterate, "FEW", 8)
    assert [jumped(df, carry={"c": "sum"}), jumped(df, stop=F.col("id") % 7 == 0, carry={"c": "max"})] == kept
    assert [{r.id: r.total for r in network.sum_upstream(df.select("id", "next"), df.select("id", F.col("c").alias("w")), how).collect()} for how in ("sum", "max")] == sums
    assert {r.node for r in iterate._along(seeds, steps).collect()} == way
    assert sums[0][1006] is None and sums[0][1005] is None and sums[0][1007] == 5.0


@pytest.mark.parametrize("best", ["min", "max"])
def test_relax_is_the_same_without_dead_ends(spark, monkeypatch, best):
    rng = np.random.default_rng(11)
    rows = [(int(k // 2), int(k), float(rng.integers(1, 90)), float(k % 13)) for k in range(2, 300)] + [(int(k // 3), int(k), float(rng.integers(1, 90)), float(k % 17)) for k in range(6, 300, 7)]
    steps = spark.createDataFrame(rows, "src long, dst long, cost double, unit double")
    start = spark.createDataFrame([(1, 0.0), (200, 5.0), (31, 1.0)] if best == "min" else [(1, 0.0)], "node long, value double")
    both = steps.union(steps.select("dst", "src", "cost", "unit")) if best == "min" else steps
    for table in (steps, both):
        kept = {tuple(r) for r in iterate.relax(start, table, best, extra="unit", whole=True).collect()}
        with monkeypatch.context() as m:
            m.setattr(iterate, "FEW", 8)
            assert {tuple(r) for r in iterate.relax(start, table, best, extra="unit").collect()} == kept


def tree(spark, n):
    return spark.range(1, n).selectExpr("id - 1 fid", "id nodea", "bigint(floor(id / 2)) nodeb", "double(id % 23 + 1) length", "id % 61 cost")


@pytest.mark.parametrize("query", ["jump", "relax", "along", "spread"])
def test_what_is_written_is_a_multiple_of_the_links(spark, shedding, written, query):
    n = 4096
    links = tree(spark, n)
    if query == "jump":
        assert {r.fid: r.measure for r in network.measure_network(links).collect()}[n - 2] == sum(((n - 1) >> k) % 23 + 1 for k in range(1, 12))
    elif query == "relax":
        more = links.where("nodea % 7 = 6").selectExpr("fid + 10000 fid", "nodea", "bigint(floor(nodea / 3)) nodeb", "1.0D length", "cost")
        assert network.distance_to_outlet(links.union(more)).count() == n
    elif query == "along":
        seeds = spark.createDataFrame([(n - 1,)], "node long")
        assert iterate._along(seeds, links.selectExpr("nodea src", "nodeb dst")).count() == 13
    else:
        metrics.maximum_on_shortest_path(links, links.where("nodea % 500 = 3").select(F.col("nodea").alias("node"))).count()
    assert sum(written) < {"jump": 8, "relax": 10, "along": 5, "spread": 12}[query] * n


def test_hack_order_without_leaves(spark, monkeypatch):
    links = tree(spark, 100).drop("cost")
    kept = {tuple(r) for r in network.hack_order(links).collect()}
    monkeypatch.setattr(iterate, "FEW", 24)
    assert {tuple(r) for r in network.hack_order(links).collect()} == kept
    assert all(math.isfinite(r[-1]) for r in kept)


def test_connect_lines_by_brute_force(spark):
    """Lines of three vertices that share nodes, against all pairs; candidates don't follow from the lines in reach."""
    rng = np.random.default_rng(2)
    at = {k: (float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 60, (70, 2)))}
    rows = []
    for fid in range(60):
        a, b = (int(v) for v in rng.choice(70 if fid % 3 else 12, 2, replace=False))
        mid = tuple(float(v) for v in rng.integers(0, 60, 2))
        rows.append((fid, a, b, [(*p, None, None) for p in (at[a], mid, at[b])]))
    lines = spark.createDataFrame(rows, "fid long, nodea long, nodeb long, geom array<struct<x:double,y:double,z:double,m:double>>")
    want = {}
    for node in {n for r in rows for n in r[1:3]}:
        x, y = at[node]
        tried = []
        for fid, a, b, geom in rows:
            for i, (p, q) in enumerate(zip(geom, geom[1:])):
                dx, dy = q[0] - p[0], q[1] - p[1]
                t = max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                if node not in (a, b):
                    tried.append((round(math.hypot(p[0] + dx * t - x, p[1] + dy * t - y), 9), fid, i))
        if tried and min(tried)[0] <= 9:
            want[node] = min(tried)
    got = {r.nodea: (r.fid, r.geom) for r in axes.connect_lines(lines, 9.0).where("kind = 'connector'").collect()}
    assert {n: w[1] for n, w in want.items() if w[0] > 0} == {n: g[0] for n, g in got.items()}
    assert axes.connect_lines(lines.limit(1), 9.0).count() == 1 and axes.connect_lines(lines.limit(0), 9.0).count() == 0


def test_connect_lines_looks_at_few_lines(spark, monkeypatch):
    """300 lines within reach of each node."""
    segs = spark.range(300).selectExpr("id fid", "id * 2 + 1 nodea", "id * 2 + 2 nodeb", "array(struct(double(id) x, 0D y, double(null) z, double(null) m), struct(double(id) x, 9D y, double(null) z, double(null) m)) geom")
    seen, plain = [], axes.placed
    monkeypatch.setattr(axes, "placed", lambda df: seen.append(df.count()) or plain(df))
    assert axes.connect_lines(segs, 1000.0).where("kind = 'connector'").count() == 600
    assert sum(seen) < 100 * 600
