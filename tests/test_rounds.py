"""Rounds of operators that follow graphs and grids: logarithmic where the shape is deep; axes, connected lines, pits and statistics."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.statistics import f_survival, log_gamma
from thalweg.operators import axes, metrics, network, referencing, terrain
from thalweg.plans import iterate, spatial_join


@pytest.fixture
def cuts(monkeypatch):
    made, plain = [], iterate.cut
    for module in (iterate, network, terrain):
        monkeypatch.setattr(module, "cut", lambda df: made.append(1) or plain(df))
    return made


def comb(spark, n):
    """A stem of n links down to node 0, with a tributary into every node of it."""
    stem = spark.range(1, n + 1).selectExpr("id fid", "id nodea", "id - 1 nodeb", "1.0D length")
    return stem.union(spark.range(1, n + 1).selectExpr("id + 1000000 fid", "id + 1000000 nodea", "id nodeb", "2.5D length"))


@pytest.mark.parametrize("n", [40, 3000])
def test_comb_of_confluences(spark, cuts, n):
    links = comb(spark, n)
    got = {r.fid: r.measure for r in network.measure_network(links).collect()}
    assert got[n] == n - 1 and got[1_000_000 + n] == n and len(cuts) < 20
    cuts.clear()
    orders = {r.fid: r.strahler for r in network.strahler_order(links).collect()}
    # The topmost stem link has one tributary above it and no stem link.
    assert orders[n] == 1 and all(orders[k] == 2 for k in range(1, n)) and all(orders[1_000_000 + k] == 1 for k in range(1, n + 1)) and len(cuts) < 60
    cuts.clear()
    length = {r.fid: r.tucl for r in network.total_upstream_channel_length(links, 1.0).collect()}
    assert math.isclose(length[1], 3.5 * n) and math.isclose(length[n // 2], 3.5 * (n - n // 2 + 1)) and len(cuts) < 60
    hack = {r.fid: (r.hack, r.laxis) for r in network.hack_order(links).collect()}
    assert hack[1] == (1, n + 2.5) and hack[1_000_000 + n // 2] == (2, 2.5)


def test_strahler_of_random_trees(spark):
    rng = np.random.default_rng(7)
    for reach in (2, 9, 400):  # parents near or far: deep and shallow trees
        up = [0, *(int(max(0, k - rng.integers(1, reach + 1))) for k in range(1, 400))]
        links = spark.createDataFrame([(k, k, up[k], 1.0) for k in range(1, 400)], "fid long, nodea long, nodeb long, length double")
        want = {}
        for k in range(399, 0, -1):
            above = sorted((want[c] for c in range(k + 1, 400) if up[c] == k), reverse=True)
            want[k] = 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])
        assert {r.fid: r.strahler for r in network.strahler_order(links).collect()} == want
        assert {r.fid: r.strahler for r in network._tree_orders(links).collect()} == want


def brute_fill(z):
    w = np.full(z.shape, np.inf)
    for (i, j), v in np.ndenumerate(z):
        around = z[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
        if np.isnan(v) or around.size < 9 or np.isnan(around).any():
            w[i, j] = v
    while True:
        low = np.full(z.shape, np.inf)
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                s = np.full(z.shape, np.inf)
                s[max(0, -di) : z.shape[0] - max(0, di), max(0, -dj) : z.shape[1] - max(0, dj)] = np.nan_to_num(w, nan=np.inf)[max(0, di) : z.shape[0] - max(0, -di), max(0, dj) : z.shape[1] - max(0, -dj)]
                low = np.minimum(low, s)
        new = np.minimum(w, np.maximum(z, low))
        if np.array_equal(new, w, equal_nan=True):
            return w
        w = new


@pytest.mark.parametrize("levels", [3, 1000])
def test_fill_against_rounds_of_all_cells(spark, levels):
    rng = np.random.default_rng(levels)
    z = rng.integers(0, levels, (24, 31)).astype(float)
    z[rng.random(z.shape) < 0.01] = np.nan
    dem = spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z)], "row int, col int, value double")
    got = np.full(z.shape, np.nan)
    for r in terrain.fill_depressions(dem).collect():
        got[r.row, r.col] = np.nan if r.value is None else r.value
    assert np.array_equal(got, brute_fill(z), equal_nan=True)


def test_fill_of_a_long_valley(spark, cuts):
    """A closed valley of 1,000 cells with a pit in every second one, which spills at its far end only."""
    n = 1000
    floor = "case when col = 0 then 9 when col > {0} then 5 else 1 + col % 2 end".format(n)
    dem = spark.range(3 * (n + 2)).selectExpr("int(id div {0}) row".format(n + 2), "int(id % {0}) col".format(n + 2)).selectExpr("row", "col", f"double(case when row = 1 then {floor} else 9 end) value")
    got = {r.col: r.value for r in terrain.fill_depressions(dem).where("row = 1").collect()}
    assert all(got[c] == 5.0 for c in range(1, n + 1)) and len(cuts) < 120
    assert terrain.fill_depressions(dem.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "ring", "braid"])
def test_closure_of_long_ways(spark, cuts, shape):
    n = 600
    rows = [(k, k + 1) for k in range(n)] + [(n + 50, 20), (n + 60, n + 61)] * (shape != "ring") + [(n, 0)] * (shape == "ring") + [(k, k + 2) for k in range(0, 40, 5)] * (shape == "braid")
    if shape == "braid":
        rows = [r for r in rows if r[0] < 60 or r[0] > n]
    steps = spark.createDataFrame(rows, "src long, dst long")
    for seeds in ([3], [3, n + 60]):
        for way in (steps, steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))):
            edges = [tuple(r) for r in way.collect()]
            want = set(seeds)
            while more := {b for a, b in edges if a in want} - want:
                want |= more
            cuts.clear()
            assert {r.node for r in iterate.closure(spark.createDataFrame([(k,) for k in seeds], "node long"), way).collect()} == want
            assert shape == "braid" or len(cuts) < 45


def test_update_axis(spark):
    """A main stem 5-3-1-0 of hack 1, a tributary 4-3 of hack 2, and a braid 3-2-1 of hack 1 beside the stem."""
    rows = [(1, 5, 3, 1, 3.0, 2.0), (2, 3, 1, 1, 1.0, 2.0), (3, 1, 0, 1, 0.0, 1.0), (4, 4, 3, 2, 3.0, 1.5), (5, 3, 2, 1, 2.0, 1.5), (6, 2, 1, 1, 1.0, 1.5)]
    links = spark.createDataFrame(rows, "fid long, nodea long, nodeb long, hack int, measure double, length double")
    got = {(r.fid, r.source): (r.axis, r.laxis, r.main) for r in axes.update_axis(links).collect()}
    assert got == {(1, 5): (1, 5.0, 1), (2, 5): (1, 5.0, 1), (3, 5): (1, 5.0, 1), (5, 5): (2, 5.0, 0), (6, 5): (2, 5.0, 0), (4, 4): (3, 1.5, 1)}
    assert axes.update_axis(links.limit(0)).count() == 0


def test_connect_lines(spark):
    """Nodes beside a bent line of three vertices: inside both segments, at its vertex, at both ends, and too far."""
    v = lambda *p: [(float(x), float(y), None, None) for x, y in p]
    rows = [
        (1, 1, 2, v((0, 0), (10, 0), (10, 10))),
        (2, 3, 4, v((4, 1), (4, 50))),  # snaps inside the first segment
        (3, 5, 6, v((11, -1), (60, -60))),  # at the middle vertex
        (4, 7, 8, v((12, 6), (60, 6))),  # inside the second one
        (5, 9, 10, v((-1, 0), (-50, 0))),  # at the first vertex: joined only
        (6, 11, 12, v((10, 11), (10, 70))),  # at the last vertex: no piece after it
        (7, 13, 14, v((500, 500), (600, 600))),
    ]
    lines = spark.createDataFrame(rows, "fid long, nodea long, nodeb long, geom array<struct<x:double,y:double,z:double,m:double>>")
    got = axes.connect_lines(lines, 2.5).collect()
    pieces = sorted((r.part, r.nodea, r.nodeb, [(p.x, p.y) for p in r.geom]) for r in got if r.kind == "piece" and r.fid == 1)
    first = 15
    new = {r.nodea: r.nodeb for r in got if r.kind == "connector" and r.fid == 1}
    assert set(new) == {9, 3, 5, 7, 11} and [new[k] for k in (9, 3, 5, 7, 11)] == list(range(first, first + 5))
    assert [(a, b) for _, a, b, _ in pieces] == [(1, new[3]), (3, new[5]), (5, new[7]), (7, new[11])]
    assert [g for *_, g in pieces] == [[(0, 0), (4, 0)], [(4, 0), (10, 0)], [(10, 0), (10, 6)], [(10, 6), (10, 10)]]
    whole = {r.fid for r in got if r.kind == "line"}
    assert 7 in whole and 1 not in whole


def test_nearest_k(spark):
    rng = np.random.default_rng(1)
    p, q = rng.integers(0, 300, (80, 2)), np.vstack([rng.integers(0, 40, (25, 2)), rng.integers(0, 5000, (15, 2))])
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "fid long, x double, y double")
    segs = spark.createDataFrame([(i, *map(float, r), *map(float, r)) for i, r in enumerate(q)], "seg long, ax double, ay double, bx double, by_ double")
    for k in (1, 10, 100):
        want = {(i, j, n + 1) for i, a in enumerate(p) for n, (_, j) in enumerate(sorted((math.hypot(*map(float, a - b)), j) for j, b in enumerate(q))[:k])}
        assert {(r.fid, r.seg, r.rank) for r in spatial_join.nearest_k(points, segs, "fid", "seg", k).collect()} == want
    assert spatial_join.nearest_k(points, segs.limit(0), "fid", "seg", 3).count() == 0 and spatial_join.nearest_k(points.limit(0), segs, "fid", "seg", 3).count() == 0


def test_f_distribution(spark):
    """Critical values from tables of the F distribution; ln gamma against the standard library."""
    table = [(1, 10, 0.05, 4.9646), (5, 20, 0.05, 2.7109), (3, 12, 0.01, 5.9525), (2, 2, 0.05, 19.0), (10, 1000, 0.05, 1.8402), (4, 30, 0.025, 3.2499), (1, 1, 0.1, 39.8635), (60, 60, 0.01, 1.8363)]
    df = spark.createDataFrame([(float(a), float(b), p, x) for a, b, p, x in table], "a double, b double, p double, x double")
    assert all(abs(r.s - r.p) < 2e-5 for r in df.withColumn("s", f_survival(F.col("x"), F.col("a"), F.col("b"))).collect())
    xs = spark.createDataFrame([(x,) for x in (0.005, 0.5, 1.0, 2.5, 10.0, 333.3)], "x double")
    assert all(math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-11, abs_tol=1e-11) for r in xs.withColumn("g", log_gamma(F.col("x"))).collect())


def test_hubert_test(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.3, 25) for m in (0, 5, 1)])
    rows = [(1, k, float(k), float(v)) for k, v in enumerate(x)] + [(2, k, float(k), float(v)) for k, v in enumerate(rng.normal(0, 1, 60))]
    series = spark.createDataFrame(rows, "axis long, fid long, ord double, metric double")
    got = {r.axis: (r.segments, r.accepted) for r in metrics.hubert_test(series).collect()}
    assert got[1] == (3, True)
    assert got[2] == (1, False)
    flat = metrics.range_test(spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (1, 2, 2.0), (2, 1, 5.0)], "axis long, ago long, metric double")).collect()
    assert [(r.axis, r.ago, r.p, r.differs) for r in flat] == [(1, 1, None, False)]


def test_tables_of_past_rounds_are_deleted(spark):
    """What rounds leave in the shared folder doesn't grow with them, and results can still be read."""
    folder = spark.conf.get("spark.checkpoint.dir")

    def left(work):
        before = set(os.listdir(folder))
        found = work()
        return len(set(os.listdir(folder)) - before), found.count()

    for n in (5, 12):
        chain = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end next", "1.0D w")
        steps = spark.range(1, n).selectExpr("id - 1 src", "id dst", "1.0D cost")
        start = spark.range(1).selectExpr("id", "id node", "0.0D value")
        pairs = spark.range(1, n).selectExpr("id a", "id - 1 b")
        assert left(lambda: iterate.jump(chain, carry={"w": "sum"})) == (1, n)  # noqa: B023
        assert left(lambda: iterate.relax(start, steps, "min", contract=False)) == (2, n)  # noqa: B023
        assert left(lambda: iterate.components(pairs)) == (1, n)  # noqa: B023
        assert left(lambda: iterate.loops(chain.selectExpr("id", f"(id + 1) % {n} next"))) == (1, n)  # noqa: B023
        assert left(lambda: terrain.spread(steps, start)) == (2, n)  # noqa: B023
        assert left(lambda: network.sum_upstream(chain.select("id", "next"), chain.select("id", "w"))) == (1, n)  # noqa: B023
    plain = iterate.cut(start)
    iterate.drop(plain.select("id"))
    assert plain.count() == 1


def test_candidates_stay_few_where_segments_and_points_are_dense_or_far(spark):
    segs = spark.range(4000).selectExpr("id seg", "id * 37 % 1009 * 1D ax", "id * 91 % 1013 * 1D ay").selectExpr("*", "ax + 30 bx", "ay - 9 by_")
    points = spark.range(3000).selectExpr("id fid", "id * 53 % 1009 + if(id % 2 = 0, 0, 40000) + 0.5D x", "id * 29 % 1013 + 0.25D y")
    tried = spatial_join.candidates(points, segs, "seg").selectExpr("sum(size(segs)) n").first().n
    assert tried < 3000 * 60


def test_nearest_within_groups_far_from_the_origin(spark):
    segs = spark.createDataFrame([(1, 1, 3000000000.1), (1, 2, 3000000000.3), (2, 3, 3000000000.1)], "axis long, seg long, ax double").selectExpr("*", "0D ay", "ax bx", "0D by_")
    points = spark.createDataFrame([(7, 1, 3000000000.22), (8, 2, 3000000000.3), (9, 3, 0.0)], "fid long, axis long, x double").withColumn("y", F.lit(0.0))
    got = {(r.fid, r.seg) for r in spatial_join.nearest(points, segs, "fid", "seg", on=["axis"]).collect()}
    assert got == {(7, 2), (8, 3)}


def test_signs_go_down_a_long_raster_by_tiles(spark, monkeypatch):
    tables, cut = [], terrain.cut

    def counted(df):
        tables.append(1)
        assert len(tables) < 60, "rounds grow with the rows"
        return cut(df)

    monkeypatch.setattr(terrain, "cut", counted)
    distance = spark.range(4000).selectExpr("int(id div 2) row", "int(id % 2) col", "double(id div 2) value")
    segs = spark.createDataFrame([(1, 0, 0, 0, 1)], "fid long, r0 int, c0 int, r1 int, c1 int")
    got = terrain.signed_shortest_distance(distance, segs, 3.0).collect()
    assert len(got) == 4000 and all(r.value == -r.row for r in got if r.row), got[:5]


def test_tiles_spread_as_rounds_of_cells_do(spark, monkeypatch):
    cells = spark.createDataFrame([(r, c, (r * c) % 2) for r in range(24) for c in range(17) if (r * 7 + c * 5) % 4], "row int, col int, ws int")
    origins = cells.where("(row * 17 + col) % 37 = 3").select(terrain.grid.cell("row", "col").alias("id"), (F.col("row") % 3).cast("double").alias("value"))
    for same in (None, "ws"):
        want = {tuple(r) for r in terrain.spread(terrain.grid_steps(cells, same=same), origins).select("id", "dist", "value").collect()}
        for places in (1 << 17, 64):
            monkeypatch.setattr(terrain, "TILE", places)
            assert {tuple(r) for r in terrain.spread_tiles(cells, origins, same).collect()} == want


def test_polygons_on_dense_networks_are_held_against_few_places(spark):
    """300 boxes over 20,000 segments hold millions of vertices together; few may be the best."""
    segs = spark.range(20000).selectExpr("id seg", "double(id * 53 % 1009) ax", "double(id * 29 % 1013) ay", "id * 53 % 1009 + 5.5D bx", "id * 29 % 1013 + 3.5D by_", "1D am", "0D bm", "int(id % 9973 % 4) hack").withColumn("hack", F.when(F.col("hack") > 0, F.col("hack")))
    boxes = spark.range(300).selectExpr("id fid", "double(id * 71 % 1009) x", "double(id * 43 % 1013) y").selectExpr("*", "x - 90 minx", "y - 70 miny", "x + 60 maxx", "y + 80 maxy")
    ends = segs.selectExpr("ax vx", "ay vy", "hack p", "seg").union(segs.selectExpr("bx", "by_", "hack", "seg"))
    tried = referencing._in_box(boxes, ends)
    assert tried.count() < 300 * 100
    want = boxes.join(ends, F.expr("vx between minx and maxx and vy between miny and maxy")).groupBy("fid").agg(F.min_by("seg", F.struct("p", F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y")).alias("d"), "seg")).alias("axis"))
    got = referencing.locate_polygon_along_network(boxes, segs)
    assert {(r.fid, r.axis) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert referencing.locate_polygon_along_network(boxes, segs.limit(0)).count() == 0


def test_components_with_labels_that_many_have(spark, monkeypatch):
    pairs = spark.range(600).selectExpr("id a", "id + 3 b")
    want = {(k, k % 3) for k in range(603)}
    for many in (1 << 16, 20, 0):
        monkeypatch.setattr(iterate, "MANY", many)
        assert {tuple(r) for r in iterate.components(pairs).collect()} == want
