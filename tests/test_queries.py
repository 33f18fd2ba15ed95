"""Every registered query against its SQL on the smallest tables; the others by properties and hand-made cases."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thalweg.operators import metrics, network, terrain, vector
from thalweg.operators import spatial as entry_spatial

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "supplier", "part", "events")
data = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
OWN = {n: f for g in entry.GROUPS for n, f in g.QUERIES.items()}
ORACLES = {n: s for g in entry.GROUPS for n, s in g.SQL.items()}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 4) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v


@data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = OWN[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=str)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())


@data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def tree(spark):
    return spark.createDataFrame([(1, 1, 0, 1.0), (2, 2, 1, 1.0), (3, 3, 1, 2.0), (4, 4, 2, 1.0), (5, 5, 2, 3.0)], "fid long, nodea long, nodeb long, length double")


def test_strahler(spark):
    got = {r.fid: r.strahler for r in network.strahler_order(tree(spark)).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1}


def test_hack(spark):
    got = {r.fid: (r.axis, r.hack, r.laxis) for r in network.hack_order(tree(spark)).collect()}
    assert got == {1: (5, 1, 5.0), 2: (5, 1, 5.0), 5: (5, 1, 5.0), 3: (3, 2, 2.0), 4: (4, 2, 1.0)}


def test_cycles(spark):
    links = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 4), (5, 5, 5), (6, 6, 7)], "fid long, nodea long, nodeb long").withColumn("length", F.lit(1.0))
    assert {r.fid for r in network.select_graph_cycle(links).collect()} == {1, 2, 3, 5}
    fixed = network.fix_network_cycles(links.where("fid <> 5"))
    assert network.select_graph_cycle(fixed.drop("fixed")).count() == 0


def test_segmentation():
    rng = np.random.default_rng(5)

    def brute(x, kmax):
        """All numbers of segments by plain recursion over their starts."""
        n = len(x)
        err = {(i, j): float(((x[i:j] - x[i:j].mean()) ** 2).sum()) for i in range(n) for j in range(i + 1, n + 1)}
        best = {(1, j): (err[(0, j)], [0]) for j in range(1, n + 1)}
        for k in range(2, min(kmax + 1, n) + 1):
            for j in range(k, n + 1):
                best[(k, j)] = min((best[(k - 1, i)][0] + err[(i, j)], [*best[(k - 1, i)][1], i]) for i in range(k - 1, j))
        score = lambda k: n * np.log(max(best[(k, n)][0], 1e-12) / (n - 1)) + 2 * k * np.log(n)
        return best[(min((k for k in range(1, min(kmax + 1, n) + 1)), key=score), n)][1]

    for sizes in (((0, 20), (5, 15), (1, 25)), ((0, 12),), ((2, 7), (4, 9), (0, 5), (3, 11))):
        x = np.concatenate([rng.normal(m, 0.3, n) for m, n in sizes])
        assert metrics.segment_breaks(x, 8) == brute(x, 8)
    assert metrics.segment_breaks(np.array([1.0]), 1) == [0]


def test_fill_and_distance(spark):
    z = np.array([[9, 9, 9, 9, 9], [9, 5, 3, 6, 9], [9, 4, 1, 7, 9], [9, 8, 8, 5, 9], [9, 9, 9, 2, 9]], float)
    dem = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(5) for j in range(5)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in terrain.fill_depressions(dem).collect()}
    assert got[(2, 2)] == 5.0 and got[(1, 1)] == 5.0 and got[(3, 3)] == 5.0 and got[(1, 3)] == 6.0 and got[(4, 3)] == 2.0
    far = {(r.row, r.col): r.value for r in terrain.shortest_distance(dem, spark.createDataFrame([(0, 0)], "row int, col int")).collect()}
    assert abs(far[(2, 1)] - (1 + 2**0.5)) < 1e-6 and abs(far[(4, 4)] - 4 * 2**0.5) < 1e-6


def test_samples_keep_distance(spark):
    ring = [(0.0, 0.0), (60.0, 0.0), (60.0, 40.0), (0.0, 40.0), (0.0, 0.0)]
    square = spark.createDataFrame([(1, [[(x, y, None, None) for x, y in ring]])], "fid long, rings array<array<struct<x:double,y:double,z:double,m:double>>>")
    p = [(r.x, r.y) for r in vector.poisson_disc_samples(square, 6.0).collect()]
    assert len(p) > 15 and all(math.dist(a, b) >= 6.0 for i, a in enumerate(p) for b in p[i + 1 :])


def test_empty_inputs(spark):
    none = tree(spark).limit(0)
    assert network.network_nodes(none).count() == 0 and network.strahler_order(none).count() == 0 and network.select_graph_cycle(none).count() == 0


def test_rings(spark):
    ring = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 8, 9), (5, 9, 10), (6, 10, 11)], "fid long, nodea long, nodeb long").withColumn("length", F.lit(1.0))
    got = {(r.nodea, r.nodeb, r.n_links) for r in network.aggregate_stream_segments(ring).where("nodea is not null and gid > 3").collect()}
    assert got == {(8, 11, 3)}
    orders = {r.fid: r.strahler for r in network.strahler_order(ring).collect()}
    assert orders == {1: None, 2: None, 3: None, 4: 1, 5: 1, 6: 1}
    with pytest.raises(ValueError, match="cycle"):
        network.measure_network(ring.union(spark.createDataFrame([(7, 3, 11, 1.0)], ring.schema))).count()
    loop = spark.createDataFrame([(0, 0, 4), (0, 1, 64), (1, 0, 4), (1, 1, 0)], "row int, col int, d8 int")
    assert terrain.flow_accumulation(loop).count() >= 0


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from thalweg.plans import iterate

    n, cuts = 3000, []
    links = spark.range(1, n + 1).selectExpr("id fid", "id nodea", "id - 1 nodeb", "1.0D length")
    links = links.union(spark.createDataFrame([(n + 1, n + 7, n // 2, 5.0)], "fid long, nodea long, nodeb long, length double"))
    plain = iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda df: cuts.append(1) or plain(df))
    monkeypatch.setattr(network, "cut", lambda df: cuts.append(1) or plain(df))
    got = {r.fid: r.measure for r in network.measure_network(links).collect()}
    assert got[n] == n - 1 and got[1] == 0 and got[n + 1] == n // 2
    orders = {r.fid: r.strahler for r in network.strahler_order(links).collect()}
    assert orders[n] == 1 and orders[1] == 2 and orders[n // 2 + 1] == 1 and orders[n // 2] == 2
    assert len(cuts) < 120


def test_scratch_needs_a_shared_folder_on_clusters():
    from types import SimpleNamespace

    from thalweg.plans import iterate

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        iterate.cut(SimpleNamespace(sparkSession=session))


def test_areas_at_a_limit_far_from_the_origin_stay(spark):
    quads = spark.createDataFrame([(k, k * 71 % 1009 + 0.37, k * 43 % 1013 + 0.41, 25.0, 30.0, 1) for k in range(400)], "fid long, cx double, cy double, rx double, ry double, kind int")
    assert vector.remove_small_objects(vector.diamonds(quads), "kind", 1, 1500.0, 10.0).count() == 400


def test_stations_of_axes_with_large_numbers(spark):
    verts = spark.createDataFrame([(axis, pos, pos * 10.0, float(pos * 7919 % 97)) for axis in (0, 90001) for pos in range(1, 60)], "fid long, pos int, x double, y double")
    lines = vector.to_lines(verts)
    points = verts.selectExpr("pos + fid * 100 fid", "fid axis", "x + 3.00001D x", "y + 2 y")
    got = {(r.axis, r.fid % 100): r.position for r in entry_spatial.disaggregate_network(lines, points, 30.0).collect()}
    assert all(got[90001, (90001 * 100 + p) % 100] == got[0, p] for p in range(1, 60))


def test_points_in_polygon_with_holes_and_copies(spark):
    ring = lambda a, b: [(a, a, None, None), (b, a, None, None), (b, b, None, None), (a, b, None, None), (a, a, None, None)]
    polygons = spark.createDataFrame([(1, [ring(0.5, 40.5), ring(10.5, 20.5)]), (2, [ring(100.5, 101.5)])], f"fid long, rings array<array<{vector.g.VERTEX}>>")
    points = spark.range(2500).selectExpr("id % 50 * 1D x", "id div 50 * 1D y").union(spark.range(5).selectExpr("3D x", "3D y"))
    assert {(r.fid, r.n) for r in vector.points_in_polygon(polygons, points).collect()} == {(1, 1600 - 100 + 5), (2, 0)}


def test_midpoint_of_a_long_line(spark):
    line = spark.range(6001).selectExpr("1L fid", "int(id) pos", "id * 1D x", "0D y")
    assert vector.line_midpoints(vector.to_lines(line)).first()[1:] == (3000.0, 0.0)
    assert vector.to_vertices(vector.set_m(vector.to_lines(line), F.lit(5.0))).where("m <> x + 5").count() == 0
