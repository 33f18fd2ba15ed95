"""Spatial components and workflows, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.iterate import components, cut
from ..plans.spatial_join import nearest
from ..sources.derived import load, sql
from . import metrics, network, raster, terrain, vector


def smooth(lines: DataFrame, iterations: int = 1, offset: float = 0.25) -> DataFrame:
    """Lines with corners cut (Chaikin): each segment gives points at offset and 1 - offset; ends stay."""
    for _ in range(iterations):
        parts = g.segments(F.col("geom"))
        inner = F.flatten(F.transform(parts, lambda s: F.array(g.between(s["a"], s["b"], F.lit(offset)), g.between(s["a"], s["b"], F.lit(1 - offset)))))
        body = F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))
        lines = lines.withColumn("geom", F.when(F.size("geom") > 2, F.concat(F.slice("geom", 1, 1), body, F.array(F.element_at("geom", -1)))).otherwise(F.col("geom")))
    return lines


def densify(lines: DataFrame, interval: float) -> DataFrame:
    """Lines with vertices added so that none are farther apart than interval."""
    n = lambda s: F.greatest(F.ceil(g.distance(s["a"], s["b"]) / interval), F.lit(1))
    added = F.flatten(F.transform(g.segments(F.col("geom")), lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n(s) - 1), lambda i: g.between(s["a"], s["b"], i / n(s)))))
    return lines.withColumn("geom", F.concat(added, F.array(F.element_at("geom", -1))))


def disaggregate_network(network_lines: DataFrame, points: DataFrame, step: float) -> DataFrame:
    """(fid, axis, dgo, position): points of an axis (fid, axis, x, y) by the nearest station each step along the axis's line (fid, geom), with its distance."""
    stations = vector.points_along(network_lines, step).select(F.col("fid").alias("station_axis"), "distance", "x", "y")
    segs = stations.select(F.col("station_axis").alias("axis"), "distance", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    near = nearest(points.select(F.struct("fid", "axis").alias("key"), "axis", "x", "y"), segs, "key", "distance", on=["axis"])
    return near.select("key.fid", "key.axis", F.round(F.col("distance") / step).cast("long").alias("dgo"), F.col("distance").alias("position"))


def valley_bottom(relative: DataFrame, low: float, high: float, radius: float = 1.0, least: int = 40) -> DataFrame:
    """(row, col, part): cells with low < height <= high, closed by a disk, in connected parts of at least `least` cells; part is its smallest cell."""
    inside = relative.select("row", "col", F.coalesce(((F.col("value") > low) & (F.col("value") <= high)).cast("int"), F.lit(0)).alias("value"))
    closed = cut(raster.binary_closing(inside, radius).where("value = 1").select("row", "col", (F.col("row").cast("long") * terrain.grid.WIDTH + F.col("col")).alias("id")))
    near = terrain.grid.neighbours(closed, "id", diagonal=False).join(closed, ["row", "col"]).select(F.col("id").alias("a"), F.col("near").alias("b"))
    label = components(near)
    parts = closed.join(label, "id", "left").withColumn("part", F.coalesce("component", "id"))
    big = parts.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("part")
    return parts.join(big, "part").select("row", "col", "part")


def sequencing(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines (fid, ax, ay, bx, by_) with nodes identified, z of the nodes' cells, and downslope orientation."""
    linked, nodes = network.identify_network_nodes(lines)
    at = nodes.select(F.col("gid").alias("node"), F.floor("y").cast("int").alias("row"), F.floor("x").cast("int").alias("col")).join(cells, ["row", "col"], "left")
    return network.fix_link_orientation(linked, at.select("node", F.col("value").alias("z")))


def elevation_and_slope(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """(fid, z_begin, z_end, slope): heights at both ends of lines (ax, ay, bx, by_ in cell units) and their fall over the length."""
    end = lambda x, y, name: segments.select("fid", F.floor(y).cast("int").alias("row"), F.floor(x).cast("int").alias("col")).join(cells, ["row", "col"], "left").select("fid", F.col("value").alias(name))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    both = segments.join(end("ax", "ay", "z_begin"), "fid").join(end("bx", "by_", "z_end"), "fid")
    return both.select("fid", "z_begin", "z_end", ((F.col("z_begin") - F.col("z_end")) / F.when(length > 0, length)).alias("slope"))


def morphometry(verts: DataFrame, iterations: int = 1) -> DataFrame:
    """Bends of smoothed lines with their metrics."""
    return metrics.bends(vector.to_vertices(smooth(vector.to_lines(verts), iterations)).select("fid", "pos", "x", "y"))


def width_by_station(points: DataFrame, centerline: DataFrame) -> DataFrame:
    """(seg, n, width): mean distance, doubled, of border points to the centerline segment they are nearest to."""
    near = nearest(points.select("fid", "x", "y"), centerline, "fid", "seg")
    return near.groupBy("seg").agg(F.count("*").alias("n"), (F.avg("dist") * 2).alias("width"))


def segmentation(lines: DataFrame, step: float) -> DataFrame:
    """Lines cut in pieces of step, numbered along each."""
    return vector.segmentize(lines, step)


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs)


_lines = lambda s: s.selectExpr("fid", "fid * 7 % 40 + 0.3D ax", "fid * 11 % 40 + 0.6D ay", "fid * 13 % 40 + 0.4D bx", "fid * 17 % 40 + 0.1D by_")
_PAIRS = ", e AS (SELECT fid, pos, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_, count(*) OVER (PARTITION BY fid) AS n FROM verts WINDOW w AS (PARTITION BY fid ORDER BY pos))"
_SMOOTH = _PAIRS + """, q AS (SELECT fid, pos * 2 AS k, x + (bx - x) * 25e-2 AS x, y + (by_ - y) * 25e-2 AS y FROM e WHERE bx IS NOT NULL AND n > 2 AND pos > 1 UNION ALL SELECT fid, pos * 2 + 1, x + (bx - x) * 75e-2, y + (by_ - y) * 75e-2 FROM e WHERE bx IS NOT NULL AND n > 2 AND pos < n - 1
 UNION ALL SELECT fid, pos * 2, x, y FROM e WHERE n <= 2 OR pos = 1 OR pos = n), m AS (SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY k) AS INT) AS pos, x, y FROM q)"""
_q("smooth_lines", lambda v: vector.to_vertices(smooth(vector.to_lines(v))).select("fid", "pos", "x", "y"), _SMOOTH + " SELECT fid, pos, round(x, 4) AS x, round(y, 4) AS y FROM m", "verts")
QUERIES["densify_lines"] = lambda spark, sf_dir: _round(vector.to_vertices(densify(vector.to_lines(load(spark, sf_dir, "verts")), 4.0)).select("fid", "pos", "x", "y"), 8)
SQL["densify_lines"] = sql(_PAIRS + """, d AS (SELECT *, CASE WHEN bx IS NULL THEN 1 ELSE greatest(1, CAST(ceil(sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) / 4) AS BIGINT)) END AS parts FROM e), u AS (SELECT *, unnest(generate_series(0, parts - 1)) AS i FROM d)
 SELECT fid, CAST(row_number() OVER (PARTITION BY fid ORDER BY pos, i) AS INT) AS pos, round(CASE WHEN bx IS NULL THEN x ELSE x + (bx - x) * (i / parts) END, 8) AS x, round(CASE WHEN bx IS NULL THEN y ELSE y + (by_ - y) * (i / parts) END, 8) AS y FROM u""", "verts")
_q("disaggregate_network", lambda v: disaggregate_network(vector.to_lines(v), v.selectExpr("pos + fid * 100000L fid", "fid axis", "x + 3 x", "y + 2 y"), 100.0), vector._CUM + """, k AS (SELECT s.*, unnest(generate_series(CAST(ceil(start / 100) AS BIGINT), CAST(ceil((start + len) / 100) AS BIGINT) - 1)) AS k FROM s), st AS (SELECT fid AS axis, k, x + (nx - x) * (k * 100 - start) / len AS sx, y + (ny - y) * (k * 100 - start) / len AS sy FROM k),
 d AS (SELECT v.pos + v.fid * 100000 AS fid, v.fid AS axis, st.k, sqrt(pow(v.x + 3 - sx, 2) + pow(v.y + 2 - sy, 2)) AS dist FROM verts v JOIN st ON st.axis = v.fid) SELECT fid, axis, k AS dgo, k * 100e0 AS position FROM d QUALIFY row_number() OVER (PARTITION BY fid ORDER BY dist, k) = 1""", "verts")
_q("valley_bottom", lambda d: valley_bottom(terrain.relative_dem(d, d.where(terrain._ON).select("row", "col")), -60, 60), None, "dem")
_q("sequencing", lambda s, d: sequencing(_lines(s), d), None, "segs", "dem")
_q("elevation_and_slope", lambda s, d: elevation_and_slope(_lines(s), d), """, l AS (SELECT fid, fid * 7 % 40 + 3e-1 AS ax, fid * 11 % 40 + 6e-1 AS ay, fid * 13 % 40 + 4e-1 AS bx, fid * 17 % 40 + 1e-1 AS by_ FROM segs)
 SELECT l.fid, a.value AS z_begin, b.value AS z_end, round((a.value - b.value) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 4) AS slope FROM l LEFT JOIN dem a ON a.row = floor(ay) AND a.col = floor(ax) LEFT JOIN dem b ON b.row = floor(by_) AND b.col = floor(bx)""", "segs", "dem")
_q("morphometry", morphometry, _SMOOTH + ", b0 AS (SELECT * FROM m)" + metrics.BENDS_SQL.replace(", 5)", ", 4)"), "verts")
_q("width_by_station", lambda p, s: width_by_station(p, s.withColumnRenamed("fid", "seg")), vector._NEAR + " SELECT seg, count(*) AS n, round(avg(dist) * 2, 4) AS width FROM n GROUP BY seg", "points", "segs")
QUERIES["segmentation"] = lambda spark, sf_dir: _round(segmentation(vector.to_lines(load(spark, sf_dir, "verts")), 250.0))
SQL["segmentation"] = vector.SQL["segmentize"].replace("300", "250")
