"""Linear referencing against segments with measures (seg, ax, ay, am, bx, by_, bm)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.geometry import cross
from ..plans.iterate import cut, jump
from ..plans.spatial_join import FAN, bucket, nearest
from ..sources.derived import load, sql
from .terrain import flow_accumulation, watershed
from .vector import _NEAR


def _side() -> Column:
    return F.signum(cross(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by_")))).cast("int")


def _m() -> Column:
    return F.col("am") + (F.col("bm") - F.col("am")) * F.col("t")


def locate_point_along_network(points: DataFrame, reference: DataFrame) -> DataFrame:
    """(fid, axis, locm, distance, side): measure and side of each point at the nearest reference segment, ties to the smaller key."""
    near = nearest(points.select("fid", "x", "y"), reference, "fid", "seg")
    return near.select("fid", F.col("seg").alias("axis"), _m().alias("locm"), F.col("dist").alias("distance"), _side().alias("side"))


def point_axis_transform(points: DataFrame, reference: DataFrame) -> DataFrame:
    """(fid, axis, rx, ry): coordinates along and across the nearest segment, left positive."""
    near = nearest(points.select("fid", "x", "y"), reference, "fid", "seg")
    return near.select("fid", F.col("seg").alias("axis"), _m().alias("rx"), (F.col("dist") * _side()).alias("ry"))


def axis_transform(verts: DataFrame, reference: DataFrame) -> DataFrame:
    """Vertices (fid, pos, x, y) with x, y along and across the nearest segment, and its axis."""
    keyed = verts.select(F.struct("fid", "pos").alias("key"), "x", "y")
    near = nearest(keyed, reference, "key", "seg")
    return near.select("key.fid", "key.pos", F.col("seg").alias("axis"), _m().alias("x"), (F.col("dist") * _side()).alias("y"))


def _in_box(polygons: DataFrame, places: DataFrame) -> DataFrame:
    """(polygons.*, places.*): of the places (vx, vy, p) in each polygon's box all that may be of the least p, and nearest to (x, y) of these.

    Places lie in cells of about four, and cells in cells FAN times as wide. Polygons go down these levels: a cell that the box
    holds whole has a place of the cell's least p no farther than its farthest corner, so cells that come after it stay out.
    What a polygon is held against thus doesn't follow from the number of places in its box.
    """
    n, wide, high = places.agg(F.count("*"), F.max("vx") - F.min("vx"), F.max("vy") - F.min("vy")).first()
    if not n:
        return polygons.crossJoin(places)
    side = max(wide, high)
    size = max(2 * math.sqrt(wide * high / n), 4 * side / n, side * 1e-9) or 1.0
    box = [f(f"{e}{c}").alias(f"{e}{c}") for c in "xy" for e, f in (("lo", F.min), ("hi", F.max))]
    held = places.withColumns({"cx": bucket(F.col("vx"), size), "cy": bucket(F.col("vy"), size)})
    cells = [cut(held.select("cx", "cy", F.struct("p").alias("top"), *(F.col(f"v{c}").alias(f"{e}{c}") for c in "xy" for e in ("lo", "hi"))).groupBy("cx", "cy").agg(F.min("top").alias("top"), *box))]
    for _ in range(max(0, math.ceil(math.log(max(side / size, 1.0), FAN)))):
        cells.append(cut(cells[-1].groupBy(*(F.shiftright(c, 2).alias(c) for c in ("cx", "cy"))).agg(F.min("top").alias("top"), *box)))
    gap = lambda c: F.greatest(F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"), F.lit(0.0))
    span = lambda c: F.greatest(F.col(f"hi{c}") - F.col(c), F.col(c) - F.col(f"lo{c}"))
    whole = F.expr("lox >= minx and hix <= maxx and loy >= miny and hiy <= maxy")
    first = F.min(F.when(whole, F.struct("top", (F.hypot(span("x"), span("y")) * (1 + 1e-9)).alias("d")))).over(Window.partitionBy(*polygons.columns))
    pairs = polygons.crossJoin(F.broadcast(cells.pop()))  # some cells of the highest level
    while True:
        pairs = pairs.where("lox <= maxx and hix >= minx and loy <= maxy and hiy >= miny").withColumn("first", first)
        pairs = pairs.where(F.col("first").isNull() | (F.struct("top", F.hypot(gap("x"), gap("y")).alias("d")) <= F.col("first"))).select(*polygons.columns, "cx", "cy")
        if not cells:
            break
        pairs = pairs.withColumnsRenamed({"cx": "ux", "cy": "uy"}).join(cells.pop().withColumns({"ux": F.shiftright("cx", 2), "uy": F.shiftright("cy", 2)}), ["ux", "uy"])
    return pairs.join(held, ["cx", "cy"]).where("vx between minx and maxx and vy between miny and maxy").drop("cx", "cy")


def locate_polygon_along_network(polygons: DataFrame, reference: DataFrame, priority: str = "hack") -> DataFrame:
    """(fid, axis, locm): for polygons (fid, x, y, minx, miny, maxx, maxy) the segment of lowest priority, then nearest to (x, y), that has a vertex in the box; the measure by distance along the segment."""
    ends = reference.select("*", F.explode(F.array(F.struct(F.col("ax").alias("vx"), F.col("ay").alias("vy")), F.struct(F.col("bx").alias("vx"), F.col("by_").alias("vy")))).alias("v"))
    ends = ends.where(F.abs(F.col("v.vx")) + F.abs(F.col("v.vy")) < float("inf"))
    # Of vertices at one place only the first counts: they are equally far from all.
    seg = F.struct("seg", "ax", "ay", "am", "bx", "by_", "bm")
    places = ends.groupBy("v").agg(F.min_by(F.struct(F.col(priority).alias("p"), seg.alias("r")), F.struct(priority, "seg")).alias("b")).select("v.vx", "v.vy", "b.p", "b.r")
    inside = _in_box(polygons, cut(places))
    far = F.hypot(F.col("vx") - F.col("x"), F.col("vy") - F.col("y"))
    best = inside.groupBy("fid", "x", "y").agg(F.min_by("r", F.struct("p", far.alias("far"), F.col("r.seg").alias("seg"))).alias("r")).select("fid", "x", "y", "r.*")
    size2 = (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by_") - F.col("ay")) * (F.col("by_") - F.col("ay"))
    along = ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by_") - F.col("ay"))) / size2
    t = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return best.select("fid", F.col("seg").alias("axis"), (F.col("am") + (F.col("bm") - F.col("am")) * t).alias("locm"))


def sub_grid_map(outlets: DataFrame, flow: DataFrame) -> DataFrame:
    """(row, col, value): the id of the first outlet (pk, row, col) downstream of each cell, 0 without one."""
    marks = outlets.groupBy("row", "col").agg(F.min("pk").alias("pk"))
    target = flow.select("row", "col").join(marks, ["row", "col"], "left").select("row", "col", F.coalesce("pk", F.lit(0)).alias("value"))
    return watershed(target, flow)


def sub_grid_topography(zones: DataFrame, acc: DataFrame, flow: DataFrame) -> DataFrame:
    """(zone, row, col, drainage, link): each zone's outlet, its cell of largest accumulation (ties by place), and the zone whose outlet comes next downstream."""
    best = zones.join(acc, ["row", "col"]).groupBy(F.col("value").alias("zone")).agg(F.max(F.struct("acc", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b"))
    outlets = best.select("zone", (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.acc").alias("drainage"))
    steps = grid.downstream(flow)
    marks = outlets.select(grid.cell("row", "col").alias("id"), F.col("zone").alias("held"))
    root = jump(steps.join(marks, "id", "left"), stop=F.col("held").isNotNull()).join(marks.toDF("root", "link"), "root")
    after = marks.join(steps, "id").join(root.select(F.col("id").alias("next"), "link"), "next", "left").select(F.col("held").alias("zone"), "link")
    return outlets.join(after, "zone", "left")


def _round(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs, recursive=recursive)


_ref = lambda s: s.withColumnRenamed("fid", "seg")
_SIDE = "CAST(sign((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) AS INT)"
_q("locate_point_along_network", lambda p, s: locate_point_along_network(p, _ref(s)), _NEAR + f" SELECT fid, seg AS axis, round(am + (bm - am) * t, 5) AS locm, round(dist, 5) AS distance, {_SIDE} AS side FROM n", "points", "segs")
_q("point_axis_transform", lambda p, s: point_axis_transform(p, _ref(s)), _NEAR + f" SELECT fid, seg AS axis, round(am + (bm - am) * t, 5) AS rx, round(dist * {_SIDE}, 5) AS ry FROM n", "points", "segs")
_q("axis_transform", lambda v, s: axis_transform(v, _ref(s)), ", points AS (SELECT fid * 100000 + pos AS fid, x, y FROM verts)" + _NEAR + f" SELECT fid // 100000 AS fid, CAST(fid % 100000 AS INT) AS pos, seg AS axis, round(am + (bm - am) * t, 5) AS x, round(dist * {_SIDE}, 5) AS y FROM n", "verts", "segs")
_q("locate_polygon_along_network", lambda q, s: locate_polygon_along_network(q.selectExpr("fid", "cx x", "cy y", "cx - rx minx", "cy - ry miny", "cx + rx maxx", "cy + ry maxy"), _ref(s)), """, e AS (SELECT fid AS seg, ax AS vx, ay AS vy, * EXCLUDE (fid) FROM segs UNION ALL SELECT fid, bx, by_, * EXCLUDE (fid) FROM segs),
 i AS (SELECT q.fid, cx, cy, e.*, row_number() OVER (PARTITION BY q.fid ORDER BY hack, sqrt((vx - cx) * (vx - cx) + (vy - cy) * (vy - cy)), seg) AS rn FROM quads q JOIN e ON vx BETWEEN cx - rx AND cx + rx AND vy BETWEEN cy - ry AND cy + ry)
 SELECT fid, seg AS axis, round(am + (bm - am) * greatest(0, least(1, ((cx - ax) * (bx - ax) + (cy - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))), 5) AS locm FROM i WHERE rn = 1""", "quads", "segs")
_SUB = """, g AS (SELECT *, row + CASE WHEN d8 IN (8, 16) THEN 1 ELSE 0 END AS nr, col + CASE WHEN d8 IN (4, 8) THEN 1 ELSE 0 END AS nc FROM flow),
 st AS (SELECT g.row, g.col, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.row END AS nr, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.col END AS nc FROM g LEFT JOIN flow t ON t.row = g.nr AND t.col = g.nc),
 t AS (SELECT row, col, CASE WHEN (row * 50 + col) % 37 = 5 THEN row * 1000 + col ELSE 0 END AS v FROM flow), w AS (SELECT row, col, v FROM t WHERE v > 0 UNION ALL SELECT st.row, st.col, w.v FROM w JOIN st ON st.nr = w.row AND st.nc = w.col JOIN t ON t.row = st.row AND t.col = st.col WHERE t.v = 0)
 SELECT t.row, t.col, CAST(coalesce(w.v, 0) AS BIGINT) AS value FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col"""
_q("sub_grid_map", lambda f: sub_grid_map(f.where("(row * 50 + col) % 37 = 5").selectExpr("bigint(row * 1000 + col) pk", "row", "col"), f), _SUB, "flow", recursive=True)
_ZONES = lambda f: f.selectExpr("row", "col", "int(floor(row / 8)) * 100 + int(floor(col / 10)) + 1 value")
_TOPO = _SUB[: _SUB.index(" t AS (")] + """ wk AS (SELECT row, col, row AS r, col AS c FROM flow WHERE d8 >= 0 UNION ALL SELECT wk.row, wk.col, st.nr, st.nc FROM wk JOIN st ON st.row = wk.r AND st.col = wk.c WHERE st.nr IS NOT NULL),
 a AS (SELECT r AS row, c AS col, count(*) AS acc FROM wk GROUP BY 1, 2), z AS (SELECT f.row, f.col, CAST(floor(f.row / 8) * 100 + floor(f.col / 10) + 1 AS INT) AS zone, CAST(coalesce(a.acc, 0) AS DOUBLE) AS acc FROM flow f LEFT JOIN a ON a.row = f.row AND a.col = f.col),
 ou AS (SELECT zone, row, col, acc FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY acc DESC, row, col) AS rn FROM z) WHERE rn = 1),
 d AS (SELECT ou.zone, st.nr AS r, st.nc AS c FROM ou JOIN st ON st.row = ou.row AND st.col = ou.col WHERE st.nr IS NOT NULL UNION ALL SELECT d.zone, st.nr, st.nc FROM d JOIN st ON st.row = d.r AND st.col = d.c WHERE st.nr IS NOT NULL AND (d.r, d.c) NOT IN (SELECT row, col FROM ou))
 SELECT ou.zone, ou.row, ou.col, ou.acc AS drainage, q.link FROM ou LEFT JOIN (SELECT d.zone, o2.zone AS link FROM d JOIN ou o2 ON o2.row = d.r AND o2.col = d.c) q ON q.zone = ou.zone"""
_q("sub_grid_topography", lambda f: sub_grid_topography(_ZONES(f), cut(flow_accumulation(f)), f), _TOPO, "flow", recursive=True)
