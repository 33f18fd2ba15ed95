"""Vector operators: lines are (fid, geom), polygons (fid, rings), points (fid, x, y).

Null geometries give null or no output; ties are broken by the smallest key.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.iterate import cut, drop, some
from ..plans.spatial_join import bucket, covering, nearest, nearest_k, passing
from ..sources.derived import load, sql


def to_lines(verts: DataFrame) -> DataFrame:
    """(fid, geom) from vertices (fid, pos, x, y[, z, m])."""
    v = g.vertex("x", "y", *("z" if "z" in verts.columns else None, "m" if "m" in verts.columns else None))
    return verts.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), v.alias("v")))), lambda s: s["v"]).alias("geom"))


def to_vertices(lines: DataFrame) -> DataFrame:
    """Vertices (fid, ..., pos from 1, x, y, z, m) of lines."""
    others = [c for c in lines.columns if c != "geom"]
    return lines.select(*others, F.posexplode("geom").alias("pos", "v")).select(*others, (F.col("pos") + 1).alias("pos"), "v.*")


def to_segments(lines: DataFrame) -> DataFrame:
    """Segments (fid, ..., at, ax, ay, am, bx, by_, bm) of lines."""
    others = [c for c in lines.columns if c != "geom"]
    return lines.select(*others, F.explode(g.segments(F.col("geom"))).alias("s")).select(
        *others, "s.at", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.a.m").alias("am"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by_"), F.col("s.b.m").alias("bm")
    )


def extract_coordinates(lines: DataFrame) -> DataFrame:
    """lines with x, y, z, m of their first vertex."""
    return lines.select("*", *(F.element_at("geom", 1)[k].alias(k) for k in "xyzm"))


def simplify(verts: DataFrame, tolerance: float) -> DataFrame:
    """The vertices (fid, pos, x, y) that Douglas and Peucker's rule keeps: a stretch is replaced by its chord if no vertex is farther than tolerance from it, else split at the farthest (ties: the first).

    All stretches of all lines are split at once, so rounds are the depth of the splits; vertices of settled
    stretches leave the state. Lines of two vertices or fewer stay.
    """
    verts = verts.select("fid", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    point = F.struct("pos", "x", "y")
    ends = cut(verts.groupBy("fid").agg(F.min_by(point, "pos").alias("a"), F.max_by(point, "pos").alias("b")))
    kept = ends.select("fid", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).select("fid", "v.*")
    state = cut(verts.join(ends, "fid").where("pos > a.pos and pos < b.pos"))
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((F.col("x") - F.col("a.x")) * dx + (F.col("y") - F.col("a.y")) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    far = F.hypot(F.col("x") - F.col("a.x") - t * dx, F.col("y") - F.col("a.y") - t * dy)
    while some(state):
        top = state.withColumn("far", far).groupBy("fid", F.col("a.pos").alias("lo")).agg(F.max(F.struct("far", (-F.col("pos")).alias("first"), "pos", "x", "y")).alias("top")).where(F.col("top.far") > tolerance)
        top = cut(top.select("fid", "lo", F.struct("top.pos", "top.x", "top.y").alias("mid")))
        kept = kept.unionByName(top.select("fid", "mid.*"))
        left = F.col("pos") < F.col("mid.pos")
        split = state.withColumn("lo", F.col("a.pos")).join(top, ["fid", "lo"]).where("pos <> mid.pos")
        past, state = state, cut(split.select("fid", "pos", "x", "y", F.when(left, F.col("a")).otherwise(F.col("mid")).alias("a"), F.when(left, F.col("mid")).otherwise(F.col("b")).alias("b")))
        drop(past)
    return kept


def line_midpoints(lines: DataFrame) -> DataFrame:
    """(fid, x, y): the point at half of each line's length."""
    return lines.withColumn("p", g.at_distance(F.col("geom"), g.length(F.col("geom")) / 2)).select("fid", "p.x", "p.y")


def unique_points(lines: DataFrame) -> DataFrame:
    """(x, y): the distinct end points of lines."""
    ends = F.array(F.element_at("geom", 1), F.element_at("geom", -1))
    return lines.select(F.explode(ends).alias("p")).select("p.x", "p.y").distinct()


def monotonic_z(lines: DataFrame, nodata: float = -99999.0, delta: float = 0.0005) -> DataFrame:
    """lines whose z never rises downstream: a vertex not below the one before takes its z less delta; nodata is skipped."""
    zero = F.struct(F.lit(None).cast("double").alias("z"), F.array().cast(f"array<{g.VERTEX}>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        skip = v["z"].isNull() | (v["z"] == nodata)
        z = F.when(acc["z"].isNotNull() & (v["z"] > acc["z"]), acc["z"] - delta).otherwise(v["z"])
        return F.struct(F.when(skip, acc["z"]).otherwise(z).alias("z"), F.array_append(acc["out"], F.when(skip, v).otherwise(F.struct(v["x"], v["y"], z.alias("z"), v["m"]))).alias("out"))

    return lines.withColumn("geom", F.aggregate("geom", zero, step, lambda acc: acc["out"]))


def set_m(lines: DataFrame, measure: str | Column, downstream: bool = True) -> DataFrame:
    """lines with m on vertices: the measure plus the distance from the start, or, upstream, the measure plus the rest of the length."""
    value = F.col(measure) if isinstance(measure, str) else measure
    parts = g.measured(F.col("geom"))
    total = g.length(F.col("geom"))
    at = F.concat(F.array(F.lit(0.0)), F.transform(parts, lambda s: s["start"] + s["len"]))
    m = lambda d: value + (d if downstream else total - d)
    return lines.withColumn("geom", F.zip_with("geom", at, lambda v, d: F.struct(v["x"], v["y"], v["z"], m(d).alias("m"))))


def transform_coordinates(lines: DataFrame, expression: str, store: str = "m") -> DataFrame:
    """lines with z or m of each vertex from an SQL expression over x, y, z, m and vertex (its number from 0)."""
    verts = to_vertices(lines.select("fid", "geom")).withColumn("vertex", F.col("pos") - 1).withColumn("__new", F.expr(expression).cast("double"))
    verts = verts.withColumn(store, F.col("__new")).select("fid", "pos", "x", "y", "z", "m")
    return lines.drop("geom").join(to_lines(verts), "fid")


def wiener_coordinates(verts: DataFrame, coordinate: str = "z", size: int = 21, noise: float | None = None, nodata: float = -99999.0) -> DataFrame:
    """Vertices (fid, pos, ...) with a Wiener filter over `size` neighbours along each line; nodata is left as it is.

    As in the usual one-dimensional filter, places beyond the ends count as zeros.
    """
    half = size // 2
    near = Window.partitionBy("fid").orderBy("pos").rowsBetween(-half, size - half - 1)
    whole = Window.partitionBy("fid")
    ok = verts.where((F.col(coordinate) != nodata) & F.col(coordinate).isNotNull())
    mean = F.sum(coordinate).over(near) / size
    ok = ok.withColumn("__mean", mean).withColumn("__var", F.sum(F.col(coordinate) * F.col(coordinate)).over(near) / size - F.col("__mean") * F.col("__mean"))
    level = F.lit(noise) if noise is not None else F.avg("__var").over(whole)
    ok = ok.withColumn("__noise", level)
    value = F.when(F.col("__var") < F.col("__noise"), F.col("__mean")).otherwise(F.col("__mean") + (1 - F.col("__noise") / F.col("__var")) * (F.col(coordinate) - F.col("__mean")))
    out = ok.withColumn(coordinate, value).drop("__mean", "__var", "__noise")
    return out.unionByName(verts.where((F.col(coordinate) == nodata) | F.col(coordinate).isNull()))


def buffer_by_m(lines: DataFrame) -> DataFrame:
    """(fid, rings): for each line a polygon as wide as m at its vertices, sides offset along the mean of adjacent directions."""
    geom = F.col("geom")
    side = lambda sign: F.transform(geom, lambda v, i: _offset(geom, v, i, sign))
    shell = F.concat(side(1), F.reverse(side(-1)))
    return lines.select("fid", F.array(F.concat(shell, F.slice(shell, 1, 1))).alias("rings"))


def _offset(geom: Column, v: Column, i: Column, sign: int) -> Column:
    before, after = F.coalesce(F.get(geom, i - 1), v), F.coalesce(F.get(geom, i + 1), v)
    along = g.angle(before, after)
    half = F.coalesce(v["m"], F.lit(0.0)) / 2 * sign
    return F.struct((v["x"] - F.sin(along) * half).alias("x"), (v["y"] + F.cos(along) * half).alias("y"), v["z"].alias("z"), v["m"].alias("m"))


def minimum_oriented_box(polygons: DataFrame) -> DataFrame:
    """(fid, area, angle, width, height): the smallest box along any edge of the outer ring, angle in degrees."""
    ring = F.element_at("rings", 1)

    def box(s: Column) -> Column:
        a = g.angle(s["a"], s["b"])
        u = F.transform(ring, lambda v: v["x"] * F.cos(a) + v["y"] * F.sin(a))
        w = F.transform(ring, lambda v: v["y"] * F.cos(a) - v["x"] * F.sin(a))
        du, dw = F.array_max(u) - F.array_min(u), F.array_max(w) - F.array_min(w)
        return F.struct((du * dw).alias("area"), F.degrees(a).alias("angle"), du.alias("width"), dw.alias("height"))

    return polygons.select("fid", F.array_min(F.transform(g.segments(ring), box)).alias("b")).select("fid", "b.*")


def points_along(lines: DataFrame, step: float) -> DataFrame:
    """(fid, distance, x, y, angle): points each step along lines, angle in degrees."""
    total = g.length(F.col("geom"))
    marks = lines.select("fid", F.explode(g.measured(F.col("geom"))).alias("s"), total.alias("total"))
    # Each segment makes its own points: those with start <= k * step < start + len, and the last end.
    first, last = F.ceil(F.col("s.start") / step), F.ceil((F.col("s.start") + F.col("s.len")) / step) - 1
    some = marks.where(first <= last).select("fid", "s", F.explode(F.sequence(first, last)).alias("k"))
    t = (F.col("k") * step - F.col("s.start")) / F.col("s.len")
    return some.select("fid", (F.col("k") * step).alias("distance"), g.between(F.col("s.a"), F.col("s.b"), t).alias("p"), F.degrees(g.angle(F.col("s.a"), F.col("s.b"))).alias("angle")).select("fid", "distance", "p.x", "p.y", "angle")


def points_along_polygon(polygons: DataFrame, step: float) -> DataFrame:
    """(fid, ring, distance, x, y, angle): points each step on all rings."""
    rings = polygons.select("fid", F.posexplode("rings").alias("ring", "geom")).select(F.struct("fid", "ring").alias("fid"), "geom")
    return points_along(rings, step).select("fid.fid", "fid.ring", "distance", "x", "y", "angle")


def with_box(polygons: DataFrame) -> DataFrame:
    ring = F.element_at("rings", 1)
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return polygons.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def points_in_polygon(polygons: DataFrame, points: DataFrame, weight: str | None = None, classes: str | None = None, size: float = 50.0) -> DataFrame:
    """(fid, n): points in each polygon, or the sum of their weight, or the number of their classes; 0 where there are none.

    Points go into square tiles, several to a mean box's side. A tile that no edge passes lies inside or outside as
    a whole, and its points count together; only in tiles on the border are points tested, those of one place once.
    """
    boxed = with_box(polygons.select("fid", "rings"))
    mean = boxed.agg(F.avg(F.least(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    tile = max(mean / 10, size * 1e-3) if mean else size
    own = [classes] if classes else []
    amount = F.sum(weight).alias("w") if weight else F.count("*").alias("w")
    places = points.where("x is not null and y is not null").groupBy("x", "y", *own).agg(amount).withColumn("cell", F.struct(bucket(F.col("x"), tile).alias("bx_"), bucket(F.col("y"), tile).alias("by__")))
    heaps = places.groupBy("cell", *own).agg(F.sum("w").alias("w"))
    # A margin far above rounding, so that a tile next to an edge is tested rather than taken whole.
    pad = F.lit(tile * 1e-4)
    cells = boxed.select("fid", F.explode(covering(F.col("minx") - pad, F.col("miny") - pad, F.col("maxx") + pad, F.col("maxy") + pad, tile)).alias("cell"))
    edges = boxed.select("fid", F.explode("rings").alias("r")).select("fid", F.explode(g.segments(F.col("r"))).alias("s"))
    border = edges.select("fid", F.explode(passing(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"), tile)).alias("cell")).distinct()
    middle = lambda k: (F.col(f"cell.{k}") + 0.5) * tile
    whole = cells.join(border, ["fid", "cell"], "left_anti").join(boxed.select("fid", "rings"), "fid").where(g.in_polygon(middle("bx_"), middle("by__"), F.col("rings"))).select("fid", "cell")
    part = border.join(places, "cell").join(boxed.select("fid", "rings"), "fid").where(g.in_polygon(F.col("x"), F.col("y"), F.col("rings"))).select("fid", *own, "w")
    inside = whole.join(heaps, "cell").select("fid", *own, "w").unionByName(part)
    value = F.count_distinct(classes) if classes else F.sum("w")
    return polygons.select("fid").join(inside.groupBy("fid").agg(value.alias("n")), "fid", "left").fillna(0, ["n"])


def remove_small_objects(polygons: DataFrame, field: str, value: int, min_area: float, min_hole: float) -> DataFrame:
    """Polygons with field = value and area >= min_area, without holes below min_hole. Areas within rounding of a limit (a billionth of it) reach it."""
    kept = polygons.where((F.col(field) == value) & (g.polygon_area(F.col("rings")) >= min_area * (1 - 1e-9)))
    return kept.withColumn("rings", F.filter("rings", lambda r, i: (i == 0) | (g.ring_area(r) >= min_hole * (1 - 1e-9))))


def hex_samples(polygons: DataFrame, step: float) -> DataFrame:
    """(fid, x, y): a hexagonal lattice with the given spacing, in phase with multiples of it, inside polygons."""
    rise = step * sqrt(3) / 2
    boxed = with_box(polygons)
    rows = boxed.withColumn("j", F.explode(F.sequence(F.floor(F.col("miny") / rise), F.ceil(F.col("maxy") / rise))))
    shift = F.when(F.pmod("j", F.lit(2)) == 1, step / 2).otherwise(0.0)
    cells = rows.withColumn("shift", shift).withColumn("i", F.explode(F.sequence(F.floor((F.col("minx") - F.col("shift")) / step), F.ceil((F.col("maxx") - F.col("shift")) / step))))
    at = cells.withColumns({"x": F.col("i") * step + F.col("shift"), "y": F.col("j") * rise})
    return at.where(g.in_polygon(F.col("x"), F.col("y"), F.col("rings"))).select("fid", "x", "y")


def poisson_disc_samples(polygons: DataFrame, distance: float, seed: int = 1) -> DataFrame:
    """(fid, x, y): random points in polygons, none nearer to another of its polygon than distance.

    Every cell of a grid half as wide throws a point with a random priority; a point stays if it has the highest
    priority within reach. What the cells around throw follows from their numbers, so nothing is joined.
    """
    step = distance / 2
    low, high = {c: F.floor(F.col(f"min{k}") / step) for c, k in (("i", "x"), ("j", "y"))}, {c: F.floor(F.col(f"max{k}") / step) for c, k in (("i", "x"), ("j", "y"))}
    boxed = with_box(polygons).withColumns({f"{c}0": low[c] for c in "ij"} | {f"{c}1": high[c] for c in "ij"})
    boxed = boxed.select("fid", "rings", "i0", "i1", "j0", "j1", F.explode(F.sequence("j0", "j1")).alias("j"))
    # Polygons are few rows and much work each, so their rows of cells are dealt out.
    boxed = boxed.repartition(int(boxed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fid", "j").withColumn("i", F.explode(F.sequence("i0", "i1")))
    rnd = lambda k, i, j: F.pmod(F.xxhash64(F.lit(seed * 10 + k), "fid", i, j), F.lit(1 << 40)) / float(1 << 40)
    throw = lambda i, j: [((i + rnd(1, i, j)) * step).alias("x"), ((j + rnd(2, i, j)) * step).alias("y"), F.xxhash64(F.lit(seed), "fid", i, j).alias("priority")]
    thrown = boxed.select("*", *throw(F.col("i"), F.col("j")))
    thrown = thrown.where(g.in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    # Points nearer than two cells are at most two cells away by number.
    around = F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-2, 3) for b in range(-2, 3) if a or b))
    there = F.filter(around, lambda c: (c["i"] >= F.col("i0")) & (c["i"] <= F.col("i1")) & (c["j"] >= F.col("j0")) & (c["j"] <= F.col("j1")) & (F.xxhash64(F.lit(seed), "fid", c["i"], c["j"]) > F.col("priority")))
    others = F.transform(there, lambda c: F.struct(*throw(c["i"], c["j"])))
    near = F.filter(others, lambda o: F.hypot(F.col("x") - o["x"], F.col("y") - o["y"]) < distance)
    beaten = F.exists(near, lambda o: g.in_polygon(o["x"], o["y"], F.col("rings")))
    return thrown.where(~beaten).select("fid", "x", "y")


def segmentize(lines: DataFrame, distance: float) -> DataFrame:
    """(fid, dgo, start, stop): pieces of equal distance; the first and the last share the remainder."""
    total = g.length(F.col("geom"))
    n = F.floor(F.col("total") / distance)
    rest = (F.col("total") - n * distance) / 2
    rows = lines.select("fid", total.alias("total")).withColumn("dgo", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))))
    first, last = F.col("dgo") == 1, (F.col("dgo") == n) | (n <= 1)
    return rows.select("fid", "dgo", F.when(first, 0.0).otherwise(rest + (F.col("dgo") - 1) * distance).alias("start"), F.when(last, F.col("total")).otherwise(rest + F.col("dgo") * distance).alias("stop"))


def _transect(p: Column, angle: Column, size: Column) -> list[Column]:
    dx, dy = -F.sin(angle) * size / 2, F.cos(angle) * size / 2
    return [(p["x"] + dx).alias("ax"), (p["y"] + dy).alias("ay"), (p["x"] - dx).alias("bx"), (p["y"] - dy).alias("by_")]


def variable_length_transects(lines: DataFrame, length: float | str, interval: float) -> DataFrame:
    """(fid, distance, ax, ay, bx, by_): transects of a length (or SQL expression over distance) each interval along lines."""
    at = points_along(lines, interval).withColumn("p", F.struct("x", "y"))
    size = F.expr(str(length)).cast("double")
    return at.select("fid", "distance", *_transect(F.col("p"), F.radians("angle"), size))


def transect_by_point(points: DataFrame, segs: DataFrame, length: float, radius: float) -> DataFrame:
    """(fid, seg, ax, ay, bx, by_): for points a transect across the nearest segment (key `seg`) at the nearest place."""
    near = nearest(points.select("fid", "x", "y"), segs, "fid", "seg", radius)
    angle = F.atan2(F.col("by_") - F.col("ay"), F.col("bx") - F.col("ax"))
    return near.withColumn("p", F.struct(F.col("px").alias("x"), F.col("py").alias("y"))).select("fid", "seg", *_transect(F.col("p"), angle, F.lit(length)))


def project_point_on_nearest_line(points: DataFrame, segs: DataFrame, radius: float, keep: bool = False) -> DataFrame:
    """(fid, seg, px, py, dist): the nearest place on a segment less than radius away; others are dropped, or kept with nulls."""
    near = nearest(points.select("fid", "x", "y"), segs, "fid", "seg", radius).where(F.col("dist") < radius).select("fid", "seg", "px", "py", "dist")
    return points.select("fid").join(near, "fid", "left") if keep else near


def locate_point_along_line(points: DataFrame, segs: DataFrame, radius: float, nodata: float = -999.0) -> DataFrame:
    """(fid, seg, m, dist): m of the nearest place on a segment with am, bm within radius; points without one have nodata."""
    near = nearest(points.select("fid", "x", "y"), segs, "fid", "seg", radius)
    near = near.select("fid", "seg", (F.col("am") + (F.col("bm") - F.col("am")) * F.col("t")).alias("m"), "dist")
    return points.select("fid").join(near, "fid", "left").withColumn("m", F.coalesce("m", F.lit(nodata)))


def _as_segments(points: DataFrame, key: str) -> DataFrame:
    return points.select(F.col("fid").alias(key), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by_"))


def distance_to_other_layer(points: DataFrame, others: DataFrame, radius: float | None = None) -> DataFrame:
    """(fid, other, dist): the nearest of the other points, within radius if given."""
    return nearest(points.select("fid", "x", "y"), _as_segments(others, "other"), "fid", "other", radius).select("fid", "other", "dist")


def distance_matrix(points: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(fid, other, rank, dist): the k nearest other points of each point."""
    return nearest_k(points.select("fid", "x", "y"), _as_segments(others, "other"), "fid", "other", k)


def select_by_distance(points: DataFrame, segs: DataFrame, radius: float) -> DataFrame:
    """Points at most radius from any segment."""
    near = nearest(points.select("fid", "x", "y"), segs.select(F.lit(0).alias("seg"), "ax", "ay", "bx", "by_"), "fid", "seg", radius)
    return points.join(near.select("fid"), "fid", "left_semi")


def select_nearest_feature(points: DataFrame, references: DataFrame, radius: float) -> DataFrame:
    """Points that are the nearest within radius to some reference point."""
    near = nearest(references.select(F.col("fid").alias("ref"), "x", "y"), _as_segments(points, "fid"), "ref", "fid", radius)
    return points.join(near.select("fid").distinct(), "fid", "left_semi")


def cut_and_rotate_ring(polygons: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Polygons whose outer ring starts at the vertex nearest to any point within radius; others stay."""
    ring = polygons.select("fid", F.posexplode(F.slice(F.element_at("rings", 1), F.lit(1), F.size(F.element_at("rings", 1)) - 1)).alias("at", "v")).select(F.struct("fid", "at").alias("fid"), "v.x", "v.y")
    near = distance_to_other_layer(ring, points, radius).groupBy("fid.fid").agg(F.min_by(F.col("fid.at"), F.struct("dist", "other", "fid.at")).alias("at"))
    open_ = F.slice(F.element_at("rings", 1), F.lit(1), F.size(F.element_at("rings", 1)) - 1)
    turned = F.concat(F.slice(open_, F.col("at") + 1, F.size(open_)), F.slice(open_, F.lit(1), F.col("at")))
    closed = F.concat(turned, F.slice(turned, 1, 1))
    out = polygons.join(near, "fid", "left")
    return out.withColumn("rings", F.when(F.col("at").isNull(), F.col("rings")).otherwise(F.concat(F.array(closed), F.slice(F.col("rings"), F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0)))))).drop("at")


def voronoi_membership(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """(fid, site): the site whose Voronoi cell holds each point: a nearest-neighbour join, ties to the smaller site."""
    return nearest(cells.select("fid", "x", "y"), _as_segments(sites, "site"), "fid", "site").select("fid", "site")


def voronoi_transects(points: DataFrame, length: float) -> DataFrame:
    """(axis, seq, ox, oy, ax, ay, bx, by_): for consecutive points of an axis a piece of their bisector, of a length, about the midpoint (ox, oy)."""
    order = Window.partitionBy("axis").orderBy("seq")
    pairs = points.withColumns({"nx": F.lead("x").over(order), "ny": F.lead("y").over(order)}).where("nx is not null")
    mid = F.struct(((F.col("x") + F.col("nx")) / 2).alias("x"), ((F.col("y") + F.col("ny")) / 2).alias("y"))
    angle = F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x"))
    return pairs.select("axis", "seq", mid["x"].alias("ox"), mid["y"].alias("oy"), *_transect(mid, angle, F.lit(length)))


def diamonds(quads: DataFrame) -> DataFrame:
    """Polygons (fid, kind, rings) of the derived quads."""
    corner = lambda sx, sy: g.vertex(F.col("cx") + sx * F.col("rx"), F.col("cy") + sy * F.col("ry"))
    return quads.select("fid", "kind", F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1), corner(1, 0))).alias("rings"))


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs, recursive=recursive)


_CUM = ", c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(len) OVER (PARTITION BY fid) AS total FROM (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM verts WINDOW w AS (PARTITION BY fid ORDER BY pos)))), s AS (SELECT * FROM c WHERE len IS NOT NULL)"
_NEAR = """, p AS (SELECT p.fid, p.x, p.y, s.fid AS seg, ax, ay, bx, by_, am, bm, greatest(0, least(1, coalesce(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0))) AS t FROM points p, segs s),
 d AS (SELECT *, ax + (bx - ax) * t AS px, ay + (by_ - ay) * t AS py FROM p), e AS (SELECT *, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS dist FROM d), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist, seg) AS rn FROM e) WHERE rn = 1)"""
_seg = lambda s: s.withColumnRenamed("fid", "seg")
_q("extract_coordinates", lambda v: extract_coordinates(to_lines(v)).select("fid", "x", "y", "z"), " SELECT fid, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM verts WHERE pos = 1", "verts")
_q("line_midpoints", lambda v: line_midpoints(to_lines(v)), _CUM + " SELECT fid, round(x + (nx - x) * (total / 2 - start) / len, 4) AS x, round(y + (ny - y) * (total / 2 - start) / len, 4) AS y FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY pos DESC) AS rn FROM s WHERE start <= total / 2) WHERE rn = 1", "verts")
_q("unique_points", lambda v: unique_points(to_lines(v)), " SELECT DISTINCT x, y FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY pos DESC) AS r FROM verts) WHERE pos = 1 OR r = 1", "verts")
_q("set_m", lambda v: to_vertices(set_m(to_lines(v), F.lit(100.0))).select("fid", "pos", "m"), _CUM + " SELECT fid, pos, round(100 + start, 4) AS m FROM c", "verts")
_q("set_m_upstream", lambda v: to_vertices(set_m(to_lines(v), F.lit(100.0), False)).select("fid", "pos", "m"), _CUM + " SELECT fid, pos, round(100 + total - start, 4) AS m FROM c", "verts")
_q("transform_coordinates", lambda v: to_vertices(transform_coordinates(to_lines(v), "z * 2 + vertex", "m")).select("fid", "pos", "m"), " SELECT fid, pos, round(z * 2 + pos - 1, 4) AS m FROM verts", "verts")
_q("monotonic_z", lambda v: to_vertices(monotonic_z(to_lines(v), delta=0.0)).select("fid", "pos", "z"), " SELECT fid, pos, round(min(z) OVER (PARTITION BY fid ORDER BY pos), 4) AS z FROM verts", "verts")
_q("wiener_coordinates", lambda v: wiener_coordinates(v, "z", 5).select("fid", "pos", "z"), """, a AS (SELECT fid, pos, z, sum(z) OVER w / 5 AS mu, sum(z * z) OVER w / 5 AS sq FROM verts WINDOW w AS (PARTITION BY fid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), b AS (SELECT *, sq - mu * mu AS v FROM a), c AS (SELECT *, avg(v) OVER (PARTITION BY fid) AS noise FROM b)
 SELECT fid, pos, round(CASE WHEN v < noise THEN mu ELSE mu + (1 - noise / v) * (z - mu) END, 4) AS z FROM c""", "verts")
_q("points_along", lambda v: points_along(to_lines(v), 25.0).select("fid", "distance", "x", "y"), _CUM + ", k AS (SELECT s.*, unnest(generate_series(ceil(start / 25)::BIGINT, ceil((start + len) / 25)::BIGINT - 1)) AS k FROM s) SELECT fid, k * 25.0::DOUBLE AS distance, round(x + (nx - x) * (k * 25 - start) / len, 4) AS x, round(y + (ny - y) * (k * 25 - start) / len, 4) AS y FROM k", "verts")
_q("segmentize", lambda v: segmentize(to_lines(v), 300.0), _CUM + ", t AS (SELECT fid, max(total) AS total, floor(max(total) / 300)::BIGINT AS n FROM s GROUP BY fid), k AS (SELECT *, unnest(generate_series(1, greatest(n, 1))) AS dgo FROM t) SELECT fid, dgo, round(CASE WHEN dgo = 1 THEN 0 ELSE (total - n * 300) / 2 + (dgo - 1) * 300 END, 4) AS start, round(CASE WHEN dgo = n OR n <= 1 THEN total ELSE (total - n * 300) / 2 + dgo * 300 END, 4) AS stop FROM k", "verts")
_q("variable_length_transects", lambda v: variable_length_transects(to_lines(v), "10 + distance / 100", 50.0), _CUM + """, k AS (SELECT s.*, unnest(generate_series(ceil(start / 50)::BIGINT, ceil((start + len) / 50)::BIGINT - 1)) AS k FROM s), p AS (SELECT fid, k * 50.0::DOUBLE AS distance, x + (nx - x) * (k * 50 - start) / len AS x, y + (ny - y) * (k * 50 - start) / len AS y, atan2(ny - y, nx - x) AS a, (10 + k * 50.0 / 100) / 2 AS h FROM k)
 SELECT fid, distance, round(x - sin(a) * h, 4) AS ax, round(y + cos(a) * h, 4) AS ay, round(x + sin(a) * h, 4) AS bx, round(y - cos(a) * h, 4) AS by_ FROM p""", "verts")
_q("project_point_on_nearest_line", lambda p, s: project_point_on_nearest_line(p, _seg(s), 60.0), _NEAR + " SELECT fid, seg, round(px, 4) AS px, round(py, 4) AS py, round(dist, 4) AS dist FROM n WHERE dist < 60", "points", "segs")
_q("locate_point_along_line", lambda p, s: locate_point_along_line(p, _seg(s), 60.0).select("fid", "seg", "m", "dist"), _NEAR + " SELECT p.fid, n.seg, round(coalesce(am + (bm - am) * t, -999), 4) AS m, round(dist, 4) AS dist FROM points p LEFT JOIN (SELECT * FROM n WHERE dist <= 60) n ON n.fid = p.fid", "points", "segs")
_q("transect_by_point", lambda p, s: transect_by_point(p, _seg(s), 10.0, 60.0), _NEAR + ", a AS (SELECT *, atan2(by_ - ay, bx - ax) AS a FROM n WHERE dist <= 60) SELECT fid, seg, round(px - sin(a) * 5, 4) AS ax, round(py + cos(a) * 5, 4) AS ay, round(px + sin(a) * 5, 4) AS bx, round(py - cos(a) * 5, 4) AS by_ FROM a", "points", "segs")
_q("select_by_distance", lambda p, s: select_by_distance(p, s.drop("fid", "am", "bm", "hack"), 40.0), _NEAR + " SELECT * FROM points WHERE fid IN (SELECT fid FROM n WHERE dist <= 40)", "points", "segs")
_q("distance_to_other_layer", lambda p, s: distance_to_other_layer(p, s.selectExpr("fid", "ax x", "ay y")), ", d AS (SELECT p.fid, s.fid AS other, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS dist FROM points p, segs s) SELECT fid, other, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist, other) AS rn FROM d) WHERE rn = 1", "points", "segs")
_q("select_nearest_feature", lambda p, s: select_nearest_feature(p, s.selectExpr("fid", "ax x", "ay y"), 100.0), ", d AS (SELECT p.fid, s.fid AS ref, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS dist FROM points p, segs s) SELECT * FROM points WHERE fid IN (SELECT fid FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY dist, fid) AS rn FROM d WHERE dist <= 100) WHERE rn = 1)", "points", "segs")
_q("voronoi_polygons", lambda p, s: voronoi_membership(p, s.selectExpr("fid", "ax x", "ay y")), ", d AS (SELECT p.fid, s.fid AS site, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) AS dist FROM points p, segs s) SELECT fid, site FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY dist, site) AS rn FROM d) WHERE rn = 1", "points", "segs")
_IN = "abs(x - cx) / rx + abs(y - cy) / ry < 1"
_q("points_in_polygon", lambda q, p: points_in_polygon(diamonds(q), p), f" SELECT q.fid, count(p.fid) AS n FROM quads q LEFT JOIN points p ON {_IN} GROUP BY q.fid", "quads", "points")
_q("points_in_polygon_classes", lambda q, p: points_in_polygon(diamonds(q), p, classes="grp"), f" SELECT q.fid, count(DISTINCT grp) AS n FROM quads q LEFT JOIN points p ON {_IN} GROUP BY q.fid", "quads", "points")
_q("remove_small_objects", lambda q: remove_small_objects(diamonds(q), "kind", 1, 1500.0, 10.0).select("fid", g.polygon_area(F.col("rings")).alias("area")), " SELECT fid, round(2 * rx * ry, 4)::DOUBLE AS area FROM quads WHERE kind = 1 AND 2 * rx * ry >= 1500", "quads")
_q("minimum_oriented_box", lambda q: minimum_oriented_box(diamonds(q)).select("fid", "area"), " SELECT fid, round(4 * greatest(rx * rx, ry * ry) * rx * ry / (rx * rx + ry * ry), 4)::DOUBLE AS area FROM quads", "quads")
_q("points_along_polygon", lambda q: points_along_polygon(diamonds(q), 7.0).select("fid", "ring", "distance"), ", l AS (SELECT fid, 4 * sqrt(rx * rx + ry * ry) AS len FROM quads) SELECT fid, 0 AS ring, unnest(generate_series(0, ceil(len / 7)::BIGINT - 1)) * 7.0::DOUBLE AS distance FROM l", "quads")
_q("hex_samples", lambda q: hex_samples(diamonds(q), 9.0), f""", r AS (SELECT *, unnest(generate_series(floor((cy - ry) / (9 * sqrt(3) / 2))::BIGINT, ceil((cy + ry) / (9 * sqrt(3) / 2))::BIGINT)) AS j FROM quads), c AS (SELECT *, unnest(generate_series(floor((cx - rx) / 9)::BIGINT - 1, ceil((cx + rx) / 9)::BIGINT)) AS i FROM r),
 p AS (SELECT *, i * 9.0 + CASE WHEN j % 2 <> 0 THEN 4.5 ELSE 0 END AS x, j * (9 * sqrt(3) / 2) AS y FROM c) SELECT fid, x::DOUBLE AS x, round(y, 4) AS y FROM p WHERE {_IN}""", "quads")
_q("poisson_disc_samples", lambda q: poisson_disc_samples(diamonds(q), 8.0), None, "quads")
_q("line_buffer_by_m", lambda v: buffer_by_m(set_m(to_lines(v), F.lit(5.0))).select("fid", g.ring_area(F.element_at("rings", 1)).alias("area")), None, "verts")
_q("cut_and_rotate_ring", lambda q, p: cut_and_rotate_ring(diamonds(q), p, 30.0).select("fid", F.element_at(F.element_at("rings", 1), 1)["x"].alias("x"), F.element_at(F.element_at("rings", 1), 1)["y"].alias("y")), """, v AS (SELECT fid, unnest([0, 1, 2, 3]) AS i, unnest([cx + rx, cx, cx - rx, cx]) AS x, unnest([cy, cy + ry, cy, cy - ry]) AS y FROM quads), d AS (SELECT v.fid, v.i, p.fid AS other, sqrt(pow(p.x - v.x, 2) + pow(p.y - v.y, 2)) AS dist FROM v, points p),
 b AS (SELECT fid, i FROM d WHERE dist <= 30 QUALIFY row_number() OVER (PARTITION BY fid ORDER BY dist, other, i) = 1) SELECT v.fid, round(v.x, 4) AS x, round(v.y, 4) AS y FROM v LEFT JOIN b ON b.fid = v.fid WHERE v.i = coalesce(b.i, 0)""", "quads", "points")
_q("voronoi_transects", lambda v: voronoi_transects(v.selectExpr("fid axis", "pos seq", "x", "y"), 20.0), """, p AS (SELECT fid AS axis, pos AS seq, (x + nx) / 2 AS ox, (y + ny) / 2 AS oy, atan2(ny - y, nx - x) AS a FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM verts WINDOW w AS (PARTITION BY fid ORDER BY pos)) WHERE nx IS NOT NULL)
 SELECT axis, seq, round(ox, 4) AS ox, round(oy, 4) AS oy, round(ox - sin(a) * 10, 4) AS ax, round(oy + cos(a) * 10, 4) AS ay, round(ox + sin(a) * 10, 4) AS bx, round(oy - cos(a) * 10, 4) AS by_ FROM p""", "verts")
_q("reverse_lines", lambda v: to_vertices(to_lines(v).withColumn("geom", F.reverse("geom"))).select("fid", "pos", "x", "y"), " SELECT fid, CAST(count(*) OVER (PARTITION BY fid) - pos + 1 AS INT) AS pos, x, y FROM verts", "verts")
_q("simplify_lines", lambda v: simplify(v, 60.0), """, r AS (SELECT fid, min(pos) AS lo, max(pos) AS hi FROM verts GROUP BY fid UNION ALL
 SELECT f.fid, CASE WHEN side = 0 THEN lo ELSE mid END, CASE WHEN side = 0 THEN mid ELSE hi END FROM (SELECT fid, lo, hi, arg_max(pos, [far, -pos]) AS mid, max(far) AS far FROM
 (SELECT w.*, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) AS far FROM (SELECT r.fid, r.lo, r.hi, v.pos, v.x, v.y, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_,
 greatest(0, least(1, ((v.x - a.x) * (b.x - a.x) + (v.y - a.y) * (b.y - a.y)) / (pow(b.x - a.x, 2) + pow(b.y - a.y, 2)))) AS t
 FROM r JOIN verts a ON a.fid = r.fid AND a.pos = r.lo JOIN verts b ON b.fid = r.fid AND b.pos = r.hi JOIN verts v ON v.fid = r.fid AND v.pos > r.lo AND v.pos < r.hi) w) GROUP BY fid, lo, hi) f, (SELECT unnest([0, 1]) AS side) s WHERE far > 60)
 SELECT v.fid, v.pos, round(v.x, 4) AS x, round(v.y, 4) AS y FROM verts v JOIN (SELECT fid, lo AS pos FROM r UNION SELECT fid, hi FROM r) k ON k.fid = v.fid AND k.pos = v.pos""", "verts", recursive=True)
_q("distance_matrix", lambda p, s: distance_matrix(p.selectExpr("fid", "round(x / 8) x", "round(y / 8) y"), s.selectExpr("fid", "round(ax / 8) ax", "round(ay / 8) ay").selectExpr("fid", "ax x", "ay y"), 10), """, d AS (SELECT p.fid, s.fid AS other, sqrt(pow(round(p.x / 8) - round(ax / 8), 2) + pow(round(p.y / 8) - round(ay / 8), 2)) AS dist FROM points p, segs s)
 SELECT fid, other, CAST(row_number() OVER (PARTITION BY fid ORDER BY dist, other) AS INT) AS rank, round(dist, 4) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY fid ORDER BY dist, other) <= 10""", "points", "segs")
