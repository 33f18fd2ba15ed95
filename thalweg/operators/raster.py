"""Raster operators on cell tables (row, col, value); nodata is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..plans.iterate import cut
from ..sources.derived import load, sql

KEYS = ["row", "col"]


def raster_info(cells: DataFrame, xres: float = 1.0, yres: float = 1.0) -> DataFrame:
    """(xres, yres, xsize, ysize, nodata): resolution, extent in cells and the number of nodata cells."""
    return cells.agg((F.max("col") + 1).cast("long").alias("xsize"), (F.max("row") + 1).cast("long").alias("ysize"), F.sum(F.col("value").isNull().cast("long")).alias("nodata")).select(
        F.lit(xres).alias("xres"), F.lit(yres).alias("yres"), "xsize", "ysize", "nodata"
    )


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("row", "col", F.col("value").alias("other")), KEYS)


def raster_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b; null where either is."""
    return _both(a, b).select("row", "col", (F.col("value") - F.col("other")).alias("value"))


def difference_threshold(dem: DataFrame, reference: DataFrame, low: float = -10, high: float = 10) -> DataFrame:
    """1 where low < dem - reference <= high, else 0; null where either is."""
    d = F.col("value") - F.col("other")
    return _both(dem, reference).select("row", "col", ((d > low) & (d <= high)).cast("int").alias("value"))


def apply_mask(cells: DataFrame, mask: DataFrame, condition: str) -> DataFrame:
    """cells where an SQL condition over `value`, the mask's, holds; else null."""
    kept = mask.select("row", "col", F.coalesce(F.expr(condition), F.lit(False)).alias("keep"))
    return cells.join(kept, KEYS).select("row", "col", F.when(F.col("keep"), F.col("value")).alias("value"))


def reclassify(cells: DataFrame, classes: list[tuple[float, float, float]]) -> DataFrame:
    """Values of the first class (low, high, value) with low < value <= high, else null."""
    out = F.lit(None).cast("double")
    for low, high, value in reversed(classes):
        out = F.when((F.col("value") > low) & (F.col("value") <= high), float(value)).otherwise(out)
    return cells.select("row", "col", out.alias("value"))


def extent(cells: DataFrame) -> tuple[int, int]:
    r = cells.agg(F.max("row"), F.max("col")).first()
    return (r[0] or 0) + 1, (r[1] or 0) + 1


def _mirrored(cells: DataFrame, half: int) -> DataFrame:
    """cells and, around them, their mirror images: the edge repeats (reflecting borders)."""
    rows, cols = extent(cells)

    def places(at: Column, n: int) -> Column:
        near, far = -at - 1, 2 * n - 1 - at
        return F.filter(F.array(at, F.when(near >= -half, near), F.when(far < n + half, far)), lambda p: p.isNotNull())

    return cells.select(F.explode(places(F.col("row"), rows)).alias("row"), "col", "value").select("row", F.explode(places(F.col("col"), cols)).alias("col"), "value")


def simple_filter(cells: DataFrame, kind: str = "mean", size: int = 3, fill: float = -99999.0) -> DataFrame:
    """Moving mean, median, minimum or maximum over size x size cells with reflecting borders; nodata takes part as `fill` and is null again."""
    half = size // 2
    filled = _mirrored(cells.withColumn("value", F.coalesce("value", F.lit(fill))), half)
    near = grid.window(filled, "value", half, half, size - 1 - half, size - 1 - half)
    value = {"mean": F.avg("near"), "median": F.percentile("near", F.lit(0.5)), "min": F.min("near"), "max": F.max("near")}[kind]
    out = near.groupBy(*KEYS).agg(value.alias("out"))
    return cells.join(out, KEYS).select("row", "col", F.when(F.col("value").isNotNull(), F.col("out")).alias("value"))


def wiener_filter(cells: DataFrame, size: int = 3, noise: float | None = None) -> DataFrame:
    """Wiener smoothing by local mean and variance; cells beyond the border and nodata count as 0, noise is the mean variance unless given."""
    half = size // 2
    zero = cells.withColumn("value", F.coalesce("value", F.lit(0.0)))
    near = grid.window(zero, "value", half, half, size - 1 - half, size - 1 - half)
    local = near.groupBy(*KEYS).agg((F.sum("near") / size**2).alias("mean"), (F.sum(F.col("near") * F.col("near")) / size**2).alias("square"))
    local = zero.join(local, KEYS).withColumn("var", F.col("square") - F.col("mean") * F.col("mean"))
    local = local.withColumn("noise", F.lit(noise)) if noise is not None else cut(local).transform(lambda d: d.crossJoin(F.broadcast(d.agg(F.avg("var").alias("noise")))))
    value = F.when(F.col("var") < F.col("noise"), F.col("mean")).otherwise(F.col("mean") + (1 - F.col("noise") / F.col("var")) * (F.col("value") - F.col("mean")))
    return cells.select(*KEYS, F.col("value").alias("own")).join(local.select(*KEYS, value.alias("out")), KEYS).select("row", "col", F.when(F.col("own").isNotNull(), F.col("out")).alias("value"))


def anisotropic_diffusion(cells: DataFrame, iterations: int = 1, kappa: float = 50.0, gamma: float = 0.25, option: int = 1) -> DataFrame:
    """Perona-Malik diffusion over four neighbours; nodata neither gives nor takes. Conductance 1: exp(-(d/k)^2), 2: 1/(1+(d/k)^2), 3: Tukey's biweight."""
    d = F.col("near") - F.col("value")
    s = d / kappa
    flux = {
        1: F.exp(-s * s) * d,
        2: d / (1 + s * s),
        3: F.when(F.abs(d) <= kappa * 2**0.5, 0.5 * F.pow(1 - (s / 2**0.5) * (s / 2**0.5), 2) * d).otherwise(0.0),
    }[option]
    state = cells
    for i in range(iterations):
        known = state.where("value is not null")
        near = grid.neighbours(known, "value", diagonal=False)
        change = known.join(near, KEYS).groupBy(*KEYS).agg(F.sum(flux).alias("change"))
        state = state.join(change, KEYS, "left").select("row", "col", (F.col("value") + gamma * F.coalesce("change", F.lit(0.0))).alias("value"))
        if i % 4 == 3:
            state = cut(state)
    return state


def binary_closing(cells: DataFrame, radius: float, iterations: int = 1) -> DataFrame:
    """Closing of the cells with a positive value by a disk: dilations, then erosions; beyond the grid is empty."""
    half = int(radius)
    state = cells.select("row", "col", F.coalesce((F.col("value") > 0).cast("int"), F.lit(0)).alias("value"))
    disk = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc") <= radius * radius
    places = state.select(*KEYS)
    need = sum(1 for a in range(-half, half + 1) for b in range(-half, half + 1) if a * a + b * b <= radius * radius)
    for _ in range(iterations):
        near = grid.window(state.where("value = 1"), "value", half, half, half, half).where(disk).select(*KEYS).distinct().withColumn("value", F.lit(1))
        state = places.join(near, KEYS, "left").fillna(0, ["value"])
    for _ in range(iterations):
        near = grid.window(state.where("value = 1"), "value", half, half, half, half).where(disk).groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") == need).select(*KEYS, F.lit(1).alias("value"))
        state = places.join(near, KEYS, "left").fillna(0, ["value"])
    return state


def focal_mean(cells: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """(fid, value): mean of the cells in a width x height window about each point's cell (fid, row, col); null if the window leaves the grid."""
    up, left = height // 2, width // 2
    span = F.flatten(F.transform(F.sequence(F.lit(-up), F.lit(height - 1 - up)), lambda r: F.transform(F.sequence(F.lit(-left), F.lit(width - 1 - left)), lambda c: F.struct(r.alias("dr"), c.alias("dc")))))
    wanted = points.select("fid", "row", "col", F.explode(span).alias("s")).select("fid", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    got = wanted.join(cells.withColumn("there", F.lit(1)), KEYS, "left").groupBy("fid").agg(F.avg("value").alias("mean"), F.count("there").alias("n"))
    return got.select("fid", F.when(F.col("n") == width * height, F.col("mean")).alias("value"))


def burn_line_z(cells: DataFrame, verts: DataFrame, source: str = "z", offset: float = 0.0, nodata: float = -99999.0) -> DataFrame:
    """cells with z or m of the vertices (fid, pos, row, col, z, m) that fall in them plus offset; the last by (fid, pos) wins."""
    burnt = verts.where(F.col(source).isNotNull() & (F.col(source) != nodata)).groupBy(*KEYS).agg(F.max_by(source, F.struct("fid", "pos")).alias("burnt"))
    return cells.join(burnt, KEYS, "left").select("row", "col", F.coalesce(F.col("burnt") + offset, "value").alias("value"))


def sample(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (fid, row, col) with the value of their cell, or null."""
    return points.join(cells, KEYS, "left")


def rasterize(segments: DataFrame, value: str = "fid") -> DataFrame:
    """(row, col, value): cells that segments (r0, c0, r1, c1 in cells) pass, by equal steps along the longer axis; the smallest value wins."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")), F.lit(1))
    walk = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("int"), F.col("n").cast("int"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") + 0.5).cast("int")
    return walk.select(at("r0", "r1").alias("row"), at("c0", "c1").alias("col"), F.col(value).alias("value")).groupBy(*KEYS).agg(F.min("value").alias("value"))


def rasterize_network(template: DataFrame, segments: DataFrame, background: int = 0) -> DataFrame:
    """The template's cells with the smallest fid of the lines that pass, or background."""
    burnt = rasterize(segments)
    return template.select(*KEYS).join(burnt, KEYS, "left").fillna(background, ["value"])


def drape(points_: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines (fid, ax, ay, bx, by_ in cell units) as vertices (fid, at, x, y, z): their ends and where they cross cell borders, with z of the cell at the middle of the piece that follows."""
    crossing = lambda a, b: F.transform(
        F.filter(F.sequence(F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))), lambda v: (v > F.least(a, b)) & (v < F.greatest(a, b))), lambda v: (v - F.col(a)) / (F.col(b) - F.col(a))
    )
    empty = F.array().cast("array<double>")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.when(F.ceil(F.least("ax", "bx")) <= F.floor(F.greatest("ax", "bx")), crossing("ax", "bx")).otherwise(empty), F.when(F.ceil(F.least("ay", "by_")) <= F.floor(F.greatest("ay", "by_")), crossing("ay", "by_")).otherwise(empty))))
    rows = points_.withColumn("cuts", cuts).select("*", F.posexplode("cuts").alias("i", "t"))
    mid = (F.col("t") + F.coalesce(F.get("cuts", F.col("i") + 1), F.get("cuts", F.col("i") - 1))) / 2
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    placed = rows.select("fid", F.col("t").alias("at"), at("ax", "bx", F.col("t")).alias("x"), at("ay", "by_", F.col("t")).alias("y"), F.floor(at("ay", "by_", mid)).cast("int").alias("row"), F.floor(at("ax", "bx", mid)).cast("int").alias("col"))
    return placed.join(cells, KEYS, "left").select("fid", "at", "x", "y", F.col("value").alias("z"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs)


_q("raster_info", raster_info, " SELECT 1e0 AS xres, 1e0 AS yres, CAST(max(col) + 1 AS BIGINT) AS xsize, CAST(max(row) + 1 AS BIGINT) AS ysize, count(*) FILTER (value IS NULL) AS nodata FROM dem", "dem")
_q("raster_difference", raster_difference, " SELECT a.row, a.col, a.value - b.value AS value FROM dem a JOIN dem2 b USING (row, col)", "dem", "dem2")
_q("difference_threshold", lambda a, b: difference_threshold(a, b, -20, 30), " SELECT a.row, a.col, CAST(a.value - b.value > -20 AND a.value - b.value <= 30 AS INT) AS value FROM dem a JOIN dem2 b USING (row, col)", "dem", "dem2")
_q("apply_mask", lambda a, b: apply_mask(a, b, "value > 50 and value < 120"), " SELECT a.row, a.col, CASE WHEN b.value > 50 AND b.value < 120 THEN a.value END AS value FROM dem a JOIN dem2 b USING (row, col)", "dem", "dem2")
_q("reclassify", lambda a: reclassify(a, [(-1, 50, 1), (50, 100, 2), (40, 150, 3)]), " SELECT row, col, CASE WHEN value > -1 AND value <= 50 THEN 1e0 WHEN value > 50 AND value <= 100 THEN 2e0 WHEN value > 40 AND value <= 150 THEN 3e0 END AS value FROM dem", "dem")
_MIRROR = """, e AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM dem), o AS (SELECT r.generate_series AS dr, c.generate_series AS dc FROM generate_series(-1, 1) r, generate_series(-1, 1) c),
 x AS (SELECT d.row, d.col, d.value, CASE WHEN d.row + dr < 0 THEN 0 WHEN d.row + dr >= h THEN h - 1 ELSE d.row + dr END AS r2, CASE WHEN d.col + dc < 0 THEN 0 WHEN d.col + dc >= w THEN w - 1 ELSE d.col + dc END AS c2 FROM dem d, o, e),
 n AS (SELECT x.row, x.col, x.value, coalesce(d.value, -99999) AS near FROM x JOIN dem d ON d.row = x.r2 AND d.col = x.c2)"""
def _filtered(kind: str):
    return lambda cells: simple_filter(cells, kind)


for _kind, _agg in (("mean", "avg(near)"), ("median", "quantile_cont(near, 0.5)"), ("min", "min(near)"), ("max", "max(near)")):
    _q(f"simple_filter_{_kind}", _filtered(_kind), _MIRROR + f" SELECT row, col, CASE WHEN value IS NOT NULL THEN round({_agg}, 6) END AS value FROM n GROUP BY row, col, value", "dem")
_q("wiener_filter", wiener_filter, """, o AS (SELECT r.generate_series AS dr, c.generate_series AS dc FROM generate_series(-1, 1) r, generate_series(-1, 1) c), z AS (SELECT row, col, value AS own, coalesce(value, 0) AS v FROM dem),
 l AS (SELECT z.row, z.col, any_value(z.own) AS own, any_value(z.v) AS v, sum(t.v) / 9 AS mu, sum(t.v * t.v) / 9 AS sq FROM z, o JOIN z t ON t.row = z.row + dr AND t.col = z.col + dc GROUP BY z.row, z.col), k AS (SELECT *, sq - mu * mu AS var FROM l), m AS (SELECT *, avg(var) OVER () AS noise FROM k)
 SELECT row, col, CASE WHEN own IS NOT NULL THEN round(CASE WHEN var < noise THEN mu ELSE mu + (1 - noise / var) * (v - mu) END, 6) END AS value FROM m""", "dem")
_q("anisotropic_diffusion", lambda a: anisotropic_diffusion(a, 1), """, n AS (SELECT d.row, d.col, sum(exp(-pow((t.value - d.value) / 50, 2)) * (t.value - d.value)) AS ch FROM dem d JOIN dem t ON (abs(t.row - d.row) + abs(t.col - d.col)) = 1 AND t.row BETWEEN d.row - 1 AND d.row + 1 AND t.col BETWEEN d.col - 1 AND d.col + 1 WHERE t.value IS NOT NULL AND d.value IS NOT NULL GROUP BY d.row, d.col)
 SELECT d.row, d.col, round(d.value + 0.25 * coalesce(ch, 0), 6) AS value FROM dem d LEFT JOIN n ON n.row = d.row AND n.col = d.col""", "dem")
_DISK = ", o AS (SELECT r.generate_series AS dr, c.generate_series AS dc FROM generate_series(-2, 2) r, generate_series(-2, 2) c WHERE r.generate_series * r.generate_series + c.generate_series * c.generate_series <= 4)"
_q("binary_closing", lambda a: binary_closing(a.withColumn("value", F.when(F.col("value") > 170, 1).otherwise(0)), 2.0), _DISK + """, b AS (SELECT row, col FROM dem WHERE value > 170), d AS (SELECT DISTINCT t.row, t.col FROM b, o, dem t WHERE t.row = b.row + dr AND t.col = b.col + dc),
 e AS (SELECT t.row, t.col FROM dem t, o, d WHERE d.row = t.row + dr AND d.col = t.col + dc GROUP BY t.row, t.col HAVING count(*) = 13) SELECT t.row, t.col, CAST(e.row IS NOT NULL AS INT) AS value FROM dem t LEFT JOIN e ON e.row = t.row AND e.col = t.col""", "dem")
_CELLS = "SELECT fid, CAST(fid * 7 % 45 AS INT) AS row, CAST(fid * 11 % 55 AS INT) AS col FROM points"
_pts = lambda p: p.selectExpr("fid", "int(fid * 7 % 45) row", "int(fid * 11 % 55) col")
_q("focal_mean", lambda a, p: focal_mean(a, _pts(p), 5, 3), f", p AS ({_CELLS}) SELECT p.fid, CASE WHEN count(d.row) = 15 THEN round(avg(d.value), 6) END AS value FROM p LEFT JOIN dem d ON d.row BETWEEN p.row - 1 AND p.row + 1 AND d.col BETWEEN p.col - 2 AND p.col + 2 GROUP BY p.fid", "dem", "points")
_q("sample_raster", lambda a, p: sample(a, _pts(p)), f", p AS ({_CELLS}) SELECT p.row, p.col, p.fid, d.value FROM p LEFT JOIN dem d ON d.row = p.row AND d.col = p.col", "dem", "points")
_q("burn_line_z", lambda a, v: burn_line_z(a, v.selectExpr("fid", "pos", "int(fid % 40) row", "int(pos % 50) col", "z"), offset=3.0), ", v AS (SELECT CAST(fid % 40 AS INT) AS row, CAST(pos % 50 AS INT) AS col, arg_max(z, fid * 1000000 + pos) AS z FROM verts GROUP BY 1, 2) SELECT d.row, d.col, round(coalesce(v.z + 3, d.value), 6) AS value FROM dem d LEFT JOIN v ON v.row = d.row AND v.col = d.col", "dem", "verts")
_SEGS = "SELECT s_suppkey AS fid, CAST(s_suppkey * 7 % 40 AS INT) AS r0, CAST(s_suppkey * 11 % 50 AS INT) AS c0, CAST(s_suppkey * 13 % 40 AS INT) AS r1, CAST(s_suppkey * 17 % 50 AS INT) AS c1 FROM supplier"
_segs = lambda s: s.selectExpr("fid", "int(fid * 7 % 40) r0", "int(fid * 11 % 50) c0", "int(fid * 13 % 40) r1", "int(fid * 17 % 50) c1")
_RAST = f", l AS ({_SEGS}), w AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0), 1) AS n FROM l), i AS (SELECT *, unnest(generate_series(0, n)) AS i FROM w), c AS (SELECT CAST(floor(r0 + CAST(r1 - r0 AS DOUBLE) * i / n + 0.5) AS INT) AS row, CAST(floor(c0 + CAST(c1 - c0 AS DOUBLE) * i / n + 0.5) AS INT) AS col, min(fid) AS value FROM i GROUP BY 1, 2)"
_q("rasterize_network", lambda a, s: rasterize_network(a, _segs(s)), _RAST + " SELECT d.row, d.col, coalesce(c.value, 0) AS value FROM dem d LEFT JOIN c ON c.row = d.row AND c.col = d.col", "dem", "segs")
QUERIES["drape_vectors"] = lambda spark, sf_dir: _round(drape(load(spark, sf_dir, "segs").selectExpr("fid", "fid * 7 % 40 + 0.3D ax", "fid * 11 % 40 + 0.6D ay", "fid * 13 % 40 + 0.4D bx", "fid * 17 % 40 + 0.1D by_"), load(spark, sf_dir, "dem")))
