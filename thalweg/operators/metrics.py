"""Metrics along lines and profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.statistics import f_survival
from ..plans.iterate import relax
from ..sources.derived import load, sql
from .vector import to_lines


def line_z_slope(verts: DataFrame) -> DataFrame:
    """Vertices (fid, pos, x, y, z) with z replaced by the upstream-positive slope: centred differences over planar length, ends as their neighbours; 0 on lines of two vertices or fewer."""
    order = Window.partitionBy("fid").orderBy("pos")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    rows = verts.withColumns({"d0": step, "z0": F.lag("z").over(order), "z1": F.lead("z").over(order), "n": F.count("*").over(Window.partitionBy("fid"))})
    rows = rows.withColumn("d1", F.lead("d0").over(order)).withColumn("s", (F.col("z0") - F.col("z1")) / (F.col("d0") + F.col("d1")))
    value = F.when(F.col("n") <= 2, 0.0).otherwise(F.coalesce("s", F.when(F.col("z0").isNull(), F.lead("s").over(order)).otherwise(F.lag("s").over(order))))
    return rows.withColumn("z", value).drop("d0", "d1", "z0", "z1", "n", "s")


def knick_points(lines: DataFrame, min_dz: float = 5.0, min_rse: float = 2.0, min_total: float = 1.0, nodata: float = -99999.0) -> DataFrame:
    """(fid, x, y, z, dz, rse): vertices of profiles where relative slope extension reaches min_rse.

    A fold over each line keeps the last vertex retained: a vertex less than min_dz below it is passed over.
    """
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    rset = (first["z"] - last["z"]) / F.greatest(F.lit(1e-4), F.log(g.length(F.col("geom"))))
    rows = lines.withColumn("rset", rset).where(F.col("rset") >= min_total)
    none = F.array().cast("array<struct<x:double,y:double,z:double,dz:double,hgi:double>>")
    zero = F.struct(first.alias("v"), F.lit(0.0).alias("far"), none.alias("out"))

    def step(acc: Column, v: Column) -> Column:
        dz, dl = acc["v"]["z"] - v["z"], g.distance(acc["v"], v)
        skip = F.coalesce((v["z"] == nodata) | (dz < min_dz) | (dl <= 0), F.lit(True))
        far = acc["far"] + dl
        point = F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), dz.alias("dz"), (dz / dl * far).alias("hgi"))
        return F.when(skip, acc).otherwise(F.struct(v.alias("v"), far.alias("far"), F.array_append(acc["out"], point).alias("out")))

    inner = F.slice("geom", F.lit(2), F.greatest(F.size("geom") - 2, F.lit(0)))
    found = rows.select("fid", "rset", F.inline(F.aggregate(inner, zero, step, lambda acc: acc["out"])))
    return found.withColumn("rse", F.col("hgi") / F.col("rset")).where(F.col("rse") >= min_rse).select("fid", "x", "y", "z", "dz", "rse")


def orthogonal_transects(segments: DataFrame, length: float | str = 200.0) -> DataFrame:
    """(fid, ax, ay, bx, by_): a transect about the middle of each segment, across its chord; nulls where the chord has no length."""
    size = F.expr(str(length)).cast("double")
    chord = F.hypot(F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"))
    ux, uy = (F.col("bx") - F.col("ax")) / F.when(chord > 0, chord), (F.col("by_") - F.col("ay")) / F.when(chord > 0, chord)
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by_")) / 2
    return segments.select("fid", (mx - uy * size / 2).alias("ax"), (my + ux * size / 2).alias("ay"), (mx + uy * size / 2).alias("bx"), (my - ux * size / 2).alias("by_"))


def maximum_on_shortest_path(edges: DataFrame, targets: DataFrame, cap: float = 60.0) -> DataFrame:
    """(node, distance, max_cost): for every node the way to the nearest target (node) over edges (nodea, nodeb, length, cost) with cost < cap, both ways; one relaxation from all targets serves all nodes."""
    one = edges.where(F.col("cost") < cap).select(F.col("nodea").alias("src"), F.col("nodeb").alias("dst"), F.col("length").alias("len"), F.col("cost").cast("double").alias("unit"))
    both = one.union(one.select("dst", "src", "len", "unit")).select("src", "dst", F.col("len").alias("cost"), "unit")
    far = relax(targets.select("node", F.lit(0.0).alias("value")), both, "min", extra="unit")
    nodes = edges.select(F.col("nodea").alias("node")).union(edges.select("nodeb")).distinct().join(targets, "node", "left_anti")
    return nodes.join(far, "node", "left").select("node", F.col("value").alias("distance"), F.coalesce(F.col("worst"), F.lit(cap)).alias("max_cost"))


#: Ends of segments that are looked at together.
WIDE = 256


#: Points above which segments are looked for by penalties.
SHORT = 400


def segment_breaks(x: np.ndarray, kmax: int) -> list[int]:
    """Starts of the optimal piecewise-constant segments of x, their number by the Bayesian criterion."""
    n = len(x)
    if n < 3 or kmax < 2:
        return [0]
    s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
    found = _by_penalties(x, s, q, min(kmax + 1, n)) if n > SHORT else None
    return _by_levels(n, s, q, kmax) if found is None else found


def _penalised(s: np.ndarray, q: np.ndarray, penalty: float) -> tuple[int, float, list[int]]:
    """(number, error, starts) of the segments with the least error plus penalty for each; starts that can't be the last one any more are passed over."""
    n = len(s) - 1
    best, back, tried = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.zeros(1, np.int64)
    best[0] = -penalty
    slack = 1e-9 * (1 + abs(q[n]))
    for t in range(1, n + 1):
        gap = s[t] - s[tried]
        value = best[tried] + (q[t] - q[tried] - gap * gap / (t - tried))
        j = int(np.argmin(value))
        best[t], back[t] = value[j] + penalty, tried[j]
        tried = np.append(tried[value <= best[t] + slack], t)
    at, starts, error = n, [], 0.0
    while at:
        low = int(back[at])
        error += q[at] - q[low] - (s[at] - s[low]) ** 2 / (at - low)
        starts.append(low)
        at = low
    return len(starts), error, starts[::-1]


def _by_penalties(x: np.ndarray, s: np.ndarray, q: np.ndarray, most: int) -> list[int] | None:
    """The starts that _by_levels finds, without going through all numbers of segments; null where that can't be told.

    The criterion is concave in number and error and rises with both, so its least value is at a corner of the lower
    hull of (number, least error), and each corner is the best for some penalty. A stretch of the hull is looked into
    while the corner of its tangents, which nothing in it can be below, might be better than the best so far.
    """
    n = len(x)
    score = lambda k, c: n * np.log(max(c, 1e-12) / (n - 1)) + 2 * k * np.log(n)
    runs = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1))
    ends = [(1, q[n] - s[n] ** 2 / n, [0]), (len(runs), 0.0, runs.tolist())]
    best = min((score(k, c), k, starts) for k, c, starts in ends if k <= most)
    todo = [(*ends[0][:2], np.inf, *ends[1][:2], 0.0)]
    while todo:
        ka, ca, pa, kb, cb, pb = todo.pop()
        if kb - ka < 2 or ka >= most:
            continue
        k = ka if pa == np.inf else min(kb, max(ka, (ca - cb + pa * ka - pb * kb) / (pa - pb))) if pa > pb else ka
        low = lambda at: cb + pb * (kb - at) if at >= k else ca - pa * (at - ka)  # noqa: B023, E731
        if min(score(at, low(at)) for at in {min(k, most), min(kb, most)}) >= best[0]:
            continue
        penalty = (ca - cb) / (kb - ka)
        new, error, starts = _penalised(s, q, penalty)
        if not ka < new < kb or error + penalty * new >= ca + penalty * ka - 1e-9 * (1 + abs(ca)):
            # Nothing is below the chord; what lies above it is no corner, unless the numbers end within.
            if kb > most and min(score(at, ca - penalty * (at - ka)) for at in (ka + 1, most)) < best[0]:
                return None
            continue
        if new <= most:
            best = min(best, (score(new, error), new, starts))
        todo += [(new, error, penalty, kb, cb, pb), (ka, ca, pa, new, error, penalty)]
    return best[2]


def _by_levels(n: int, s: np.ndarray, q: np.ndarray, kmax: int) -> list[int]:
    """Starts of the best segments by dynamic programming over their number."""

    def cost(low: int, high: int) -> np.ndarray:
        """The errors of segments from each start to the ends low to high - 1."""
        i, j = np.arange(high)[:, None], np.arange(low, high)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
        out[i >= j] = np.inf
        return out

    levels = min(kmax + 1, n)
    best, back, scores = np.full((levels, n + 1), np.inf), np.zeros((levels - 1, n + 1), np.int32), []
    # Ends go in blocks, so that memory is that of a block's errors and of the levels.
    for low in range(0, n + 1, WIDE):
        high = min(low + WIDE, n + 1)
        errors = cost(low, high)
        best[0, low:high] = errors[0]
        for k in range(1, levels):
            total = best[k - 1, :high, None] + errors
            back[k - 1, low:high] = np.argmin(total, axis=0)
            best[k, low:high] = np.min(total, axis=0)
    for k, c in enumerate(best, 1):
        scores.append(n * np.log(max(c[n], 1e-12) / (n - 1)) + 2 * k * np.log(n))
    k, at, cuts = int(np.argmin(scores)), n, []
    for level in range(k, 0, -1):
        at = int(back[level - 1][at])
        cuts.append(at)
    return [0, *reversed(cuts)]


def _segmented(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).sort_by([("ord", "ascending"), ("fid", "ascending")])
    x = rows["metric"].to_numpy().astype(float)
    starts = segment_breaks(x, max(1, len(x) // 3))
    part = np.searchsorted(starts, np.arange(len(x)), side="right")
    yield from pa.table({"axis": pa.array([key[0].as_py()] * len(x), pa.int64()), "fid": rows["fid"], "ago": pa.array(part, pa.int64()), "metric": rows["metric"]}).to_batches()


def aggregate_features(series: DataFrame, dissolve: bool = False) -> DataFrame:
    """(axis, fid, ago, metric) for series (axis, fid, ord, metric), or with dissolve (axis, ago, n, mean, std).

    An axis, one series by nature, is segmented by dynamic programming in one task; null metrics are left out.
    """
    rows = series.where("metric is not null").selectExpr("cast(axis as bigint) axis", "cast(fid as bigint) fid", "cast(ord as double) ord", "cast(metric as double) metric")
    out = rows.groupBy("axis").applyInArrow(_segmented, "axis bigint, fid bigint, ago bigint, metric double")
    return out.groupBy("axis", "ago").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"), F.stddev_pop("metric").alias("std")) if dissolve else out


def _held_against_next(series: DataFrame, alpha: float) -> DataFrame:
    """(axis, ago, k, observed, p, differs): range_test with the number of segments and with rows for the last ones, whose observed is null."""
    parts = series.where("metric is not null").groupBy("axis", "ago").agg(F.count("*").alias("n"), F.avg("metric").alias("mean"), F.var_pop("metric").alias("var"))
    order = Window.partitionBy("axis").orderBy("ago")
    after = {f"{c}2": F.lead(c).over(order) for c in ("n", "mean", "var")}
    pairs = parts.withColumns(after | {"k": F.count("*").over(Window.partitionBy("axis"))})
    n = F.col("n") + F.col("n2")
    gap = F.col("mean2") - F.col("mean")
    var = (F.col("n") * F.col("var") + F.col("n2") * F.col("var2")) / n + F.col("n") * F.col("n2") / (n * n) * gap * gap
    seen = F.abs(gap) / F.when(var > 0, F.sqrt(var * (1 / F.col("n") + 1 / F.col("n2"))))
    left = (n - F.col("k")).cast("double")
    tried = pairs.select("axis", "ago", "k", F.col("n2").isNotNull().alias("followed"), seen.alias("observed"), (F.col("k") - 1).cast("double").alias("df1"), F.when(left > 0, left).otherwise(-left + 0.01).alias("df2"))
    p = f_survival(F.col("observed"), F.col("df1"), F.col("df2"))
    return tried.withColumn("p", F.when(F.col("followed"), p)).select("axis", "ago", "k", "followed", "observed", "p", F.coalesce(F.col("p") <= alpha, F.lit(False)).alias("differs"))


def range_test(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(axis, ago, observed, p, differs) for series (axis, ago, metric): whether each segment's mean differs from the next one's.

    observed is the difference of the means over its standard error, the variance being that of both together; it
    is held against the F distribution with (segments - 1) and (values of both - segments) degrees of freedom; if
    those are not above 0, their amount plus 0.01 stands for them. Constant segments have no p and don't differ.
    The last segment of an axis has no row; nor has an axis of one segment.
    """
    return _held_against_next(series, alpha).where("followed").select("axis", "ago", "observed", "p", "differs")


def hubert_test(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(axis, segments, accepted): the segmentation of aggregate_features, accepted if it has two segments or more and each differs from the next."""
    tests = _held_against_next(aggregate_features(series), alpha)
    return tests.groupBy("axis").agg(F.max("k").alias("segments"), F.coalesce(F.min(F.when(F.col("followed"), F.col("differs"))), F.lit(False)).alias("accepted"))


def bends(verts: DataFrame) -> DataFrame:
    """(fid, bend, n, length, wave, sinuosity, amplitude): stretches of a line between changes of its turn's sign.

    Wave is twice the chord, sinuosity twice the length over the wave, amplitude the largest distance to the chord.
    """
    order = Window.partitionBy("fid").orderBy("pos")
    rows = verts.withColumns({"px": F.lag("x").over(order), "py": F.lag("y").over(order), "nx": F.lead("x").over(order), "ny": F.lead("y").over(order)})
    turn = F.signum((F.col("x") - F.col("px")) * (F.col("ny") - F.col("y")) - (F.col("y") - F.col("py")) * (F.col("nx") - F.col("x")))
    rows = rows.withColumn("turn", F.when(turn != 0, turn)).withColumn("turn", F.last("turn", ignorenulls=True).over(order))
    change = F.when(F.col("turn") != F.lag("turn").over(order), 1).otherwise(0)
    rows = rows.withColumn("change", change).withColumn("bend", F.sum("change").over(order))
    rows = rows.withColumn("step", F.when(F.lag("bend").over(order) == F.col("bend"), F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).otherwise(0.0))
    ends = rows.groupBy("fid", "bend").agg(F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"), F.count("*").alias("n"), F.sum("step").alias("length"))
    chord = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    far = F.abs(g.cross(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))) / F.when(F.col("chord") > 0, F.col("chord"))
    out = rows.select("fid", "bend", "x", "y").join(ends.withColumn("chord", chord), ["fid", "bend"]).groupBy("fid", "bend", "n", "length", "chord").agg(F.max(F.coalesce(far, F.hypot(F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")))).alias("amplitude"))
    return out.select("fid", "bend", "n", "length", (F.col("chord") * 2).alias("wave"), (F.col("length") / F.when(F.col("chord") > 0, F.col("chord"))).alias("sinuosity"), "amplitude")


def _round(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs, recursive=recursive)


_q("line_z_slope", lambda v: line_z_slope(v).select("fid", "pos", "z"), """, a AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d0, lag(z) OVER w AS z0, lead(z) OVER w AS z1 FROM verts WINDOW w AS (PARTITION BY fid ORDER BY pos)),
 b AS (SELECT *, (z0 - z1) / (d0 + lead(d0) OVER w) AS s, count(*) OVER (PARTITION BY fid) AS n FROM a WINDOW w AS (PARTITION BY fid ORDER BY pos)), c AS (SELECT *, lead(s) OVER w AS sn, lag(s) OVER w AS sp FROM b WINDOW w AS (PARTITION BY fid ORDER BY pos))
 SELECT fid, pos, round(CASE WHEN n <= 2 THEN 0 ELSE coalesce(s, CASE WHEN z0 IS NULL THEN sn ELSE sp END) END, 5) AS z FROM c""", "verts")
_q("orthogonal_transects", lambda s: orthogonal_transects(s, 40), ", c AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS d FROM segs) SELECT fid, round((ax + bx) / 2 - (by_ - ay) / d * 20, 5) AS ax, round((ay + by_) / 2 + (bx - ax) / d * 20, 5) AS ay, round((ax + bx) / 2 + (by_ - ay) / d * 20, 5) AS bx, round((ay + by_) / 2 - (bx - ax) / d * 20, 5) AS by_ FROM c", "segs")
_KNICK = """, v AS (SELECT fid, pos, x, y, 1000 - x / 10 - z / 20 AS z, count(*) OVER (PARTITION BY fid) AS n FROM verts), t AS (SELECT fid, (arg_min(z, pos) - arg_max(z, pos)) / greatest(1e-4, ln(sum(d))) AS rset FROM (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS d FROM v WINDOW w AS (PARTITION BY fid ORDER BY pos)) GROUP BY fid),
 r AS (SELECT fid, pos, x, y, z, 0e0 AS far, false AS hit, 0e0 AS dz, 0e0 AS dl FROM v WHERE pos = 1 UNION ALL SELECT fid, pos, CASE WHEN hit THEN vx ELSE x END, CASE WHEN hit THEN vy ELSE y END, CASE WHEN hit THEN vz ELSE z END, CASE WHEN hit THEN far + dl ELSE far END, hit, dz, dl FROM
 (SELECT *, dz >= 2 AND dl > 0 AS hit FROM (SELECT v.fid, v.pos, r.x, r.y, r.z, r.far, v.x AS vx, v.y AS vy, v.z AS vz, r.z - v.z AS dz, sqrt(pow(v.x - r.x, 2) + pow(v.y - r.y, 2)) AS dl FROM r JOIN v ON v.fid = r.fid AND v.pos = r.pos + 1 WHERE v.pos < v.n)))
 SELECT r.fid, x, round(y, 5) AS y, round(z, 5) AS z, round(dz, 5) AS dz, round(dz / dl * far / rset, 5) AS rse FROM r JOIN t ON t.fid = r.fid WHERE hit AND rset >= 5e-1 AND dz / dl * far / rset >= 5e-1"""
_q("knick_points", lambda v: knick_points(to_lines(v.withColumn("z", F.lit(1000.0) - F.col("x") / 10 - F.col("z") / 20)), 2.0, 1.0, 0.5), _KNICK.replace("rset >= 5e-1 AND dz / dl * far / rset >= 5e-1", "rset >= 5e-1 AND dz / dl * far / rset >= 1"), "verts", recursive=True)
# The links are a tree, so ways from a target never meet again.
_SHORT = """, e AS (SELECT nodea AS a, nodeb AS b, length, CAST(fid % 61 AS DOUBLE) AS cost FROM links WHERE fid % 61 < 60), u AS (SELECT a, b, length, cost FROM e UNION ALL SELECT b, a, length, cost FROM e), t AS (SELECT nodea AS node FROM links WHERE nodea % 500 = 3),
 p AS (SELECT node, node AS prev, 0e0 AS dist, -1e0 AS worst FROM t UNION ALL SELECT u.b, p.node, p.dist + u.length, greatest(p.worst, u.cost) FROM p JOIN u ON u.a = p.node AND u.b <> p.prev), n AS (SELECT nodea AS node FROM links UNION SELECT nodeb FROM links)
 SELECT n.node, round(min(dist), 5) AS distance, coalesce(arg_min(worst, dist), 60) AS max_cost FROM n LEFT JOIN p ON p.node = n.node WHERE n.node NOT IN (SELECT node FROM t) GROUP BY n.node"""
_q("maximum_on_shortest_path", lambda k: maximum_on_shortest_path(k.withColumn("cost", F.expr("fid % 61")), k.where("nodea % 500 = 3").select(F.col("nodea").alias("node"))), _SHORT, "links", recursive=True)
_q("aggregate_features", lambda v: aggregate_features(v.selectExpr("fid axis", "pos fid", "pos ord", "y metric")).select("axis", "fid", "ago"), None, "verts")
_q("aggregate_features_dissolve", lambda v: aggregate_features(v.selectExpr("fid axis", "pos fid", "pos ord", "y metric"), True), None, "verts")
#: Bends of the vertices of a table b0 (fid, pos, x, y).
BENDS_SQL = """, b1 AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM b0 WINDOW w AS (PARTITION BY fid ORDER BY pos)),
 b2 AS (SELECT *, nullif(sign((x - px) * (ny - y) - (y - py) * (nx - x)), 0) AS t0 FROM b1), b3 AS (SELECT *, last_value(t0 IGNORE NULLS) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM b2),
 b4 AS (SELECT *, CASE WHEN turn <> lag(turn) OVER (PARTITION BY fid ORDER BY pos) THEN 1 ELSE 0 END AS change FROM b3), b5 AS (SELECT *, sum(change) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bend FROM b4),
 b6 AS (SELECT *, CASE WHEN lag(bend) OVER (PARTITION BY fid ORDER BY pos) = bend THEN sqrt((x - px) * (x - px) + (y - py) * (y - py)) ELSE 0 END AS step FROM b5),
 b7 AS (SELECT fid, bend, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS by_, count(*) AS n, sum(step) AS length FROM b6 GROUP BY 1, 2), b8 AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS chord FROM b7)
 SELECT b8.fid, CAST(b8.bend AS BIGINT) AS bend, n, round(length, 5) AS length, round(chord * 2, 5) AS wave, round(CASE WHEN chord > 0 THEN length / chord END, 5) AS sinuosity,
 round(max(CASE WHEN chord > 0 THEN abs((b6.x - ax) * (by_ - ay) - (b6.y - ay) * (bx - ax)) / chord ELSE sqrt((b6.x - ax) * (b6.x - ax) + (b6.y - ay) * (b6.y - ay)) END), 5) AS amplitude
 FROM b8 JOIN b6 ON b6.fid = b8.fid AND b6.bend = b8.bend GROUP BY b8.fid, b8.bend, n, length, chord"""
_q("planform_bends", bends, ", b0 AS (SELECT fid, pos, x, y FROM verts)" + BENDS_SQL, "verts")
# F has closed forms for two degrees above: (1 + 2x / df2) ** (-df2 / 2), which three segments give.
_THREE = ", s AS (SELECT fid AS axis, CAST(floor((pos - 1) * 3 / count(*) OVER (PARTITION BY fid)) AS BIGINT) AS ago, y AS metric FROM verts), m AS (SELECT axis, ago, count(*) AS n, avg(metric) AS mean, var_pop(metric) AS v FROM s GROUP BY 1, 2)"
_q("range_test", lambda v: range_test(v.selectExpr("fid axis", "y metric", "bigint(floor((pos - 1) * 3 / count(*) over (partition by fid))) ago")).withColumn("differs", F.col("differs").cast("int")), _THREE + """, q AS (SELECT *, lead(n) OVER w AS n2, lead(mean) OVER w AS m2, lead(v) OVER w AS v2, count(*) OVER (PARTITION BY axis) AS k FROM m WINDOW w AS (PARTITION BY axis ORDER BY ago)),
 o AS (SELECT axis, ago, k, CASE WHEN n + n2 > k THEN n + n2 - k ELSE k - n - n2 + 1e-2 END AS df, abs(m2 - mean) / sqrt(((n * v + n2 * v2) / (n + n2) + n * n2 * pow(m2 - mean, 2) / pow(n + n2, 2)) * (1e0 / n + 1e0 / n2)) AS observed FROM q WHERE n2 IS NOT NULL)
 SELECT axis, ago, round(observed, 5) AS observed, round(pow(1 + 2 * observed / df, -df / 2), 5) AS p, CAST(pow(1 + 2 * observed / df, -df / 2) <= 5e-2 AS INT) AS differs FROM o""", "verts")
_q("hubert_test", lambda v: hubert_test(v.selectExpr("fid axis", "pos fid", "pos ord", "y metric")), None, "verts")
