"""Terrain operators on cell tables: D8 flow as a functional graph, distances by relaxation, depressions by fixpoint.

Nodata is null in value rasters and -1 in flow rasters. Chains are followed by pointer jumping and sums by
doubling, so rounds are the logarithm of the longest path; no operator gathers a band or a basin.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid
from ..plans.iterate import cut, drop, jump, some
from ..plans.spatial_join import nearest
from ..sources.derived import load, sql
from .network import sum_upstream
from .raster import KEYS, rasterize

DIAGONAL = 2**0.5


def flow_direction(dem: DataFrame) -> DataFrame:
    """(row, col, d8): the code of the lowest neighbour below the cell, the first from north clockwise of equal ones; 0 without one, -1 for nodata."""
    known = dem.where("value is not null")
    low = grid.neighbours(known, "value").groupBy(*KEYS).agg(F.min(F.struct("near", "k")).alias("low"))
    code = F.when(F.col("value").isNull(), -1).when(F.col("low.near") < F.col("value"), F.pow(F.lit(2.0), F.col("low.k"))).otherwise(0)
    return dem.join(low, KEYS, "left").select("row", "col", code.cast("int").alias("d8"))


def flow_accumulation(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """(row, col, acc): cells (or their weights) above and at each cell; 0 at nodata."""
    steps = grid.downstream(flow)
    valid = flow.where("d8 >= 0").select(grid.cell("row", "col").alias("id"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    total = sum_upstream(steps.join(valid.select("id"), "id", "left_semi"), valid)
    out = flow.select("row", "col", grid.cell("row", "col").alias("id")).join(total, "id", "left")
    return out.select("row", "col", F.coalesce("total", F.lit(0.0)).alias("acc"))


def watershed(target: DataFrame, flow: DataFrame) -> DataFrame:
    """(row, col, value): target's values, and at its zero cells the value of the first valued cell downstream, else 0."""
    held = target.where("value is not null and value <> 0").select(grid.cell("row", "col").alias("id"), F.col("value").alias("held"))
    root = jump(grid.downstream(flow).join(held, "id", "left"), stop=F.col("held").isNotNull())
    ends = root.join(held.toDF("root", "held"), "root", "left").select("id", "held")
    out = target.select("row", "col", "value", grid.cell("row", "col").alias("id")).join(ends, "id", "left")
    return out.select("row", "col", F.coalesce(F.when(F.col("value") != 0, F.col("value")), "held", F.lit(0)).alias("value"))


def watershed_max(target: DataFrame, reference: DataFrame, flow: DataFrame, fill: float = -99999.0) -> DataFrame:
    """As watershed from cells other than fill, but upstream the value becomes the largest reference on the way down to the valued cell, or its value."""
    held = target.where(F.col("value").isNotNull() & (F.col("value") != fill)).select(grid.cell("row", "col").alias("id"), F.col("value").alias("held"))
    ref = reference.select(grid.cell("row", "col").alias("id"), F.col("value").alias("most"))
    steps = grid.downstream(flow).join(held, "id", "left").join(ref, "id", "left")
    root = jump(steps, stop=F.col("held").isNotNull(), carry={"most": "max"})
    ends = root.join(held.toDF("root", "held"), "root").select("id", F.greatest("held", "most").alias("found"))
    out = target.select("row", "col", "value", grid.cell("row", "col").alias("id")).join(ends, "id", "left")
    return out.select("row", "col", F.coalesce(F.when(F.col("value") != fill, F.col("value")), "found", F.lit(fill)).alias("value"))


def relative_by_flow(dem: DataFrame, stream: DataFrame, flow: DataFrame) -> DataFrame:
    """(row, col, value): height over the first stream cell (row, col) downstream; null without one."""
    z = dem.select(grid.cell("row", "col").alias("id"), F.col("value").alias("z"))
    held = stream.select(grid.cell("row", "col").alias("id")).distinct().join(z, "id")
    root = jump(grid.downstream(flow).join(held.select("id", F.lit(1).alias("on")), "id", "left"), stop=F.col("on").isNotNull())
    ends = root.join(held.toDF("root", "ref"), "root").select("id", "ref")
    out = dem.select("row", "col", "value", grid.cell("row", "col").alias("id")).join(ends, "id", "left")
    return out.select("row", "col", (F.col("value") - F.col("ref")).alias("value"))


def nearest_cells(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, col, trow, tcol, dist): the nearest target cell, ties by (trow, tcol)."""
    aims = targets.select(F.col("row").alias("trow"), F.col("col").alias("tcol")).distinct()
    if not some(aims):
        return cells.select("row", "col", F.lit(None).cast("int").alias("trow"), F.lit(None).cast("int").alias("tcol"), F.lit(None).cast("double").alias("dist"))
    at = lambda c: F.col(c).cast("double")
    points = cells.select(F.struct(*KEYS).alias("cell"), at("col").alias("x"), at("row").alias("y"))
    sites = aims.select(F.struct("trow", "tcol").alias("site"), at("tcol").alias("ax"), at("trow").alias("ay"), at("tcol").alias("bx"), at("trow").alias("by_"))
    return nearest(points, sites, "cell", "site").select("cell.row", "cell.col", "site.trow", "site.tcol", "dist")


def relative_dem(dem: DataFrame, stream: DataFrame) -> DataFrame:
    """(row, col, value): height over the nearest stream cell with data."""
    z = dem.where("value is not null").select(F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("value").alias("ref"))
    on = stream.join(z.select(F.col("trow").alias("row"), F.col("tcol").alias("col")), KEYS, "left_semi")
    return dem.join(nearest_cells(dem, on), KEYS).join(z, ["trow", "tcol"]).select("row", "col", (F.col("value") - F.col("ref")).alias("value"))


def detrend_dem(dem: DataFrame, stations: DataFrame, half: int = 7) -> DataFrame:
    """(row, col, value): height over the mean of a window about the nearest station (row, col)."""
    near = nearest_cells(dem, stations)
    span = F.flatten(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda a: F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda b: F.struct(a.alias("dr"), b.alias("dc")))))
    wanted = stations.select(F.col("row").alias("trow"), F.col("col").alias("tcol")).distinct().withColumn("s", F.explode(span)).select("trow", "tcol", (F.col("trow") + F.col("s.dr")).alias("row"), (F.col("tcol") + F.col("s.dc")).alias("col"))
    means = wanted.join(dem, KEYS).groupBy("trow", "tcol").agg(F.avg("value").alias("ref"))
    return dem.join(near, KEYS).join(means, ["trow", "tcol"]).select("row", "col", (F.col("value") - F.col("ref")).alias("value"))


def distance_to_stream(dem: DataFrame, segments: DataFrame, signed: bool = False, resolution: float = 1.0) -> DataFrame:
    """(row, col, value): distance to the nearest cell of the rasterised segments (fid, r0, c0, r1, c1); signed: negative right of its segment."""
    burnt = rasterize(segments)
    near = nearest_cells(dem, burnt)
    out = dem.join(near, KEYS)
    dist = F.when(F.col("value").isNotNull(), F.col("dist") * resolution)
    if not signed:
        return out.select("row", "col", dist.alias("value"))
    of = burnt.select(F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("value").alias("fid")).join(segments, "fid")
    side = (F.col("c1") - F.col("c0")) * (F.col("row") - F.col("r0")) - (F.col("r1") - F.col("r0")) * (F.col("col") - F.col("c0"))
    return out.join(of, ["trow", "tcol"], "left").select("row", "col", F.when(side > 0, -dist).otherwise(dist).alias("value"))


def grid_steps(cells: DataFrame, cost: Column | None = None, same: str | None = None) -> DataFrame:
    """Steps (src, dst, cost) between neighbouring cells with data: 1 or sqrt(2), times the entered cell's cost; with `same`, only within one value of that column."""
    cols = [same] if same else []
    known = cells.select("row", "col", *cols, (F.lit(1.0) if cost is None else cost.cast("double")).alias("unit"))
    packed = known.withColumn("here", F.struct(grid.cell("row", "col").alias("id"), *cols))
    near = grid.neighbours(packed, "here").join(known.withColumn("me", grid.cell("row", "col")), KEYS)
    if same:
        near = near.where(F.col(f"near.{same}") == F.col(same))
    return near.select(F.col("near.id").alias("src"), F.col("me").alias("dst"), (F.when(F.col("k") % 2 == 1, DIAGONAL).otherwise(1.0) * F.col("unit")).alias("cost"))


def spread(steps: DataFrame, origins: DataFrame) -> DataFrame:
    """(id, dist, value): least cost from any origin (id, value) and that origin's value, ties to the smaller value.

    Each round the improved cells offer (dist, value) to their neighbours; the least pair wins.
    """
    state = frontier = cut(origins.select("id", F.lit(0.0).alias("dist"), "value"))
    steps = cut(steps)
    while some(frontier):
        offer = F.struct((F.round(F.col("dist") + F.col("cost"), 9)).alias("dist"), "value")
        tried = steps.join(frontier, steps.src == frontier.id).groupBy(F.col("dst").alias("id")).agg(F.min(offer).alias("new"))
        old = state.select("id", F.struct("dist", "value").alias("old"))
        past = state, frontier
        frontier = cut(tried.join(old, "id", "left").where(F.col("old").isNull() | (F.col("new") < F.col("old"))).select("id", "new.*"))
        state = cut(state.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
        drop(*past)
    drop(steps)
    return state


#: Places of a tile, at most, in `spread_tiles`.
TILE = 1 << 17
#: Tables of rounds of `spread_tiles` that are put together once there are as many.
PARTS = 16


def _spread_tile(table: pa.Table) -> pa.Table:
    """What offers change within a tile: rows (id, kind, far, value, zone) are its cells (kind 0), the pairs (far, value) known so far (1) and offers (2).

    far is the distance in 1e-9, so that sums are exact. Cells next to a change are looked at in steps, all of a step at once.
    """
    ids, kind, far, value, zone = (table[c].to_numpy() for c in ("id", "kind", "far", "value", "zone"))
    row, col = ids // grid.WIDTH, ids % grid.WIDTH
    top, left = row.min() - 1, col.min() - 1
    wide = int(col.max() - left) + 2
    size = (int(row.max() - top) + 2) * wide
    place = (row - top) * wide + (col - left)
    own = kind == 0
    known, group = np.zeros(size, bool), np.zeros(size, np.int64)
    known[place[own]], group[place[own]] = True, zone[own]
    best, held = np.full(size, np.iinfo(np.int64).max), np.full(size, np.inf)

    def improve(at: np.ndarray, to: np.ndarray, what: np.ndarray) -> np.ndarray:
        better = known[at] & ((to < best[at]) | ((to == best[at]) & (what < held[at])))
        at = at[better]
        best[at], held[at] = to[better], what[better]
        return at

    for k in (1, 2):
        some = np.flatnonzero(kind == k)
        some = some[np.lexsort((value[some], far[some], place[some]))]
        some = some[np.concatenate(([True], place[some][1:] != place[some][:-1]))[: len(some)]]  # the least of each place
        front = improve(place[some], far[some], value[some])
    changed = np.zeros(size, bool)
    steps = [(dr * wide + dc, 1_414_213_562 if k % 2 else 1_000_000_000) for k, (dr, dc) in enumerate(zip(grid.DROW, grid.DCOL))]
    while len(front):
        changed[front] = True
        moved = [improve(at, best[front][near] + cost, held[front][near]) for step, cost in steps for near in [group[front + step] == group[front]] for at in [(front + step)[near]]]
        front = np.unique(np.concatenate(moved))
    at = np.flatnonzero(changed)
    cells = (at // wide + top) * grid.WIDTH + at % wide + left
    return pa.table({"id": cells, "far": best[at], "value": held[at], "zone": group[at]})


def spread_tiles(cells: DataFrame, origins: DataFrame, same: str | None = None) -> DataFrame:
    """(id, dist, value) as `spread` over grid_steps(cells, same=same) with whole numbers in `same`; values are numbers and become double.

    Tiles of at most TILE places are spread over by themselves, all that have offers at once; what changed next to
    another tile is offered to it. So rounds are the tiles of the longest way, and a round reads and
    writes tiles with offers only.
    """
    kind = dict(origins.dtypes)["value"]
    box = cells.agg(F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1).first()  # one row
    start = cut(origins.select("id", F.lit(0).cast("long").alias("far"), F.col("value").cast("double").alias("value")))
    high, wide = (max(1, int(n or 1)) for n in box)
    side = int(TILE**0.5)
    wide, high = (wide, TILE // wide) if wide <= side else (TILE // high, high) if high <= side else (side, side)
    row, col = grid.row_of(F.col("id")), grid.col_of(F.col("id"))
    tile = F.floor(row / high) * grid.WIDTH + F.floor(col / wide)
    known = cells.select(grid.cell("row", "col").alias("id"), (F.col(same).cast("long") if same else F.lit(0).cast("long")).alias("zone")).where("zone is not null")
    known = cut(known.withColumn("tile", tile))
    rim = (row % high).isin(0, high - 1) | (col % wide).isin(0, wide - 1)
    rims = cut(known.where(rim))
    ways = F.array(*(F.struct(F.lit(dr * grid.WIDTH + dc).cast("long").alias("to"), F.lit(1_414_213_562 if k % 2 else 1_000_000_000).cast("long").alias("cost")) for k, (dr, dc) in enumerate(zip(grid.DROW, grid.DCOL))))
    held = known.select("id", F.lit(None).cast("long").alias("far"), F.lit(None).cast("double").alias("value")).limit(0)
    offers, parts = start.withColumn("tile", tile), []
    cols = ("tile", "id", "kind", "far", "value", "zone")
    none = {"far": F.lit(0).cast("long"), "value": F.lit(0.0), "zone": F.lit(0).cast("long")}
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("far", "value")).alias("p")).select("id", "p.*")
    while some(offers):
        active = F.broadcast(offers.select("tile").distinct())  # one row per tile
        rows = known.join(active, "tile", "left_semi").select("tile", "id", F.lit(0).alias("kind"), none["far"].alias("far"), none["value"].alias("value"), "zone")
        for part in parts:
            rows = rows.union(part.withColumn("tile", tile).join(active, "tile", "left_semi").select("tile", "id", F.lit(1), "far", "value", none["zone"]))
        rows = rows.union(offers.select("tile", "id", F.lit(2), "far", "value", none["zone"])).toDF(*cols)
        out = cut(rows.groupBy("tile").applyInArrow(_spread_tile, "id bigint, far bigint, value double, zone bigint"))
        parts.append(out.select("id", "far", "value"))
        past = held, offers
        edge = out.where(rim)
        held = cut(least(held.union(edge.select("id", "far", "value"))))
        sent = edge.select("zone", tile.alias("of"), "far", "value", "id", F.explode(ways).alias("w")).select("zone", "of", (F.col("id") + F.col("w.to")).alias("id"), (F.col("far") + F.col("w.cost")).alias("far"), "value")
        sent = sent.groupBy("id", "zone", "of").agg(F.min(F.struct("far", "value")).alias("new")).join(rims, ["id", "zone"]).where("of <> tile")
        old = held.select("id", F.struct("far", "value").alias("old"))
        offers = cut(sent.join(old, "id", "left").where("old is null or new < old").select("id", "new.far", "new.value", "tile"))
        drop(*past)
        if len(parts) == PARTS:
            parts = [cut(least(reduce(DataFrame.union, parts)))]
    far = least(reduce(DataFrame.union, parts, start))
    return far.select("id", F.round(F.col("far") / 1e9, 9).alias("dist"), F.col("value").cast(kind).alias("value"))


def _settle_tile(enter: Callable[[float, float, int, float, float], tuple[float, float]]) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow: what offers change within a tile, nearest first, so that a cell is left once whatever the ways.

    Rows (id, kind, far, value, unit, high, zone) are its cells (kind 0), the pairs (far, value) known so far (1) and offers (2):
    pairs of its own cells, or of cells of other tiles next to them.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, kind, far, value, unit, high, zone = (table[c].to_numpy() for c in ("id", "kind", "far", "value", "unit", "high", "zone"))
        row, col = ids // grid.WIDTH, ids % grid.WIDTH
        top, left = row.min() - 1, col.min() - 1
        wide = int(col.max() - left) + 2
        size = (int(row.max() - top) + 2) * wide
        place = (row - top) * wide + (col - left)
        own = kind == 0
        cells = []
        for source, empty in ((np.ones(len(ids), bool), False), (unit, 0.0), (high, 0.0), (zone, 0.0)):
            held = np.full(size, empty)
            held[place[own]] = source[own]
            cells.append(held.tolist())
        known, units, highs, groups = cells
        best: list[tuple[float, float]] = [(np.inf, np.inf)] * size
        changed, heap = set(), []
        for k in (1, 2):
            for at, f, v, g in zip(*(c[kind == k].tolist() for c in (place, far, value, zone)), strict=True):
                if not known[at]:
                    groups[at] = g
                    heap.append((f, v, at))
                elif (f, v) < best[at]:
                    best[at] = f, v
                    if k == 2:
                        changed.add(at)
                        heap.append((f, v, at))
        heapq.heapify(heap)
        steps = [dr * wide + dc for dr, dc in zip(grid.DROW, grid.DCOL, strict=True)]
        while heap:
            f, v, at = heapq.heappop(heap)
            if known[at] and (f, v) != best[at]:
                continue
            group = groups[at]
            for k, step in enumerate(steps):
                to = at + step
                if known[to] and groups[to] == group:
                    found = enter(f, v, k, units[to], highs[to])
                    if found < best[to]:
                        best[to] = found
                        changed.add(to)
                        heapq.heappush(heap, (*found, to))
        at = np.array(sorted(changed), np.int64)
        pairs = np.array([best[a] for a in at], float).reshape(-1, 2)
        return pa.table({"id": (at // wide + top) * grid.WIDTH + at % wide + left, "far": pairs[:, 0], "value": pairs[:, 1], "zone": np.array(groups, float)[at]})

    return run


def settle_tiles(cells: DataFrame, starts: DataFrame, enter: Callable[[float, float, int, float, float], tuple[float, float]]) -> DataFrame:
    """(id, far, value): the least pair (far, value) that ways from starts (id, far, value) bring to cells (row, col, unit, high, zone).

    A way goes between neighbours of one zone; enter(far, value, k, unit, high) is the pair in a cell entered in direction
    k or opposite to it, no less than the pair in the cell left. Tiles as in `spread_tiles`: rounds are the tiles of the longest way.
    """
    high, wide = (max(1, int(n or 1)) for n in cells.agg(F.max("row") - F.min("row") + 1, F.max("col") - F.min("col") + 1).first())
    side = int(TILE**0.5)
    wide, high = (wide, TILE // wide) if wide <= side else (TILE // high, high) if high <= side else (side, side)
    tile_of = lambda c: F.floor(grid.row_of(c) / high) * grid.WIDTH + F.floor(grid.col_of(c) / wide)
    tile = tile_of(F.col("id"))
    double = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    known = cut(cells.select(grid.cell("row", "col").alias("id"), *double("unit", "high", "zone")).where("zone is not null").withColumn("tile", tile))
    row, col = grid.row_of(F.col("id")), grid.col_of(F.col("id"))
    rim = (row % high).isin(0, high - 1) | (col % wide).isin(0, wide - 1)
    near = F.array(*(F.lit(dr * grid.WIDTH + dc).cast("long") for dr, dc in zip(grid.DROW, grid.DCOL, strict=True)))
    none = [F.lit(0.0)] * 2
    offers = first = cut(starts.select(tile.alias("tile"), "id", *double("far", "value"), F.lit(0.0).alias("zone")))
    parts = [first.select("id", "far", "value").limit(0)]
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("far", "value")).alias("p")).select("id", "p.*")
    while some(offers):
        active = F.broadcast(offers.select("tile").distinct())  # one row per tile
        rows = known.join(active, "tile", "left_semi").select("tile", "id", F.lit(0), *none, "unit", "high", "zone")
        for part in parts[1:]:
            rows = rows.union(part.withColumn("tile", tile).join(active, "tile", "left_semi").select("tile", "id", F.lit(1), "far", "value", *none, F.lit(0.0)))
        rows = rows.union(offers.select("tile", "id", F.lit(2), "far", "value", *none, "zone")).toDF("tile", "id", "kind", "far", "value", "unit", "high", "zone")
        out = cut(rows.groupBy("tile").applyInArrow(_settle_tile(enter), "id bigint, far double, value double, zone double"))
        parts.append(out.select("id", "far", "value"))
        beside = F.array_distinct(F.transform(near, lambda d: tile_of(F.col("id") + d)))
        sent = out.where(rim).select(F.explode(beside).alias("tile"), "id", "far", "value", "zone").where(F.col("tile") != tile)
        past, offers = offers, cut(sent.join(F.broadcast(known.select("tile").distinct()), "tile", "left_semi"))
        if past is not first:
            drop(past)
        if len(parts) == PARTS:
            parts = [parts[0], cut(least(reduce(DataFrame.union, parts)))]
    return least(reduce(DataFrame.union, parts))


def shortest_distance(dem: DataFrame, stream: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(row, col, value): chamfer distance (1, sqrt 2) from the stream cells over cells with data."""
    known = dem.where("value is not null")
    start = stream.join(known.select(*KEYS), KEYS, "left_semi").select(grid.cell("row", "col").alias("id"), F.lit(0).alias("value")).distinct()
    far = spread_tiles(known, start)
    return dem.select("row", "col", grid.cell("row", "col").alias("id")).join(far, "id", "left").select("row", "col", (F.col("dist") * resolution).alias("value"))


def shortest_reference(cells: DataFrame, fill: float = -99999.0) -> DataFrame:
    """(row, col, value, dist): cells equal to fill take the value of the nearest other cell, by chamfer distance."""
    known = cells.where("value is not null")
    start = known.where(F.col("value") != fill).select(grid.cell("row", "col").alias("id"), "value")
    far = spread_tiles(known, start)
    return cells.select("row", "col", grid.cell("row", "col").alias("id"), F.col("value").alias("own")).join(far, "id", "left").select("row", "col", F.when(F.col("own").isNotNull(), F.coalesce("value", "own")).alias("value"), "dist")


def hand_in_watershed(dem: DataFrame, stream: DataFrame, watersheds: DataFrame) -> DataFrame:
    """(row, col, value): height over the nearest stream cell reached without leaving the watershed."""
    known = dem.where("value is not null").join(watersheds.select("row", "col", F.col("value").alias("ws")), KEYS)
    start = stream.join(known, KEYS).select(grid.cell("row", "col").alias("id"), "value")
    far = spread_tiles(known, start, same="ws")
    return dem.select("row", "col", grid.cell("row", "col").alias("id"), F.col("value").alias("own")).join(far, "id", "left").select("row", "col", (F.col("own") - F.col("value")).alias("value"))


def hand_combined(dem: DataFrame, stream: DataFrame, watersheds: DataFrame, flow: DataFrame, slope: DataFrame, limit: float = 2.0) -> DataFrame:
    """As hand_in_watershed, but where slope > limit the reference is the stream cell downstream on D8."""
    near = hand_in_watershed(dem, stream, watersheds).withColumnRenamed("value", "near")
    down = relative_by_flow(dem, stream, flow).withColumnRenamed("value", "down")
    return near.join(down, KEYS).join(slope.select("row", "col", F.col("value").alias("slope")), KEYS, "left").select("row", "col", F.when((F.col("slope") > limit) & F.col("down").isNotNull(), F.col("down")).otherwise(F.col("near")).alias("value"))


def land_cover_continuity(cover: DataFrame, stream: DataFrame, costs: dict[int, float] | None = None) -> DataFrame:
    """(row, col, value): the largest class on the least-cost way from the stream, of equal ones the least, classes costing 1, 10, 100 by default."""
    costs = costs or {1: 1.0, 2: 10.0, 3: 100.0}
    unit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in costs.items() for x in kv)), F.col("value").cast("int")), F.lit(1.0))
    known = cover.where("value is not null")
    cells = known.select("row", "col", unit.alias("unit"), F.col("value").alias("high"), F.lit(0.0).alias("zone"))
    start = stream.join(known, KEYS).select(grid.cell("row", "col").alias("id"), F.lit(0.0).alias("far"), F.lit(float("-inf")).alias("value"))
    far = settle_tiles(cells, start, _costly).select("id", "far", F.when(F.col("value") > float("-inf"), F.col("value")).alias("worst"))
    out = cover.select("row", "col", F.col("value").alias("own"), grid.cell("row", "col").alias("id")).join(far, "id", "left")
    return out.select("row", "col", F.when(F.col("far").isNotNull(), F.coalesce("worst", F.col("own").cast("double"))).alias("value"))


def _costly(far: float, value: float, k: int, unit: float, high: float) -> tuple[float, float]:
    return round(far + unit * (DIAGONAL if k % 2 else 1.0), 9), max(value, high)


def fill_depressions(dem: DataFrame, delta: float = 0.0) -> DataFrame:
    """(row, col, value): the lowest surface at least as high as dem that drains over cells delta lower each to the border or to nodata.

    Without delta: every cell belongs to the pit that steepest descent leads to; pits are joined by their lowest
    passes, and a cell is filled to the height that its pit has to overflow on the way out (`spill_levels`). With
    delta heights depend on the ways themselves: every inner cell takes max(own z, lowest neighbour + delta), lowest
    cells first, tile by tile (`settle_tiles`).
    """
    known = dem.where("value is not null").select("row", "col", F.col("value").alias("z"))
    if delta:
        filled = _raised(known, delta)
        return dem.join(filled, KEYS, "left").select("row", "col", F.col("filled").alias("value"))
    pairs = cut(grid.neighbours(known.withColumn("v", F.struct(F.col("z").alias("z"), grid.cell("row", "col").alias("id"))), "v").join(known.withColumn("me", F.struct(F.col("z").alias("z"), grid.cell("row", "col").alias("id"))), KEYS).select("me", F.col("near").alias("other")))
    inner = pairs.groupBy(F.col("me.id").alias("id")).agg(F.count("*").alias("n")).where("n = 8").select("id")
    cells = cut(known.select(grid.cell("row", "col").alias("id"), "z").join(inner.withColumn("inner", F.lit(True)), "id", "left"))
    lowest = pairs.groupBy("me").agg(F.min("other").alias("low")).where("low < me").select(F.col("me.id").alias("id"), F.col("low.id").alias("next"))
    label = cut(jump(cells.select("id").join(lowest, "id", "left")).select("id", F.col("root").alias("label")))
    of = lambda side: label.select(F.col("id").alias(f"{side}_id"), F.col("label").alias(side))
    passes = pairs.where("me.id < other.id").select(F.col("me.id").alias("a_id"), F.col("other.id").alias("b_id"), F.greatest("me.z", "other.z").alias("z"))
    passes = passes.join(of("a"), "a_id").join(of("b"), "b_id").where("a <> b").select("a", "b", "z")
    exits = cells.where("inner is null").join(label, "id").select(F.col("label").alias("a"), F.lit(OUTSIDE).alias("b"), "z")
    level = spill_levels(passes.union(exits))
    filled = cells.join(label, "id").join(level, "label", "left").select("id", F.greatest("z", "level").alias("w"))
    filled = filled.select(grid.row_of(F.col("id")).alias("row"), grid.col_of(F.col("id")).alias("col"), F.col("w").alias("filled"))
    return dem.join(filled, KEYS, "left").select("row", "col", F.col("filled").alias("value"))


#: The label of all that is beyond the border and in nodata.
OUTSIDE = -(1 << 62)


def spill_levels(passes: DataFrame) -> DataFrame:
    """(label, level): the height that water from each label has to reach on its lowest way to OUTSIDE over passes (a, b, z).

    Boruvka's rounds: every group of labels takes its lowest pass out (ties: by the groups' numbers) and is joined
    with the group beyond; a group's level is the higher of that pass and the level of the group it becomes part
    of, nothing if that holds OUTSIDE. Groups at least halve in a round, so rounds are logarithmic in the labels.
    """
    edges = cut(passes.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("z").alias("z")))
    rounds = []
    while some(edges):
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to"), "z", "a", "b").union(edges.select("b", "a", "z", "a", "b")).where(F.col("id") != OUTSIDE)
        taken = cut(both.groupBy("id").agg(F.min(F.struct("z", "a", "b", "to")).alias("m")).select("id", "m.z", F.col("m.to").alias("next")))
        back = taken.select(F.col("id").alias("next"), F.col("next").alias("again"))
        # Two groups that take the same pass: the smaller number is the root.
        steps = taken.join(back, "next", "left").select("id", F.when((F.col("again") == F.col("id")) & (F.col("id") < F.col("next")), F.lit(None)).otherwise(F.col("next")).alias("next"))
        steps = steps.union(taken.where(F.col("next") == OUTSIDE).limit(1).select("next", F.lit(None).cast("long")))
        root = cut(jump(steps).where(F.col("id") != OUTSIDE).select("id", "root"))
        rounds.append(cut(taken.select("id", "z").join(root, "id")))
        of = lambda side: root.select(F.col("id").alias(side), F.col("root").alias(f"{side}2"))  # noqa: E731, B023
        moved = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "z").where("a <> b")
        past, edges = edges, cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("z").alias("z")))
        drop(past, taken, root)
    level = None
    for part in reversed(rounds):
        above = part.withColumn("level", F.lit(None).cast("double")) if level is None else part.join(level.select(F.col("label").alias("root"), "level"), "root", "left")
        past, level = level, cut(above.select(F.col("id").alias("label"), F.greatest("z", "level").alias("level")))
        drop(part, *([] if past is None else [past]))
    return level if level is not None else passes.select(F.col("a").alias("label"), F.col("z").alias("level"))


def _raised(known: DataFrame, delta: float) -> DataFrame:
    """(row, col, filled): fill_depressions with a delta of cells (row, col, z)."""
    inner = grid.neighbours(known, "z").groupBy(*KEYS).agg(F.count("*").alias("n")).where("n = 8")
    start = known.join(inner, KEYS, "left_anti").select(grid.cell("row", "col").alias("id"), F.col("z").alias("far"), F.lit(0.0).alias("value"))
    cells = known.select("row", "col", F.col("z").alias("unit"), F.lit(0.0).alias("high"), F.lit(0.0).alias("zone"))
    level = settle_tiles(cells, start, lambda far, value, k, z, high: (max(z, far + delta), value))
    return level.select(grid.row_of(F.col("id")).alias("row"), grid.col_of(F.col("id")).alias("col"), F.col("far").alias("filled"))


def resolve_flats(filled: DataFrame, flow: DataFrame) -> DataFrame:
    """(row, col, d8): flow with codes inside flats: cells without flow drain to the neighbour of equal height that has the fewest steps to an outlet of the flat, those nearer to higher ground first avoided.

    Two breadth-first distances over the flat's cells, from outlets and from higher ground, order the cells.
    """
    flow = cut(flow)
    z = cut(filled.where("value is not null").join(flow, KEYS).select("row", "col", "value", "d8", grid.cell("row", "col").alias("id")))
    near = grid.neighbours(z.select("row", "col", F.struct("id", "value", "d8").alias("v")), "v").join(z, KEYS)
    equal = cut(near.where("near.value = value").select("id", F.col("near.id").alias("other"), "k", "d8", F.col("near.d8").alias("other_d8")))
    flat = z.where("d8 = 0").select("row", "col", F.lit(1.0).alias("unit"), F.lit(0.0).alias("high"), F.col("value").alias("zone"))
    first = lambda rows: rows.select("id", F.lit(1.0).alias("far"), F.lit(0.0).alias("value")).distinct()
    steps = lambda start, name: cut(settle_tiles(flat, start, lambda far, value, k, unit, high: (far + unit, value)).select("id", F.col("far").alias(name)))
    low = steps(first(equal.where("d8 = 0 and other_d8 > 0")), "toward")
    high = steps(first(near.where("d8 = 0 and near.value > value")), "away")
    rank = low.join(high, "id", "left").select("id", "toward", F.coalesce("away", F.lit(1e9)).alias("away"))
    aims = equal.where("d8 = 0").join(rank.toDF("other", "ot", "oa"), "other", "left")
    aims = aims.where("other_d8 > 0 or ot is not null").withColumn("ot", F.when(F.col("other_d8") > 0, 0.0).otherwise(F.col("ot")))
    best = aims.join(rank.select("id", "toward"), "id").where("ot < toward").groupBy("id").agg(F.min(F.struct("ot", (-F.coalesce("oa", F.lit(0.0))).alias("a"), "k")).alias("b"))
    out = flow.select("row", "col", "d8", grid.cell("row", "col").alias("id")).join(best, "id", "left")
    return out.select("row", "col", F.when((F.col("d8") == 0) & F.col("b").isNotNull(), F.pow(F.lit(2.0), F.col("b.k"))).otherwise(F.col("d8")).cast("int").alias("d8"))


def stream_segments(acc: DataFrame, flow: DataFrame, least: float) -> DataFrame:
    """(gid, row, col, place): stream cells (acc >= least) by segment: from heads and junctions down to the next, its cell included; gid is the last cell's number."""
    cells = acc.where(F.col("acc") >= least).select(grid.cell("row", "col").alias("id"), "acc")
    steps = grid.downstream(flow).join(cells.select("id"), "id", "left_semi")
    steps = cut(steps.join(cells.select(F.col("id").alias("next"), F.lit(1).alias("on")), "next", "left").select("id", F.when(F.col("on") == 1, F.col("next")).alias("next")))
    into = steps.where("next is not null").groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n"))
    # A step into a cell with one stream cell above it belongs to the same segment.
    inner = into.where("n = 1").select(F.col("id").alias("next"), F.lit(1.0).alias("ahead"))
    chain = steps.join(inner, "next", "left").select("id", F.when(F.col("ahead") == 1, F.col("next")).alias("next"), F.lit(1.0).alias("ahead"))
    root = jump(chain, carry={"ahead": "sum"})
    own = root.select("id", F.col("root").alias("gid"), F.col("ahead").alias("rest"))
    last = steps.select(F.col("id").alias("gid"), "next").where("next is not null").select(F.col("next").alias("id"), "gid", F.lit(-1.0).alias("rest"))
    both = own.unionByName(last)
    place = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("rest")))
    return both.select("gid", grid.row_of(F.col("id")).alias("row"), grid.col_of(F.col("id")).alias("col"), place.alias("place"))


def stream_to_feature(acc: DataFrame, flow: DataFrame, least: float) -> DataFrame:
    """(gid, n_cells, area1, area2): one row for each stream segment with the accumulation at its first and last cell."""
    placed = stream_segments(acc, flow, least).join(acc, KEYS)
    return placed.groupBy("gid").agg(F.count("*").alias("n_cells"), F.min_by("acc", "place").alias("area1"), F.max_by("acc", "place").alias("area2"))


def stream_to_raster(template: DataFrame, segments: DataFrame, method: str = "id", fill: float = 0.0, burn: float = 1.0) -> DataFrame:
    """(row, col, value): the cells that segments pass get the smallest fid, the template's value or a constant; others fill."""
    burnt = rasterize(segments).select("row", "col", F.col("value").alias("fid"))
    value = {"id": F.col("fid").cast("double"), "template": F.col("value"), "burn": F.lit(burn)}[method]
    return template.join(burnt, KEYS, "left").select("row", "col", F.when(F.col("fid").isNotNull(), value).otherwise(fill).alias("value"))


def stream_flow_direction(dem: DataFrame, streams: DataFrame) -> DataFrame:
    """(row, col, d8): stream cells drain to the lowest lower neighbour of their own stream, else of a smaller stream id, else as other cells do."""
    known = dem.where("value is not null").join(streams.select("row", "col", F.col("value").alias("sid")), KEYS, "left").withColumn("sid", F.when(F.col("sid") != 0, F.col("sid")))
    near = grid.neighbours(known.select("row", "col", F.struct("value", "sid").alias("v")), "v").join(known, KEYS).where("near.value < value")
    rank = F.when(F.col("sid").isNull(), 0).when(F.col("near.sid") == F.col("sid"), 0).when(F.col("near.sid") < F.col("sid"), 1).otherwise(2)
    best = near.groupBy(*KEYS).agg(F.min(F.struct(rank.alias("r"), F.col("near.value").alias("z"), "k")).alias("b"))
    return dem.join(best, KEYS, "left").select("row", "col", F.when(F.col("value").isNull(), -1.0).when(F.col("b").isNotNull(), F.pow(F.lit(2.0), F.col("b.k"))).otherwise(0.0).cast("int").alias("d8"))


def burn_fill(dem: DataFrame, streams: DataFrame, delta: float = 0.0005, depth: float = 1e6) -> DataFrame:
    """(row, col, value, d8): dem filled with stream cells (row, col) lowered so that they are flooded first, then lifted back, and its D8."""
    low = dem.join(streams.select(*KEYS).distinct().withColumn("on", F.lit(1)), KEYS, "left").select("row", "col", (F.col("value") - F.when(F.col("on") == 1, depth).otherwise(0.0)).alias("value"))
    filled = cut(fill_depressions(low, delta))
    lifted = filled.select("row", "col", F.when(F.col("value") < -depth / 2, F.col("value") + depth).otherwise(F.col("value")).alias("value"))
    return lifted.join(flow_direction(filled), KEYS)


def signed_shortest_distance(distance: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(row, col, value): distance with the sign of the side of the nearest segment within radius; farther cells take the sign of the nearest signed cell."""
    near = cut(distance_to_stream(distance, segments, signed=True).where(F.abs("value") <= radius).select("row", "col", F.when(F.col("value") < 0, -1.0).otherwise(1.0).alias("sign")))
    marks = distance.join(near, KEYS, "left").select("row", "col", F.when(F.col("value").isNotNull(), F.coalesce("sign", F.lit(0.0))).alias("value"))
    signs = shortest_reference(marks, 0.0).select("row", "col", F.col("value").alias("sign"))
    return distance.join(signs, KEYS).select("row", "col", (F.col("value") * F.col("sign")).alias("value"))


def spill_graph(labels: DataFrame, dem: DataFrame) -> DataFrame:
    """(l1, l2, z): for adjacent labels the lowest of the higher of two touching cells."""
    both = labels.join(dem.select("row", "col", F.col("value").alias("z")), KEYS).where("z is not null")
    near = grid.neighbours(both.select("row", "col", F.struct(F.col("value").alias("l"), "z").alias("v")), "v").join(both, KEYS).where("near.l > value")
    return near.groupBy(F.col("value").alias("l1"), F.col("near.l").alias("l2")).agg(F.min(F.greatest("z", "near.z")).alias("z"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


QUERIES: dict = {}
SQL: dict = {}


def _q(name: str, make, oracle: str | None, *inputs: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, sf_dir: _round(make(*(load(spark, sf_dir, i) for i in inputs)))
    if oracle:
        SQL[name] = sql(oracle, *inputs, recursive=recursive)


_ON = "(row * 50 + col) % 41 = 3"
_stream = lambda d: d.where(_ON).select("row", "col")
_target = lambda d: d.selectExpr("row", "col", f"case when {_ON} then row * 50 + col + 1 else 0 end value")
_KS = ", o AS (SELECT unnest([-1, -1, 0, 1, 1, 1, 0, -1]) AS dr, unnest([0, 1, 1, 1, 0, -1, -1, -1]) AS dc, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k)"
_NXT = ", g AS (SELECT *, row + CASE WHEN d8 IN (8, 16) THEN 1 ELSE 0 END AS nr, col + CASE WHEN d8 IN (4, 8) THEN 1 ELSE 0 END AS nc FROM flow), st AS (SELECT g.row, g.col, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.row END AS nr, CASE WHEN g.d8 > 0 AND t.d8 >= 0 THEN t.col END AS nc FROM g LEFT JOIN flow t ON t.row = g.nr AND t.col = g.nc)"
_q("flow_direction", flow_direction, _KS + """, n AS (SELECT d.row, d.col, d.value, t.value AS near, k FROM dem d, o JOIN dem t ON t.row = d.row + dr AND t.col = d.col + dc WHERE t.value < d.value), b AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY near, k) AS rn FROM n)
 SELECT d.row, d.col, CAST(CASE WHEN d.value IS NULL THEN -1 WHEN b.k IS NULL THEN 0 ELSE pow(2, b.k) END AS INT) AS d8 FROM dem d LEFT JOIN b ON b.row = d.row AND b.col = d.col AND rn = 1""", "dem")
_ACC = _NXT + ", w AS (SELECT row, col, row AS r, col AS c, {w} AS m FROM flow WHERE d8 >= 0 UNION ALL SELECT w.row, w.col, st.nr, st.nc, w.m FROM w JOIN st ON st.row = w.r AND st.col = w.c WHERE st.nr IS NOT NULL), a AS (SELECT r AS row, c AS col, sum(m) AS acc FROM w GROUP BY 1, 2) SELECT f.row, f.col, CAST(coalesce(acc, 0) AS DOUBLE) AS acc FROM flow f LEFT JOIN a ON a.row = f.row AND a.col = f.col"
_q("flow_accumulation", flow_accumulation, _ACC.format(w="1"), "flow", recursive=True)
_q("mask_accumulation", lambda f: flow_accumulation(f, "w"), _ACC.format(w="w"), "flow", recursive=True)
_SHED = _NXT + f""", t AS (SELECT row, col, CASE WHEN {_ON} THEN row * 50 + col + 1 ELSE 0 END AS v FROM flow), w AS (SELECT row, col, v FROM t WHERE v > 0 UNION ALL SELECT st.row, st.col, w.v FROM w JOIN st ON st.nr = w.row AND st.nc = w.col JOIN t ON t.row = st.row AND t.col = st.col WHERE t.v = 0)
 SELECT t.row, t.col, coalesce(w.v, 0) AS value FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col"""
_q("watershed", lambda f: watershed(_target(f), f), _SHED, "flow", recursive=True)
_MAXQ = _NXT + f""", t AS (SELECT row, col, CASE WHEN {_ON} THEN 20e0 ELSE -99999e0 END AS v, w AS ref FROM flow), w AS (SELECT row, col, v FROM t WHERE v > -99999 UNION ALL SELECT st.row, st.col, greatest(w.v, t.ref) FROM w JOIN st ON st.nr = w.row AND st.nc = w.col JOIN t ON t.row = st.row AND t.col = st.col WHERE t.v = -99999)
 SELECT t.row, t.col, coalesce(w.v, -99999) AS value FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col"""
_q("watershed_max", lambda f: watershed_max(f.selectExpr("row", "col", f"case when {_ON} then 20D else -99999D end value"), f.selectExpr("row", "col", "w value"), f), _MAXQ, "flow", recursive=True)
_REL = _NXT + f""", t AS (SELECT f.row, f.col, d.value, {_ON.replace('row', 'f.row').replace('col', 'f.col')} AS s FROM flow f JOIN dem d ON d.row = f.row AND d.col = f.col), w AS (SELECT row, col, value AS ref FROM t WHERE s UNION ALL SELECT st.row, st.col, w.ref FROM w JOIN st ON st.nr = w.row AND st.nc = w.col JOIN t ON t.row = st.row AND t.col = st.col WHERE NOT t.s)
 SELECT t.row, t.col, t.value - w.ref AS value FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col"""
_q("relative_dem_by_flow", lambda d, f: relative_by_flow(d, _stream(d), f), _REL, "dem", "flow", recursive=True)
_q("relative_dem", lambda d: relative_dem(d, _stream(d)), f""", s AS (SELECT * FROM dem WHERE {_ON} AND value IS NOT NULL), n AS (SELECT d.row, d.col, d.value - s.value AS value, row_number() OVER (PARTITION BY d.row, d.col ORDER BY (d.row - s.row) * (d.row - s.row) + (d.col - s.col) * (d.col - s.col), s.row, s.col) AS rn FROM dem d, s) SELECT row, col, value FROM n WHERE rn = 1""", "dem")
_q("detrend_dem", lambda d: detrend_dem(d, _stream(d), 2), f""", s AS (SELECT row, col FROM dem WHERE {_ON}), m AS (SELECT s.row, s.col, avg(t.value) AS ref FROM s JOIN dem t ON abs(t.row - s.row) <= 2 AND abs(t.col - s.col) <= 2 GROUP BY 1, 2),
 n AS (SELECT d.row, d.col, d.value - m.ref AS value, row_number() OVER (PARTITION BY d.row, d.col ORDER BY (d.row - m.row) * (d.row - m.row) + (d.col - m.col) * (d.col - m.col), m.row, m.col) AS rn FROM dem d, m) SELECT row, col, round(value, 6) AS value FROM n WHERE rn = 1""", "dem")
_RAST = ", l AS (SELECT fid, CAST(fid * 7 % 40 AS INT) AS r0, CAST(fid * 11 % 50 AS INT) AS c0, CAST(fid * 13 % 40 AS INT) AS r1, CAST(fid * 17 % 50 AS INT) AS c1 FROM segs), w AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0), 1) AS n FROM l), i AS (SELECT *, unnest(generate_series(0, n)) AS i FROM w), c AS (SELECT CAST(floor(r0 + CAST(r1 - r0 AS DOUBLE) * i / n + 0.5) AS INT) AS row, CAST(floor(c0 + CAST(c1 - c0 AS DOUBLE) * i / n + 0.5) AS INT) AS col, min(fid) AS fid FROM i GROUP BY 1, 2)"
_segs = lambda s: s.selectExpr("fid", "int(fid * 7 % 40) r0", "int(fid * 11 % 50) c0", "int(fid * 13 % 40) r1", "int(fid * 17 % 50) c1")
_q("distance_to_stream", lambda d, s: distance_to_stream(d, _segs(s)), _RAST + " SELECT d.row, d.col, CASE WHEN d.value IS NOT NULL THEN round(min(sqrt((d.row - c.row) * (d.row - c.row) + (d.col - c.col) * (d.col - c.col))), 6) END AS value FROM dem d, c GROUP BY d.row, d.col, d.value", "dem", "segs")
_q("stream_to_raster_id", lambda d, s: stream_to_raster(d, _segs(s)), _RAST + " SELECT d.row, d.col, CAST(coalesce(c.fid, 0) AS DOUBLE) AS value FROM dem d LEFT JOIN c ON c.row = d.row AND c.col = d.col", "dem", "segs")
_q("stream_to_raster_template", lambda d, s: stream_to_raster(d, _segs(s), "template", -1.0), _RAST + " SELECT d.row, d.col, CASE WHEN c.fid IS NOT NULL THEN d.value ELSE -1 END AS value FROM dem d LEFT JOIN c ON c.row = d.row AND c.col = d.col", "dem", "segs")
# Chamfer distances by rounds of all cells, until a round changes nothing. {also} names further columns that stay with a cell.
_SPREAD = """, s AS (SELECT 0 AS k, row, col{also}, [0e0, {v}] AS b, true AS go FROM {cells} WHERE {start} UNION ALL
 SELECT k + 1, row, col{also}, b, bool_or(b IS DISTINCT FROM was) OVER () FROM (SELECT k, row, col{also}, min(b) AS b, min(b) FILTER (own) AS was FROM (SELECT k, row, col{also}, b, true AS own FROM s WHERE go UNION ALL
 SELECT s.k, t.row, t.col{t_also}, [round(s.b[1] + CASE WHEN o.k % 2 = 1 THEN sqrt(2) ELSE 1 END, 9), s.b[2]], false FROM s, o, {cells} t WHERE s.go AND t.row = s.row + dr AND t.col = s.col + dc{same}) GROUP BY k, row, col{also})), f AS (SELECT row, col, b FROM s WHERE k = (SELECT max(k) FROM s))"""
_KNOWN = ", c AS (SELECT * FROM dem WHERE value IS NOT NULL)"
_q("shortest_distance", lambda d: shortest_distance(d, _stream(d)), _KS + _KNOWN + _SPREAD.format(cells="c", v="0e0", start=_ON, same="", also="", t_also="") + " SELECT d.row, d.col, round(f.b[1], 6) AS value FROM dem d LEFT JOIN f ON f.row = d.row AND f.col = d.col", "dem", recursive=True)
_q("shortest_distance_reference", lambda d: shortest_reference(d.withColumn("value", F.when(F.expr(_ON), F.col("value")).otherwise(-99999.0))), _KS + f", c AS (SELECT row, col, CASE WHEN {_ON} THEN value ELSE -99999e0 END AS value FROM dem), c2 AS (SELECT * FROM c WHERE value IS NOT NULL)" + _SPREAD.format(cells="c2", v="value", start="value <> -99999", same="", also="", t_also="") + " SELECT c.row, c.col, CASE WHEN c.value IS NOT NULL THEN coalesce(f.b[2], c.value) END AS value, round(f.b[1], 6) AS dist FROM c LEFT JOIN f ON f.row = c.row AND f.col = c.col", "dem", recursive=True)
_WS = _SHED.replace(" SELECT t.row, t.col, coalesce(w.v, 0) AS value FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col", ", ws AS (SELECT t.row, t.col, coalesce(w.v, 0) AS ws FROM t LEFT JOIN w ON w.row = t.row AND w.col = t.col), c AS (SELECT d.*, ws.ws FROM dem d JOIN ws ON ws.row = d.row AND ws.col = d.col WHERE d.value IS NOT NULL)")
_q("hand_in_same_watershed", lambda d, f: hand_in_watershed(d, _stream(d), watershed(_target(f), f)), _WS + _KS + _SPREAD.format(cells="c", v="value", start=_ON, same=" AND t.ws = s.ws", also=", ws", t_also=", t.ws") + " SELECT d.row, d.col, round(d.value - f.b[2], 6) AS value FROM dem d LEFT JOIN f ON f.row = d.row AND f.col = d.col", "dem", "flow", recursive=True)
_DOWN = f""", ds AS (SELECT row, col, value, {_ON} AS s FROM dem), dn AS (SELECT row, col, value AS ref FROM ds WHERE s UNION ALL SELECT st.row, st.col, dn.ref FROM dn JOIN st ON st.nr = dn.row AND st.nc = dn.col JOIN ds ON ds.row = st.row AND ds.col = st.col WHERE NOT ds.s)"""
_q("hand_combined", lambda d, f, s: hand_combined(d, _stream(d), watershed(_target(f), f), f, s.withColumn("value", F.col("value") % 5)), _WS + _DOWN + _KS + _SPREAD.format(cells="c", v="value", start=_ON, same=" AND t.ws = s.ws", also=", ws", t_also=", t.ws") + """
 SELECT d.row, d.col, round(CASE WHEN e.value % 5 > 2 AND d.value - dn.ref IS NOT NULL THEN d.value - dn.ref ELSE d.value - f.b[2] END, 6) AS value FROM dem d LEFT JOIN f ON f.row = d.row AND f.col = d.col LEFT JOIN dn ON dn.row = d.row AND dn.col = d.col LEFT JOIN dem2 e ON e.row = d.row AND e.col = d.col""", "dem", "flow", "dem2", recursive=True)
_q("land_cover_continuity", lambda d: land_cover_continuity(d.withColumn("value", (F.col("value") % 3 + 1).cast("int")), _stream(d)), None, "dem")
_FILL = _KS + _KNOWN + """, p AS (SELECT a.row, a.col, b.row AS nr, b.col AS nc FROM c a, o, c b WHERE b.row = a.row + dr AND b.col = a.col + dc), i AS (SELECT row, col FROM p GROUP BY 1, 2 HAVING count(*) = 8),
 s AS (SELECT 0 AS k, c.row, c.col, CASE WHEN i.row IS NULL THEN c.value ELSE 1e300 END AS w, true AS go FROM c LEFT JOIN i ON i.row = c.row AND i.col = c.col UNION ALL
 SELECT k + 1, row, col, new, bool_or(new <> w) OVER () FROM (SELECT s.k, s.row, s.col, s.w, CASE WHEN s.w = c.value THEN c.value ELSE greatest(c.value, least(s.w, min(coalesce(n.w, 1e300)))) END AS new FROM s JOIN c ON c.row = s.row AND c.col = s.col LEFT JOIN p ON p.row = s.row AND p.col = s.col LEFT JOIN s n ON n.row = p.nr AND n.col = p.nc WHERE s.go GROUP BY s.k, s.row, s.col, s.w, c.value))
 SELECT d.row, d.col, s.w AS value FROM dem d LEFT JOIN s ON s.row = d.row AND s.col = d.col AND s.k = (SELECT max(k) FROM s)"""
_q("fill_depressions", fill_depressions, _FILL, "dem", recursive=True)
_q("resolve_flats", lambda d: (lambda f: resolve_flats(f, flow_direction(f)))(cut(fill_depressions(d))), None, "dem")
_q("stream_to_feature", lambda f: stream_to_feature(cut(flow_accumulation(f)), f, 5), None, "flow")
_q("stream_flow_direction", lambda d: stream_flow_direction(d, d.selectExpr("row", "col", "case when col % 7 = 2 then int(col) when row % 9 = 4 then 100 + int(row) else 0 end value")), None, "dem")
_q("burn_fill", lambda d: burn_fill(d, _stream(d)), None, "dem")
_q("signed_shortest_distance", lambda d, s: signed_shortest_distance(shortest_distance(d, _stream(d)), _segs(s), 10.0), None, "dem", "segs")
_q("spill_graph", lambda d: spill_graph(d.selectExpr("row", "col", "int(floor(row / 6)) * 100 + int(floor(col / 8)) + 1 value"), d), _KS + ", l AS (SELECT row, col, value AS z, CAST(floor(row / 6) * 100 + floor(col / 8) + 1 AS INT) AS l FROM dem WHERE value IS NOT NULL) SELECT a.l AS l1, b.l AS l2, min(greatest(a.z, b.z)) AS z FROM l a, o JOIN l b ON b.row = a.row + dr AND b.col = a.col + dc WHERE b.l > a.l GROUP BY 1, 2", "dem")
