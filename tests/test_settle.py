"""Fills with a slope, land cover and flats go by tiles; results are those of rounds over all cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.operators import terrain

SHAPE = (23, 31)


@pytest.fixture(params=[1 << 17, 40])
def tile(request, monkeypatch):
    """Everything in one tile, and tiles of a few cells."""
    monkeypatch.setattr(terrain, "TILE", request.param)
    return request.param


def frame(spark, z, kind="double"):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z)], "row int, col int, value double").withColumn("value", F.col("value").cast(kind))


def around(i, j):
    return [(k, i + dr, j + dc) for k, (dr, dc) in enumerate(zip(terrain.grid.DROW, terrain.grid.DCOL, strict=True)) if 0 <= i + dr < SHAPE[0] and 0 <= j + dc < SHAPE[1]]


def settle(best, enter):
    """Rounds over all cells until nothing changes; best maps cells to pairs."""
    while True:
        new = dict(best)
        for (i, j), pair in best.items():
            for k, a, b in around(i, j):
                if (found := enter(pair, k, (i, j), (a, b))) is not None and found < new.get((a, b), (np.inf, np.inf)):
                    new[(a, b)] = found
        if new == best:
            return best
        best = new


def test_fill_with_a_slope(spark, tile):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 40, SHAPE).astype(float)
    z[rng.random(SHAPE) < 0.01] = np.nan
    known = [c for c, v in np.ndenumerate(z) if not np.isnan(v)]
    start = {c: (z[c], 0.0) for c in known if sum(not np.isnan(z[a, b]) for _, a, b in around(*c)) < 8}
    want = settle(start, lambda pair, k, at, to: None if np.isnan(z[to]) else (max(z[to], pair[0] + 0.25), 0.0))
    got = {(r.row, r.col): r.value for r in terrain.fill_depressions(frame(spark, z), 0.25).collect()}
    assert {c: v for c, v in got.items() if v is not None} == {c: want[c][0] for c in known} and len(got) == z.size


def test_land_cover(spark, tile):
    rng = np.random.default_rng(6)
    z = rng.integers(1, 4, SHAPE).astype(float)
    z[:, 12] = np.nan  # nothing beyond is reached
    stream = [(3, 3), (20, 7)]
    cost = {1: 1.0, 2: 10.0, 3: 100.0}
    want = settle({c: (0.0, -np.inf) for c in stream}, lambda pair, k, at, to: None if np.isnan(z[to]) else (round(pair[0] + cost[z[to]] * (2**0.5 if k % 2 else 1.0), 9), max(pair[1], z[to])))
    got = {(r.row, r.col): r.value for r in terrain.land_cover_continuity(frame(spark, z, "int"), spark.createDataFrame(stream, "row int, col int")).collect()}
    assert got == {c: (z[c] if c in stream else want[c][1]) if c in want else None for c, _ in np.ndenumerate(z)}


def test_flats_are_left_by_the_fewest_steps(spark, tile):
    """A flat of one height with one outlet, and a second flat of another height beside it, which must not be crossed."""
    z = np.full(SHAPE, 9.0)
    z[2:9, 2:29], z[9, 28], z[11:20, 2:29], z[20, 2] = 5.0, 4.0, 7.0, 6.0
    dem = frame(spark, z)
    flow = {(r.row, r.col): r.d8 for r in terrain.resolve_flats(dem, terrain.flow_direction(dem)).collect()}
    for rows, end in ((range(2, 9), (9, 28)), (range(11, 20), (20, 2))):
        for i in rows:
            for j in range(2, 29):
                at, n = (i, j), 0
                while at != end:
                    k = int(np.log2(flow[at]))
                    at, n = (at[0] + terrain.grid.DROW[k], at[1] + terrain.grid.DCOL[k]), n + 1
                    assert n <= max(abs(i - end[0]), abs(j - end[1]))


def test_few_tables_are_written_for_long_ways(spark, monkeypatch):
    """Water of a valley of 300 cells: rounds of cells wrote some 600 tables."""
    written = []
    monkeypatch.setattr(terrain, "cut", lambda df, cut=terrain.cut: written.append(1) or cut(df))
    dem = spark.range(3 * 300).selectExpr("int(id div 300) row", "int(id % 300) col").selectExpr("row", "col", "double(case when row = 1 and col > 0 and col < 299 then 1 when row = 1 and col = 0 then 2 else 900 end) value")
    got = {r.col: r.value for r in terrain.fill_depressions(dem, 0.5).where("row = 1").collect()}
    assert all(got[c] == 2 + 0.5 * c for c in range(299)) and len(written) < 12
