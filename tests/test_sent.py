"""What Spark may send through the driver: tables whose files say little of their rows are not broadcast."""

from __future__ import annotations

import numpy as np
import pytest

from thalweg.functions import grid
from thalweg.llm import line_dedup
from thalweg.operators import terrain


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def dem(spark, tmp_path):
    spark.range(2000).selectExpr("int(id div 50) row", "int(id % 50) col", "double(id * 7919 % 211) value").write.parquet(str(tmp_path / "dem"))
    return spark.read.parquet(str(tmp_path / "dem"))


def test_cells_meet_neighbours_without_a_broadcast(spark, dem):
    """The file of this grid is far below Spark's limit for broadcasts, as is that of one with millions of cells."""
    flow = terrain.flow_direction(dem)
    for df in (terrain.grid_steps(dem), flow, grid.downstream(flow), grid.window(dem, "value", 1, 1, 1, 1).join(dem, ["row", "col"])):
        assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)


def test_loaded_grids_are_not_broadcast(spark):
    for name in ("spill_graph", "stream_flow_direction"):
        assert "BroadcastHashJoin" not in plan(terrain.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_lists_of_lines_are_not_broadcast(spark):
    """Keys of lines repeat, so their table is a small file, whatever the lists of all documents hold."""
    text = " / ".join(f"a line that many documents hold, number {k}" for k in range(3)).replace(" / ", "\n")
    docs = spark.createDataFrame([(k, f"{text}\nand one of its own that is long enough to be a key, {k}") for k in range(12)], "doc_id long, text string")
    out = line_dedup.dedup_lines(docs)
    assert "Join" in plan(out) and "BroadcastHashJoin" not in plan(out)
    assert sorted((r.doc_id, r.n_dropped) for r in out.collect()) == [(k, 0 if k == 11 else 3) for k in range(12)]


def test_packed_bits_are_read_as_they_are():
    rng = np.random.default_rng(3)
    bits = rng.random(1 << 10) < 0.3
    at = rng.integers(0, len(bits), (4, 500)).astype(np.uint64)
    assert np.array_equal(line_dedup.bits_at(np.packbits(bits), at), bits[at])
