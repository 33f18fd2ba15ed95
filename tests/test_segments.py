"""Segments found by penalties are those of the dynamic programme over their number; hubert_test segments once."""

import numpy as np
import pytest

from thalweg.operators import metrics


@pytest.mark.parametrize("kind", ["noise", "steps", "skewed", "walk"])
def test_penalties_find_the_same_segments(kind):
    rng = np.random.default_rng(8)
    for n in (6, 7, 20, 61, 150, 151):
        x = {"noise": rng.normal(0, 1, n), "steps": np.repeat(rng.normal(0, 5, n // 7 + 1), 7)[:n] + rng.normal(0, 0.3, n), "skewed": np.round(rng.exponential(50, n), 2), "walk": np.cumsum(rng.normal(0, 1, n))}[kind]
        s, q = np.concatenate(([0.0], np.cumsum(x))), np.concatenate(([0.0], np.cumsum(x * x)))
        found = metrics._by_penalties(x, s, q, n // 3 + 1)
        assert found is None or found == metrics._by_levels(n, s, q, n // 3)


def test_long_series_need_no_levels(monkeypatch):
    monkeypatch.setattr(metrics, "_by_levels", lambda *a: pytest.fail("all numbers of segments are gone through"))
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.3, 700) for m in (0, 5, 1)])
    assert metrics.segment_breaks(x, len(x) // 3) == [0, 700, 1400]


def test_hubert_test_segments_once(spark):
    series = spark.range(30).selectExpr("id % 2 axis", "id fid", "double(id) ord", "double(id div 15) metric")
    plan = metrics.hubert_test(series)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
