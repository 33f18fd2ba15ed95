"""Axes against brute force, with braids and cycles; rows of sources are written once."""

import heapq

import numpy as np
import pytest

from thalweg.operators import axes, network
from thalweg.plans import iterate


def brute(rows):
    """{(fid, source): (axis, laxis, main)} by Dijkstra's algorithm from every source."""
    about, out, into = {}, {}, set()
    for fid, a, b, h, _, _ in rows:
        about.setdefault(a, set()).add(h), about.setdefault(b, set()).add(h)
        out.setdefault(a, []).append((fid, b, h))
        into.add((b, h))
    by = {r[0]: r for r in rows}
    found = []
    for s in out:
        order = min(about[s])
        if (s, order) in into:
            continue
        dist, back, heap, seen = {s: 0.0}, {}, [(0.0, s)], set()
        while heap:
            d, n = heapq.heappop(heap)
            if n in seen:
                continue
            seen.add(n)
            for fid, b, h in out.get(n, []):
                if h >= order and d + by[fid][5] < dist.get(b, np.inf):
                    dist[b], back[b] = d + by[fid][5], fid
                    heapq.heappush(heap, (dist[b], b))
        ends = [(dist[n], n) for n in seen if n not in out or min(h for *_, h in out[n]) < order]
        main, at = set(), min(ends)[1] if ends else s
        while at != s:
            main.add(back[at])
            at = by[back[at]][1]
        fids = {fid for n in seen for fid, _, h in out.get(n, []) if h >= order}
        top = by[max(f for f, *_ in out[s])]
        found.append((order, -max(r[4] + r[5] for r in [top]), s, fids, main, min(ends)[0] if ends else None))
    want, number = {}, 0
    for _, _, s, fids, main, length in sorted(found, key=lambda f: f[:3]):
        for f in fids:
            want[f, s] = (number + 2 - (f in main), None if length is None else round(length, 6), int(f in main))
        number += 1 + bool(fids - main)
    return want


@pytest.mark.parametrize("shape", ["braid", "loops"])
def test_update_axis_by_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    pairs = [(k, int(rng.integers(max(0, k - 12), k))) for k in range(1, 90) for _ in range(1 + (k % 4 == 0))]
    if shape == "loops":
        pairs += [(20, 41), (23, 31), (5, 9), (200, 201), (201, 202), (202, 200), (203, 201), (2, 30)]
    hack = rng.integers(1, 4, len(pairs))
    rows = [(k, a, b, int(1 if a > 199 else hack[k]), float(rng.integers(0, 900)), float(rng.integers(1, 10**6)) / 1000) for k, (a, b) in enumerate(pairs)]
    links = spark.createDataFrame(rows, "fid long, nodea long, nodeb long, hack int, measure double, length double")
    got = {(r.fid, r.source): (r.axis, None if r.laxis is None else round(r.laxis, 6), r.main) for r in axes.update_axis(links).collect()}
    assert got == brute(rows)
    assert shape == "braid" or any(v[1] is None for v in got.values())


def test_update_axis_writes_rows_once(spark, monkeypatch):
    """A stem of 12 links with 60 sources above it: each reaches the whole stem."""
    rows, plain = [], iterate.cut
    count = lambda df: (lambda out: rows.append(out.count()) or out)(plain(df))
    for module in (iterate, network, axes):
        monkeypatch.setattr(module, "cut", count)
    stem = spark.range(1, 13).selectExpr("id fid", "id nodea", "id - 1 nodeb", "2 hack", "double(id) measure", "1.0D length")
    heads = spark.range(60).selectExpr("id + 100 fid", "id + 100 nodea", "12L nodeb", "2 hack", "41D measure", "id + 1.0D length")
    n = axes.update_axis(stem.union(heads)).count()
    assert n == 60 * 13 and sum(rows) < 4 * n
