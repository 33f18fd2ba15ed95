"""Prefix trie, nearest neighbours and hard negatives against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.llm import ann, hard_negatives, key_blocks, prefix_trie
from thalweg.llm.common import Scratch

TURN = "conv_id long, turn int, role string, text string"
VEC = "vec_id long, embedding array<double>, label int"
CLASH = "1 as query, 2 as grp, 3 as block, 4 as lo, 5 as n, 6 as ids, 7 as seq, 8 as cls, 9 as up, 10 as score, 11 as rank"


def brute_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    seqs = {c: [(r, x) for _, r, x in sorted(s)] for c, s in turns.items()}
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(seqs[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in under),
            sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under), sum((len(nodes[q]) - 1) * len(q[-1][1].split()) for q in under if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie(spark, rows, local=prefix_trie.LOCAL, more=()):
    scratch = Scratch(spark, "trie")
    _, sequences = prefix_trie.encode(spark.createDataFrame(rows, TURN).selectExpr("*", *more), scratch)
    return sorted(map(tuple, prefix_trie.trie(sequences, scratch, local).drop("turn_id").collect()), key=str)


@pytest.mark.parametrize("local", [0, 6, prefix_trie.LOCAL])
def test_trie_against_brute_force(spark, local):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "c", "", None, "d e f"])) for c in range(60) for t in range(rng.randrange(6))]
    rows += [(c, t, "user", "same start") for c in range(200, 230) for t in range(3)]  # copies
    rows += [(300 + n, t, "x", "comb") for n in range(12) for t in range(n)]  # each a prefix of the next
    rows += [(None, 1, "user", "lost"), (-7, None, "u", "first"), (-7, 0, "u", "second"), (-7, 0, "u", "second"), (-7, 0, "a", "tied")]
    assert trie(spark, rows, local) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    long = [(1, t, "user", "w " * (t % 3)) for t in range(6000)] + [(2, t, "user", "w " * (t % 3)) for t in range(5000)]
    got = trie(spark, long)
    assert len(got) == 6001 and {n[5] for n in got} == {1} and max(n[6] for n in got) == sum(t % 3 for t in range(5000))
    some = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "ho")]
    assert trie(spark, some, more=CLASH.split(", ")) == trie(spark, some) == brute_trie(some)
    many = [(c, 0, "user", "one") for c in range(0, 200_000, 2)]  # ids in more than one part
    root, leaf = trie(spark, many)
    ends = {n[1]: n[7] for n in (root, leaf)}
    assert ends[1] == hashlib.sha256(",".join(str(c) for c in range(0, 200_000, 2)).encode()).hexdigest() and ends[0] == prefix_trie.NO_ENDS


def test_rebuilt_heads(spark):
    from zlib import crc32

    rows = [(c, t, "u", f"{c} {t}") for c in (0, 3, 5, 19, 20, 27, 45) for t in range(c % 5 + 1)]
    scratch = Scratch(spark, "trie")
    known, sequences = prefix_trie.encode(spark.createDataFrame(rows, TURN), scratch)
    text = {r.turn_id: r.text for r in known.collect()}
    got = {r.conv_id: [text[i] for i in r.seq] for r in prefix_trie.rebuild_with_shared_heads(sequences, scratch).collect()}
    own = {c: [x for k, _, _, x in rows if k == c] for c in {r[0] for r in rows}}
    assert got == {c: own.get(c - c % 20, [])[: crc32(str(c).encode()) % 4] + s[crc32(str(c).encode()) % 4 :] for c, s in own.items()}


def clustered(rng, n, dim):
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.3, 1.0], (n, 1))
    x[: n // 3] = centres[0] + rng.normal(size=(n // 3, dim)) * 0.01  # a third of near copies
    x[n // 3 : n // 2 : 2] = x[n - 1]  # and exact ones
    return x


@pytest.mark.parametrize("shape", ["clusters", "isotropic"])
def test_recall(spark, shape):
    rng = np.random.default_rng(3)
    x = clustered(rng, 6000, 24) if shape == "clusters" else rng.normal(size=(6000, 24))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
    got = ann.nearest_neighbours(rows, F.col("vec_id") % 50 == 0).toPandas()
    u = ann.unit(x)
    hits = total = 0
    for q, mine in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        kth = np.sort(s)[-5]
        mine = mine.sort_values("rank")
        assert len(mine) == 5 and mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[mine.vec_id], atol=1e-12)
        assert (np.diff(mine.score) <= 0).all() and all(a < b for a, b, d in zip(mine.vec_id, mine.vec_id[1:], np.diff(mine.score), strict=False) if d == 0)
        hits += (mine.score >= kth - 1e-12).sum()
        total += 5
    assert total == 600 and hits >= 0.9 * total


def test_nearest_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 0), (0, v, 0), (50, [2.0, 4.0, 6.0], 0), (1, v, 1), (2, v, 1), (3, [-1.0, 0.0, 0.0], 1), (None, v, 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 1.0], 1), (7, [1.0, math.nan, 1.0], 1), (8, [math.inf, 1.0, 1.0], 1), (9, [1.0, 2.0], 1), (100, [1e200, 1e200, 1.0], 0), (10, [], 0)]
    df = spark.createDataFrame(rows, VEC)
    ask = F.col("vec_id") % 50 == 0
    got = {}
    for r in sorted(ann.nearest_neighbours(df.selectExpr("*", *CLASH.split(", ")), ask).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    near = round(3 / math.sqrt(28), 9)
    assert got[0] == [(1, 1.0), (2, 1.0), (50, 1.0), (100, near), (3, round(-1 / math.sqrt(14), 9))]
    assert [i for i, _ in got[50]] == [0, 1, 2, 100, 3] and [i for i, _ in got[100]] == [0, 1, 2, 50, 3]
    assert set(got) == {0, 50, 100}
    assert ann.nearest_neighbours(df.limit(0), ask).count() == 0 and ann.nearest_neighbours(df.where("vec_id = 0"), ask).count() == 0


def test_depths():
    for score in (-1.0, 0.0, 0.4, 0.9, 0.999, 1.0, None):
        d, n = ann.depths(score, 16, 128, 0.04)
        p = 1 - math.acos(-1.0 if score is None else score) / math.pi
        assert 0 <= n <= 16 and ((1 - p**d) ** n * (1 - p ** (d + 1)) ** (16 - n) <= 0.0400001 or d == 0)
    assert ann.depths(1.0, 16, 128, 0.04)[0] >= 127 and ann.depths(-1.0, 16, 128, 0.04)[0] == 0


def brute_negatives(rows, positives=5, negatives=10):
    x = {(i, lab): np.floor(256 * np.array(e)) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)}
    out = []
    for (a, lab), q in x.items():
        if a % 100:
            continue
        s = sorted((-int(q @ v), i, own) for (i, own), v in x.items() if i != a)
        pos = [(-n, i) for n, i, own in s if own == lab][:positives]
        for ps, p in pos:
            neg = [(-n, i) for n, i, own in s if own != lab and 30 * ps <= -100 * n <= 90 * ps][:negatives]
            out += [(a, p, k + 1, i, ps, ns) for k, (ns, i) in enumerate(neg)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "isotropic", "lattice"])
def test_hard_negatives_against_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = {"clusters": lambda: clustered(rng, 3000, 12), "isotropic": lambda: rng.normal(size=(3000, 12)), "lattice": lambda: rng.integers(-1, 2, (3000, 4)) / 1.0}[shape]()  # the last: ties everywhere
    label = rng.choice(4, 3000, p=[0.7, 0.2, 0.0995, 0.0005])
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.2], 2), (3, [0.4, 0.2], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [1.0, math.nan], 1), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [-1.0, 0.0], 2), (100, [-0.1, 0.0], 3), (200, [0.9, 0.4], 1)]
    df = spark.createDataFrame(rows, VEC)
    ask = F.col("vec_id") % 100 == 0
    got = sorted(map(tuple, hard_negatives.hard_negatives(df.selectExpr("*", *CLASH.split(", ")), ask).collect()))
    assert got == brute_negatives(rows) and got
    assert hard_negatives.hard_negatives(df.limit(0), ask).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id = 0"), ask).count() == 0


def test_blocks_hold_one_group(spark):
    rows = spark.range(5000).selectExpr("id % 3 grp", "double(id div 7) key", "id vec_id", "0L label", "0L flag", "encode(string(id), 'utf-8') vec")
    index, directory = key_blocks.pack(rows, 5000, Scratch(spark, "blocks"))
    ids = []
    for r in index.collect():
        own = np.frombuffer(r.ids, "<i8")
        assert (own % 3 == r.grp).all() and len(own) == r.n <= key_blocks.BLOCK and (np.diff(np.frombuffer(r["keys"], "<f8")) >= 0).all()
        ids += own.tolist()
    assert sorted(ids) == list(range(5000)) and directory.count() == index.count()
