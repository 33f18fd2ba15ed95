"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives every vector a hash string of BITS signs of random projections and keeps the vectors
as a sorted array of their strings, cut into blocks. A query descends to its longest prefix matches: the block
of neighbours around its own string in every tree. The k-th best cosine found so far then says how far it has
to ascend: a vector as near as that shares a prefix of d bits in a tree with probability p^d, where
p = 1 - angle/pi, so all trees ascend together to the largest depths at which such a vector stays unseen with a
chance of at most MISS, and the arrays' stretches with these prefixes are scanned. The expected recall is
1 - MISS at least, whatever the data; no bucket is capped. Data without structure make queries ascend far, up
to the root, where the search is exact.

Of rows with the same vector the k + 1 smallest ids are indexed, which are all that any list can hold, and
their queries are one search; lists are given to every query row.

Defined results: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows
with a null vec_id; vectors of different lengths never meet; rows that repeat an id and its vector count once, and an
id with several vectors is as near as the nearest of them;
fewer than k candidates give shorter lists; ties go to the smaller vec_id; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import key_blocks
from .common import Scratch

TREES, BITS, MISS, SEED = 16, 128, 0.04, 20


def vectors_of(rows: DataFrame, *more: Column) -> tuple[DataFrame, str]:
    """(vec_id, vec, dim, ...) of the rows that take part, vec as bytes, and the numpy type of its components."""
    double = rows.schema["embedding"].dataType.elementType.typeName() != "float"
    kind, dtype = ("double", "<f8") if double else ("float", "<f4")
    v = F.col("embedding").cast(f"array<{kind}>")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), *more).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & (F.size("embedding") > 0))
    rest = [c for c in named.columns if c not in ("vec_id", "embedding")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype(dtype), lists.offsets.to_numpy()
            raw = [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(np.diff(at), pa.int32()), *(batch.column(c) for c in rest)], ["vec_id", "vec", "dim", *rest])

    kinds = dict(named.dtypes)
    return named.mapInArrow(run, ", ".join(["vec_id bigint, vec binary, dim int", *(f"{c} {kinds[c]}" for c in rest)])), dtype


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles times powers of two, so that their squares stay finite; cosines don't change."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with that of b; a pair's value depends on nothing else."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@lru_cache
def planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * bits)).astype(np.float32)


def _hashed(dtype: str, trees: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                for at in range(0, len(own), 512):
                    part = own.slice(at, 512)
                    x = unit(scaled(key_blocks.binaries(part.column("vec"), dtype)))
                    keys = np.packbits(x.astype(np.float32) @ planes(dim, trees, bits) > 0, axis=1).reshape(len(x) * trees, bits // 8)
                    again = np.repeat(np.arange(len(x)), trees)
                    part = part.take(pa.array(again))
                    grp = np.tile(np.arange(trees), len(x)) + dim * trees
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grp, pa.int64()), key_blocks.fixed(keys), part.column("vec_id"), pa.array(np.zeros(len(again), np.int64)), part.column("flag"), part.column("vec")], ["grp", "key", "vec_id", "label", "flag", "vec"]
                    )

    return run


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list]:
    """The k best of x for each row of q; a few more are compared exactly, as products round differently."""
    near = unit(q) @ unit(x).T
    out = [], []
    for row, one in zip(near, q, strict=True):
        at = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
        least = row[at].min() if len(row) > k + 1 else -2.0
        at = np.flatnonzero(row >= least - 1e-12)
        i, s = key_blocks.best(ids[at], cosine(x[at], one[None, :]), k)
        out[0].append(i)
        out[1].append(s)
    return out


def _descend(dtype: str, bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                who = np.flatnonzero(np.frombuffer(r["flags"], "<i8"))
                if not len(who):
                    continue
                ids, x = np.frombuffer(r["ids"], "<i8"), scaled(np.frombuffer(r["vecs"], dtype).reshape(r["n"], -1))
                keys = np.frombuffer(r["keys"], "u1").reshape(r["n"], bits // 8)
                i, s = _nearest(x[who], x, ids, k)
                cols = [pa.array(ids[who]), pa.array([r["grp"]] * len(who), pa.int64()), pa.array([r["block"]] * len(who), pa.int64()), key_blocks.fixed(keys[who])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(i, pa.list_(pa.int64())), pa.array(s, pa.list_(pa.float64()))], ["query", "grp", "home", "key", "ids", "scores"])

    return run


def depths(score: float | None, trees: int, bits: int, miss: float) -> tuple[int, int]:
    """(d, n): n trees have to be seen to depth d, the others to d + 1."""
    p = 1 - math.acos(max(-1.0, min(1.0, -1.0 if score is None else score))) / math.pi
    for d in range(bits - 1, -1, -1):
        far, near = math.log1p(-min(p**d, 1 - 1e-15)), math.log1p(-min(p ** (d + 1), 1 - 1e-15))
        for n in range(trees + 1):
            if n * far + (trees - n) * near <= math.log(miss):
                return d, n
    return 0, trees


def _intervals(trees: int, bits: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = (1 << bits) - 1
        for batch in batches:
            low, high = [], []
            for key, grp, score in zip(batch.column("key").to_pylist(), batch.column("grp").to_pylist(), batch.column("least").to_pylist(), strict=True):
                d, n = depths(score, trees, bits, miss)
                d += grp % trees >= n
                whole, rest = int.from_bytes(key), ones >> d
                low.append((whole & ~rest).to_bytes(bits // 8))
                high.append((whole | rest).to_bytes(bits // 8))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("grp"), batch.column("home"), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["query", "grp", "home", "a", "b"])

    return run


def _ascend(dtype: str, bits: int, k: int):
    names, kinds = ["query", "ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        rows = []
        if len(asks) and len(block):
            r = block.to_pylist()[0]
            keys = np.array([r["keys"][i : i + bits // 8] for i in range(0, len(r["keys"]), bits // 8)], object)
            ids, x = np.frombuffer(r["ids"], "<i8"), scaled(np.frombuffer(r["vecs"], dtype).reshape(r["n"], -1))
            a, b = asks.column("a").to_pylist(), asks.column("b").to_pylist()
            start, end = [int(np.searchsorted(keys, v, "left")) for v in a], [int(np.searchsorted(keys, v, "right")) for v in b]
            q = scaled(key_blocks.binaries(asks.column("vec"), dtype))
            who = asks.column("query").to_pylist()
            spans: dict[tuple, list[int]] = {}
            for j, span in enumerate(zip(start, end, strict=True)):
                spans.setdefault(span, []).append(j)
            for (i, j), of in spans.items():
                if i < j:
                    found = _nearest(q[of], x[i:j], ids[i:j], k)
                    rows += list(zip([who[o] for o in of], *found, strict=True))
        return key_blocks.lists(rows, names, kinds)

    return run


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, bits: int = BITS, miss: float = MISS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query row of rows (vec_id, embedding)."""
    scratch = Scratch(rows.sparkSession, "ann")
    some = F.expr("exists(embedding, x -> x <> 0)")
    vectors, dtype = vectors_of(rows.where(some), F.coalesce(is_query, F.lit(False)).alias("asks"))
    vectors = scratch.write(vectors.distinct(), "vectors")
    same = Window.partitionBy("vec").orderBy("vec_id")
    kept = scratch.write(vectors.withColumn("place", F.row_number().over(same)).where(f"place <= {k + 1}").drop("asks"), "kept")
    firsts = kept.where("place = 1").select(F.col("vec_id").alias("query"), "vec")
    queries = scratch.write(vectors.where("asks").select(F.col("vec_id").alias("query_id"), "vec").join(firsts, "vec").select("query_id", "query"), "queries")
    asking = queries.select("query").distinct()
    # A first copy stands for the queries among its copies.
    flagged = kept.join(asking, kept.vec_id == asking["query"], "left").withColumn("flag", (F.col("query").isNotNull() & (F.col("place") == 1)).cast("bigint"))
    hashed = flagged.select("vec_id", "vec", "dim", "flag").mapInArrow(_hashed(dtype, trees, bits), "grp bigint, key binary, vec_id bigint, label bigint, flag bigint, vec binary")
    index, directory = key_blocks.pack(hashed, kept.count() * trees, scratch)
    found = scratch.write(index.mapInArrow(_descend(dtype, bits, k + 1), "query bigint, grp bigint, home bigint, key binary, ids array<bigint>, scores array<double>"), "descended")
    top = lambda own, ids, scores: key_blocks.best(ids, scores, k + 1)
    first = scratch.write(key_blocks.merged(found, top, {}), "first")
    least = first.select("query", F.get("scores", F.lit(k)).alias("least"))
    asks = found.select("query", "grp", "home", "key").join(least, "query").mapInArrow(_intervals(trees, bits, miss), "query bigint, grp bigint, home bigint, a binary, b binary")
    byte = lambda key: F.conv(F.hex(F.substring(key, 1, 1)), 16, 10).cast("int")
    routed = key_blocks.route(asks, directory, byte).where("block <> home").select("query", "block", "a", "b")
    vec = kept.where("place = 1").select(F.col("vec_id").alias("query"), "vec").join(asking, "query", "left_semi")
    more = key_blocks.scan(routed.join(vec, "query"), index, _ascend(dtype, bits, k + 1), "query bigint, ids array<bigint>, scores array<double>", scratch, "ascended")
    both = scratch.write(key_blocks.merged(first.unionByName(more), top, {}), "both")
    scratch.drop("index", "directory", "vectors", "kept", "descended", "first", "ascended-found")
    own = queries.join(both, "query").select("query_id", F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")).alias("near"))
    return own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


#: DuckDB's form over the view embeddings: every query against every row. A table of a few blocks is searched whole, and then the results are the same.
SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
