"""Vectors in sorted order of a key, packed into blocks that searches scan by key intervals.

A group (a tree, a pivot) holds its rows in the order of their keys; a block is a row of the index table with
up to BLOCK neighbours, their ids and vectors as arrays. The directory names each block's first and last key.
Searches ask for key intervals; an ask meets the blocks that overlap it through cells of the key, so that no
query is paired with a block it doesn't need. Asks of one block that are more than CHUNK are dealt to several
tasks. What blocks return is merged query by query as a stream, so no task gathers a query's candidates whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK, CHUNK = 1024, 256


def binaries(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1)


def fixed(raw: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    raw = np.ascontiguousarray(raw)
    width = raw.shape[1] * raw.itemsize
    at = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * width, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, at.buffers()[1], pa.py_buffer(raw.tobytes())])


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows (grp, key, vec_id, label, flag, vec); blocks never hold two groups."""
    count, held = 0, []
    names = ["grp", "block", "lo", "hi", "n", "keys", "ids", "labels", "flags", "vecs"]

    def block(rows: pa.Table) -> pa.RecordBatch:
        nonlocal count
        key = rows.column("key")
        keys = b"".join(key.to_pylist()) if pa.types.is_binary(key.type) else key.to_numpy().tobytes()
        packed = [rows.column(c).to_numpy().astype(t).tobytes() for c, t in (("vec_id", "<i8"), ("label", "<i8"), ("flag", "<i8"))]
        own = (TaskContext.get().partitionId() << 32) + count
        count += 1
        one = [rows.column("grp")[0].as_py(), own, key[0].as_py(), key[-1].as_py(), len(rows), keys, *packed, b"".join(rows.column("vec").to_pylist())]
        kinds = [pa.int64(), pa.int64(), key.type, key.type, pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < BLOCK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        grp = rows.column("grp").to_numpy()
        at = 0
        while len(rows) - at >= BLOCK:
            end = at + min(BLOCK, int(np.searchsorted(grp[at:], grp[at], "right")))
            yield block(rows.slice(at, end - at))
            at = end
        held = rows.slice(at).to_batches()
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    at = 0
    while rows is not None and at < len(rows):
        end = at + int(np.searchsorted(rows.column("grp").to_numpy()[at:], rows.column("grp")[at].as_py(), "right"))
        end = min(end, at + BLOCK)
        yield block(rows.slice(at, end - at))
        at = end


def pack(rows: DataFrame, n_rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index and its directory over rows (grp, key, vec_id, label, flag, vec)."""
    key = dict(rows.dtypes)["key"]
    ordered = rows.repartitionByRange(max(1, n_rows // (16 * BLOCK)), "grp", "key", "vec_id").sortWithinPartitions("grp", "key", "vec_id")
    index = scratch.write(ordered.mapInArrow(_packer, f"grp bigint, block bigint, lo {key}, hi {key}, n int, keys binary, ids binary, labels binary, flags binary, vecs binary"), "index")
    return index, scratch.write(index.select("grp", "block", "lo", "hi"), "directory")


def route(asks: DataFrame, directory: DataFrame, cell: Callable[[Column], Column]) -> DataFrame:
    """asks (grp, a, b, ...) with each block of the directory whose keys overlap [a, b]; cell is a monotone whole number of a key."""
    span = lambda x, y: F.explode(F.sequence(cell(F.col(x)), cell(F.col(y)))).alias("cell")
    blocks = directory.select(F.col("grp").alias("of"), "block", "lo", "hi", span("lo", "hi"))
    met = asks.select("*", span("a", "b")).join(blocks.withColumnRenamed("cell", "own"), (F.col("grp") == F.col("of")) & (F.col("cell") == F.col("own")) & (F.col("lo") <= F.col("b")) & (F.col("hi") >= F.col("a")))
    first = F.col("cell") == F.greatest(cell(F.col("lo")), cell(F.col("a")))  # each pair in one cell only
    return met.where(first).drop("of", "cell", "own")


def scan(asks: DataFrame, index: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, scratch: Scratch, name: str) -> DataFrame:
    """kernel over (asks of a block, the block), asks having a column block; a block's asks go to a task for each CHUNK of them."""
    asks = scratch.write(asks, f"{name}-asks")
    sizes = asks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    left = asks.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int")).drop("chunks")
    right = index.join(sizes, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(kernel, schema)
    found = scratch.write(found, f"{name}-found")
    scratch.drop(f"{name}-asks")
    return found


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], scores[keep]


def lists(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def merged(found: DataFrame, keep: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], carried: dict[str, str]) -> DataFrame:
    """One row (query, ids, scores, carried...) for each query of found; keep cuts a query's candidates to those it can need."""
    names = list(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, own, ids, scores, held = None, {}, [], [], 0

        def ended() -> pa.RecordBatch:
            i, s = keep(own, np.concatenate(ids), np.concatenate(scores))
            cols = [pa.array([query], pa.int64()), pa.array([i.tolist()], pa.list_(pa.int64())), pa.array([s.tolist()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(cols + [pa.array([own[c]], types[c]) for c in names], ["query", "ids", "scores", *names])

        types = {}
        for batch in batches:
            types = types or {c: batch.schema.field(c).type for c in names}
            out = []
            for k, q in enumerate(batch.column("query").to_pylist()):
                if q != query:
                    if query is not None:
                        out.append(ended())
                    query, own, ids, scores, held = q, {c: batch.column(c)[k].as_py() for c in names}, [], [], 0
                i = batch.column("ids")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids.append(i)
                scores.append(batch.column("scores")[k].values.to_numpy(zero_copy_only=False).astype(np.float64))
                held += len(i)
                if held > 8192:
                    i, s = keep(own, np.concatenate(ids), np.concatenate(scores))
                    ids, scores, held = [i], [s], len(i)
            yield from out
        if query is not None:
            yield ended()

    schema = ", ".join(["query bigint, ids array<bigint>, scores array<double>", *(f"{c} {t}" for c, t in carried.items())])
    return found.select("query", "ids", "scores", *names).repartition("query").sortWithinPartitions("query").mapInArrow(run, schema)
