"""Hard negatives by exact inner-product search over one-dimensional distance keys.

Components become whole numbers. One more component brings all stored vectors to the largest norm M, so that an
inner product s with an anchor q stands for the distance D with D^2 = |q|^2 + M^2 - 2s, and searching by score
is searching by distance. Every vector is stored with its nearest pivot, in blocks sorted by (pivot, distance to
it). A vector within r of the anchor has, in each pivot's array, a key within r of the anchor's own distance to
that pivot, so key intervals of growing r search annuli around the pivots; an anchor's search ends when r
reaches the distance of its k-th best, which certifies the list. Searches go in rounds of all anchors: the
block that holds the anchor, then r = M/4, M/2, M, 2M, never beyond what certifies the list. Negatives are
searched in the same way, below each positive's ceiling, until r is past the k-th of every window or past the
lowest floor. Nothing is capped: data without structure are scanned whole.

The pivots are means of a bounded sample (SAMPLE rows, chosen by a hash of their ids); they decide only how much
is scanned. Of rows with the same vector and label the first `negatives` + 1 ids are indexed, which are all that
any list can hold, and the anchors among them are one search.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part;
vectors of different lengths never meet; rows that repeat id, label and vector count once, and rows of one id
are never one another's positives; fewer partners give shorter lists; scores are exact while they stay below
2^53; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ann, key_blocks
from .common import Scratch

PIVOTS, SAMPLE, TURNS = 64, 4096, 4
#: Cells of the key between 0 and M, by which annuli meet blocks.
CELLS = 32
FOUND = "query bigint, ids array<bigint>, scores array<double>"


def _quantised(dtype: str, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.floor(scale * np.frombuffer(v, dtype).astype(np.float64)) for v in batch.column("vec").to_pylist()]
            norms = pa.array([float(v @ v) for v in x], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("asks"), batch.column("dim"), norms, pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "asks", "dim", "norm", "vec"])

    return run


def pivots_of(sample: list, top: float, pivots: int) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample, means by Lloyd's rule, with the added component last."""
    out = {}
    for dim in sorted({r.dim for r in sample}):
        rows = [r for r in sample if r.dim == dim]
        x = np.array([np.frombuffer(r.vec, "<f8") for r in rows])
        x = np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])
        centre = x[np.random.default_rng(dim).permutation(len(x))[:pivots]]
        for _ in range(TURNS):
            near = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
            centre = np.array([x[near == k].mean(axis=0) for k in range(len(centre)) if (near == k).any()])
        out[dim] = centre
    return out


def _pivots(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim + 1)))


def _keyed(pivots: dict[int, np.ndarray], top: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("dim").to_numpy() == dim))
                p, x = _pivots(pivots, dim), key_blocks.binaries(own.column("vec"), "<f8")
                more = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))
                squares = np.maximum(top + (p * p).sum(axis=1) - 2 * (x @ p[:, :-1].T + more[:, None] * p[:, -1]), 0)
                near = squares.argmin(axis=1)
                key = np.sqrt(squares[np.arange(len(x)), near])
                yield pa.RecordBatch.from_arrays([pa.array(near + dim * most, pa.int64()), pa.array(key), own.column("vec_id"), own.column("label"), own.column("flag"), own.column("vec")], ["grp", "key", "vec_id", "label", "flag", "vec"])

    return run


def _positives(q: np.ndarray, labels: list[int], x: np.ndarray, ids: np.ndarray, other: np.ndarray, k: int) -> list[tuple]:
    """The k best rows of each anchor's label."""
    scores, out = q @ x.T, []
    for row, label in zip(scores, labels, strict=True):
        at = np.flatnonzero(other == label)
        out.append(key_blocks.best(ids[at], row[at], k))
    return out


def _block(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["vecs"], "<f8").reshape(r["n"], -1)


def _at_home(k: int):
    """Anchors (the flags are their numbers) against their own blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flags = np.frombuffer(r["flags"], "<i8")
                who = np.flatnonzero(flags)
                if not len(who):
                    continue
                ids, labels, x = _block(r)
                found = _positives(x[who], labels[who].tolist(), x, ids, labels, k)
                lists = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.float64()))]
                cols = [pa.array(flags[who] - 1), pa.array([r["block"]] * len(who), pa.int64()), pa.array(labels[who]), pa.array((x[who] ** 2).sum(axis=1)), key_blocks.fixed(x[who]), *lists]
                yield pa.RecordBatch.from_arrays(cols, ["query", "home", "label", "norm", "vec", "ids", "scores"])

    return run


def _annuli(pivots: dict[int, np.ndarray], most: int, slack: float):
    """For each anchor and pivot the interval of keys within r1 of the anchor's distance d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, home, vec, r0, r1 in zip(*(batch.column(c).to_pylist() for c in ("query", "home", "vec", "r0", "r1")), strict=True):
                q = np.frombuffer(vec, "<f8")
                p = _pivots(pivots, len(q))
                d = np.sqrt(np.maximum(q @ q + (p * p).sum(axis=1) - 2 * p[:, :-1] @ q, 0))
                n, a = len(p), np.maximum(d - r1 - slack, 0)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(n, query), np.full(n, home), np.arange(n) + len(q) * most, d, a, d + r1 + slack, np.full(n, r0))], ["query", "home", "grp", "d", "a", "b", "r0"])

    return run


def _more_positives(k: int):
    names, kinds = ["query", "ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        if not len(asks) or not len(block):
            return key_blocks.lists([], names, kinds)
        ids, labels, x = _block(block.to_pylist()[0])
        found = _positives(key_blocks.binaries(asks.column("vec"), "<f8"), asks.column("label").to_pylist(), x, ids, labels, k)
        return key_blocks.lists([(q, *f) for q, f in zip(asks.column("query").to_pylist(), found, strict=True) if len(f[0])], names, kinds)

    return run


def in_windows(los: list[int], his: list[int], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids in each window of scores, together."""
    ids, scores = key_blocks.best(ids, scores, len(ids))
    keep = np.zeros(len(ids), bool)
    for lo, hi in zip(los, his, strict=True):
        first, last = np.searchsorted(-scores, -hi, "left"), np.searchsorted(-scores, -lo, "right")
        keep[first : min(last, first + k)] = True
    return ids[keep], scores[keep]


def _below(k: int):
    names, kinds = ["query", "ids", "scores"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(asks: pa.Table, block: pa.Table) -> pa.Table:
        rows = []
        if len(asks) and len(block):
            ids, labels, x = _block(block.to_pylist()[0])
            scores = key_blocks.binaries(asks.column("vec"), "<f8") @ x.T
            for row, query, label, los, his in zip(scores, *(asks.column(c).to_pylist() for c in ("query", "label", "los", "his")), strict=True):
                at = np.flatnonzero((labels != label) & (row >= min(los)) & (row <= max(his)))
                if len(at):
                    rows.append((query, *in_windows(los, his, ids[at], row[at], k)))
        return key_blocks.lists(rows, names, kinds)

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score over rows (vec_id, embedding, label)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    vectors, dtype = ann.vectors_of(rows.where("label is not null"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    whole = vectors.mapInArrow(_quantised(dtype, scale), "vec_id bigint, label bigint, asks boolean, dim int, norm double, vec binary").where("norm < double('infinity')")
    vectors = scratch.write(whole.distinct(), "vectors")
    same = Window.partitionBy("vec", "label").orderBy("vec_id")
    kept = scratch.write(vectors.withColumn("place", F.row_number().over(same)).where(f"place <= {max(positives, negatives) + 1}").drop("asks").withColumn("number", F.monotonically_increasing_id()), "kept")
    firsts = kept.where("place = 1").select(F.col("number").alias("query"), "vec", "label")
    anchors = scratch.write(vectors.where("asks").select(F.col("vec_id").alias("anchor_id"), "vec", "label").join(firsts, ["vec", "label"]).select("anchor_id", "query"), "anchors")
    flagged = kept.join(anchors.select("query").distinct(), kept.number == F.col("query"), "left").withColumn("flag", F.coalesce(F.col("query") + 1, F.lit(0)))
    n, top = kept.agg(F.count("*"), F.max("norm")).first()
    sample = kept.orderBy(F.xxhash64("vec_id", "label"), "number").limit(SAMPLE).select("dim", "vec").collect()
    means = pivots_of(sample, top or 0.0, pivots)
    radius = max(1.0, (top or 0.0) ** 0.5)
    slack = radius * 1e-6
    index, directory = key_blocks.pack(flagged.select("vec_id", "label", "flag", "dim", "vec").mapInArrow(_keyed(means, top or 0.0, pivots), "grp bigint, key double, vec_id bigint, label bigint, flag bigint, vec binary"), n, scratch)
    cell = lambda key: F.floor(key / F.lit(radius / CELLS)).cast("int")
    home = scratch.write(index.mapInArrow(_at_home(positives + 1), "query bigint, home bigint, label bigint, norm double, vec binary, ids array<bigint>, scores array<double>"), "home")
    queries = home.drop("ids", "scores")
    farthest = 2 * radius + 1
    distance = lambda score: F.sqrt(F.greatest(F.col("norm") + F.lit(top or 0.0) - 2 * score, F.lit(0.0)))
    best = lambda own, ids, scores: key_blocks.best(ids, scores, positives + 1)

    def searched(active: DataFrame, kernel, columns: list[str], name: str, with_home: bool) -> DataFrame:
        asks = active.select("query", "home", "vec", "r0", "r1").mapInArrow(_annuli(means, pivots, slack), "query bigint, home bigint, grp bigint, d double, a double, b double, r0 double")
        bound = F.greatest(F.col("lo") - F.col("d"), F.col("d") - F.col("hi"), F.lit(0.0)) - slack
        met = key_blocks.route(asks, directory, cell).where(bound > F.col("r0"))
        met = met if with_home else met.where("block <> home")
        return key_blocks.scan(met.select("query", "block").join(active.select("query", "vec", "label", *columns), "query"), index, kernel, FOUND, scratch, name)

    found, r, k = home.select("query", "ids", "scores"), radius / 4, 0
    state = queries.withColumn("seen", F.lit(-radius))
    while True:
        # What certifies a list: the distance of its last entry, or everything while it isn't full.
        lists = scratch.write(key_blocks.merged(found, best, {}), f"positives-{k}")
        last = F.get("scores", F.lit(positives))
        reach = F.when(last.isNull(), F.lit(farthest)).otherwise(distance(last))
        active = state.join(lists.select("query", "scores"), "query").withColumn("reach", reach).where("reach > seen")
        active = scratch.write(active.withColumn("r0", F.col("seen")).withColumn("r1", F.least("reach", F.lit(min(r, farthest)))).drop("scores", "reach"), f"active-{k}")
        if not active.limit(1).count():
            break
        found = lists.unionByName(searched(active, _more_positives(positives + 1), [], f"round-{k}", False))
        state = active.withColumn("seen", F.col("r1")).drop("r0", "r1")
        r, k = 2 * r, k + 1

    ends = lambda share, up: F.expr(f"transform(sums, s -> cast({'ceil' if up else 'floor'}(s * {share}L / 100D) as bigint))")
    sums = F.expr(f"filter(array_distinct(scores), s -> (s <> norm or size(filter(scores, t -> t = s)) > 1) and ceil({low} * s / 100D) <= floor({high} * s / 100D))")
    windows = queries.join(lists.select("query", "scores"), "query").withColumn("sums", sums).where("size(sums) > 0")
    windows = scratch.write(windows.withColumn("los", ends(low, True)).withColumn("his", ends(high, False)).drop("scores", "sums"), "windows")
    lowest, ceiling = F.array_min("los").cast("double"), F.array_min("his").cast("double")
    within = lambda own, ids, scores: in_windows(own["los"], own["his"], ids, scores, negatives)
    found = spark.createDataFrame([], FOUND)
    state = windows.withColumn("seen", F.lit(-radius))
    for k, share in enumerate((0.25, 0.5, 1.0)):
        active = scratch.write(state.withColumn("r0", F.col("seen")).withColumn("r1", distance(ceiling - share * (ceiling - lowest))), f"below-{k}")
        found = found.unionByName(searched(active, _below(negatives), ["los", "his"], f"below-round-{k}", True))
        lists_below = scratch.write(key_blocks.merged(found.join(windows.select("query", "los", "his"), "query"), within, {"los": "array<bigint>", "his": "array<bigint>"}).select("query", "ids", "scores"), f"negatives-{k}")
        # A window is done when its last entry is above all that is beyond r1.
        beyond = (F.col("norm") + F.lit(top or 0.0) - F.col("r1") * F.col("r1")) / 2
        full = F.forall(F.arrays_zip("los", "his"), lambda w: F.coalesce(F.get(F.filter("scores", lambda s: (s >= w["los"]) & (s <= w["his"])), F.lit(negatives - 1)) > beyond, F.lit(False)))
        found = lists_below
        state = active.join(lists_below.select("query", "scores"), "query", "left").where(~F.coalesce(full, F.lit(False))).withColumn("seen", F.col("r1")).drop("r0", "r1", "scores")

    own = anchors.join(lists.select("query", "ids", "scores"), "query").withColumn("p", F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("anchor_id")), 1, positives))
    pairs = own.select("anchor_id", "query", F.explode("p").alias("p")).join(lists_below.select("query", F.arrays_zip("ids", "scores").alias("n")), "query")
    inside = F.filter("n", lambda x: (low * F.col("p.scores") <= 100 * x["scores"]) & (100 * x["scores"] <= high * F.col("p.scores")))
    out = pairs.select("anchor_id", F.col("p.ids").alias("positive_id"), F.col("p.scores").cast("long").alias("positive_score"), F.posexplode(F.slice(inside, 1, negatives)).alias("i", "x"))
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.ids").alias("negative_id"), "positive_score", F.col("x.scores").cast("long").alias("negative_score"))


#: DuckDB's form over the view embeddings.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
