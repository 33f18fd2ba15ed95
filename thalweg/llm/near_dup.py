"""Near-duplicate documents by MinHash: one permutation, optimal densification, banded buckets, stars.

A document's set holds its distinct 5-word shingles as 64-bit hashes. The sorted hashes give one
permutation's bins at once: the high bits name the bin, its smallest hash is the value; empty bins take the
value of the first filled bin in a fixed random sequence of bins (optimal densification). Bands of bins
form bucket keys. Documents with equal sets are one class; only class representatives are banded.

The smallest id of a bucket is the hub of a star: edges go from hubs to the others, so a bucket of n documents
gives n - 1 candidates. Candidates are confirmed on the full sets, and confirmed links are joined into
components. Buckets that still hold several components may hide links that no star met. Their documents, and
all sets of fewer than SHORT shingles (for which few different values fill the bins, so that bands miss more
often), are compared once more, exactly: of each set the shingles that are rarest among them (by a counting
sketch; any order will do) are kept, as many as make sure that two sets at the threshold have one of them in
common. Two documents of different components that share such a shingle are a pair if the places of the
shingle in both leave room for the overlap that the threshold asks for; few pairs are left.

The bands are as many as leave a pair at the threshold a chance below MISS to share no bucket, taking bins as
independent.

Defined results: documents without words have an empty set and are linked with nothing; a null doc_id is
linked with nothing, has a null component and is kept; rows that repeat a doc_id are one document, linked
where any of their texts is; columns other than doc_id and text are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE, ROWS = 5, 6
MISS = 1e-10
#: Sets that can be linked with a set of fewer shingles than this are compared exactly, whatever their bands.
SHORT = 64


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


class _Hashes(dict):
    """64-bit hashes of words; a task keeps those of the words it has met, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_CACHE = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the text with A-Z lower-cased."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


@lru_cache
def _donors(bins: int, block: int) -> np.ndarray:
    """For each bin 64 entries of a fixed random sequence of bins, from which an empty one takes its value."""
    with np.errstate(over="ignore"):
        x = np.arange(64 * bins, dtype=np.uint64) + np.uint64(64 * bins * block) + np.uint64(0x51ED270B)
        return (_mixed(x * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64).reshape(64, bins)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a non-empty sorted set, densified."""
    width = np.uint64((1 << 64) // bins + 1)
    home = (hashes // width).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[home[first]] = hashes[first]
    filled[home[first]] = True
    source = np.where(filled, np.arange(bins), -1)
    open_ = np.flatnonzero(~filled)
    if len(first) == 1:  # what every sequence comes to
        source[open_], open_ = home[first[0]], open_[:0]
    for block in count():
        if not len(open_):
            break
        donors = _donors(bins, block)[:, open_]
        got = filled[donors]
        at, found = got.argmax(axis=0), got.any(axis=0)
        source[open_[found]] = donors[at, np.arange(len(open_))][found]
        open_ = open_[~found]
    return out[source]


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    sig = signature(hashes, bands * ROWS).reshape(bands, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        for k in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
    return key


def _signed(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(s, bands).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"]
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "packed"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            ok = []
            for a, left, right in zip(batch.column("a").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                if a != hub or len(hub_set) * 8 != len(left.as_buffer()) or hub_set.tobytes() != left.as_py():
                    hub, hub_set = a, np.frombuffer(left.as_py(), np.uint64)
                ok.append(similar(hub_set, np.frombuffer(right.as_py(), np.uint64), percent))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def components(spark, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, component) for the ids that edges (a, b) join: the smallest id reachable.

    Each round every id takes the smallest label among itself and its neighbours, then the label of that
    label; rounds are cut by written tables and end when no label changes.
    """
    both = scratch.write(edges.union(edges.select("b", "a")).distinct().toDF("id", "other"), f"{tag}-both")
    label = scratch.write(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), f"{tag}-0")
    k = 0
    while True:
        near = both.join(label.toDF("other", "theirs"), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        step = label.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "theirs").alias("component"))
        jump = label.toDF("component", "further")
        k += 1
        after = scratch.write(step.join(jump, "component", "left").select("id", F.coalesce(F.least("further", "component"), "component").alias("component"), "was"), f"{tag}-{k}")
        changed = after.where("component <> was").limit(1).count()
        label = after.select("id", "component")
        scratch.drop(f"{tag}-{k - 1}")
        if not changed:
            label = scratch.write(label, tag)
            scratch.drop(f"{tag}-both", f"{tag}-{k}")
            return label


SKETCH_BITS, SKETCH_PARTS = 22, 64


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint8)
    for batch in batches:
        for packed in batch.column("packed"):
            at = np.unique(_slots(np.frombuffer(packed.as_py(), np.uint64)))
            counts[at] += counts[at] < 255
    parts = counts.reshape(SKETCH_PARTS, -1)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "counts"])


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
    for batch in batches:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())], ["part", "counts"])


#: Words of 64 bits in the parity map of a set.
MAP = 8
MAPS = [f"map{k}" for k in range(MAP)]


def parity_map(s: np.ndarray) -> np.ndarray:
    """64 * MAP bits, each the parity of how many hashes of a set fall on it: two maps differ in as many bits at most as the sets in hashes."""
    bits = np.bincount((_mixed(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _prefixes(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            tokens, places, ids, sizes, maps = [], [], [], [], [np.empty((0, MAP), np.int64)]
            for doc, packed in zip(batch.column("id").to_pylist(), batch.column("packed"), strict=True):
                s = np.frombuffer(packed.as_py(), np.uint64)
                n = len(s)
                often = counts[_slots(s)]
                rare = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1]
                place = np.flatnonzero(often[rare] > 1)  # a shingle alone in its slot has no partner
                tokens.append(s[rare[place]].view(np.int64))
                places.append(place)
                ids += [doc] * len(place)
                sizes += [n] * len(place)
                maps.append(np.repeat(parity_map(s)[None, :], len(place), axis=0))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            at = np.concatenate(places) if places else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *map(pa.array, np.concatenate(maps).T)], ["token", "place", "id", "n", *MAPS])

    return run


def prefix_groups(own: DataFrame, percent: int) -> DataFrame:
    """(token, place, id, n, maps): groups by shingle such that any two of the sets own (id, packed) at the threshold meet in one; place is the shingle's rank by rarity in its set, maps its parity map."""
    parts = own.mapInArrow(_counted, "part int, counts binary").groupBy("part").applyInArrow(_summed, "part int, counts binary")
    counts = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint8)
    for r in parts.collect():  # the sketch, of fixed size
        counts[r.part] = np.frombuffer(r.counts, np.uint8)
    return own.mapInArrow(_prefixes(own.sparkSession.sparkContext.broadcast(counts.tobytes()), percent), ", ".join(["token bigint, place bigint, id bigint, n bigint", *(f"{m} bigint" for m in MAPS)]))


def prefix_pairs(groups: DataFrame, label: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle and can reach the threshold.

    Of two sets whose first common shingle has places p and q, at most min(n - p, m - q) shingles are common; and
    sets at the threshold differ in few shingles, so in few bits of their parity maps. Both tests are part of the
    join, so that pairs that fail them are never written and their sets don't travel.
    Documents of the component that the group's most central document has meet only those outside of it.
    """
    placed = scratch.write(groups.join(label, "id", "left").select("token", "place", "id", "n", *MAPS, F.coalesce("component", "id").alias("component")), "placed")
    heads = placed.groupBy("token").agg(F.min(F.struct((F.col("place") / F.col("n")).alias("share"), "component")).alias("head"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("least"))
    room = F.expr(f"(100 + {percent}) * (n - place) >= {percent} * (n + greatest(least, {percent} * n / 100))")
    mixed = placed.join(heads.where("x <> y"), "token").where(room).select("token", "place", "id", "n", *MAPS, "component", (F.col("component") != F.col("head.component")).alias("outer"))
    mixed = scratch.write(mixed, "mixed")
    left = mixed.where("outer").selectExpr("token", "place p", "id a", "n a_n", "component a_c", *(f"{m} a_{m}" for m in MAPS))
    right = mixed.selectExpr("token", "place q", "id b", "n b_n", "component b_c", *(f"{m} b_{m}" for m in MAPS))
    differ = " + ".join(f"bit_count(a_{m} ^ b_{m})" for m in MAPS)
    fits = F.expr(f"a_c <> b_c and (100 + {percent}) * least(a_n - p, b_n - q) >= {percent} * (a_n + b_n) and (100 + {percent}) * ({differ}) <= (100 - {percent}) * (a_n + b_n)")
    return left.join(right, (left["token"] == right["token"]) & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = sets.selectExpr("id a", "packed left"), sets.selectExpr("id b", "packed right")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(_confirmed(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    bands = bands_for(percent)
    signed = scratch.write(docs.mapInArrow(_signed(bands), "doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>"), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    classes = scratch.write(named.groupBy("set_id").agg(F.min("doc_id").alias("id")), "classes")
    # One signature for each class: that of its representative.
    reps = named.join(classes, [named.set_id == classes.set_id, named.doc_id == classes.id], "left_semi")
    banded = scratch.write(reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")), "banded")
    hubs = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("rows")).where("rows > 1").select("band", "hub")
    shared = scratch.write(banded.join(hubs, "band").selectExpr("band", "id", "n", "hub.id hub", "hub.n hub_n"), "shared")
    scratch.drop("banded")
    # Sets of the documents that share a bucket or are short, read again from their texts.
    short = signed.where(f"doc_id is not null and n_shingles > 0 and {percent} * n_shingles < 100 * {SHORT}").select(F.col("doc_id").alias("id")).join(classes, "id", "left_semi")
    short = scratch.write(short.distinct(), "short")
    ids = shared.select("id").union(short).distinct()
    sets = scratch.write(docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", "text").mapInArrow(_packed, "id bigint, packed binary").where("packed <> x''"), "sets")
    star = shared.where(f"id <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").selectExpr("hub a", "id b").distinct()
    links = scratch.write(confirmed_links(scratch.write(star, "star"), sets, percent), "links-0")
    label = components(spark, links, scratch, "label-0")
    mine = shared.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    several = mine.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    rest = scratch.write(shared.join(several, "band", "left_semi").select("id").union(short).distinct(), "rest")
    groups = prefix_groups(sets.join(rest, "id", "left_semi"), percent)
    more = scratch.write(confirmed_links(scratch.write(prefix_pairs(groups, label, percent, scratch), "pairs"), sets, percent), "links-1")
    if more.limit(1).count():
        label = components(spark, links.union(more), scratch, "label-1")
    of_class = classes.join(label, "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    out = signed.join(of_class, "set_id", "left")
    # A repeated doc_id is one node: its rows take the smallest component of any.
    same = Window.partitionBy("doc_id")
    repeated = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    component = F.coalesce("component", "doc_id")
    if repeated:
        component = F.when(F.col("doc_id").isNotNull(), F.min(component).over(same))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    out = scratch.write(out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "result")
    scratch.drop("signed", "classes", "shared", "short", "sets", "star", "links-0", "links-1", "rest", "placed", "mixed", "pairs", "label-0", "label-1")
    return out


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each component; rows with a null id stay."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("__dup_id")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__dup_id"), "left_anti")
