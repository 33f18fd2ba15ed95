"""Token ids in a byte-aligned variable-length code with separate control bytes.

Texts are tokenised once into a scratch table, as the tokenizer does by default: the strings of its added
tokens stand for those tokens. Ids are ranked by frequency over the whole corpus, so that
common ones take one byte. Documents go out in ascending doc_id, range-partitioned, as blocks: two bits of
control for each id (its length less one, four ids a byte) apart from the data bytes. Decoding looks up all
lengths of a control byte in one table, sums them, and gathers the values with numpy.

A dataset is a folder of Parquet files, written by Spark's committers so that it survives lost executors
and lands on any store: `blocks` (shard, before: the shard's ids ahead of the block, n_docs, n_tokens,
doc_ids, lengths, control, data) and `ranks` (rank, id, n).
The rank table has as many rows as the vocabulary at most, the proven bound of its broadcast.

Defined results: a null or empty text holds the end id only; null doc_ids come first; rows that repeat a
doc_id follow one another by a hash of their ids; columns other than doc_id and text are ignored, whatever
their names; an empty table gives a dataset without blocks and an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

END = 2
BLOCK_TOKENS = 1 << 20
SCHEMA = "before bigint, n_docs bigint, n_tokens bigint, doc_ids binary, lengths binary, control binary, data binary"
#: Lengths in bytes of the four ids of each control byte, and their masks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
NULL_ID = -(1 << 63)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    four = codes.reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of (control, data)."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    padded = data + b"\0\0\0\0"
    words = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    return words[start] & MASKS[size]


_TOKENIZERS: dict = {}
_KNOWN: dict = {}  # units by tokenizer, kept by a worker from task to task
#: Units after which a worker forgets those it has met, and the longest unit in bytes that it keeps.
KEPT, KEPT_BYTES = 1 << 21, 64
SLOTS = 22
SPAN = 1 << 20


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


@lru_cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit values of bytes, and the powers of an odd number and of its inverse."""
    base = 0x9E3779B97F4A7C15
    steps = np.full((2, SPAN + KEPT_BYTES), 1, np.uint64)
    steps[:, 1:] = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64), powers[0], powers[1]


#: Kinds of bytes: no white space; begins a character that is no white space; space or line end; letter or digit; mark.
PLAIN, OPENS, WHITE, ALNUM, MARK = 1, 2, 4, 8, 16


@lru_cache
def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = PLAIN | OPENS
    out[0xC3:] |= OPENS
    out[[0xE1, 0xE2, 0xE3]] = 0  # may begin wide white space
    out[[0x20, 0x0A]] = WHITE
    for x in range(0x21, 0x7F):
        out[x] |= ALNUM if chr(x).isalnum() else MARK
    return out


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start in the bytes of texts: at each text, at each space or line end beside a character that is no white space, and at a mark after a letter or digit.

    A byte-level tokenizer's piece holds letters, digits or marks behind one space at most, or white space, of
    which it leaves the last character to what follows; so no token crosses such a place.
    """
    kind = _kinds()[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = ((kind[1:] & WHITE) != 0) & ((kind[:-1] & PLAIN) != 0)
    cut[1:-1] |= ((kind[1:-1] & WHITE) != 0) & ((kind[2:] & OPENS) != 0)
    cut[1:] |= ((kind[1:] & MARK) != 0) & ((kind[:-1] & ALNUM) != 0)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class _Units:
    """Tokenises texts by units; ids of the units that a worker has met are kept in a hash table over arrays.

    A unit is known by a 64-bit hash of its bytes.
    """

    def __init__(self, tokenizer, wide: str):
        self.tokenizer, self.wide = tokenizer, wide
        self.encode = getattr(tokenizer, "encode_batch_fast", None) or tokenizer.encode_batch
        self.added = [t["content"] for t in json.loads(tokenizer.to_str()).get("added_tokens", [])]
        self.cuts = _cuts_bytes(tokenizer)
        self.mark = next((t for t in self.added if self.cuts and self.encode([t + " a" + t], add_special_tokens=False)[0].ids.count(tokenizer.token_to_id(t)) == 2), None)
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int64)
        self.n, self.pool, self.used = 0, np.zeros(1 << 16, self.wide), 1
        self.pool[0] = END

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.wide) for e in self.encode(texts, add_special_tokens=False)]

    def several(self, texts: list[str]) -> list[np.ndarray]:
        """As whole, for short texts: those between two marks are tokenised on their own."""
        if self.mark is None:
            return self.whole(texts)
        mark, out = self.tokenizer.token_to_id(self.mark), []
        blocks = [texts[i : i + 500] for i in range(0, len(texts), 500)]
        for e in self.encode([self.mark.join(b) for b in blocks], add_special_tokens=False):
            ids = np.array(e.ids, self.wide)
            ends = [-1, *np.flatnonzero(ids == mark).tolist(), len(ids)]
            out += [ids[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def _slots(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> np.uint64(64 - SLOTS)) + np.uint64(step) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values of hashes, -1 for unknown ones."""
        out, open_, step = np.full(len(h), -1), np.arange(len(h)), 0
        while len(open_):
            slot = self._slots(h[open_], step)
            there = self.keys[slot]
            hit = there == h[open_]
            out[open_[hit]] = self.values[slot[hit]]
            open_, step = open_[~hit & (there != 0)], step + 1
        return out

    def store(self, h: np.ndarray, values: np.ndarray) -> None:
        """Stores values of different unknown hashes."""
        self.n += len(h)
        step = 0
        while len(h):
            slot = self._slots(h, step)
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = self.keys[slot] == h
            self.values[slot[own]] = values[own]
            h, values, step = h[~own], values[~own], step + 1

    def pooled(self, ids: list[np.ndarray]) -> np.ndarray:
        """Appends ids to the pool; their values: place and number."""
        sizes = np.array([len(x) for x in ids], np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), self.wide)))
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(ids)
        values = (self.used + np.cumsum(sizes) - sizes) << 32 | sizes
        self.used += total
        return values

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of units of at most KEPT_BYTES bytes, in order."""
        out = np.empty(len(starts), np.uint64)
        by_byte, power, inverse = _powers()
        edges = np.flatnonzero(np.diff(starts // SPAN, prepend=-1, append=-1)) if len(starts) else []
        with np.errstate(over="ignore"):
            for a, b in zip(edges, edges[1:], strict=False):
                at = starts[a]
                sums = np.cumsum(by_byte[data[at : ends[b - 1]]] * power[: ends[b - 1] - at], dtype=np.uint64)
                before = np.where(starts[a:b] > at, sums[starts[a:b] - at - 1], 0)
                h = (sums[ends[a:b] - at - 1] - before) * inverse[starts[a:b] - at]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out[a:b] = h ^ (h >> np.uint64(32)) | np.uint64(1)
        return out

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (their bytes, and n + 1 offsets), each with the end id, and their n + 1 offsets."""
        if self.n > KEPT:
            self.forget()
        raw = data.tobytes()
        apart = np.full(len(offsets) - 1, not self.cuts)
        for t in self.added:
            at = raw.find(t.encode())
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                apart[d] = True  # or the match spans texts: no harm
                at = raw.find(t.encode(), max(at + 1, int(offsets[d + 1]) - len(t.encode()) + 1))
        starts = unit_starts(data, offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        if apart.any():
            keep = ~apart[doc] | (starts == offsets[doc])
            starts, doc = starts[keep], doc[keep]
        ends = np.minimum(np.append(starts[1:], len(data)), offsets[doc + 1])
        values = np.full(len(starts), -1)
        short = np.flatnonzero((ends - starts <= KEPT_BYTES) & ~apart[doc])
        h = self.hashes(data, starts[short], ends[short])
        values[short] = self.find(h)
        new = short[values[short] < 0]
        if len(new):
            every, first = np.unique(h[values[short] < 0], return_index=True)
            texts = [raw[a:b].decode() for a, b in zip(starts[new[first]].tolist(), ends[new[first]].tolist(), strict=True)]
            self.store(every, self.pooled(self.several(texts)))
            values[new] = self.find(h[values[short] < 0])
        kept, long = self.used, np.flatnonzero(values < 0)
        values[long] = self.pooled(self.whole([raw[a:b].decode() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]))
        self.used = kept  # long units are not kept
        per_doc = np.bincount(doc, minlength=len(offsets) - 1)
        with_end = np.empty(len(values) + len(per_doc), np.int64)
        ends_at = np.cumsum(per_doc) + np.arange(len(per_doc))
        with_end[ends_at] = 1  # the end id is the pool's first
        with_end[np.arange(len(values)) + doc] = values
        sizes = with_end & 0xFFFFFFFF
        total = np.cumsum(sizes)
        ids = self.pool[np.repeat((with_end >> 32) - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.append(0, total[ends_at])


def _cuts_bytes(tokenizer) -> bool:
    """Whether the tokenizer cuts texts as byte-level ones do, and changes nothing else before it merges."""
    state = json.loads(tokenizer.to_str())
    before = state.get("pre_tokenizer") or {}
    return not state.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


def _tokenised(path: str, wide: str):
    """Units go through the tokenizer once for a worker; texts are put together from their units' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, wide) not in _KNOWN:
            _KNOWN[(path, wide)] = _Units(_tokenizer(path), wide)
        known = _KNOWN[(path, wide)]
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_string())
            every = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
            at = 0
            while at < len(texts):  # rows of about SPAN bytes, one at least
                to = max(at + 1, int(np.searchsorted(every, every[at] + SPAN, "right")) - 1)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[every[at] : every[to]]
                ids, offsets = known.tokens(data, every[at : to + 1] - every[at])
                ids = ids.tobytes()
                size = offsets * np.dtype(wide).itemsize
                crc = [crc32(memoryview(ids)[a:b]) for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), packed.cast(pa.binary()), pa.array(crc, pa.int64())], ["doc_id", "ids", "tie"])
                at = to

    return run


def tokenise(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """(doc_id, ids, tie) with ids as packed little-endian integers of the type returned."""
    wide = "<u2" if max(_tokenizer(tokenizer).get_vocab_size() - 1, END) < 1 << 16 else "<u4"
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return docs.mapInArrow(_tokenised(tokenizer, wide), "doc_id bigint, ids binary, tie bigint"), wide


def _frequencies(wide: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), wide))
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return run


def _blocks(shared, wide: str, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = done = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in parts], np.int64)
            control, data = encode(rank[np.concatenate(parts)])
            row = [done, len(ids), held, np.array(ids, np.int64).tobytes(), lengths.tobytes(), control, data]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["before", "n_docs", "n_tokens", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(NULL_ID if doc_id is None else doc_id)
                parts.append(np.frombuffer(packed.as_py(), wide))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield flush()
                    ids, parts, held, done = [], [], 0, done + held
        if ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, scratch: Scratch, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the dataset of docs to path."""
    spark = docs.sparkSession
    tokens, wide = tokenise(docs, tokenizer)
    tokens = scratch.write(tokens, "tokens")
    ranks = tokens.select("ids").mapInArrow(_frequencies(wide), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    order = ranks.toArrow().sort_by([("n", "descending"), ("id", "ascending")])
    of = order["id"].to_numpy()
    rank = np.zeros(int(of.max()) + 1 if len(of) else 1, np.uint32)
    rank[of] = np.arange(len(of))
    table = pa.table({"rank": pa.array(np.arange(len(of)), pa.int64()), "id": order["id"], "n": order["n"]})
    spark.createDataFrame(table, "rank bigint, id bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    blocks = sorted_.mapInArrow(_blocks(spark.sparkContext.broadcast(rank), wide, block_tokens), SCHEMA)
    blocks = blocks.withColumn("shard", F.spark_partition_id())
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("tokens")


def _decoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                n, base = batch.column("n_tokens")[row].as_py(), batch.column("base")[row].as_py()
                ids = back[decode(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), n)]
                lengths = np.frombuffer(batch.column("lengths")[row].as_py(), np.int64)
                docs = np.frombuffer(batch.column("doc_ids")[row].as_py(), np.int64)
                cuts = np.cumsum(lengths)
                crc = [crc32(ids[a:b]) for a, b in zip(cuts - lengths, cuts, strict=True)]
                ids_ = pa.array(docs, pa.int64(), mask=docs == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids_, pa.array(base + cuts - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a dataset, decoded from its blocks.

    Starts come from sums over shards (one row per written shard) and over a shard's blocks.
    """
    ranks = spark.read.schema("rank bigint, id bigint, n bigint").parquet(f"{path}/ranks").toArrow()
    back = np.zeros(max(1, len(ranks)), "<u4")
    back[ranks["rank"].to_numpy()] = ranks["id"].to_numpy()
    blocks = spark.read.schema(f"{SCHEMA}, shard int").parquet(f"{path}/blocks")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("all")).select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("shard_base"))
    based = blocks.join(F.broadcast(shards), "shard").select("n_tokens", (F.col("shard_base") + F.col("before")).alias("base"), "doc_ids", "lengths", "control", "data")
    return based.mapInArrow(_decoded(spark.sparkContext.broadcast(back)), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the dataset (to path, or the scratch folder) and returns what reading it back gives."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = path or scratch.path("dataset")
    write_token_files(docs, path, tokenizer, scratch)
    return read_token_files(docs.sparkSession, path)
