"""Line dedup with two Bloom filters.

Each task hashes its lines' keys once and sends them, as packed 8-byte values, to the segment of the
filter that their high bits name. A segment's task sets a key's bits in the first filter when it meets
the key, and in the second when the first already has them all. The second filter, broadcast under a
fixed bound, then tells which lines are suspected repeats; only those shuffle, as (key, doc_id), for exact
counting and for the choice of the document that keeps them. Filter bits follow the number of lines up to
`max_filter_bits`; past that more lines are suspected, and the confirmed result stays the same.

Defined results: a null or empty text is one empty line; rows with a null doc_id hold no key and lose no
line; rows that repeat a doc_id count as one document and are each cleaned; columns other than doc_id and
text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

PROBES = 4


def line_keys(text: str | None) -> list[str]:
    """The key of each line: ends stripped of white space, A-Z lower-cased."""
    return [x.strip(SPACE) for x in (text or "").encode("utf-8").lower().decode("utf-8").split("\n")]


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers in a segment of `bits` (a power of two) for each 64-bit hash; the high bits named the segment."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(13)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a + np.arange(PROBES, dtype=np.uint64)[:, None] * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)


def bits_at(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits with these numbers are set, as np.packbits has them."""
    return packed[at >> np.uint64(3)] >> (~at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: set[int] = set()
            twice: list[int] = []
            for text in batch.column(1):
                for key in set(line_keys(text.as_py())):
                    if len(key) >= min_chars:
                        h = xxhash.xxh3_64_intdigest(key)
                        if h in got:
                            twice.append(h)  # its second sending sets the second filter
                        got.add(h)
            values = np.array(sorted(got) + sorted(set(twice)), np.uint64)
            part = (values >> np.uint64(56)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            values, part = values[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            groups = np.split(values, cuts) if len(values) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(g[0] >> np.uint64(56)) for g in groups], pa.int32()), pa.array([g.tobytes() for g in groups], pa.binary())],
                ["segment", "hashes"],
            )

    return run


def _segment_filter(bits: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
        for batch in batches:
            for packed in batch.column("hashes"):
                values = np.frombuffer(packed.as_py(), np.uint64)
                values, counts = np.unique(values, return_counts=True)
                at = bit_positions(values, bits)
                again = once[at].all(axis=0) | (counts > 1)
                once[at.ravel()] = True
                twice[at[:, again].ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    return run


def repeat_filter(docs: DataFrame, min_chars: int, max_filter_bits: int) -> tuple[dict[int, bytes], int]:
    """The second Bloom filter: 256 segments of packed bits, at most max_filter_bits / 8 bytes in all, and a segment's bits."""
    n_lines = docs.select(F.sum(F.length("text") / min_chars + 1)).first()[0] or 0
    bits = 1 << 10
    while bits * 256 < min(12 * n_lines / 4, max_filter_bits):
        bits *= 2
    parts = docs.mapInArrow(_hashes(min_chars), "segment int, hashes binary").groupBy("segment").applyInArrow(_segment_filter(bits), "segment int, bits binary")
    return {r.segment: bytes(r.bits) for r in parts.collect()}, bits


def _suspects(shared, bits: int, min_chars: int, with_text: bool):
    """Rows: a document's suspected keys, the digest it has without dropping, and the text where a line may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()}  # as they came: unpacked bits would be eight times as much
        none = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys: list[str] = []
            owner: list[int] = []
            texts = [t.as_py() or "" for t in batch.column(1)]
            for i, text in enumerate(texts):
                for key in set(line_keys(text)):
                    if len(key) >= min_chars:
                        keys.append(key)
                        owner.append(i)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            at = bit_positions(hashes, bits)
            segment = (hashes >> np.uint64(56)).astype(np.int64)
            hit = np.zeros(len(keys), bool)
            for s in np.unique(segment):
                mine = np.flatnonzero(segment == s)
                hit[mine] = bits_at(filters.get(int(s), none), at[:, mine]).all(axis=0)
            if with_text:
                some = np.zeros(len(texts), bool)
                some[np.array(owner, np.int64)[hit]] = True
                rows = [
                    (len_lines, None, t, True) if s else (len_lines, hashlib.sha256(t.encode("utf-8")).hexdigest(), None, False)
                    for t, s in zip(texts, some, strict=True)
                    for len_lines in (t.count("\n") + 1,)
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))],
                    ["doc_id", "n_lines", "kept_sha256", "text", "suspect"],
                )
            else:
                ids = batch.column(0).to_pylist()
                pairs = [(keys[j], ids[owner[j]]) for j in np.flatnonzero(hit) if ids[owner[j]] is not None]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["key", "doc_id"])

    return run


def clean(text: str, gone: set[str]) -> tuple[str, int]:
    """The text without the lines whose key is in gone, and how many those were."""
    lines = text.split("\n")
    kept = [line for line, key in zip(lines, line_keys(text), strict=True) if key not in gone]
    return "\n".join(kept), len(lines) - len(kept)


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, dropped, texts = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            kept, n = clean(text, set(gone or ()))
            texts.append(kept)
            digests.append(hashlib.sha256(kept.encode("utf-8")).hexdigest())
            dropped.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
        )


def repeated_lines(docs: DataFrame, shared, bits: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, key): the confirmed repeats that this document loses."""
    suspects = docs.mapInArrow(_suspects(shared, bits, min_chars, False), "key string, doc_id bigint").distinct()
    confirmed = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    return suspects.join(confirmed, "key").where("doc_id < keeper").select("doc_id", "key")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, max_filter_bits: int = 1 << 28) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, for documents with a suspected line, kept_text."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    found, bits = repeat_filter(docs, min_chars, max_filter_bits)
    shared = spark.sparkContext.broadcast(found)
    scratch = Scratch(spark, "lines")
    gone = scratch.write(repeated_lines(docs, shared, bits, min_chars, min_docs), "gone")
    # Keys repeat, so the table is a small file, but its lists would go through the driver in full if they were broadcast.
    lists = gone.groupBy("doc_id").agg(F.collect_list("key").alias("gone")).hint("merge")
    rows = docs.mapInArrow(_suspects(shared, bits, min_chars, True), "doc_id bigint, n_lines bigint, kept_sha256 string, text string, suspect boolean")
    sure = rows.where("not suspect").selectExpr("doc_id", "n_lines", "0L n_dropped", "kept_sha256", "cast(null as string) kept_text")
    unsure = rows.where("suspect").join(lists, "doc_id", "left").select("doc_id", "n_lines", "text", "gone")
    return sure.unionByName(unsure.mapInArrow(_cleaned, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, kept_text string"))


#: DuckDB's form of op2, over the view documents.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r
"""
