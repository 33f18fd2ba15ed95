"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths, computed in numpy over a document's word ids, mark the
characters that lie inside n-grams found twice or more; repeated lines are measured the same way.

Defined results: null and empty texts have no words and fail the base rule; repeated rows and repeated
or null ids are measured row by row; ties cannot occur; columns other than doc_id and text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE

#: Largest share of word characters inside duplicated n-grams (first occurrences included), by n.
NGRAM_LIMITS = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
#: Largest share of word characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
#: Characters that count as symbols, and the most of them a word may have on average.
SYMBOLS = "#*$%&|<>"
SYMBOL_LIMIT = 0.5

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_chars bigint, "
    + ", ".join(f"dup_chars_{n} bigint" for n in NGRAM_LIMITS)
)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each n-gram length, a mask of the words inside n-grams that occur twice or more."""
    n = len(ids)
    out = {}
    with np.errstate(over="ignore"):
        value = _mix((ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
        rolling = value.copy()
        for size in range(2, max(lengths) + 1):
            if n < size:
                break
            rolling = rolling[: n - size + 1] * MULTIPLIER + value[size - 1 :]
            if size in lengths:
                order = np.argsort(rolling, kind="stable")
                same = rolling[order[1:]] == rolling[order[:-1]]
                if not same.any():
                    break  # a repeated longer n-gram would hold a repeated shorter one
                twice = np.zeros(len(rolling) + 1, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                edge = np.zeros(n + 1, np.int32)
                starts = np.flatnonzero(twice[:-1])
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + size, -1)
                out[size] = np.cumsum(edge[:-1]) > 0
    return out


def measure(text: str | None) -> tuple:
    """One document's counts, in the order of SCHEMA after doc_id."""
    text = text or ""
    words = text.encode("utf-8").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup_lines, dup_line_chars = set(), 0, 0
    lines = text.split("\n")
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line) - sum(line.count(c) for c in SPACE)
            elif line.strip(SPACE):
                seen.add(line)
    covered = {}
    if n >= 5:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        masks = repeated_words(ids, sorted({*NGRAM_LIMITS, 8}))
        if masks:
            width = np.fromiter((len(w.decode("utf-8")) for w in words), np.int64, n)
            covered = {k: (int(m.sum()), int(width[m].sum())) for k, m in masks.items()}
    repeat_words = covered.get(8, (0, 0))[0]
    dup = [covered.get(k, (0, 0))[1] for k in NGRAM_LIMITS]
    failed = n < 20 or 100 * repeat_words > 30 * n
    kept = (
        not failed
        and all(d <= limit * chars for d, limit in zip(dup, NGRAM_LIMITS.values(), strict=True))
        and dup_line_chars <= LINE_LIMIT * chars
        and symbols <= SYMBOL_LIMIT * n
    )
    return (n, chars, symbols, dup_lines, repeat_words, failed, kept, dup_line_chars, *dup)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars"]
    names += [f"dup_chars_{n}" for n in NGRAM_LIMITS]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * (1 + len(NGRAM_LIMITS))
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(1)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs. A narrow map without a shuffle."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_run, SCHEMA)
