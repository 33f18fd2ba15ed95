"""Toxicity by class-conditional Kneser-Ney models.

A word is a run of letters and digits, in lower case; an expression is a word or a part of one. (Contexts that
reach into the word before were tried and gained nothing, as the README shows.) Each class has a model of the
next character after the five before it in the word, by absolute discounting of its counts (a document counts
each of its words once):

    p_c(x | stuvw) = (max(n_c(stuvwx) - D, 0) + D * types_c(stuvw) * q(x | tuvw)) / n_c(stuvw)

What is rare in a class is thereby left to q, the backoff that both classes share. q is Kneser and Ney's,
from all documents: q(x | tuvw), ..., q(x | w) and q(x) discount continuation counts, the number of different
characters (a word's start is one) seen before tuvwx, ..., wx and x, each backing off to the next shorter one.
What starts a word has nothing before it; it backs off to the same characters anywhere. A context that a class
has never seen has q itself. A word with its end has the likelihood p_c of its characters. A toxic text is
an ordinary one but for a SHARE of its words, so its likelihood is that of the mixture, word by word:

    feature = mean over words of log((1 - SHARE) * p_other + SHARE * p_toxic) - log(p_other)

that is the toxic less the ordinary log-likelihood, divided by the length. A logistic curve fitted on rows
kept from the counts makes the score.

Counts, continuation counts and ratios are distributed tables over packed 6-grams. The ratios of the most
frequent n-grams, HOT rows at most, are broadcast and looked up in place; the rows of all others are joined,
so no bound cuts the model. Ratios are integers (SCALE to one): sums do not depend on their order.

The class counts use at most `max_labelled` labelled rows, picked by a hash of the id (a documented bound, so
that their ids can be broadcast); the shared counts use every document.

Defined results: null and empty texts, and texts without letters or digits, have feature 0; letters from
U+0400 on share codes; a word may be of any length; labels whose doc_id or toxic is null are ignored, and a
doc_id labelled more than once is toxic if any label says so; a null doc_id is scored and is never held out; without labels of both
classes every score is 0; repeated rows get equal scores; columns other than doc_id, text and toxic are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of an n-gram, packed by BITS each in a long; what is taken off a count.
ORDER, BITS, DISCOUNT = 6, 10, 0.75
#: The share of words in a toxic text that come from the toxic model.
SHARE = 0.02
#: So many n-grams are broadcast; the others are joined.
HOT = 1 << 18
#: Log-likelihood ratios are counted in parts of one.
SCALE = 1 << 24
#: Labelled rows with crc32(doc_id) % FOLDS == 0 are held out, == 1 fit the curve, the others give class counts.
FOLDS = 5
SLICE = 1 << 20
#: Distinct n-grams that a task holds before it passes their counts on.
HELD = 1 << 20
COUNTS = ("n", "n_toxic", "n_other")


@lru_cache
def _letters() -> np.ndarray:
    """Codes of letters and digits by code point, 0 for all others."""
    wide = 1 << BITS
    return np.array([(p if p < wide else 1 + p % (wide - 1)) if chr(p).isalnum() else 0 for p in range(1 << 16)], np.uint16)


def _codes(text: str) -> np.ndarray:
    at = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    code = _letters()[np.minimum(at, 0xFFFF)]
    code[at > 0xFFFF] = (1 << BITS) - 1
    return code


def grams_of(text: str | None) -> Iterator[np.ndarray]:
    """The packed n-grams that end at each character of the text's words and at the words' ends; whole words, slice by slice."""
    text = text or ""
    open_ = np.empty(0, np.uint16)
    for at in range(0, len(text), SLICE):
        code = np.concatenate((np.zeros(1, np.uint16), open_, _codes(text[at : at + SLICE].lower() + (" " if at + SLICE >= len(text) else ""))))
        code = code[1:][(code[1:] != 0) | (code[:-1] != 0)]
        ends = np.flatnonzero(code == 0)
        if not len(ends):
            open_ = code
            continue
        row, open_ = np.concatenate((np.zeros(ORDER - 1, np.uint16), code[: ends[-1] + 1])), code[ends[-1] + 1 :]
        out, inside = row[ORDER - 1 :].astype(np.int64), np.ones(len(row) - ORDER + 1, bool)
        for k in range(1, ORDER):
            before = row[ORDER - 1 - k : len(row) - k]
            inside &= before != 0
            out |= np.where(inside, before, 0).astype(np.int64) << BITS * k
        yield out


def word_totals(grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values of each word's n-grams."""
    ends = np.flatnonzero(grams & ((1 << BITS) - 1) == 0)
    return np.diff(np.cumsum(values)[ends], prepend=0)


def new_words(grams: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words seen with these, and the n-grams of each word that is not among those seen before, once."""
    with np.errstate(over="ignore"):
        mixed = (grams * np.int64(0x2545F4914F6CDD1D)) ^ (grams >> 7)
        ends = np.flatnonzero(grams & ((1 << BITS) - 1) == 0)
        word = np.diff(np.cumsum(mixed * mixed)[ends], prepend=0)
    every, first = np.unique(word, return_index=True)
    if len(seen):
        first = first[~np.isin(every, seen, assume_unique=True)]
        every = np.union1d(every, seen)
    lengths = np.diff(ends, prepend=-1)
    new = np.zeros(len(ends), bool)
    new[first] = True
    return every, grams[np.repeat(new, lengths)]


def fold(doc_id: int | None) -> int:
    return -1 if doc_id is None else crc32(str(doc_id).encode()) % FOLDS


def _gram_counts(shared):
    """How often each n-gram stands in the distinct words of documents, of all and of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = shared.value
        keys, counts = np.empty(0, np.int64), np.zeros((3, 0), np.int64)
        waiting: list[tuple[np.ndarray, int]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            kinds = np.concatenate([np.full(len(keys), -1), *(np.full(len(k), kind) for k, kind in waiting)])
            every, at = np.unique(np.concatenate([keys, *(k for k, _ in waiting)]), return_inverse=True)
            out = np.zeros((3, len(every)), np.int64)
            for k in range(3):
                out[k] = np.bincount(at[(kinds == k) if k else (kinds >= 0)], minlength=len(every))
                out[k][at[: len(keys)]] += counts[k]
            waiting.clear()
            return every, out

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, *counts)], ["gram", *COUNTS])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kind = 0
                if doc_id is not None and len(ids) and fold(doc_id) > 1:
                    at = min(int(np.searchsorted(ids, doc_id)), len(ids) - 1)
                    if ids[at] == doc_id:
                        kind = 1 if toxic[at] else 2
                seen = np.empty(0, np.int64)
                for grams in grams_of(text.as_py()):
                    seen, own = new_words(grams, seen)
                    waiting.append((own, kind))
                    size += len(own)
                if size > HELD:
                    keys, counts = merged()
                    size = 0
                    if len(keys) > HELD:
                        yield table()
                        keys, counts = np.empty(0, np.int64), np.zeros((3, 0), np.int64)
        keys, counts = merged()
        yield table()

    return run


def _suffix(width: int):
    """The last `width` characters of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * width) - 1))


def _context():
    """What stands before the last character of a gram."""
    return F.shiftright("gram", BITS)


def shared_backoff(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(suffix, q) of the last ORDER - 1 characters of each n-gram: the shared Kneser-Ney probability of the last of them."""
    above, counts = grams.select("gram"), {}
    for width in range(ORDER - 1, 0, -1):
        above = counts[width] = scratch.write(above.groupBy(_suffix(width).alias("gram")).agg(F.count("*").alias("n")), f"counts-{width}")
    of = counts[1].agg(F.sum("n")).first()[0] or 1
    below = counts[1].select(F.col("gram").alias("suffix"), (F.col("n") / of).alias("q"))  # what is taken off goes evenly to all characters: each gets back its own discount
    for width in range(2, ORDER):
        rows = counts[width].withColumns({"context": _context(), "suffix": _suffix(width - 1)})
        alike = Window.partitionBy("context")
        rows = rows.select("gram", "suffix", "n", F.sum("n").over(alike).alias("of"), F.count("*").over(alike).alias("types")).join(below, "suffix")
        own = (F.col("n") - DISCOUNT + DISCOUNT * F.col("types") * F.col("q")) / F.col("of")
        below = rows.select(F.col("gram").alias("suffix"), F.when(F.shiftright("gram", BITS * (width - 1)) == 0, F.col("q")).otherwise(own).alias("q"))
    return below


def likelihoods(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, n, p_toxic, p_other): the probability that each class gives the last character of each n-gram."""
    alike = Window.partitionBy("context")  # as many rows as there are characters, at most
    rows = grams.withColumns({"context": _context(), "suffix": _suffix(ORDER - 1)})
    sums = {f"{kind}_{c}": x.over(alike) for c in COUNTS[1:] for kind, x in (("of", F.sum(c)), ("types", F.sum((F.col(c) > 0).cast("int"))))}
    rows = rows.select("*", *(x.alias(k) for k, x in sums.items())).join(shared_backoff(grams, scratch), "suffix")

    def p(c: str):
        own = (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types_{c}") * F.col("q")) / F.col(f"of_{c}")
        return F.when(F.col(f"of_{c}") > 0, own).otherwise(F.col("q"))

    return rows.select("gram", "n", p("n_toxic").alias("p_toxic"), p("n_other").alias("p_other"))


def ratios(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, n, ratio): log toxic less log ordinary probability, in parts of SCALE."""
    return likelihoods(grams, scratch).select("gram", "n", F.round(F.log(F.col("p_toxic") / F.col("p_other")) * SCALE).cast("bigint").alias("ratio"))


def least_hot(fitted: DataFrame) -> int:
    """The smallest power of two such that at most HOT rows have an n as large."""
    sizes = {r.k: r.rows for r in fitted.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("rows")).collect()}
    total, k = 0, max(sizes, default=0) + 1
    while k > 0 and total + sizes.get(k - 1, 0) <= HOT:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


class Lookup:
    """Values of sorted int64 keys: most by one step into a table by hash, the others by bisection."""

    SLOTS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.own, self.got = np.zeros(1 << self.SLOTS, np.int64), np.zeros(1 << self.SLOTS, np.int64)  # no gram is 0: spaces don't follow each other
        at = self._slot(keys)
        self.own[at], self.got[at] = keys, values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the keys, 0 for those that have none, and the places of these."""
        at = self._slot(keys)
        out = self.got[at]
        missed = np.flatnonzero(self.own[at] != keys)
        if len(missed) and len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys[missed]), len(self.keys) - 1)
            known = self.keys[place] == keys[missed]
            out[missed] = np.where(known, self.values[place], 0)
            missed = missed[~known]
        else:
            out[missed] = 0
        return out, missed


def _mixed(totals: np.ndarray) -> np.ndarray:
    return np.round(np.log1p(SHARE * np.expm1(np.minimum(totals / SCALE, 500))) * SCALE).astype(np.int64)


def _document_parts(shared):
    """For each row the sum over words whose n-grams are all frequent, the number of words, and the others: their sum so far and the n-grams to be joined."""
    kind = pa.list_(pa.struct([("part", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(*shared.value)
        for batch in batches:
            sums, sizes, rest = [], [], []
            for text in batch.column(2):
                total, n, open_ = 0, 0, []
                for g in grams_of(text.as_py()):
                    values, missed = look.find(g)
                    totals = word_totals(g, values)
                    n += len(totals)
                    if len(missed):
                        ends = np.flatnonzero(g & ((1 << BITS) - 1) == 0)
                        word = np.searchsorted(ends, missed)
                        first = np.flatnonzero(np.diff(word, prepend=-1))
                        open_ += [{"part": int(totals[word[a]]), "grams": own} for a, own in zip(first, np.split(g[missed], first[1:]), strict=True)]
                        totals = np.delete(totals, word[first])
                    total += int(_mixed(totals).sum())
                sums.append(total)
                sizes.append(n)
                rest.append(open_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rest, kind)], ["row", "doc_id", "part", "n_words", "rest"])

    return run


def feature_rows(docs: DataFrame, fitted: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, feature) for each row of docs."""
    least = least_hot(fitted)
    hot = fitted.where(F.col("n") >= least).select("gram", "ratio").toArrow().sort_by("gram")
    hot = docs.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(), hot["ratio"].to_numpy()))
    schema = "row bigint, doc_id bigint, part bigint, n_words bigint, rest array<struct<part:bigint,grams:array<bigint>>>"
    parts = scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(_document_parts(hot), schema), "parts")
    hot.unpersist()
    rare = fitted.where(F.col("n") < least).select("gram", "ratio")
    words = parts.select("row", F.posexplode("rest").alias("word", "w")).select("row", "word", F.col("w.part").alias("part"), F.explode("w.grams").alias("gram"))
    words = words.join(rare, "gram").groupBy("row", "word").agg((F.max("part") + F.sum("ratio")).alias("total"))
    mixed = F.round(F.log1p(SHARE * F.expm1(F.least(F.col("total") / SCALE, F.lit(500.0)))) * SCALE).cast("bigint")
    more = words.groupBy("row").agg(F.sum(mixed).alias("more"))
    total = F.col("part") + F.coalesce("more", F.lit(0))
    return parts.drop("rest").join(more, "row", "left").select("doc_id", F.when(F.col("n_words") > 0, total / F.lit(float(SCALE)) / F.col("n_words")).otherwise(0.0).alias("feature"))


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (feature, toxic rows, other rows), by Newton steps with a small ridge."""
    x = np.array([b[0] for b in bins], float)
    pos, neg = (np.array([b[k] for b in bins], float) for k in (1, 2))
    n = pos + neg
    if not pos.sum() or not neg.sum():
        return 0.0, -40.0
    mean, std = (x * n).sum() / n.sum(), 1.0
    std = math.sqrt(((x - mean) ** 2 * n).sum() / n.sum()) or 1.0
    design = np.stack([(x - mean) / std, np.ones_like(x)])
    beta, ridge = np.zeros(2), np.diag([0.05, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -40, 40)))
        gradient = design @ (pos - n * p) - ridge @ beta
        hessian = (design * (n * np.maximum(p * (1 - p), 1e-9))) @ design.T + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / std), float(beta[1] - beta[0] * mean / std)


def gram_counts(docs: DataFrame, labelled: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, n, n_toxic, n_other) over docs (doc_id, text); labelled: sorted ids and whether they are toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(labelled)
    rows = docs.select("doc_id", "text").mapInArrow(_gram_counts(shared), "gram bigint, n bigint, n_toxic bigint, n_other bigint")
    return rows.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = 400_000) -> DataFrame:
    """doc_id, held_out, score, predicted and feature for each row of docs."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    known = labels.where("doc_id is not null and toxic is not null").selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labelled / n * (1 << 30)))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = known.toArrow().sort_by("doc_id")
    labelled = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy() > 0
    grams = scratch.write(gram_counts(docs, labelled), "grams")
    fitted = scratch.write(ratios(grams, scratch), "ratios")
    features = scratch.write(feature_rows(docs, fitted, scratch), "features")
    fits = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 1)
    x = F.round(F.asinh(F.col("feature") / SHARE), 3)  # near linear below SHARE, where ordinary texts lie, and even beyond
    curve = features.join(fits, "doc_id").groupBy(x.alias("x")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    slope, intercept = fit_curve([(r.x, r.t, r.o) for r in curve.orderBy("x").collect()])
    scratch.drop("grams", "ratios", "parts", *(f"counts-{width}" for width in range(1, ORDER)))
    score = 1 / (1 + F.exp(-(F.lit(slope) * x + F.lit(intercept))))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    out = features.select("doc_id", held.alias("held_out"), score.alias("score"), "feature")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "feature")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; rows with a null id stay."""
    bad = toxicity_scores(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__toxic_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__toxic_id"), "left_anti")
