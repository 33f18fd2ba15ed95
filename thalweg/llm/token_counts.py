"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text is cut where a piece cannot cross: before each run of white space marks. For each distinct
stretch an Aho-Corasick automaton enumerates all vocabulary matches; dynamic programming over end places
carries the best score and that path's piece count, nothing else, and of end places only those that a piece
can reach back to. Ties go to the match that starts first, as the unigram tokenizers of public libraries have
it; a character without a piece costs an unknown penalty and counts as many tokens as it has bytes in UTF-8
(byte fallback).

The vocabulary is that of a sentencepiece model file, its path a parameter: all its pieces with their scores,
runs of marks and byte pieces included. The public model at hand is a BPE model, whose scores are the ranks
of its merges; read as unigram scores they define a count of their own, which is the count of the
`tokenizers` library's Unigram model over the same pieces, not that of the model's own BPE.

Defined results: null and empty texts have 0 tokens; repeated rows and null ids are counted row by row;
columns other than doc_id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0


@lru_cache
def vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without those for unknown, control and unused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not skip(i)}


class Counter(dict):
    """Token counts of stretches; a task keeps those of the stretches it has met, up to a bound."""

    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces), default=1)
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.singles = {p for p in pieces if len(p) == 1}

    def __missing__(self, stretch: str) -> int:
        n = self.known(stretch) if len(stretch) <= 4096 and self.singles.issuperset(stretch) else self.viterbi(stretch)
        if len(stretch) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[stretch] = n
        return n

    def count(self, text: str | None) -> int:
        flat = normalised(text)
        return sum(map(self.__getitem__, stretches(flat) if self.cuts else [flat]))

    def known(self, text: str) -> int:
        """viterbi of a text whose characters are all pieces: no end is without a match, so matches alone are gone through."""
        scores, counts = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
        for last, (size, worth) in self.automaton.iter(text):  # of one end the longest comes first and wins ties
            e = last + 1
            got = scores[e - size] + worth
            if got > scores[e]:
                scores[e] = got
                counts[e] = counts[e - size] + 1
        return counts[-1]

    def viterbi(self, text: str) -> int:
        """Pieces on the best path; scores and counts hold (for ends modulo their length) the best way to each end."""
        room = self.longest + 1
        scores, counts = [0.0] * room, [0] * room
        matches = self.automaton.iter(text)
        last, (size, score) = next(matches, (len(text), (0, 0.0)))
        for e in range(1, len(text) + 1):
            top = n = None
            single = False
            own = []
            while last + 1 == e:
                own.append((size, score))
                last, (size, score) = next(matches, (len(text), (0, 0.0)))
            for long, worth in sorted(own, reverse=True):  # the longest starts first and wins ties
                single |= long == 1
                at = (e - long) % room
                if top is None or scores[at] + worth > top:
                    top, n = scores[at] + worth, counts[at] + 1
            at = (e - 1) % room
            if not single and (top is None or scores[at] + self.unknown > top):
                top, n = scores[at] + self.unknown, counts[at] + len(text[e - 1].encode())
            scores[e % room], counts[e % room] = top, n
        return counts[len(text) % room]


def normalised(text: str | None) -> str:
    """Spaces as marks, with one before the text; other characters stay."""
    return MARK + text.replace(" ", MARK) if text else ""


def stretches(text: str) -> list[str]:
    """Cuts before every run of marks: no piece has a mark after another character."""
    if MARK * 2 in text:
        return RUNS.findall(text)
    parts = text.split(MARK)
    return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary(path))
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens for each row of docs. A narrow map without a shuffle."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_counted(model), "doc_id bigint, n_tokens bigint")
