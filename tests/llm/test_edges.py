"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

from thalweg.llm import chat, decontam, line_dedup, mixing, near_dup, quality, secrets, token_counts, token_files, toxicity
from thalweg.llm.queries import _tokenizer

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 20_000
ROWS = [
    (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id here at all, but text", "en", "b"),
    (4, LONG, None, "a"), (5, " \n \n", "de", None), (6, "tied text", "en", "c"), (7, "tied text", "en", "c"), (None, None, None, None),
]
CLASH = "text as size, source as copies, lang as score, 1 as kept, 2 as component_id, 3 as n_lines, 4 as spans, 5 as band, 6 as id, 7 as h, 8 as words"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (3, 0, 0), (4, 1, None), (None, 0, 1), (6, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "No id here, at all but text")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "mixing": mixing.mix_copies,
        "line_dedup": line_dedup.dedup_lines,
        "secrets": secrets.secret_spans,
        "token_files": lambda d: token_files.token_files(d, _tokenizer("byte_bpe_50k.json")),
        "token_counts": lambda d: token_counts.token_counts(d, _tokenizer("piece_bpe_32k.model")),
        "near_dup": near_dup.near_duplicates,
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "quality": quality.quality_rules,
    }


@pytest.mark.parametrize("name", list(operators(None, None)))
def test_one_row_for_each_row(spark, docs, labels, benchmark, name):
    op = operators(labels, benchmark)[name]
    plain = op(docs)
    got = sorted(map(str, plain.collect()))
    assert len(got) == len(ROWS)
    clash = op(docs.selectExpr("*", *CLASH.split(", ")))
    cols = [c for c in plain.columns]
    assert sorted(map(str, clash.select(*(clash[c] for c in cols)).collect())) == got
    assert op(docs.limit(0)).count() == 0


def test_leaks_edges(docs, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()}
    assert got == {(1, 1), (None, None)}
    assert decontam.leaks(docs.limit(0), benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0
    left = decontam.decontaminate(docs.selectExpr("*", *CLASH.split(", ")), benchmark)
    assert left.count() == len(ROWS) - 2


def test_near_duplicates_edges(docs):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert got[7].component_id == 6 and not got[7].kept and got[6].kept
    assert got[1].component_id == 1 and got[1].n_shingles == 3
    assert got[2].n_shingles == 0 and got[2].component_id == 2 and got[3].kept and got[None].kept and got[None].component_id is None


def test_mixing_edges(docs):
    got = mixing.mix_copies(docs).collect()
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert all(r["__mix_copies"] <= 3 for r in got)
    assert mixing.mix_sources(docs).columns == docs.columns


def test_filters_keep_columns(docs, labels, benchmark):
    for out in (toxicity.drop_toxic(docs, labels), near_dup.drop_near_duplicates(docs), decontam.decontaminate(docs, benchmark), mixing.mix_sources(docs)):
        assert out.columns == docs.columns


def test_chat_edges(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "?"), (None, 3, "ann", "lost"), (2, 0, "system", "alone")],
        "conv_id long, turn int, role string, text string",
    )
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(turns.selectExpr("*", "text as rendered", "role as perspective", "1 as piece")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = got[(1, "ann")]
    assert ann.n_turns == 5 and ann.n_trained == 1
    start, end = map(int, ann.mask.split(":"))
    assert ann.text[start:end] == "hi<|end|>"
    assert "<|start|>system\nbe kind<|end|>\n" in ann.text and "user name=bob\n" in ann.text
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0
    many = spark.range(3000).selectExpr("7L conv_id", "int(id) turn", "case when id % 2 = 0 then 'ann' else 'bob' end role", "string(id) text")
    many = many.union(spark.range(2500).selectExpr("7L conv_id", "int(null) turn", "'eve' role", "'<|end|>' || string(id) text"))
    every = chat.rotate_perspectives(many).where("perspective = 'bob'").orderBy("piece").collect()
    assert [c.piece for c in every] == list(range(len(every))) and max(c.n_turns for c in every) <= 1024 and sum(c.n_turns for c in every) == 5500
    whole = "".join(c.text for c in every)
    said = [whole[int(a) : int(b)] for c in every if c.mask for a, b in (m.split(":") for m in c.mask.split(","))]
    assert said == [f"{i}<|end|>" for i in range(1, 3000, 2)] and whole.count("<|end|>") == 5500
    one = chat.rotate_perspectives(many, 10_000).where("perspective = 'bob'").collect()
    assert [c.text for c in one] == [whole]
