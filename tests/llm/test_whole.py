"""What must hold whatever the size of the input: nothing fitted, matched or counted is left out."""

import random

import numpy as np

from thalweg.llm import decontam, near_dup, toxicity


def _labelled(texts):
    """(doc_id, text, toxic) rows whose ids are not held out and give class counts."""
    ids = (i for i in range(10_000_000) if toxicity.fold(i) > 1)
    return [(next(ids), text, toxic) for text, toxic in texts]


def _features(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return {r.doc_id: r.feature for r in toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}


def test_rare_toxic_words_count_beside_many_ordinary_ones(spark):
    rng = random.Random(1)
    many = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(40_000)]
    texts = []
    for _ in range(24):
        rng.shuffle(many)
        texts += [(" ".join(many[i : i + 1000]), 0) for i in range(0, len(many), 1000)]
    texts += [("zugrobel " + " ".join(rng.sample(many, 3)), 1) for _ in range(6)]
    rows = _labelled(texts)
    got = _features(spark, rows)
    assert min(got[d] for d, text, _ in rows if "zugrobel" in text) > max(got[d] for d, text, _ in rows if "zugrobel" not in text)


def test_one_class_gives_no_score(spark):
    for toxic in (0, 1):
        df = spark.createDataFrame(_labelled([("some words here", toxic), ("and others there", toxic)]), "doc_id long, text string, toxic int")
        assert {r.predicted for r in toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0)).collect()} == {0}


def test_joined_and_broadcast_words_score_alike(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(300)]
    rows = _labelled([(" ".join(rng.choices(words[:200] if k % 3 else words[100:], k=20)), int(k % 3 == 0)) for k in range(300)])
    want = _features(spark, rows)
    monkeypatch.setattr(toxicity, "HOT", 20)
    got = _features(spark, rows)
    assert all(abs(got[d] - want[d]) < 1e-6 for d in want) and any(want.values())


def _leaks(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_items_rich_in_numbers_are_found(spark):
    items = [
        (1, "Add 12 kg, 15 kg, 18 kg, 21 kg, 24 kg and 30 kg"), (2, "Weights are 12 kg 15 kg 18 kg 21 kg 24 kg 27 kg 30 kg and the mean is asked for"),
        (3, "3 5 8 13 21 34 55 89 144 233"),
    ]
    docs = [
        (1, "so it said: " + items[0][1] + " please"), (2, "so it said: " + items[1][1] + " please"), (3, "so it said: " + items[2][1] + " please"),
        (11, "Add 10 kg, 11 kg, 13 kg, 14 kg, 16 kg and 17 kg"), (12, "Weights are 1 kg 2 kg 3 kg 4 kg 5 kg 6 kg 7 kg and the mean is asked for"),
        (21, "a table 1 2 4 8 16 32 64 128 256 512 1024 of powers"), (22, "only 10 kg, 11 kg, 13 kg, 14 kg, 16 kg, 17 kg, 19 kg"),
    ]
    assert _leaks(spark, docs, items) == {(1, 1), (2, 2), (3, 3), (11, 1), (12, 2)}


def test_windows_of_placeholders_alone_need_the_whole_template(spark):
    """The windows with words of an item match in all; only the placeholders before them, or their number, differ."""
    items = [(1, "It took 12 kg, 15 kg, 18 kg, 21 kg, 24 kg, 12 kg and 30 kg")]
    docs = [
        (1, "so: it took 10 kg, 11 kg, 13 kg, 14 kg, 16 kg, 10 kg and 19 kg please"), (2, "it gave 10 kg, 11 kg, 13 kg, 14 kg, 16 kg, 17 kg and 19 kg"),
        (3, "10 kg, 11 kg, 13 kg, 14 kg, 16 kg, 17 kg and 19 kg"), (4, "it took 10 kg, 11 kg, 13 kg, 14 kg, 16 kg, 17 kg and 19 kg"),
    ]
    assert _leaks(spark, docs, items) == {(1, 1)}


def test_short_items_match_whole_documents(spark):
    items = [(1, "Yes"), (2, "42 apples"), (3, "Red, green, blue"), (4, "")]
    docs = [(1, "yes!"), (2, "42 apples."), (3, "43 apples"), (4, "red green\nblue"), (5, "yes we saw red green blue and 42 apples"), (6, "")]
    assert _leaks(spark, docs, items) == {(1, 1), (2, 2), (4, 3)}


def test_copies_wrapped_elsewhere_or_with_other_names_are_found(spark):
    item = "On the way home from work the nurse Clara counts 14 red cars and 9 blue cars"
    other = "Clara has 14 apples and eats 3 of them. Clara sells the rest at 2 dollars each"
    items = [(1, item), (2, other)]
    docs = [
        (1, item.replace(" Clara", "\nClara")), (2, item.replace(" ", "  ")), (3, item.replace(" ", "\t")), (4, "see, on" + item[2:]), (5, item.lower().replace("clara", "Clara")),
        (11, other.replace("Clara", "Bruno")), (12, "Easy. " + other.replace("2 dollars", "2\ndollars")), (13, "well, " + other), (14, other.replace("Clara", "Bruno", 1)),
    ]
    assert _leaks(spark, docs, items) == {*((d, 1) for d in range(1, 6)), *((d, 2) for d in range(11, 14))}


def test_short_texts_at_the_threshold_share_a_band():
    rng, bands = np.random.default_rng(4), near_dup.bands_for(80)
    for size in (4, 5, 6, 8):
        for _ in range(100):
            larger = np.sort(rng.integers(0, 1 << 64, size + 1, dtype=np.uint64))
            smaller = np.delete(larger, rng.integers(size + 1))
            assert (near_dup.band_keys(larger, bands) == near_dup.band_keys(smaller, bands)).any()


def test_pairs_at_the_threshold_are_linked_at_every_size(spark):
    """2,000 pairs of sets of each size, near to 85 % alike, none of them lost."""
    rng = random.Random(6)
    docs, want, word = [], {}, 0
    for size in (6, 12, 20, 80, 300):
        for k in range(2000 if size < 80 else 400):
            words = [f"w{word + i}" for i in range(size + 4)]
            word += size + 4
            other = list(words)
            if size >= 80:  # each word in the middle that is replaced changes five shingles, each at the end one
                free = int((size * 0.15 / 1.85) // 5)
                for i in rng.sample(range(10, size - 10, 5), free):
                    other[i] = f"x{i}-{word}"
            else:
                other += [f"y{word}-{i}" for i in range(int(size * 0.15 / 0.85))]
            a, b = len(docs), len(docs) + 1
            docs += [(a, " ".join(words)), (b, " ".join(other))]
            same = len(s := {tuple(words[i : i + 5]) for i in range(len(words) - 4)} & {tuple(other[i : i + 5]) for i in range(len(other) - 4)})
            assert s and 100 * same >= 85 * (len(words) + len(other) - 8 - same)
            want[a] = want[b] = a
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_dense_repeats_in_one_bucket(spark):
    """A large family of edits of one text: a hot bucket with many components, links only between few of them."""
    from test_exact import brute_components, shingles

    rng = random.Random(7)
    base = [f"b{i}" for i in range(160)]
    docs = []
    for d in range(400):
        words = list(base)
        for i in rng.sample(range(160), rng.choice((0, 1, 2, 2, 3, 4, 6, 8))):
            words[i] = f"e{d}-{i}"
        docs.append((d, " ".join(words)))
    want = brute_components({d: shingles(t) for d, t in docs}, 85)
    got = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
