"""The unigram piece model against exhaustive search, and in use."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from clozemill.operators import batches, subwords

TEXTS = [
    "the lower house and the higher house were built lower than the highest tower",
    "low lower lowest high higher highest tow tower towers",
    "дом и домик у дома, домики и домища",
    " the  the \n house　house ",
    None,
    "",
    "x" * 150,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 5)], "row_idx long, text string").repartition(4)


@pytest.fixture(scope="module")
def words(texts):
    return subwords.word_counts(texts, "text").cache()


@pytest.fixture(scope="module")
def trained(words):
    report = []
    return subwords.train(words, 60, report), report


def ways(word):
    """Every way to cut a word."""
    for bits in itertools.product((0, 1), repeat=len(word) - 1):
        cuts = [0, *[i for i, b in enumerate(bits, 1) if b], len(word)]
        yield [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def score(model, parts):
    return sum(model.scores.get(p, model.unknown if len(p) == 1 else -math.inf) for p in parts)


def random_model(rng):
    pieces = {"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(12)} | {"a", "b"}
    return subwords.Pieces({p: -rng.random() * 6 for p in pieces})


def test_segments_equal_exhaustive_search():
    rng = random.Random(3)
    for _ in range(60):
        model = random_model(rng)
        for _ in range(10):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
            parts, value = model.segment(word)
            assert "".join(parts) == word and value == pytest.approx(score(model, parts))
            assert value == pytest.approx(max(score(model, w) for w in ways(word)))


def test_expected_counts_equal_exhaustive_sums():
    rng = random.Random(4)
    for _ in range(40):
        model = random_model(rng)
        word = "".join(rng.choices("abcd", k=rng.randint(1, 8)))
        counts, likelihood = model.expected(word)
        weights = [(w, math.exp(score(model, w))) for w in ways(word)]
        total = sum(x for _, x in weights)
        assert likelihood == pytest.approx(math.log(total))
        for piece in model.scores:
            assert counts.get(piece, 0.0) == pytest.approx(sum(x * w.count(piece) for w, x in weights) / total)


def test_words_are_counted_whole(words):
    from collections import Counter

    want = Counter(w for t in TEXTS * 5 for w in subwords.words_in(t))
    assert {r["word"]: r["n"] for r in words.collect()} == want
    assert max(map(len, want)) == 64 and want["▁the"] == 25


def test_likelihood_never_falls_between_prunings(trained):
    _, report = trained
    assert len({n for n, _ in report}) > 1
    for (n, before), (m, after) in zip(report, report[1:], strict=False):
        assert n != m or after >= before - 1e-6 * abs(before)


def test_size_and_characters(trained):
    model, _ = trained
    letters = {c for t in TEXTS for w in subwords.words_in(t) for c in w}
    assert letters <= set(model.scores) and len(model.scores) <= 60
    assert sum(map(math.exp, model.scores.values())) == pytest.approx(1.0)
    assert any(len(p) > 3 for p in model.scores)


def test_training_does_not_depend_on_partitions(words, trained):
    again = subwords.train(words.repartition(7), 60)
    assert again.scores.keys() == trained[0].scores.keys()
    assert all(again.scores[p] == pytest.approx(s) for p, s in trained[0].scores.items())


def test_truncation_by_pieces(texts, trained):
    model, _ = trained
    number = subwords.ids_of(model)
    df = texts.select("row_idx", F.col("text").alias("source"), F.lit("the lowest tower q").alias("target"))
    rows = batches.truncate_tokens(df, 12, 3, subwords.tokenizer(model)).collect()
    for r in rows:
        whole = [number.get(p, 0) for w in subwords.words_in(TEXTS[r["row_idx"] % len(TEXTS)]) for p in model.segment(w)[0]]
        target = [number.get(p, 0) for w in subwords.words_in("the lowest tower q") for p in model.segment(w)[0]]
        assert r["input_ids"] == whole[:12] and r["attention_mask"] == [1] * len(whole[:12])
        assert r["labels"] == target[:3] and r["truncated"] == (len(whole) > 12 or len(target) > 3)
    assert 0 in [number.get(p, 0) for p in model.segment("▁q")[0]]


def test_odd_tables(spark, texts):
    none = subwords.word_counts(texts.where("false"), "text")
    assert subwords.train(none, 5).scores == {}
    assert subwords.Pieces({}).segment("ab")[0] == ["a", "b"]
    one = subwords.train(spark.createDataFrame([("▁a", 3)], "word string, n long"), 1)
    assert set(one.scores) == {"▁", "a"}
    with pytest.raises(ValueError):
        subwords.train(none, 0)
