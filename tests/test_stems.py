"""Stems and the stages of word alignment."""

import random

import pytest
from pyspark.sql import functions as F

from clozemill.functions import stems
from clozemill.functions.overlap import _align
from clozemill.operators import metrics

GOLDENS = """
caresses caress, ponies poni, ties tie, caress caress, cats cat, feed feed, agreed agre, plastered plaster,
bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop, tanned tan,
falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, enjoy enjoy, by by, say say,
spied spi, died die, cries cri, relational relat, conditional condit, rational ration, valenci valenc,
digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog,
vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis,
hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl,
triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop,
adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend,
adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog,
effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll,
dying die, news news, proceed proceed, as as, generalizations gener, oscillators oscil, archaeology archaeolog,
ё ё, дома дома, быстро быстро, 1990s 1990, owed owe, using use
"""


@pytest.mark.parametrize("pair", [p.strip() for p in GOLDENS.replace("\n", " ").split(",")])
def test_goldens(pair):
    word, expected = pair.split()
    assert stems.word_stem(word) == expected


def test_shapes():
    assert stems._shape("syzygy") == "101010" and stems._shape("yay") == "101"
    assert [stems._measure(w) for w in ("tree", "by", "trouble", "oats", "troubles", "private")] == [0, 0, 1, 1, 2, 2]


def test_odd_words_keep_a_stem():
    rng = random.Random(3)
    look_up = stems.remembering()
    for _ in range(20_000):
        word = "".join(rng.choice("aeiouylsztnbdngmi") for _ in range(rng.randint(0, 3)))
        word += rng.choice(["", "ed", "ing", "ies", "ied", "eed", "alli", "ion", "ement", "y", "ll", "e", "logi", "s"])
        assert look_up(word) == stems.word_stem(word) == look_up(word)
        assert word == "" or stems.word_stem(word)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(stems, "REMEMBERED", 3)
    look_up = stems.remembering()
    assert [look_up(w) for w in ("cats", "dogs", "cows", "pigs", "cats")] == ["cat", "dog", "cow", "pig", "cat"]


def plain(x, y, stem, synonyms):
    """All stages by looking at every pair, both texts from the end."""
    free_x, free_y, found = list(range(len(x))), list(range(len(y))), []
    for same in (lambda a, b: a == b, lambda a, b: stem(a) == stem(b), lambda a, b: b in synonyms.get(a, ())):
        for i in free_x[::-1]:
            for j in free_y[::-1]:
                if same(x[i], y[j]):
                    found.append((i, j))
                    free_x.remove(i)
                    free_y.remove(j)
                    break
    found.sort()
    chunks = sum((d - b, c - a) != (1, 1) for (a, b), (c, d) in zip(found, found[1:]))
    return len(found), chunks + bool(found)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_equals_looking_at_all_pairs(seed):
    rng = random.Random(seed)
    words = ["run", "runs", "running", "cat", "cats", "dog", "hope", "hoping", "hopes", "fall"]
    synonyms = {"run": {"dog", "fall"}, "cats": {"dog"}, "hope": {"fall", "cat"}}
    x, y = ([rng.choice(words) for _ in range(rng.randint(0, 9))] for _ in range(2))
    assert _align(x, y, synonyms, stems.word_stem) == plain(x, y, stems.word_stem, synonyms)


def test_meteor_by_stages(spark):
    pairs = spark.createDataFrame(
        [("the cats were falling", "the cat was falls"), (None, "a"), ("", "")], "prediction string, reference string"
    ).limit(1)
    exact, stemmed = metrics.meteor_exact(pairs).head(), metrics.meteor_stems(pairs).head()
    assert exact.meteor == pytest.approx((1 - 0.5) * 0.25)
    # the, cats and falling match in two chunks: 3 of 4 words on both sides
    assert stemmed.meteor == pytest.approx((1 - 0.5 * (2 / 3) ** 3) * 0.75)
    table = spark.createDataFrame([("were", "was")], "word string, synonym string")
    assert metrics.meteor_stems(pairs, synonyms=table).head().meteor == pytest.approx(1 - 0.5 / 4**3)


def test_a_column_of_stems(spark):
    df = spark.createDataFrame([("cats",), (None,), ("",)], "w string").select(stems.stem(F.col("w")).alias("s"))
    assert [r.s for r in df.collect()] == ["cat", None, ""]


def test_wrong_options_are_raised(spark):
    pairs = spark.createDataFrame([("a", "a")], "prediction string, reference string")
    for wrong in ({"tokenizer": "typo"}, {"synonyms": pairs}):
        with pytest.raises(ValueError):
            metrics.isolated_text_metrics(pairs, **wrong)
    with pytest.raises(TypeError):
        metrics.isolated_text_metrics(pairs, tokeniser="ascii")
