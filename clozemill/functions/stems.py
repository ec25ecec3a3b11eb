"""Stems of English words by suffix rules, for word alignment.

A word is looked at beside its shape, a string with 0 for each vowel and 1 for
each consonant; y is a vowel after a consonant. The measure of a stem is the
number of times a vowel is followed by a consonant. Words of other scripts have
no ending that fits, and stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill import fixed_values as fv

#: Words whose stems a task remembers at once.
REMEMBERED = 1 << 16


def _shape(word: str) -> str:
    marks: list[str] = []
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and marks[-1:] == ["1"])
        marks.append("0" if vowel else "1")
    return "".join(marks)


def _measure(stem: str) -> int:
    return _shape(stem).count("01")


def _short_end(word: str) -> bool:
    """Consonant, vowel and a consonant that is not w, x or y; or a vowel and a consonant alone."""
    shape = _shape(word)
    return shape == "01" or (shape.endswith("101") and word[-1] not in "wxy")


def _replaced(word: str, rules, fits) -> str:
    """The word by the first rule whose ending it has, if the rest fits."""
    for ending, new in rules:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            return rest + new if fits(rest, ending) else word
    return word


def _without_plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    return _replaced(word, fv.STEM_PLURALS, lambda rest, ending: True)


def _without_tense(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = re.search("(ed|ing)$", word)
    if not ending or "0" not in _shape(word[: ending.start()]):
        return word
    rest = word[: ending.start()]
    if rest.endswith(tuple(old for old, _ in fv.STEM_REPAIRS)):
        return rest + "e"
    if rest[-2:-1] == rest[-1] and _shape(rest)[-1] == "1":
        return rest if rest[-1] in "lsz" else rest[:-1]
    return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest


def _with_i(word: str) -> str:
    return word[:-1] + "i" if len(word) > 2 and word[-1] == "y" and _shape(word)[-2] == "1" else word


def _without_double(word: str) -> str:
    def fits(rest: str, ending: str) -> bool:
        return _measure(rest + "log" if ending == "logi" else rest) > 0

    shorter = _replaced(word, fv.STEM_DOUBLE, fits)
    return _without_double(shorter) if word.endswith("alli") and shorter != word else shorter


def _without_single(word: str) -> str:
    return _replaced(word, fv.STEM_SINGLE, lambda rest, ending: _measure(rest) > 0)


def _without_last(word: str) -> str:
    def fits(rest: str, ending: str) -> bool:
        return _measure(rest) > 1 and (ending != "ion" or rest[-1] in "st")

    return _replaced(word, [(ending, "") for ending in fv.STEM_LAST], fits)


def _tidy(word: str) -> str:
    if word.endswith("e"):
        measure = _measure(word[:-1])
        if measure > 1 or (measure == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


_STEPS = (_without_plural, _without_tense, _with_i, _without_double, _without_single, _without_last, _tidy)


def word_stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay."""
    if word in fv.STEM_IRREGULAR:
        return fv.STEM_IRREGULAR[word]
    if len(word) > 2:
        for step in _STEPS:
            word = step(word)
    return word


def remembering() -> Callable[[str], str]:
    """``word_stem`` with a memory of its own, emptied when it is full."""
    known: dict[str, str] = {}

    def look_up(word: str) -> str:
        found = known.get(word)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[word] = word_stem(word)
        return found

    return look_up


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    """The stem of each lower-case word; null stays null."""
    return words.map(lambda w: None if w is None else word_stem(w))
