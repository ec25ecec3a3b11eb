"""Sentence splitting and answer-candidate patterns, one Column function each.

Every extractor takes one sentence (whitespace already collapsed) and gives an
``array<string>`` of cleaned, valid candidates in match order. Word boundaries
are spelled out with look-arounds, so that they mean "letter, number or
underscore" on every JDK.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozemill import fixed_values as fv

_W = r"[\p{L}\p{N}_]"
# The look-ahead settles most positions at once; the look-behind is dearer.
_OPENS_NUMBER = rf"(?=\p{{Nd}})(?<!{_W})"
_OPENS_CAPITAL = f"(?=[A-ZА-ЯЁ])(?<!{_W})"
_CLOSES = f"(?!{_W})"
_EDGE = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_S = fv.WHITESPACE
_D = r"\p{Nd}"

DATE_PATTERNS = (
    rf"(?iu){_OPENS_NUMBER}{_D}{{1,2}}{_S}+{fv.MONTH_NAME_PATTERN}{_S}+{_D}{{4}}{_CLOSES}",
    rf"(?iu){_OPENS_NUMBER}{_D}{{4}}{_S}*{fv.YEAR_WORD_PATTERN}{_EDGE}",
    rf"(?iu){_OPENS_NUMBER}{_D}+{fv.DECIMALS_PATTERN.replace(chr(92) + 'd', _D)}{_S}*{fv.UNIT_PATTERN}{_EDGE}",
)
ABBREVIATION_PATTERN = (
    f"{_OPENS_CAPITAL}{fv.CAPITALS_PATTERN}(?:-{fv.CAPITALS_PATTERN})?{_CLOSES}"
)
# A single capitalised word that opens a sentence must be consumed but not
# reported: it matches outside group 1, which then comes back empty.
_NOT_INITIAL = rf"(?<=[^.!?\s]\s?)"
NAME_PATTERN = (
    f"{_OPENS_CAPITAL}(?:("
    f"{fv.CAPITALIZED_PATTERN}(?:{_S}+{fv.CAPITALIZED_PATTERN})"
    f"{{1,{fv.MAX_NAME_WORDS - 1}}}{_EDGE}"
    f"|{_NOT_INITIAL}{fv.CAPITALIZED_PATTERN}{_EDGE}"
    f")|{fv.CAPITALIZED_PATTERN}{_EDGE})"
)
# Letters, decimal digits, and the superscript, subscript and circled digits.
_LETTER_OR_DIGIT = (
    r"[\p{L}\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}"
    r"\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}"
    r"\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}"
    r"\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}"
    r"\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]"
)


def split_sentences(text: Column) -> Column:
    """Pieces that end in '.', '!' or '?' before whitespace; blanks dropped.

    Expects collapsed whitespace, so that no piece can start or end in a space.
    """
    return F.filter(F.split(text, f" (?<=[{fv.SENTENCE_END}] )"), lambda s: s != "")


def clean_candidate(c: Column) -> Column:
    return F.btrim(c, F.lit(fv.STRIP_CHARS))


_LONGEST_STOP_WORD = max(map(len, fv.STOP_WORDS))


def is_stop_word(c: Column) -> Column:
    # Lower-casing is dear, so length decides first.
    return (F.length(c) <= _LONGEST_STOP_WORD) & F.lower(c).isin(*fv.STOP_WORDS)


def _has_valid_form(c: Column) -> Column:
    return F.length(c).between(fv.MIN_ANSWER_LENGTH, fv.MAX_ANSWER_LENGTH) & ~is_stop_word(c)


def is_valid_candidate(c: Column) -> Column:
    return _has_valid_form(c) & c.rlike(_LETTER_OR_DIGIT)


def _matches(sentence: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(sentence, F.lit(pattern), F.lit(group))


def _none() -> Column:
    return F.array().cast("array<string>")


def quoted(sentence: Column) -> Column:
    found = F.transform(_matches(sentence, fv.QUOTED_PATTERN, 1), clean_candidate)
    return F.when(sentence.rlike('["«]'), F.filter(found, is_valid_candidate)).otherwise(_none())


# The patterns below only match text with a letter or a digit, and, but for the
# dot of a year, with nothing to strip; so each checks what is left to check.


def dates_and_numbers(sentence: Column) -> Column:
    found = F.concat(*[_matches(sentence, p) for p in DATE_PATTERNS])
    valid = F.filter(F.transform(found, clean_candidate), _has_valid_form)
    return F.when(sentence.rlike(_D), valid).otherwise(_none())


def abbreviations(sentence: Column) -> Column:
    return F.filter(_matches(sentence, ABBREVIATION_PATTERN), _has_valid_form)


def proper_names(sentence: Column) -> Column:
    return F.filter(_matches(sentence, NAME_PATTERN, 1), _has_valid_form)


_LONG_STOP_WORDS = [w for w in fv.STOP_WORDS if len(w) >= fv.MIN_KEYWORD_LENGTH]


def key_words(sentence: Column) -> Column:
    """The words of a sentence; null in place of short words and stop words."""

    def is_key(w: Column) -> Column:
        return (F.length(w) > _LONGEST_STOP_WORD) | (
            (F.length(w) >= fv.MIN_KEYWORD_LENGTH) & ~F.lower(w).isin(*_LONG_STOP_WORDS)
        )

    words = F.regexp_extract_all(sentence, F.lit(fv.WORD_PATTERN), F.lit(0))
    return F.transform(words, lambda w: F.when(is_key(w), w))


def key_phrases(words: Column, size: int) -> Column:
    """Phrases of ``size`` neighbouring key words; a null word voids the phrase."""

    def phrase(word: Column, i: Column) -> Column:
        rest = [F.concat(F.lit(" "), F.get(words, i + k)) for k in range(1, size)]
        return reduce(lambda a, b: F.concat(a, b), rest, word)

    return F.filter(
        F.transform(words, phrase),
        lambda p: p.isNotNull() & (F.length(p) <= fv.MAX_ANSWER_LENGTH),
    )
