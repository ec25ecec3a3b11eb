"""Prompts, cloze questions and question checks as Column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozemill import fixed_values as fv
from clozemill.functions.text import collapse_whitespace, strip_whitespace


def build_source(template: str, context: Column, answer: Column) -> Column:
    """The prompt template filled with a context and an answer.

    The template is split on the driver, so braces inside a context stay text.
    """
    fields = {"context": context, "answer": answer}
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in fields or spec or conversion:
            raise ValueError(f"Unsupported field in template: {name!r}")
        parts.append(fields[name])
    return F.concat(*parts) if parts else F.lit("")


def clean_question(c: Column) -> Column:
    return collapse_whitespace(F.replace(c, F.lit(fv.SENTINEL_TOKEN), F.lit("")))


def is_valid_question(c: Column) -> Column:
    text = strip_whitespace(c)
    return (
        (F.length(text) >= fv.MIN_QUESTION_LENGTH)
        & text.rlike(r"\p{L}")
        & ~F.lower(text).isin(*fv.EMPTY_PROMPTS)
    )


def template_question(answer: Column, kind: Column, sentence: Column) -> Column:
    """A cloze question: the answer is blanked out of its sentence.

    The blanked sentence is only trimmed: patterns would be searched for at
    every character of it, several times per answer.
    """
    sentence = F.coalesce(sentence, F.lit(""))
    blanked = strip_whitespace(F.replace(sentence, answer, F.lit(fv.BLANK)))
    fact = F.rtrim(blanked, F.lit(fv.SENTENCE_END))

    def opening(which: int) -> Column:
        said = F.lit(fv.QUESTION_TEXTS["other"][which])
        for name, texts in fv.QUESTION_TEXTS.items():
            if name != "other":
                said = F.when(kind == name, F.lit(texts[which])).otherwise(said)
        return said

    # Something but end marks is left, and the kind has a text for facts.
    asks_fact = (fact != "") & opening(0).isNotNull()
    return F.concat(
        F.when(asks_fact, opening(0)).otherwise(opening(1)),
        F.when(asks_fact, fact).otherwise(answer),
        F.lit("?"),
    )
