"""Documents to questions: mine answers, ask about each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill import fixed_values as fv
from clozemill.functions.questions import build_source
from clozemill.functions.text import collapse_whitespace
from clozemill.operators.answers import top_answers
from clozemill.operators.questions import (
    Generator,
    attach_model_questions,
    batch_generate,
    resolve_questions,
)


def _prompt(template: str, context: str, answer: str) -> Column:
    return build_source(
        template, collapse_whitespace(F.col(context)), collapse_whitespace(F.col(answer))
    )


def text_to_questions(
    docs: DataFrame,
    strategy: str = "template",
    predictions: DataFrame | None = None,
    make_generator: Callable[[], Generator] | None = None,
    config: dict | None = None,
    template: str = fv.DEFAULT_TEMPLATE,
    max_source_length: int | None = None,
    max_answers: int = fv.DEFAULT_MAX_ANSWERS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Ranked answers of every document with their questions.

    The strategies ``model`` and ``hybrid`` need a generator, or a table of
    ``predictions`` (key, rank, model_question). Without the table the job has
    no shuffle at all.
    """
    if strategy == "template":
        return resolve_questions(top_answers(docs, key, text, max_answers), strategy)
    if predictions is not None:
        answers = top_answers(docs, key, text, max_answers)
        return resolve_questions(
            attach_model_questions(answers, predictions, (key, "rank")), strategy
        )
    if make_generator is None:
        raise ValueError(f"Strategy {strategy!r} needs a generator or predictions")
    answers = top_answers(docs, key, text, max_answers, keep=(text,))
    prompts = answers.select(
        *[c for c in answers.columns if c != text],
        _prompt(template, text, "answer_text").alias("source"),
    )
    asked = batch_generate(
        prompts, make_generator, config, output="model_question",
        max_source_length=max_source_length,
    )
    return resolve_questions(asked.drop("source"), strategy)


def questions_for_answers(
    items: DataFrame,
    make_generator: Callable[[], Generator],
    config: dict | None = None,
    template: str = fv.DEFAULT_TEMPLATE,
    max_source_length: int | None = None,
) -> DataFrame:
    """Generated questions for given (context, answer_text) rows."""
    prompts = items.withColumn("source", _prompt(template, "context", "answer_text"))
    asked = batch_generate(
        prompts, make_generator, config, output="generated_question",
        max_source_length=max_source_length,
    )
    return asked.drop("source")
