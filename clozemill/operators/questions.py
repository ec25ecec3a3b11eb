"""From answers to questions: model output, templates, and the choice between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill import fixed_values as fv
from clozemill.functions.questions import clean_question, is_valid_question, template_question
from clozemill.functions.text import strip_whitespace

Generator = Callable[[list[str], dict], list[str]]


def attach_model_questions(
    answers: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("doc_id", "rank")
) -> DataFrame:
    """Left join of model output (keys + model_question); a miss gives ''.

    The keys name one answer, so no key is hot and the join spreads evenly.
    """
    joined = answers.join(predictions.select(*keys, "model_question"), list(keys), "left")
    return joined.withColumn("model_question", F.coalesce("model_question", F.lit("")))


def resolve_questions(answers: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """Adds generated_question, model_question, used_fallback and strategy.

    ``template`` always asks the cloze question, ``model`` never does, and
    ``hybrid`` asks it where the model's question is not usable.
    """
    if strategy not in fv.STRATEGIES:
        raise ValueError(f"Unknown strategy: {strategy!r}, use one of {fv.STRATEGIES}")
    template = template_question(
        F.col("answer_text"), F.col("answer_kind"), F.col("source_sentence")
    )
    if strategy == "template":
        model, fallback = F.lit(""), F.lit(True)
    else:
        if "model_question" not in answers.columns:
            raise ValueError(f"Strategy {strategy!r} needs a model_question column")
        model = clean_question(F.coalesce(F.col("model_question"), F.lit("")))
        fallback = F.lit(False) if strategy == "model" else ~is_valid_question(model)
    columns = [c for c in answers.columns if c != "model_question"]
    return answers.select(
        *columns,
        F.when(fallback, template).otherwise(model).alias("generated_question"),
        model.alias("model_question"),
        fallback.alias("used_fallback"),
        F.lit(strategy).alias("strategy"),
    )


def batch_generate(
    df: DataFrame,
    make_generator: Callable[[], Generator],
    config: dict | None = None,
    source: str = "source",
    output: str = "prediction",
    max_source_length: int | None = None,
) -> DataFrame:
    """Runs a text generator over a column, in Arrow batches on the executors.

    ``make_generator`` is called once per task, so a model is loaded where it is
    used. Only the source column travels to Python; sources are cut to
    ``max_source_length`` tokens first, when given. The batch size is the
    session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    settings = {**fv.GENERATION_DEFAULTS, **(config or {})}

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generator = make_generator()
        for batch in batches:
            yield pd.Series(generator(batch.tolist(), settings), dtype="object")

    text = F.col(source)
    if max_source_length is not None:
        text = F.array_join(F.slice(F.split(text, " "), 1, max_source_length), " ")
    return df.withColumn(output, strip_whitespace(generate(text)))


def prediction_rows(
    examples: DataFrame, predictions: DataFrame, key: str = "row_idx"
) -> DataFrame:
    """Examples joined to their predictions by row, in the six-column layout."""
    return examples.join(predictions.select(key, "prediction"), key, "inner").select(
        key,
        "example_id",
        "dataset_name",
        "context",
        "answer_text",
        F.col("target").alias("reference_question"),
        F.col("prediction").alias("generated_question"),
    )
