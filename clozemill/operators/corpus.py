"""Question-answer corpora of several layouts, normalised into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.fixed_values import WHITESPACE
from clozemill.functions.questions import build_source
from clozemill.functions.text import falsy_to_empty, normalize_text
from clozemill.operators.ordering import DENSE_WIDTH, with_dense_index, with_running

ROW = "row_idx"
QA_COLUMNS = (
    "example_id", "context", "answer_text", "question", "source", "target",
    "dataset_name", "language",
)


def _first_answer_raw(answers: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    nothing = F.lit(""), T.StringType()
    if isinstance(dtype, T.StructType):
        if "text" not in dtype.names:
            return nothing
        text_type = dtype["text"].dataType
        if isinstance(text_type, T.ArrayType):
            return F.get(answers["text"], 0), text_type.elementType
        # The first element of a plain string is its first character.
        return F.substring(answers["text"].cast("string"), 1, 1), T.StringType()
    if isinstance(dtype, T.ArrayType):
        first, element = F.get(answers, 0), dtype.elementType
        if not isinstance(element, T.StructType):
            return first, element
        if "text" in element.names:
            return first["text"], element["text"].dataType
    return nothing


def first_answer(answers: Column, dtype: T.DataType) -> Column:
    """The first answer text, from a struct of lists, a list of structs or a list.

    The layout is decided once from the column type. Any other type, such as
    the plain text of a CSV cell, has no answer.
    """
    raw, raw_type = _first_answer_raw(answers, dtype)
    return normalize_text(raw, raw_type)


def _has_text(c: Column) -> Column:
    # Repairing an encoding never leaves only whitespace behind, so emptiness
    # can be read from the raw text.
    return c.rlike(f"[^{WHITESPACE[1:]}")


def drop_incomplete(df: DataFrame, columns=("context", "question", "answer_text")) -> DataFrame:
    """Keeps the rows in which every one of the columns has text."""
    return df.where(reduce(lambda a, b: a & b, [F.length(c) > 0 for c in columns]))


def _raw_field(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    return falsy_to_empty(F.col(name), df.schema[name].dataType)


def normalize_qa(
    df: DataFrame,
    template: str,
    dataset_name: str = "local",
    language: str = "unknown",
    null_id_as_text: bool = False,
) -> DataFrame:
    """The canonical rows of a corpus: row_idx and the eight text columns.

    A table with a ``qas`` column is flattened (see ``flatten_qas``). A row
    without an id gets ``<dataset>-<hash of context, question and answer>``.
    ``null_id_as_text`` keeps a null id as the text "None".
    """
    if "qas" in df.columns:
        return flatten_qas(df, template, dataset_name, language, null_id_as_text)
    answer = F.lit("")
    if "answers" in df.columns:
        answer = falsy_to_empty(
            *_first_answer_raw(F.col("answers"), df.schema["answers"].dataType)
        )
    # Incomplete rows go before the dear part of the normalisation.
    raw = df.select(
        ROW,
        (F.col("id").cast("string") if "id" in df.columns else F.lit("")).alias("raw_id"),
        _raw_field(df, "context").alias("context"),
        _raw_field(df, "question").alias("question"),
        answer.alias("answer_text"),
    ).where(
        reduce(
            lambda a, b: a & b,
            [_has_text(F.col(c)) for c in ("context", "question", "answer_text")],
        )
    )
    rows = raw.select(
        ROW,
        "raw_id",
        *[normalize_text(F.col(c)).alias(c) for c in ("context", "question", "answer_text")],
    )
    digest = F.sha2(F.concat_ws("\x01", "context", "question", "answer_text"), 256)
    return rows.select(
        ROW,
        _id_or(F.col("raw_id"), F.concat(F.lit(f"{dataset_name}-"), digest), null_id_as_text)
        .alias("example_id"),
        *_canonical(template, dataset_name, language),
    )


def _id_or(raw_id: Column, fallback: Column, null_id_as_text: bool) -> Column:
    if null_id_as_text:
        raw_id = F.coalesce(raw_id, F.lit("None"))
    return F.when(raw_id != "", raw_id).otherwise(fallback)


def _canonical(template: str, dataset_name: str, language: str) -> list[Column]:
    return [
        F.col("context"),
        F.col("answer_text"),
        F.col("question"),
        build_source(template, F.col("context"), F.col("answer_text")).alias("source"),
        F.col("question").alias("target"),
        F.lit(dataset_name).alias("dataset_name"),
        F.lit(language).alias("language"),
    ]


def flatten_qas(
    df: DataFrame,
    template: str,
    dataset_name: str = "local",
    language: str = "unknown",
    null_id_as_text: bool = False,
) -> DataFrame:
    """One canonical row per nested question, with the title repeated.

    ``row_idx`` becomes the position among the kept rows, and a question without
    an id is called ``<dataset>-<that position>``. Positions come from running
    counts per context row, so that numbering never gathers the questions.
    """
    qa_type = df.schema["qas"].dataType.elementType
    if "answers" in qa_type.names and isinstance(qa_type["answers"].dataType, T.StructType):
        raise ValueError("Nested answers must be a list")

    def raw(qa: Column, name: str) -> Column:
        if name not in qa_type.names:
            return F.lit("")
        return falsy_to_empty(qa[name], qa_type[name].dataType)

    def raw_answer(qa: Column) -> Column:
        if "answers" not in qa_type.names:
            return F.lit("")
        return falsy_to_empty(*_first_answer_raw(qa["answers"], qa_type["answers"].dataType))

    found = F.transform(
        "qas",
        lambda qa: F.struct(
            (qa["id"].cast("string") if "id" in qa_type.names else F.lit("")).alias("raw_id"),
            raw(qa, "question").alias("question"),
            raw_answer(qa).alias("answer_text"),
        ),
    )
    kept = F.filter(found, lambda qa: _has_text(qa["question"]) & _has_text(qa["answer_text"]))
    rows = df.select(
        ROW,
        _raw_field(df, "context").alias("context"),
        _raw_field(df, "title").alias("title"),
        F.when(_has_text(_raw_field(df, "context")), kept).alias("kept"),
    )
    size = F.coalesce(F.size("kept"), F.lit(0)).cast("bigint")
    numbered = with_running(rows, ROW, {"start": ("sum", size)}, inclusive=False)
    questions = numbered.select(
        "start",
        normalize_text(F.col("context")).alias("context"),
        normalize_text(F.col("title")).alias("title"),
        F.posexplode(F.slice("kept", 1, F.size("kept"))).alias("pos", "qa"),
    ).select(
        (F.col("start") + F.col("pos")).alias(ROW),
        "context",
        "title",
        F.col("qa.raw_id").alias("raw_id"),
        normalize_text(F.col("qa.question")).alias("question"),
        normalize_text(F.col("qa.answer_text")).alias("answer_text"),
    )
    counter = F.concat(F.lit(f"{dataset_name}-"), F.col(ROW).cast("string"))
    return questions.select(
        ROW,
        _id_or(F.col("raw_id"), counter, null_id_as_text).alias("example_id"),
        *_canonical(template, dataset_name, language),
        "title",
    )


def rows_near_first(df: DataFrame, n: int, order: str = ROW) -> DataFrame:
    """The rows up to the end of the chunk of the order column that holds the n-th; no row is moved.

    Rows per chunk are counted, and the last chunk needed is a scalar of the
    counts, so this is a filter where rows are read.
    """
    missing = F.raise_error(F.lit(f"Rows without {order} have no place")).cast("bigint")
    chunk = F.shiftright(F.coalesce(F.col(order).cast("bigint"), missing), DENSE_WIDTH)
    counts = df.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))
    counts = with_running(counts, "chunk", {"before": ("sum", F.col("rows"))}, inclusive=False)
    last = counts.where(F.col("before") < n).agg(F.max("chunk"))
    return df.where(chunk <= last.scalar())


def limit_first_n(df: DataFrame, max_samples: int | str | None, order: str = ROW) -> DataFrame:
    """The first rows in table order; None keeps all. A null in the order is an error.

    Only rows up to the end of the n-th row's chunk are shuffled, to be
    numbered, whatever the size of the corpus.
    """
    if max_samples is None:
        return df
    n = max(int(max_samples), 0)
    near = with_dense_index(rows_near_first(df, n, order), order, "__position")
    return near.where(F.col("__position") < n).drop("__position")


def union_corpora(corpora: list[DataFrame]) -> DataFrame:
    """Corpora one after another; ``spec_pos`` keeps their order, gaps are null."""
    if not corpora:
        raise ValueError("No corpus is given")
    tagged = [df.withColumn("spec_pos", F.lit(i)) for i, df in enumerate(corpora)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
