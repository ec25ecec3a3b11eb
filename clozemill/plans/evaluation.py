"""Corpus to predictions to scores, and the reports over many runs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.operators.metrics import isolated_text_metrics
from clozemill.operators.questions import Generator, batch_generate
from clozemill.operators.runs import human_eval_sheet, run_summary
from clozemill.sources.readers import load_corpora
from clozemill.sources.sinks import write_csv, write_jsonl, write_markdown, write_one_csv, write_record

#: From texts to the token vectors of each.
Encoder = Callable[[list[str]], list[list[list[float]]]]


def evaluate_corpus(
    spark: SparkSession,
    config: dict,
    make_generator: Callable[[], Generator],
    split: str = "evaluation_datasets",
    root: str = ".",
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """Generates a question for every row of a corpus, then scores them.

    Predictions are written first and read back for scoring, so the generator
    runs once, and a lost executor costs only its own tasks. ``make_encoder``
    runs once per task and gives a function from texts to the vectors of their
    tokens; with it the scores hold bertscore_f1.
    """
    data = config["data"]
    corpus = load_corpora(spark, data[split], data["source_template"], root)
    generated = batch_generate(
        corpus,
        make_generator,
        config.get("generation"),
        max_source_length=int(data["max_source_length"]),
    )
    out = f"{config['output_dir']}/evaluation"
    rows = generated.select(
        "spec_pos",
        "row_idx",
        "example_id",
        "dataset_name",
        "context",
        "answer_text",
        F.col("target").alias("reference_question"),
        F.col("prediction").alias("generated_question"),
    )
    write_jsonl(rows, f"{out}/predictions")
    written = spark.read.schema(rows.schema).json(f"{out}/predictions")
    pairs = written.select(
        F.xxhash64("spec_pos", "row_idx").alias("pair_id"),
        F.col("generated_question").alias("prediction"),
        F.col("reference_question").alias("reference"),
    )
    vectors = encoded(pairs, make_encoder) if make_encoder else None
    metrics = isolated_text_metrics(pairs.drop("pair_id"), token_vectors=vectors, stems=True)
    write_record(metrics, f"{out}/metrics")
    return spark.read.schema(metrics.schema).json(f"{out}/metrics")


def encoded(pairs: DataFrame, make_encoder: Callable[[], Encoder]) -> DataFrame:
    """Token vectors (pair_id, side, pos, vec) of both texts of every pair."""

    def encode(batches):
        encoder = make_encoder()
        for batch in batches:
            rows = []
            for side in ("prediction", "reference"):
                texts = [t or "" for t in batch[side]]
                for pair, vectors in zip(batch["pair_id"], encoder(texts), strict=True):
                    rows += [(pair, side, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
            yield pd.DataFrame(rows, columns=["pair_id", "side", "pos", "vec"])

    return pairs.mapInPandas(encode, "pair_id bigint, side string, pos int, vec array<double>")


def rating_sheet(spark: SparkSession, predictions: str, output_csv: str) -> DataFrame:
    """Written predictions as a sheet with blank rating columns, saved as CSV in the order of their rows."""
    sheet = human_eval_sheet(spark.read.json(predictions))
    if order := tuple(c for c in ("spec_pos", "row_idx") if c in sheet.columns):
        write_one_csv(sheet, output_csv, order, tuple(sheet.columns))
    else:
        write_csv(sheet, output_csv)
    return sheet


def summarize_runs(
    experiments: DataFrame,
    configs: DataFrame,
    metrics: DataFrame,
    summaries: DataFrame,
    output_csv: str,
    output_md: str,
) -> DataFrame:
    """The research summary of many runs, as CSV and Markdown."""
    summary = run_summary(experiments, configs, metrics, summaries)
    write_one_csv(summary, output_csv, ("group_pos", "pos"))
    write_markdown(summary, output_md)
    return summary
