"""Documents to packed training sequences: five stages, each a table in, a table out.

Each stage reads what its predecessor kept and returns the columns of
``documents``, but for the last, which returns pieces with their places. run()
writes every stage as Parquet into the folder of spark.checkpoint.dir and reads
it again, so a lost executor costs its own tasks only; a stage's folder is
removed once the next one is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.llm import decontaminate, packing, pii, quality, simhash
from clozemill.llm.common import removed, shared_folder

#: Models and packing cannot be written in SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """The whole row beside its text, so that no output name can clash with a column."""
    return docs.select(F.struct("*").alias("row"), "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_rows(docs), model).where("predicted = 1").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(_rows(docs), items).where("not contaminated").select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts, and counts their characters anew."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return pii.redact(docs, pii.train(docs), length=length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts documents into pieces and gives every piece its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs
