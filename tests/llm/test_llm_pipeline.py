"""The pipeline against its stages in plain Python, and the contract of the queries."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import duck
from clozemill.llm import pii, quality
from clozemill.llm.queries import ORACLES, QUERIES
from test_llm_operators import check_packing, grouped, plain_fingerprint, plain_hits

SF = "/root/testdata/sf0.001"


def test_run(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in sorted(quality.score(docs, model).collect()) if r["predicted"] == 1]
    places = grouped([plain_fingerprint(r["text"]) for r in good])
    single = [r for i, r in enumerate(good) if places[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for r in single:
        n, hit, _ = plain_hits(r["text"], items)
        if not (hit and 20 * hit >= n):
            clean.append((r["doc_id"], r["text"]))
    left = spark.createDataFrame(clean, "doc_id bigint, text string")
    texts = {}
    for r in pii.find(left, pii.train(left)).collect():
        text = r["text"]
        for s in sorted(r["found"], reverse=True):
            text = text[: s["start"]] + f"[{s['kind'].upper()}]" + text[s["end"] :]
        texts[r["doc_id"]] = text
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    used, least = check_packing(rows, texts, library)
    assert len(texts) < len(good) < docs.count() and used <= least + 1


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, None), (None, "", "x"), (3, "clean words of a small text here", "x"), (3, "clean words of a small text here", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    for source in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, source, SF)
            assert kept.columns == source.columns, name
            assert kept.count() <= source.count()
        assert corpus_pipeline.STAGES[-1][1](spark, source, SF).count() == source.count()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, connection, name):
    got = QUERIES[name](spark, SF)
    want = connection.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def as_text(names, rows):
        order = [names.index(c) for c in columns]
        return sorted(repr([str(r[i]) for i in order]) for r in rows)

    assert as_text(got.columns, got.collect()) == as_text(want.columns, want.fetchall())


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_held_out_rows_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert (abs(a.weights - b.weights) < 1e-6).all()
