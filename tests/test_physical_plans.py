"""What the plans must keep: where they shuffle, what they read, what runs in Python."""

import pytest

from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import view
from clozemill import fixed_values as fv
from clozemill.functions.questions import template_question
from clozemill.functions.text import normalize_text
from clozemill.operators import answers, corpus, metrics
from clozemill.plans.text_to_questions import text_to_questions

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_need_no_shuffle_and_two_columns(spark):
    text = plan(text_to_questions(view(spark, SF, "documents")))
    assert "Exchange" not in text and "Python" not in text and "Window" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    # a filter here would carry a second copy of the whole chain
    assert " Filter " not in text


def test_documents_without_answers_need_no_join(spark):
    text = plan(answers.documents_without_answers(view(spark, SF, "documents")))
    assert "Join" not in text and "Exchange" not in text and " Filter " not in text


def test_the_search_for_an_answer_can_stop(spark):
    text = plan(answers.documents_without_answers(view(spark, SF, "documents")))
    assert "exists(sentences" in text and "flatten(" not in text
    rows = [(1, "он и она."), (2, "он. 50%x"), (3, None), (4, ""), (5, "к 5. " * 9 + "Слово"), (6, "a" * 91)]
    found = answers.documents_without_answers(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 4, 6]


def test_a_cloze_question_needs_no_pattern(spark):
    rows = [("Кит", "keyword", "\u2003Кит плыл?!. \n"), ("Кит", "keyword", "..Кит!"), ("?!", "keyword", "?!"), ("ООН", "abbreviation", None), ("!", "quoted", " . ! ")]
    df = spark.createDataFrame(rows, "a string, k string, s string")
    asked = df.select(template_question(F.col("a"), F.col("k"), F.col("s")).alias("q"))
    assert "regexp" not in plan(asked).lower() and "rlike" not in plan(asked).lower()
    fact, bare = fv.QUESTION_TEXTS["other"]
    assert [r.q for r in asked.collect()] == [
        f"{fact}_____ плыл?", f"{fact}.._____?", f"{fact}_____?", "Что обозначает ООН?", f"{fact}. _____?",
    ]


def test_a_score_shuffles_only_group_sums(spark):
    text = plan(metrics.compute_text_metrics(view(spark, SF, "v_pairs"), ("lang",)))
    assert text.count("Exchange") == 1 and "partial_sum" in text
    assert text.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("n", [5, 500_000])
def test_limits_have_one_plan(spark, n):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    text = plan(corpus.limit_first_n(df, n))
    assert "TakeOrdered" not in text and "Limit" not in text and "Window" in text


def test_repair_maps_a_column_once(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert plan(df.select(normalize_text(F.col("t")).alias("t"))).count("translate(") == 1
    for name, columns in (("normalize_qa", 4), ("flatten_qas", 4)):
        assert plan(QUERIES[name](spark, SF)).count("translate(") <= columns, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_products_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert "NestedLoop" not in text
