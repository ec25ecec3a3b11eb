import pytest
from pyspark.sql import functions as F

from clozemill.functions import questions as fq
from clozemill.operators import questions as oq
from clozemill.plans.text_to_questions import questions_for_answers, text_to_questions


def asked(spark, answer, kind, sentence):
    df = spark.createDataFrame([(answer, kind, sentence)], "a string, k string, s string")
    return df.select(fq.template_question(F.col("a"), F.col("k"), F.col("s"))).head()[0]


def test_cloze_texts(spark):
    s = "Кит живёт в море, и кит велик!"
    assert asked(spark, "Кит", "proper_name", s) == (
        "Кто или что пропущено в факте: _____ живёт в море, и кит велик?"
    )
    assert asked(spark, "1941", "date_or_number", "Год 1941. ") == (
        "Какая дата или число пропущено в факте: Год _____?"
    )
    assert asked(spark, "1941", "date_or_number", "") == "Когда упоминается 1941?"
    assert asked(spark, "ООН", "abbreviation", s) == "Что обозначает ООН?"
    assert asked(spark, "море", "keyword", "..!") == "Что сказано о море?"
    assert asked(spark, "море", "proper_name", None) == "Кто или что такое море?"
    assert asked(spark, "нет", "quoted", "Да.") == "Какое ключевое понятие пропущено в факте: Да?"


def test_validity(spark):
    cases = {"": False, "12345": False, " a b ": False, "Что это?": True, " Context: ": False,
             "ANSWER:": False, "abcde": True, " abcd ": False}
    df = spark.createDataFrame([(c,) for c in cases], "q string")
    rows = df.select("q", fq.is_valid_question(F.col("q")).alias("v")).collect()
    assert {r.q: r.v for r in rows} == cases


def test_prompt_keeps_braces_of_the_context(spark):
    df = spark.createDataFrame([("c {answer}", "a {context}")], "c string, a string")
    source = fq.build_source("x {context} y {answer} {{z}}", F.col("c"), F.col("a"))
    assert df.select(source).head()[0] == "x c {answer} y a {context} {z}"
    with pytest.raises(ValueError):
        fq.build_source("{other}", F.col("c"), F.col("a"))


@pytest.fixture
def answers_df(spark):
    return spark.createDataFrame(
        [(1, 1, "Кит", "proper_name", "Кит плыл.", "<extra_id_0> Кто  плыл?"),
         (1, 2, "ООН", "abbreviation", "ООН.", "12"), (2, 1, "ВОЗ", "abbreviation", "ВОЗ.", None)],
        "doc_id int, rank int, answer_text string, answer_kind string, source_sentence string, "
        "model_question string",
    )


def test_strategies(answers_df):
    def run(strategy):
        rows = oq.resolve_questions(answers_df, strategy).orderBy("doc_id", "rank").collect()
        return [(r.generated_question, r.model_question, r.used_fallback) for r in rows]

    assert run("hybrid") == [("Кто плыл?", "Кто плыл?", False), ("Что обозначает ООН?", "12", True),
                             ("Что обозначает ВОЗ?", "", True)]
    assert run("model") == [("Кто плыл?", "Кто плыл?", False), ("12", "12", False), ("", "", False)]
    assert [r[1:] for r in run("template")] == [("", True)] * 3
    with pytest.raises(ValueError):
        run("other")


def test_model_questions_join_by_document_and_rank(spark):
    docs = spark.createDataFrame([(1, "Там был NASA и Юпитер.")], "doc_id int, text string")
    predictions = spark.createDataFrame([(1, 2, "Что там было?")], "doc_id int, rank int, model_question string")
    rows = text_to_questions(docs, "hybrid", predictions, max_answers=2).orderBy("rank").collect()
    assert [r.used_fallback for r in rows] == [True, False]
    assert rows[1].generated_question == "Что там было?"


def test_a_generator_asks_about_every_answer(spark):
    def make():
        return lambda sources, config: ["Что это?" if "NASA" in s[-8:] else "" for s in sources]

    docs = spark.createDataFrame([(1, "Там  был NASA и Юпитер.")], "doc_id int, text string")
    rows = text_to_questions(docs, "hybrid", make_generator=make, max_answers=2).collect()
    by_answer = {r.answer_text: r.generated_question for r in rows}
    assert by_answer["NASA"] == "Что это?" and len(by_answer) == 2
    assert all(q for q in by_answer.values())
    with pytest.raises(ValueError):
        text_to_questions(docs, "model")
    items = spark.createDataFrame([(" a  b ", "c")], "context string, answer_text string")

    def echo():
        return lambda sources, config: sources

    out = questions_for_answers(items, echo).head()
    assert out.generated_question == "generate question: context: a b answer: c"


def test_generator_is_built_per_task_and_sees_cut_sources(spark):
    def make():
        return lambda sources, config: [f" {s}|{config['num_beams']} " for s in sources]

    df = spark.createDataFrame([("a b c d",), ("e",)], "source string")
    out = oq.batch_generate(df, make, {"num_beams": 2}, max_source_length=2)
    assert sorted(r.prediction for r in out.collect()) == ["a b|2", "e|2"]
