import pytest
from pyspark.sql import functions as F

from clozemill.fixed_values import DEFAULT_TEMPLATE
from clozemill.operators import corpus, ordering


def test_flat_layouts_and_ids(spark):
    rows = [
        (0, "a", " The  sea ", "What?", ["water", "x"]),
        (1, "", "The sea", "Where?", ["here"]),
        (2, None, "The sea", "Who?", ["me"]),
        (3, "d", "The sea", " \n", ["me"]),
        (4, "e", "The sea", "Why?", []),
        (5, "f", None, "Why?", ["so"]),
    ]
    df = spark.createDataFrame(rows, "row_idx long, id string, context string, question string, a array<string>")
    expected = [(0, "a", "water"), (1, None, "here"), (2, None, "me")]
    for answers in (
        F.struct(F.col("a").alias("text")),
        F.transform("a", lambda t: F.struct(t.alias("text"))),
        F.col("a"),
    ):
        out = corpus.normalize_qa(df.withColumn("answers", answers), DEFAULT_TEMPLATE, "set", "en")
        got = out.orderBy("row_idx").collect()
        assert [(r.row_idx, r.example_id if r.row_idx == 0 else None, r.answer_text) for r in got] == expected
        assert got[1].example_id.startswith("set-") and got[1].example_id != got[2].example_id
        assert got[0].source == "generate question: context: The sea answer: water"
        assert got[0].target == got[0].question == "What?"
    as_text = corpus.normalize_qa(df.withColumn("answers", F.col("a")), DEFAULT_TEMPLATE, null_id_as_text=True)
    assert as_text.where("row_idx = 2").head().example_id == "None"
    plain = df.withColumn("answers", F.lit("water"))
    assert corpus.normalize_qa(plain, DEFAULT_TEMPLATE).count() == 0
    assert corpus.normalize_qa(df.drop("a"), DEFAULT_TEMPLATE).count() == 0


def test_text_struct_gives_its_first_character(spark):
    df = spark.createDataFrame([(("word",),)], "answers struct<text:string>")
    first = corpus.first_answer(F.col("answers"), df.schema["answers"].dataType)
    assert df.select(first).head()[0] == "w"


def test_nested_questions_are_numbered_over_kept_rows(spark):
    qa = "array<struct<id:string, question:string, answers:array<struct<text:string>>>>"
    rows = [
        (10, "c1", "t1", [("", "q1", [("a",)]), ("x", "", [("a",)]), ("y", "q2", [("b",)])]),
        (70_000, "", "t2", [("", "q3", [("a",)])]),
        (200_000, "c3", None, None),
        (200_001, "c4", "t4", [("", "q4", []), (None, "q5", [("c",)]), ("", "q6", [("d",)])]),
    ]
    df = spark.createDataFrame(rows, f"row_idx long, context string, title string, qas {qa}").repartition(3)
    out = corpus.normalize_qa(df, DEFAULT_TEMPLATE, "n", "ru").orderBy("row_idx").collect()
    assert [(r.row_idx, r.example_id, r.question, r.title) for r in out] == [
        (0, "n-0", "q1", "t1"), (1, "y", "q2", "t1"), (2, "n-2", "q5", "t4"), (3, "n-3", "q6", "t4"),
    ]


@pytest.mark.parametrize("limit, expected", [(None, 10), (3, 3), ("4", 4), (0, 0), (99, 10)])
def test_limit_keeps_the_first_rows(spark, limit, expected):
    df = spark.range(10).select((F.col("id") * 7 % 10).alias("row_idx")).repartition(3)
    rows = corpus.limit_first_n(df, limit).collect()
    assert sorted(r.row_idx for r in rows) == list(range(expected))
    unplaced = df.union(spark.sql("select cast(null as bigint)"))
    if limit is not None:
        with pytest.raises(Exception, match="have no place"):
            corpus.limit_first_n(unplaced, limit).count()


def test_union_keeps_order_and_fills_gaps(spark):
    a = spark.createDataFrame([(0, "x")], "row_idx long, q string")
    b = spark.createDataFrame([(0, "y", "t")], "row_idx long, q string, title string")
    rows = corpus.union_corpora([a, b]).orderBy("spec_pos", "row_idx").collect()
    assert [(r.spec_pos, r.q, r.title) for r in rows] == [(0, "x", None), (1, "y", "t")]
    with pytest.raises(ValueError, match="No corpus is given"):
        corpus.union_corpora([])


def test_running_values_across_chunks(spark):
    rows = [(k, i * 3 - 40, (i * 37) % 11) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    out = ordering.with_running(
        df, "o", {"s": ("sum", F.col("v")), "m": ("min", F.col("v"))}, ("k",), width=4
    )
    got = {(r.k, r.o): (r.s, r.m) for r in out.collect()}
    for k in "ab":
        seen = []
        for _, o, v in [r for r in rows if r[0] == k]:
            seen.append(v)
            assert got[k, o] == (sum(seen), min(seen))
    dense = ordering.with_dense_index(df.where("k = 'a'"), "o", "n", width=2).orderBy("o").collect()
    assert [r.n for r in dense] == list(range(60))


@pytest.mark.parametrize("width", [2, 16])
def test_first_rows_of_any_order(spark, monkeypatch, width):
    monkeypatch.setattr(corpus, "DENSE_WIDTH", width)
    numbers = [*range(40), *range(100, 900, 50), -7, 10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in numbers], "row_idx long, text string").repartition(5)
    for n in (0, 1, 3, 40, 41, 57, 58, 59, 1000):
        got = {r["row_idx"] for r in corpus.limit_first_n(df, n).collect()}
        assert got == set(sorted(numbers)[:n])
    assert corpus.limit_first_n(df, None) is df
    assert corpus.limit_first_n(df.where("false"), 5).count() == 0
    equal = spark.createDataFrame([(1,)] * 9 + [(0,)], "row_idx long")
    assert corpus.limit_first_n(equal, 4).count() == 4
    with pytest.raises(Exception, match="have no place"):
        corpus.limit_first_n(spark.createDataFrame([(None,), (1,)], "row_idx long"), 1).collect()


def test_rows_beyond_the_limit_are_dropped_before_the_shuffle(spark):
    df = spark.range(500_000).selectExpr("id as row_idx", "uuid() as text")
    plans = set()
    for n in (10, 150_000):
        near = corpus.rows_near_first(df, n)
        assert n <= near.count() <= n + 65536
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Subquery")[0]
        plans.add(corpus.limit_first_n(df, n)._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert len(plans) == 1
    assert {r["row_idx"] for r in corpus.limit_first_n(df, 10).collect()} == set(range(10))
