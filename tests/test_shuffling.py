"""The keyed bijection between row numbers and places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozemill.operators import shuffling


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 31, 64, 65, 1000, 1023, 4099])
def test_places_are_a_bijection(n):
    numbers = np.arange(n)
    for seed in (0, 1, 42):
        places = shuffling.permuted(numbers, n, seed)
        assert sorted(places.tolist()) == numbers.tolist()
        assert (shuffling.permuted(places, n, seed, back=True) == numbers).all()


def test_huge_tables_come_back():
    n = 10**15 + 37
    numbers = np.random.default_rng(1).integers(0, n, 5000)
    places = shuffling.permuted(numbers, n, 9)
    assert places.min() >= 0 and places.max() < n and len(set(places.tolist())) == len(set(numbers.tolist()))
    assert (shuffling.permuted(places, n, 9, back=True) == numbers).all()
    with pytest.raises(ValueError):
        shuffling.permuted(numbers, 1 << 61, 9)


def test_places_look_drawn():
    n = 20_000
    places = [shuffling.permuted(np.arange(n), n, seed) for seed in (7, 42)]
    for p in places:
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.03
        steps = np.diff(p)
        assert (np.abs(steps) < 10).mean() < 0.005 and len(set(steps.tolist())) > n / 4
        counts = np.histogram(p[: n // 10], 20, (0, n))[0]
        assert counts.min() > 60 and counts.max() < 145  # 100 expected
    assert (places[0] == places[1]).mean() < 0.001


def test_batches_and_their_inverse(spark):
    n = 1003
    rows = spark.range(n).withColumnRenamed("id", "row_idx").repartition(5)
    placed = shuffling.shuffled_batches(rows, 8, 3)
    back = shuffling.batch_rows(F.col("batch_id"), F.col("batch_pos"), 8, n, 3)
    got = placed.withColumn("back", back).collect()
    assert {(r["batch_id"], r["batch_pos"]) for r in got} == {divmod(i, 8) for i in range(n)}
    assert all(r["back"] == r["row_idx"] for r in got)
    again = shuffling.shuffled_batches(rows.coalesce(1), 8, 3, n=n).collect()
    assert set(again) == {r[:3] for r in map(tuple, got)}


def test_no_row_is_moved(spark):
    rows = spark.range(100).withColumnRenamed("id", "row_idx").withColumn("text", F.lit("x"))
    df = shuffling.shuffled_batches(rows, 8, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def test_numbers_outside_are_errors(spark):
    for numbers in ([0, 1, 5], [None, 0, 1], [-1, 0, 1]):
        rows = spark.createDataFrame([(i,) for i in numbers], "row_idx long")
        with pytest.raises(Exception, match="outside"):
            shuffling.shuffled_batches(rows, 2, 1).collect()
    assert shuffling.shuffled_batches(spark.range(0).withColumnRenamed("id", "row_idx"), 2, 1).count() == 0
