"""Bootstrap intervals against plain Python, and the sums they come from."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clozemill.operators import bootstrap, metrics


def plain_weight(key, replicate, seed):
    digest = hashlib.md5(f"{key}:{replicate // 8}:{seed}".encode()).digest()
    at = 2 * (replicate % 8)
    u = int.from_bytes(digest[at : at + 2], "big")
    k, below = 0, math.exp(-1)
    while k < 8 and u >= round(below * 65536):
        k += 1
        below += math.exp(-1) / math.factorial(k)
    return k


def test_weights_are_poisson_and_stated():
    got = bootstrap.weights(["a", "7", ""], 37, 3)
    assert got.shape == (3, 37)
    assert [[plain_weight(k, r, 3) for r in range(37)] for k in ("a", "7", "")] == got.tolist()
    many = bootstrap.weights([str(i) for i in range(400)], 500, 0)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02
    for k in range(5):
        assert abs((many == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003
    # Rows and replicates are drawn apart from each other.
    assert abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.2 and abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.2


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "hot" if i % 3 else None, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(500)]
    return spark.createDataFrame(data, "id long, kind string, x double, y double").repartition(6)


def plain(rows, seed, replicates, confidence):
    groups = {}
    for r in rows:
        groups.setdefault(r["kind"], []).append(r)
    out = {}
    for kind, own in groups.items():
        w = np.array([[plain_weight(r["id"], b, seed) for b in range(replicates)] for r in own])
        tail = (1 - confidence) / 2
        found = [len(own)]
        for c in ("x", "y"):
            has = np.array([r[c] is not None for r in own])
            v = np.array([r[c] or 0.0 for r in own])
            means = (v * has) @ w / (has @ w)
            found += [np.quantile(means, q) for q in (tail, 0.5, 1 - tail)]
        out[kind] = found
    return out


def test_means_equal_plain_python(rows):
    got = bootstrap.bootstrap_mean(rows, "id", ("x", "y"), ("kind",), 60, 0.9, seed=5).collect()
    want = plain(rows.collect(), 5, 60, 0.9)
    assert {r["kind"] for r in got} == set(want)
    for r in got:
        assert list(r)[1:] == pytest.approx(want[r["kind"]])


def test_sums_do_not_depend_on_partitions(rows, monkeypatch):
    def sums(df):
        return {tuple(r)[:2]: tuple(r)[2:] for r in bootstrap.replicate_sums(df, "id", ("x",), ("kind",), 11).collect()}

    want = sums(rows.coalesce(1))
    assert len(want) == 22 and sums(rows.repartition(9)) == want
    monkeypatch.setattr(bootstrap, "GROUPS", 1)
    assert sums(rows.repartition(2)) == want


def test_only_sums_are_exchanged(spark, rows):
    plan = bootstrap.bootstrap_mean(rows, "id", ("x",), ("kind",), 40)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :] if "MapInArrow" in plan else plan[plan.index("mapInArrow") :]
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning" not in below
    assert "partial_sum" in plan


PAIRS = [(i, "en", " ".join("abcdefgh"[: 2 + i % 6]), " ".join("abcdefgh"[i % 3 :])) for i in range(80)]


def test_scores_hold_the_plain_mean(spark):
    pairs = spark.createDataFrame(PAIRS, "id long, lang string, prediction string, reference string")
    names = ("rouge1", "rouge2", "rougeL", "rougeLsum", "sacrebleu", "meteor")
    got = bootstrap.bootstrap_text_metrics(pairs, "id", ("lang",), names, replicates=200).head()
    point = metrics.compute_text_metrics(pairs, ("lang",), names).head()
    assert got["num_examples"] == 80
    for name in names:
        low, mid, high = (got[f"{name}_{x}"] for x in ("low", "mid", "high"))
        assert low < mid < high and low < point[name] < high
        assert abs(mid - point[name]) < 0.3 * (high - low)


def test_equal_scores_have_no_interval(spark):
    pairs = spark.createDataFrame([(i, "a b c d", "a b c d") for i in range(20)], "id long, prediction string, reference string")
    got = bootstrap.bootstrap_text_metrics(pairs, "id", replicates=50).head()
    assert all(got[f"{m}_{x}"] == pytest.approx(1.0) for m in bootstrap.ROUGE for x in ("low", "mid", "high"))


def test_odd_tables(spark, rows):
    assert bootstrap.bootstrap_mean(rows.where("false"), "id", ("x",), ("kind",)).count() == 0
    whole = bootstrap.bootstrap_mean(rows.where("false"), "id", ("x",)).head()
    assert whole["num_examples"] == 0 and whole["x_mid"] is None
    nothing = bootstrap.bootstrap_mean(rows.withColumn("x", F.lit(None).cast("double")), "id", ("x",), replicates=9).head()
    assert nothing["num_examples"] == 500 and nothing["x_low"] is None
    one = bootstrap.bootstrap_mean(rows.where("id = 3"), "id", ("x",), replicates=99).head()
    assert (one["x_low"], one["x_mid"], one["x_high"]) == (3.0, 3.0, 3.0)
    for bad in ({"replicates": 0}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            bootstrap.bootstrap_mean(rows, "id", ("x",), **bad).head()
