import math
import random

import pytest

from pyspark.sql import functions as F

from clozemill.functions import formats
from clozemill.operators import runs
from clozemill.sources.readers import manifest_table

MANIFEST = {
    "full": [
        {"id": "a", "title": "A", "config": "c1", "model_name": "m-a", "scenario": "mono"},
        {"id": "b", "title": "B", "config": "c2"},
    ],
    "fast": [{"id": "c", "config": "c1", "model_name": ""}],
}


@pytest.fixture
def manifest(spark):
    return manifest_table(spark, MANIFEST)


@pytest.fixture
def summary(spark, manifest):
    experiments = runs.select_groups(manifest, ["fast", "none", "full", "fast"])
    configs = spark.createDataFrame(
        [("c1", "out/1", "base-1"), ("c2", "out/2", "base-2")],
        "config string, output_dir string, config_model_name string",
    )
    metrics = spark.createDataFrame(
        [("out/1", 7, 12.34565, 0.5)], "output_dir string, num_examples int, sacrebleu double, rougeL double"
    )
    outcomes = spark.createDataFrame(
        [("out/2", 1.25, "00:01:00", "cpu")],
        "output_dir string, best_val_loss double, elapsed_hms string, device string",
    )
    return runs.run_summary(experiments, configs, metrics, outcomes)


def test_groups_in_request_order(manifest):
    picked = runs.in_manifest_order(runs.select_groups(manifest, ["fast", "none", "full", "fast"]))
    assert [(r.group_pos, r.id) for r in picked.collect()] == [(0, "c"), (2, "a"), (2, "b"), (3, "c")]
    assert runs.select_groups(manifest, []).count() == 0


def test_ids(spark, manifest):
    assert {r.id for r in runs.select_ids(manifest, ["a", "c"]).collect()} == {"a", "c"}
    table = spark.createDataFrame([("b",), ("b",)], "id string")
    assert [r.id for r in runs.select_ids(manifest, table).collect()] == ["b"]
    with pytest.raises(ValueError, match="holds no experiment"):
        runs.require_experiments(runs.select_ids(manifest, ["zzz"]))


def test_run_summary(summary):
    rows = {(r.group_pos, r.id): r for r in summary.collect()}
    assert len(rows) == 4
    a, b, c = rows[2, "a"], rows[2, "b"], rows[0, "c"]
    assert (a.model_name, b.model_name, c.model_name) == ("m-a", "base-2", "")
    assert (a.scenario, b.scenario, b.dataset) == ("mono", "", "")
    assert a.checkpoint == "out/1/checkpoints/best"
    assert (a.num_examples, a.sacrebleu, a.best_val_loss, a.elapsed_hms) == (7, 12.34565, None, "")
    assert (b.num_examples, b.meteor, b.best_val_loss, b.device) == (None, None, 1.25, "cpu")


def test_missing_config_fails(spark, manifest, summary):
    none = spark.createDataFrame([], "config string, output_dir string, config_model_name string")
    empty = spark.createDataFrame([], "output_dir string")
    with pytest.raises(Exception, match="No config"):
        runs.run_summary(manifest, none, empty, empty).collect()


def test_report_cells(summary):
    rows = {(r.group_pos, r.id): r for r in runs.report_cells(summary).collect()}
    assert (rows[2, "a"].sacrebleu, rows[2, "a"].meteor) == (f"{12.34565:.4f}", "")
    assert rows[2, "b"].best_val_loss == "1.2500"


def walk(losses, patience):
    best, best_epoch, waited = math.inf, None, 0
    for epoch, loss in enumerate(losses, start=1):
        if loss < best:
            best, best_epoch, waited = loss, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch, best_epoch, best, True
    return len(losses), best_epoch, best, False


@pytest.mark.parametrize("patience", [0, 1, 2, 3])
def test_early_stopping(spark, patience):
    rng = random.Random(patience)
    losses = {i: [rng.randint(1, 9) / 2 for _ in range(rng.randint(1, 15))] for i in range(40)}
    losses[100] = [3.0, 2.0, 2.0, 2.0]
    losses[101] = [math.nan, math.nan]
    rows = [(i, e, v) for i, vs in losses.items() for e, v in enumerate(vs, start=1)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double").repartition(3)
    got = {r.run_id: r for r in runs.early_stopping(df, patience).collect()}
    for i, vs in losses.items():
        r = got[i]
        assert (r.stop_epoch, r.best_epoch, r.best_val_loss, r.stopped_early) == walk(vs, patience)


def test_one_trace_answers_all_patiences(spark, monkeypatch):
    """Also over many small chunks, in one long run beside short ones, and with gaps between epochs."""
    monkeypatch.setattr(runs, "DENSE_WIDTH", 2)
    rng = random.Random(5)
    losses = {i: [rng.choice([math.nan, None, math.inf, *range(9)]) for _ in range(rng.randint(1, 40))] for i in range(60)}
    losses[None] = [float(500 - i) for i in range(300)] + [1000.0] * 9
    losses[-1] = [float(i % 17 - i // 40) for i in range(400)]
    epochs = {i: sorted(rng.sample(range(10 * len(vs)), len(vs))) for i, vs in losses.items()}
    rows = [(i, e, None if v is None else float(v)) for i, vs in losses.items() for e, v in zip(epochs[i], vs, strict=True)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double").repartition(7)
    patiences = (0, 1, 2, 3, 7, 1000)
    got = {(r.run_id, r.patience): r for r in runs.early_stopping(df, patiences).collect()}
    assert len(got) == len(losses) * len(patiences)
    for (i, patience), r in got.items():
        plain = [math.inf if v is None else v for v in losses[i]]
        n, best, low, stopped = walk(plain, patience)
        at = epochs[i]
        want = (n, at[n - 1], None if best is None else at[best - 1], low, stopped)
        assert (r.epochs_run, r.stop_epoch, r.best_epoch, r.best_val_loss, r.stopped_early) == want
    assert runs.early_stopping(df.where("false"), patiences).count() == 0


def test_early_stopping_exchanges(spark):
    df = spark.range(1000).selectExpr("id % 7 run_id", "cast(id as int) epoch", "rand(3) val_loss")
    shapes = []
    for patiences in ((2,), (0, 1, 2, 3)):
        result = runs.early_stopping(df, patiences)
        result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        shapes.append(plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange"))
    assert shapes[0] == shapes[1] <= 5


def test_training_log_and_means(spark):
    logs = spark.createDataFrame(
        [("o", [(1, 2.0), (2, 1.0)])], "output_dir string, training_log array<struct<epoch:int,val_loss:double>>"
    )
    assert [tuple(r) for r in runs.explode_training_log(logs).orderBy("epoch").collect()] == [
        ("o", 1, 2.0), ("o", 2, 1.0),
    ]
    steps = spark.createDataFrame([(1, 1, 2.0), (1, 1, 4.0), (1, 2, None)], "run_id int, epoch int, loss double")
    means = {r.epoch: r.mean_loss for r in runs.epoch_mean_loss(steps).collect()}
    assert means == {1: 3.0, 2: 0.0}


def test_ratings(spark):
    predictions = spark.createDataFrame([("e1", "kept")], "example_id string, notes string")
    sheet = runs.human_eval_sheet(predictions)
    assert len(sheet.columns) == 8 and sheet.head().notes == "kept" and sheet.head().annotator_id == ""
    rated = spark.createDataFrame(
        [("m", "5", "x"), ("m", "", "4"), ("m", "2", "")],
        "model string, fluency_score_1_5 string, overall_score_1_5 string",
    )
    r = runs.human_eval_summary(rated).head()
    assert (r.fluency, r.overall) == (3.5, 4.0)


def test_compare_runs(spark):
    scores = spark.createDataFrame([("a", 30.0), ("b", 12.5)], "id string, sacrebleu double")
    pairs = spark.createDataFrame([("drop", "a", "b")], "comparison string, left_id string, right_id string")
    r = runs.compare_runs(scores, pairs, ("sacrebleu",)).head()
    assert (r.comparison, r.sacrebleu_delta) == ("drop", 17.5)


def test_ratings_may_be_fractions(spark):
    rated = spark.createDataFrame([("m", "4.5"), ("m", "3")], "model string, fluency_score_1_5 string")
    assert runs.human_eval_summary(rated).head().fluency == 3.75


def test_checks_survive_column_pruning(spark, manifest):
    none = spark.createDataFrame([], "config string, output_dir string, config_model_name string")
    empty = spark.createDataFrame([], "output_dir string")
    summary = runs.run_summary(manifest, none, empty, empty)
    for shape in (summary.count, runs.report_cells(summary).select("id").collect):
        with pytest.raises(Exception, match="No config"):
            shape()


def test_rows_without_an_epoch_fail_and_null_runs_stay(spark):
    rows = [(None, 1, 2.0), (None, 2, 1.0), (7, 1, 1.0)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, val_loss double")
    got = {r.run_id: r.epochs_run for r in runs.early_stopping(df).collect()}
    assert got == {None: 2, 7: 1}
    bad = spark.createDataFrame([(1, None, 2.0)], "run_id int, epoch int, val_loss double")
    with pytest.raises(Exception, match="have no place"):
        runs.early_stopping(bad).collect()


def test_format_metric_as_python_does(spark):
    rng = random.Random(11)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-6, 15) for _ in range(10_000)]
    values += [0.0, -0.0, 274877906944.00055, 12345678901234.568, 0.99995, 9.99995, 0.00005, 2.5e-05, 1e22, 2.0**99, 2.0**53 + 2, 1e-300]
    values += [k / 32 / 1000 for k in range(200)] + [math.inf, -math.inf, math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.t for r in df.select("i", formats.format_metric(F.col("v")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [f"{v:.4f}" for v in values]
