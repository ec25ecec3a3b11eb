import json
import re

import pytest

from clozemill.fixed_values import DEFAULT_TEMPLATE, METRIC_COLUMNS
from clozemill.operators import runs
from clozemill.plans.evaluation import evaluate_corpus, rating_sheet, summarize_runs
from clozemill.sources import readers, sinks
from clozemill.schemas import SQUAD_SCHEMA


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n  \n", encoding="utf8")
    return str(path)


def example(i, answer="да"):
    return {"id": f"e{i}", "context": f"Текст  {i}", "question": f"Что {i}?", "answers": {"text": [answer], "answer_start": [0]}}


def test_jsonl_numbers_rows_in_file_order(spark, tmp_path):
    b = lines(tmp_path / "b.jsonl", [example(i) for i in range(5)])
    a = lines(tmp_path / "a.jsonl", [example(i) for i in range(5, 8)])
    df = readers.read_json_corpus(spark, [b, a], SQUAD_SCHEMA).orderBy("row_idx")
    assert [(r.row_idx, r.id) for r in df.collect()] == [(i, f"e{i}") for i in range(8)]


def test_split_files_keep_their_order(spark, tmp_path):
    path = lines(tmp_path / "big.jsonl", [example(i) for i in range(400)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_json_corpus(spark, path, SQUAD_SCHEMA)
        assert df.rdd.getNumPartitions() > 4
        assert all(r.id == f"e{r.row_idx}" for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_malformed_line_fails(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), SQUAD_SCHEMA).collect()


def test_specs(spark, tmp_path):
    data = lines(tmp_path / "d.jsonl", [example(0), example(1, ""), example(2), example(3)])
    csv = tmp_path / "d.csv"
    csv.write_text('id,context,question,answers\nx,"a ""b""\nc",q?,"{""text"": [""b""], ""answer_start"": [0]}"\n')
    root = tmp_path / "named"
    squad = spark.createDataFrame([("n1", "ctx", "q?", ["a"], "train"), ("n2", "ctx", "q?", ["a"], "test")],
                                  "id string, context string, question string, answers array<string>, split string")
    squad.write.partitionBy("split").parquet(str(root / "squad" / "plain"))
    specs = [
        {"type": "json", "data_files": data, "dataset_name": "d", "language": "ru", "max_samples": 2},
        {"type": "csv", "data_files": str(csv), "answers_json": True},
        {"path": "squad", "name": "plain", "split": "test"},
    ]
    df = readers.load_corpora(spark, specs, DEFAULT_TEMPLATE, str(root)).orderBy("spec_pos", "row_idx")
    rows = [(r.spec_pos, r.example_id, r.dataset_name, r.language) for r in df.collect()]
    assert rows == [(0, "e0", "d", "ru"), (0, "e2", "d", "ru"), (1, "x", str(csv), "unknown"), (2, "n2", "squad", "unknown")]
    assert readers.load_one_spec(spark, {"type": "csv", "data_files": str(csv)}, DEFAULT_TEMPLATE).count() == 0
    with pytest.raises(ValueError, match="No reader for corpora"):
        readers.load_one_spec(spark, {"type": "xml"}, DEFAULT_TEMPLATE)


def test_inline_and_text_inputs(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Первый.\nВторой.", encoding="utf8")
    (tmp_path / "two.txt").write_text("Третий.", encoding="utf8")
    docs = readers.read_context(spark, input_txt=str(tmp_path)).collect()
    assert sorted(r.text for r in docs) == ["Первый.\nВторой.", "Третий."]
    assert readers.read_context(spark, context="abc").head().text == "abc"
    assert readers.read_generation_input(spark, context="c", answer="a").head().answer_text == "a"
    for call in (lambda: readers.read_context(spark), lambda: readers.read_generation_input(spark, context="c")):
        with pytest.raises(ValueError):
            call()


def test_jsonl_and_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ёж", None), (2, "", 'a "b"\nc')], "i int, s string, t string")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part*")).read_text(encoding="utf8")
    assert json.loads(text.splitlines()[0]) == {"i": 1, "s": "Ёж", "t": None} and "Ёж" in text
    sinks.write_csv(df, str(tmp_path / "c"), single_file=True)
    raw = next((tmp_path / "c").glob("part*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfi,s,t")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted(r.t or "" for r in back.collect()) == ["", 'a "b"\nc']


def test_evaluation_and_reports(spark, tmp_path):
    data = lines(tmp_path / "d.jsonl", [example(i) for i in range(3)])
    config = {
        "output_dir": str(tmp_path / "runs" / "r1"),
        "data": {"source_template": DEFAULT_TEMPLATE, "max_source_length": 64,
                 "evaluation_datasets": [{"type": "json", "data_files": data, "dataset_name": "d"}]},
    }

    def make():
        return lambda sources, settings: ["Что 1?" for _ in sources]

    metrics = evaluate_corpus(spark, config, make).head()
    assert metrics.num_examples == 3 and 0 < metrics.meteor < 1
    written = spark.read.json(f"{config['output_dir']}/evaluation/predictions")
    assert written.count() == 3 and written.head().generated_question == "Что 1?"

    run = tmp_path / "runs" / "r2"
    (run / "evaluation").mkdir(parents=True)
    (run / "logs").mkdir()
    (run / "evaluation" / "metrics.json").write_text(json.dumps({"num_examples": 4, "sacrebleu": 1.5}, indent=2))
    (run / "logs" / "training_summary.json").write_text(json.dumps(
        {"best_val_loss": 0.5, "device": "cpu", "training_log": [{"epoch": 1, "val_loss": 0.5}]}, indent=2))
    root = str(tmp_path / "runs")
    scores, outcomes = readers.read_run_metrics(spark, root), readers.read_training_summaries(spark, root)
    assert scores.where(f"output_dir = '{root}/r2'").head().sacrebleu == 1.5
    assert runs.explode_training_log(outcomes).head().val_loss == 0.5

    manifest = tmp_path / "m.yaml"
    manifest.write_text("g:\n  - {id: x, config: c2}\n  - {id: y, config: c3, model_name: m}\n")
    experiments = runs.select_groups(readers.read_manifest(spark, str(manifest)), ["g"])
    configs = spark.createDataFrame([("c2", f"{root}/r2", "base"), ("c3", f"{root}/r3", "base")],
                                    "config string, output_dir string, config_model_name string")
    summarize_runs(experiments, configs, scores, outcomes, str(tmp_path / "csv"), str(tmp_path / "md"))
    parts = sorted((tmp_path / "md").glob("part*"))
    report = "".join(p.read_text() for p in parts).splitlines()
    assert report[0].startswith("| id | scenario | model_name |") and report[1] == "| " + " | ".join(["---"] * 10) + " |"
    assert report[2:] == ["| x |  | base |  |  | 1.5000 |  |  |  | 0.5000 |", "| y |  | m |  |  |  |  |  |  |  |"]
    assert set(METRIC_COLUMNS) <= set(scores.columns)


def test_files_count_in_the_order_given(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y y").mkdir()
    first = lines(tmp_path / "y y" / "train.jsonl", [example(0), example(1)])
    second = lines(tmp_path / "x" / "train.jsonl", [example(2)])
    third = lines(tmp_path / "bad+d.jsonl", [example(3)])
    fourth = lines(tmp_path / "d.jsonl", [example(4)])
    for schema in (SQUAD_SCHEMA, None):
        df = readers.read_json_corpus(spark, [first, second, third, fourth], schema).orderBy("row_idx")
        assert [(r.row_idx, r.id) for r in df.collect()] == [(i, f"e{i}") for i in range(5)]


def test_bad_csv_fails(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,context,question,answers\nx,c,q?,"{""text"": 7"\n')
    with pytest.raises(Exception):
        readers.read_csv_corpus(spark, str(path), answers_json=True).collect()
    path.write_text("id,n\nx,1\ny,z\n")
    with pytest.raises(Exception):
        readers.read_csv_corpus(spark, str(path), schema="id string, n int").collect()


def test_records_keep_all_rows(spark, tmp_path):
    sinks.write_record(spark.range(2), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_run_folders(spark, tmp_path):
    root = tmp_path / "all runs"
    for name, score in (("a/r1", 1.0), ("b/r1", 2.0), ("c + d", 3.0)):
        (root / name / "evaluation").mkdir(parents=True)
        (root / name / "evaluation" / "metrics.json").write_text(json.dumps({"sacrebleu": score}))
    (root / "a" / "metrics.json").write_text('{"sacrebleu": 9}')
    rows = readers.read_run_metrics(spark, str(root)).collect()
    assert {(r.output_dir, r.sacrebleu) for r in rows} == {
        (f"{root}/a/r1", 1.0), (f"{root}/b/r1", 2.0), (f"{root}/c + d", 3.0),
    }
    assert readers.read_training_summaries(spark, str(root)).count() == 0
    (root / "a" / "r1" / "evaluation" / "metrics.json").write_text('{"sacrebleu": ')
    with pytest.raises(Exception):
        readers.read_run_metrics(spark, str(root)).collect()


def test_from_manifest_to_report(spark, tmp_path):
    data = lines(tmp_path / "d.jsonl", [example(i) for i in range(3)])
    root = tmp_path / "runs"
    for name, text in (("one.yaml", f"output_dir: {root}/g/one\nmodel: {{name: base-1}}\n"),
                       ("two.json", json.dumps({"output_dir": f"{root}/two", "model": {}}))):
        (tmp_path / name).write_text(text)
    manifest = tmp_path / "m.yaml"
    manifest.write_text(
        f"g:\n  - {{id: x, config: {tmp_path}/one.yaml}}\n  - {{id: y, config: {tmp_path}/two.json, model_name: m}}\n"
    )
    experiments = runs.select_groups(readers.read_manifest(spark, str(manifest)), ["g"])
    configs = readers.read_configs(spark, experiments)
    found = {r.config: r for r in configs.collect()}
    assert found[f"{tmp_path}/one.yaml"].config_model_name == "base-1"

    def make():
        return lambda sources, settings: ["Что 1?" for _ in sources]

    def encoder():
        return lambda texts: [[[1.0, float(len(w))] for w in t.split()] for t in texts]

    for r in found.values():
        config = {"output_dir": r.output_dir,
                  "data": {"source_template": DEFAULT_TEMPLATE, "max_source_length": 64,
                           "evaluation_datasets": [{"type": "json", "data_files": data, "dataset_name": "d"}]}}
        evaluate_corpus(spark, config, make, make_encoder=encoder)
    scores = readers.read_run_metrics(spark, str(root))
    assert {(r.output_dir, r.num_examples, r.bertscore_f1 > 0.9) for r in scores.collect()} == {
        (f"{root}/g/one", 3, True), (f"{root}/two", 3, True),
    }
    outcomes = readers.read_training_summaries(spark, str(root))
    summarize_runs(experiments, configs, scores, outcomes, str(tmp_path / "csv"), str(tmp_path / "md"))
    report = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part*"))).splitlines()
    assert [line.split(" | ")[2] for line in report[2:]] == ["base-1", "m"]
    assert all(float(line.split(" | ")[8]) > 0.9 for line in report[2:])
    sheet = rating_sheet(spark, f"{root}/two/evaluation/predictions", str(tmp_path / "sheet"))
    assert sheet.count() == 3 and "overall_score_1_5" in sheet.columns
    with pytest.raises(Exception):
        readers.read_configs(spark, [f"{tmp_path}/none.yaml"]).collect()


@pytest.mark.parametrize("bom", [True, False])
def test_one_csv_in_many_parts(spark, tmp_path, bom):
    from pyspark.sql import functions as F

    texts = F.element_at(
        F.array(*[F.lit(t) for t in ("", " a", "b ", 'say ""x""', "1,2", "line\nbreak", "\r\n", "#c", "\\", "Ёж")]),
        (F.col("id") % 11 + 1).cast("int"),
    )
    df = spark.range(500).select(
        (F.col("id") * 7919 % 500).alias("place"), "id",
        F.when(F.col("id") % 11 < 10, texts).alias('a "b", c'), (F.col("id") / 7).alias("x.y"),
    )
    for i, cells in enumerate((None, ("place", 'a "b", c'), ('a "b", c',))):
        wide = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            sinks.write_one_csv(df, str(tmp_path / f"many{i}"), ("place",), cells, bom)
        finally:
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", wide)
        chosen = [c for c in df.columns if c != "place"] if cells is None else cells
        ordered = df.coalesce(1).sortWithinPartitions("place").select(*[F.col(f"`{c}`") for c in chosen])
        sinks.write_csv(ordered, str(tmp_path / f"one{i}"), bom=False, single_file=True)
        parts = sorted((tmp_path / f"many{i}").glob("part*"))
        (one,) = (tmp_path / f"one{i}").glob("part*")
        assert len(parts) > 2
        written = b"".join(p.read_bytes() for p in parts)
        if len(chosen) == 1:  # the writer of files leaves rows of one empty cell out
            assert len(re.findall(rb'(?m)^""\n', written)) == 91
            written = re.sub(rb'(?m)^""\n', b"", written)
        assert written == (b"\xef\xbb\xbf" if bom else b"") + one.read_bytes()


def test_one_csv_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "pos int, s string, t string")
    sinks.write_one_csv(empty, str(tmp_path / "c"), ("pos",))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "c").glob("part*"))) == b"\xef\xbb\xbfs,t\n"
    with pytest.raises(ValueError, match="needs a column"):
        sinks.write_one_csv(empty, str(tmp_path / "d"), ("pos", "s", "t"))
