"""Files and literal records as DataFrames with a row number."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.operators.corpus import limit_first_n, normalize_qa, union_corpora
from clozemill.schemas import (
    CONFIG_SCHEMA,
    GENERATION_INPUT_SCHEMA,
    MANIFEST_FIELDS,
    MANIFEST_SCHEMA,
    METRICS_SCHEMA,
    SQUAD_SCHEMA,
    TRAINING_SUMMARY_SCHEMA,
)
from clozemill.sources.csv_rows import read_rows


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def number_rows(scans: list[DataFrame], name: str = "row_idx") -> DataFrame:
    """Adds the position of every row: 0, 1, 2, … over all scans one after another.

    Within a scan, files count by name and their splits in order. Only the row
    counts of the file splits are gathered in one task, one row per split; the
    rows themselves are neither sorted nor shuffled, unless there are so many
    splits that Spark will not broadcast their counts.
    """
    columns = list(dict.fromkeys(c for scan in scans for c in scan.columns))
    tagged = [
        scan.select(
            "*",
            F.lit(i).alias("__listed"),
            F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__split"),
            F.monotonically_increasing_id().alias("__id"),
        )
        for i, scan in enumerate(scans)
    ]
    placed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    splits = (
        placed.groupBy("__listed", "__file", "__split")
        .agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    )
    earlier = Window.orderBy("__listed", "__file", "__split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = splits.select(
        "__listed",
        "__file",
        "__split",
        "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__start"),
    )
    return placed.join(starts, ["__listed", "__file", "__split"]).select(
        *columns, (F.col("__start") + F.col("__id") - F.col("__first")).alias(name)
    )


def read_jsonl(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the job."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(_as_list(paths))


def read_json_corpus(
    spark: SparkSession, data_files: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """A JSON-lines corpus with its row numbers; the schema is inferred if not given."""
    paths = _as_list(data_files)
    schema = schema or read_jsonl(spark, paths).schema
    return number_rows([read_jsonl(spark, path, schema) for path in paths])


def read_csv_corpus(
    spark: SparkSession,
    data_files: str | list[str],
    answers_json: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A CSV corpus with a header; all columns are text unless a schema is given.

    A plain cell in ``answers`` is no answer, so such a corpus normalises to
    nothing; ``answers_json`` parses the cell as a struct of lists instead. A
    malformed row or cell fails the job. Cells may hold line breaks, and a file
    is read by as many tasks as it has splits all the same (see ``csv_rows``).
    """
    corpus = read_rows(spark, _as_list(data_files), schema)
    if answers_json and "answers" in corpus.columns:
        parsed = F.from_json("answers", SQUAD_SCHEMA["answers"].dataType, {"mode": "FAILFAST"})
        corpus = corpus.withColumn("answers", parsed)
    return corpus


def read_named_corpus(
    spark: SparkSession, root: str, path: str, name: str | None, split: str
) -> DataFrame:
    """One split of a named corpus, kept as Parquet partitioned by ``split``."""
    location = "/".join(p for p in (root, path, name) if p)
    scan = spark.read.parquet(location).where(F.col("split") == split)
    return number_rows([scan]).drop("split")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents, one per file: doc_id (the path) and text."""
    scan = spark.read.text(path, wholetext=True)
    return scan.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_generation_input(
    spark: SparkSession,
    input_jsonl: str | None = None,
    context: str | None = None,
    answer: str | None = None,
) -> DataFrame:
    """Contexts with answers, from a file or from one inline record."""
    if input_jsonl:
        return read_jsonl(spark, input_jsonl, GENERATION_INPUT_SCHEMA)
    if not context or not answer:
        raise ValueError("Nothing to read: give a file, or a context with its answer")
    return spark.createDataFrame([(context, answer)], GENERATION_INPUT_SCHEMA)


def read_context(
    spark: SparkSession, input_txt: str | None = None, context: str | None = None
) -> DataFrame:
    """Documents from text files, or one inline context."""
    if input_txt:
        return read_documents(spark, input_txt)
    if not context:
        raise ValueError("Nothing to read: give a text file or a context")
    return spark.createDataFrame([("inline", context)], "doc_id string, text string")


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """A loaded manifest (group -> list of experiments) as a table."""
    rows = [
        (group, pos, *[experiment.get(field) for field in MANIFEST_FIELDS])
        for group, experiments in manifest.items()
        for pos, experiment in enumerate(experiments or [])
    ]
    return spark.createDataFrame(rows, MANIFEST_SCHEMA)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A YAML or JSON manifest file; it lists experiments, so it is read on the driver."""
    text = spark.read.text(path, wholetext=True).head()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return manifest_table(spark, yaml.safe_load(text))
    if path.endswith(".json"):
        import json

        return manifest_table(spark, json.loads(text))
    raise ValueError(f"A manifest is a YAML or JSON file, not {path}")


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as the file system names it, with one slash after the scheme."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", system.makeQualified(found).toString())


def _file_path() -> Column:
    """The file of a row, in the form of ``_qualified``."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def read_configs(spark: SparkSession, configs: DataFrame | list[str]) -> DataFrame:
    """(config, output_dir, config_model_name) of config files, YAML or JSON.

    ``configs`` is a list of paths or a manifest; it lists experiments, so the
    paths are gathered on the driver. A missing file or output_dir is an error.
    """
    if isinstance(configs, DataFrame):
        configs = [r[0] for r in configs.select("config").distinct().collect()]
    if not configs:
        return spark.createDataFrame([], CONFIG_SCHEMA)

    @F.pandas_udf("output_dir string, config_model_name string")
    def settings(texts: pd.Series) -> pd.DataFrame:
        import yaml

        loaded = [yaml.safe_load(text) for text in texts]  # JSON is YAML, too
        return pd.DataFrame(
            {
                "output_dir": [str(c["output_dir"]) for c in loaded],
                "config_model_name": [(c.get("model") or {}).get("name", "") for c in loaded],
            },
            dtype="object",
        )

    scan = spark.read.text(configs, wholetext=True)
    read = scan.select(_file_path().alias("__file"), settings("value").alias("s"))
    named = spark.createDataFrame(
        [(c, _qualified(spark, c)) for c in configs], "config string, __file string"
    )
    return named.join(read, "__file").select("config", "s.*")


def _read_runs(spark: SparkSession, root: str, folder: str, stem: str, schema: T.StructType) -> DataFrame:
    """``folder/stem.json`` of every run below ``root``, or the parts of a table written there.

    output_dir is ``root`` with the path between it and ``folder``. The files are
    listed first, one name per run; a broken one fails the job.
    """
    inner = rf"/{folder}/{stem}(\.json|(\.json)?/part-[^/]*\.json)$"
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select("path")
        .where(F.col("path").rlike(inner))
    )
    paths = [r["path"] for r in listed.collect()]
    prefix = _qualified(spark, root).rstrip("/")
    between = F.regexp_replace(F.substring(_file_path(), F.lit(len(prefix) + 1), F.lit(2**30)), inner, "")
    scans = [
        spark.read.schema(schema)
        .option("multiLine", whole)
        .option("mode", "FAILFAST")
        .json(own)
        .select(F.concat(F.lit(root.rstrip("/")), between).alias("output_dir"), "*")
        for whole in (True, False)
        if (own := [p for p in paths if whole != bool(re.search(r"/part-[^/]*$", p))])
    ]
    if not scans:
        return spark.createDataFrame([], T.StructType([T.StructField("output_dir", T.StringType()), *schema]))
    return reduce(lambda a, b: a.union(b), scans)


def read_run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metrics of every run below a folder; a run without the file has no row."""
    return _read_runs(spark, root, "evaluation", "metrics", METRICS_SCHEMA)


def read_training_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _read_runs(spark, root, "logs", "training_summary", TRAINING_SUMMARY_SCHEMA)


def load_one_spec(
    spark: SparkSession, spec: dict, template: str, root: str = "."
) -> DataFrame:
    """One corpus from its spec: scanned, normalised, then limited."""
    kind = spec.get("type", "hf")
    files = spec.get("data_files", "local")
    name = spec.get("dataset_name") or spec.get("path") or files
    name = name if isinstance(name, str) else str(name)
    if kind == "hf":
        raw = read_named_corpus(spark, root, spec["path"], spec.get("name"), spec["split"])
    elif kind == "json":
        raw = read_json_corpus(spark, spec["data_files"], spec.get("schema"))
    elif kind == "csv":
        raw = read_csv_corpus(
            spark, spec["data_files"], spec.get("answers_json", False), spec.get("schema")
        )
    else:
        raise ValueError(f"No reader for corpora of type {kind!r}")
    corpus = normalize_qa(raw, template, name, spec.get("language", "unknown"))
    return limit_first_n(corpus, spec.get("max_samples"))


def load_corpora(
    spark: SparkSession, specs: list[dict], template: str, root: str = "."
) -> DataFrame:
    """All specs one after another, with ``spec_pos``."""
    return union_corpora([load_one_spec(spark, spec, template, root) for spec in specs])
