"""Schemas of the tables that files are read into."""

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


SQUAD_SCHEMA = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("context", _S),
        T.StructField("question", _S),
        T.StructField(
            "answers",
            T.StructType(
                [
                    T.StructField("text", T.ArrayType(_S)),
                    T.StructField("answer_start", T.ArrayType(T.IntegerType())),
                ]
            ),
        ),
    ]
)
CONFIG_SCHEMA = _strings("config", "output_dir", "config_model_name")
GENERATION_INPUT_SCHEMA = _strings("context", "answer_text")
MANIFEST_FIELDS = (
    "id", "title", "config", "model_family", "model_name", "train_language",
    "eval_language", "dataset", "scenario",
)
MANIFEST_SCHEMA = T.StructType(
    [T.StructField("group", _S), T.StructField("pos", T.IntegerType())]
    + [T.StructField(f, _S) for f in MANIFEST_FIELDS]
)
METRICS_SCHEMA = T.StructType(
    [T.StructField("num_examples", T.LongType()), T.StructField("sacrebleu_signature", _S)]
    + [
        T.StructField(m, T.DoubleType())
        for m in (
            "sacrebleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor", "bertscore_f1",
        )
    ]
    + [T.StructField(f"{m}_error", _S) for m in ("rouge", "meteor", "bertscore")]
)
TRAINING_SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("config_path", _S),
        T.StructField(
            "training_log",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("epoch", T.IntegerType()),
                        T.StructField("train_loss", T.DoubleType()),
                        T.StructField("val_loss", T.DoubleType()),
                        T.StructField("global_step", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("best_val_loss", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("elapsed_hms", _S),
        T.StructField("device", _S),
    ]
)
