"""One Spark query per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyspark.cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import checks
import clozemill
from checks.views import view
from clozemill import fixed_values as fv
from clozemill.functions import formats, questions, stems, text, tokens
from clozemill.operators import (
    answers,
    batches,
    bootstrap,
    corpus,
    metrics,
    ordering,
    runs,
    shuffling,
    subwords,
    vectors,
)
from clozemill.operators import questions as question_ops
from clozemill.plans.text_to_questions import text_to_questions
from clozemill.sources import sinks

# Python workers then need neither package on their path.
for _package in (checks, clozemill):
    pyspark.cloudpickle.register_pickle_by_value(_package)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STRING = T.StringType()
PATIENCES = (0, 1, 2, 3)
CP1251_BREAK = (text.CP1251_NARROW, text.CP1251_WIDE)
GROUPS = ["BUILDING", "NO SUCH GROUP", "MACHINERY", "BUILDING"]
ALL_GROUPS = ["MACHINERY", "AUTOMOBILE", "BUILDING", "HOUSEHOLD", "FURNITURE"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The test tables are one file each, which one core would read alone."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(view(spark, sf_dir, "v_texts"), "doc_id")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(
        *[F.round(c, 6).alias(c) if not names or c in names else F.col(c) for c in df.columns]
    )


# --- normalisation -----------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = view(spark, sf_dir, "pages").select(F.lit("p"), "page_id", "html")
    return docs.union(pages).select("kind", "id", text.normalize_text(F.col("text")).alias("text"))


@query
def repair_mojibake(spark, sf_dir):
    facts = view(spark, sf_dir, "v_ru_facts")
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    broken = facts.select(F.lit("broken").alias("kind"), "doc_id", F.translate(misread, *CP1251_BREAK).alias("text"))
    intact = facts.select(F.lit("intact"), "doc_id", "text")
    latin = view(spark, sf_dir, "documents").select(
        F.lit("latin"), "doc_id", F.concat(F.lit("Р "), "text")
    )
    rows = broken.union(intact).union(latin)
    return rows.select("kind", "doc_id", text.repair_mojibake(F.col("text")).alias("text"))


@query
def falsy_to_empty(spark, sf_dir):
    items = view(spark, sf_dir, "lineitem")
    late = F.col("l_returnflag") == "R"
    return items.select(
        "l_orderkey",
        "l_linenumber",
        text.falsy_to_empty(F.col("l_discount"), T.DoubleType()).alias("number"),
        text.falsy_to_empty(F.floor("l_extendedprice") * F.lit(2.0**12), T.DoubleType()).alias("large"),
        text.falsy_to_empty(F.col("l_quantity") / F.lit(2.0**16), T.DoubleType()).alias("small"),
        text.falsy_to_empty(late, T.BooleanType()).alias("flag"),
        text.falsy_to_empty(F.when(late, F.col("l_linestatus")), STRING).alias("text"),
    )


@query
def build_source(spark, sf_dir):
    source = questions.build_source(fv.DEFAULT_TEMPLATE, F.col("context"), F.col("answer"))
    return view(spark, sf_dir, "v_qa_flat").select("row_idx", source.alias("source"))


_LAYOUTS = ("struct", "structs", "list", "empty", "text")


def _layout(df: DataFrame, layout: str) -> DataFrame:
    answer = F.col("answer")
    answers = {
        "struct": lambda: F.struct(F.array(answer).alias("text")),
        "structs": lambda: F.array(F.struct(answer.alias("text"))),
        "list": lambda: F.array(answer),
        "empty": lambda: F.array().cast("array<string>"),
        "text": lambda: answer,
    }
    return df.withColumn("answers", answers[layout]())


@query
def first_answer(spark, sf_dir):
    parts = []
    for layout in _LAYOUTS:
        df = _layout(view(spark, sf_dir, "v_qa_flat"), layout)
        first = corpus.first_answer(F.col("answers"), df.schema["answers"].dataType)
        parts.append(df.select(F.lit(layout).alias("layout"), "row_idx", first.alias("answer_text")))
    return corpus.union_corpora(parts).drop("spec_pos")


@query
def drop_incomplete(spark, sf_dir):
    turns = view(spark, sf_dir, "v_turns").na.fill("", ["context", "answer"])
    return corpus.drop_incomplete(turns, ("context", "question", "answer")).select("row_idx", "id")


def _canonical(spark, sf_dir) -> DataFrame:
    blank = F.when(F.col("row_idx") % 3 == 0, "").otherwise(F.col("id"))
    turns = _layout(view(spark, sf_dir, "v_turns").withColumn("id", blank), "struct")
    return corpus.normalize_qa(turns, fv.DEFAULT_TEMPLATE, "talks", "xx")


def _nested(spark, sf_dir) -> DataFrame:
    nested = view(spark, sf_dir, "v_qa_nested")
    return corpus.flatten_qas(nested, fv.DEFAULT_TEMPLATE, "nested", "xx")


@query
def normalize_qa(spark, sf_dir):
    return _canonical(spark, sf_dir)


@query
def flatten_qas(spark, sf_dir):
    return _nested(spark, sf_dir)


@query
def limit_first_n(spark, sf_dir):
    return corpus.limit_first_n(_canonical(spark, sf_dir), 50).select("row_idx", "example_id")


@query
def union_corpora(spark, sf_dir):
    both = corpus.union_corpora([_canonical(spark, sf_dir), _nested(spark, sf_dir)])
    return both.select("spec_pos", "row_idx", "example_id", "dataset_name", "question", "title")


# --- answers -----------------------------------------------------------------


@query
def split_sentences(spark, sf_dir):
    return answers.sentences(_texts(spark, sf_dir))


def _extractor(name: str) -> None:
    def run(spark, sf_dir):
        return answers.extracted(_texts(spark, sf_dir), name)

    run.__name__ = name
    query(run)


for _name in ("quoted", "dates_and_numbers", "abbreviations", "proper_names", "key_phrases"):
    _extractor(_name)


@query
def dedup_candidates(spark, sf_dir):
    return answers.distinct_candidates(_texts(spark, sf_dir))


@query
def top_answers(spark, sf_dir):
    return answers.top_answers(_texts(spark, sf_dir))


@query
def docs_without_answers(spark, sf_dir):
    return answers.documents_without_answers(_texts(spark, sf_dir))


# --- questions ---------------------------------------------------------------


@query
def clean_question(spark, sf_dir):
    raw = F.concat(F.lit("<extra_id_0> "), F.col("text"), F.lit(" <extra_id_0>"))
    return view(spark, sf_dir, "conversations").select(
        "conv_id", "turn", questions.clean_question(raw).alias("question")
    )


@query
def is_valid_question(spark, sf_dir):
    candidate = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(
        F.col("o_orderstatus") == "P", F.lit(" Answer: ")
    ).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return view(spark, sf_dir, "orders").select(
        "o_orderkey", questions.is_valid_question(candidate).alias("valid")
    )


@query
def template_question(spark, sf_dir):
    asked = questions.template_question(
        F.col("answer_text"), F.col("answer_kind"), F.col("source_sentence")
    )
    return view(spark, sf_dir, "v_answers").select("doc_id", asked.alias("question"))


@query
def resolve_questions(spark, sf_dir):
    given = view(spark, sf_dir, "v_answers")
    parts = [question_ops.resolve_questions(given, s) for s in fv.STRATEGIES]
    return corpus.union_corpora(parts).select(
        "doc_id", "rank", "answer_text", "generated_question", "model_question",
        "used_fallback", "strategy",
    )


@query
def attach_model_questions(spark, sf_dir):
    given = view(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("rank"), "l_partkey"
    )
    predicted = view(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rank"),
        F.col("o_orderpriority").alias("model_question"),
    )
    return question_ops.attach_model_questions(given, predicted)


@query
def text_to_questions_template(spark, sf_dir):
    return text_to_questions(_texts(spark, sf_dir))


def _stub_generator():
    return lambda sources, config: [f" {len(s)} {s.replace(' ', '_')}\n" for s in sources]


def _predictions(spark, sf_dir) -> DataFrame:
    return question_ops.batch_generate(
        _canonical(spark, sf_dir), _stub_generator, max_source_length=384
    )


@query
def batch_generate(spark, sf_dir):
    return _predictions(spark, sf_dir).select("row_idx", "prediction")


@query
def prediction_rows(spark, sf_dir):
    examples = _canonical(spark, sf_dir)
    predicted = view(spark, sf_dir, "v_turn_pairs")
    return question_ops.prediction_rows(examples, predicted)


# --- scores ------------------------------------------------------------------


@query
def align_pairs(spark, sf_dir):
    pairs = view(spark, sf_dir, "v_turn_pairs")
    return metrics.align_pairs(pairs.drop("reference"), pairs.drop("prediction"))


def _pairs(spark, sf_dir) -> DataFrame:
    return _spread(view(spark, sf_dir, "v_pairs"), "pair_id")


def _turns(spark, sf_dir) -> DataFrame:
    pairs = view(spark, sf_dir, "v_turn_pairs")
    return pairs.select(
        "row_idx", *[text.collapse_whitespace(F.col(c)).alias(c) for c in ("prediction", "reference")]
    )


@query
def corpus_bleu(spark, sf_dir):
    scores = metrics.corpus_bleu(_pairs(spark, sf_dir), ("lang",))
    return _rounded(scores.drop("sacrebleu_signature"), "sacrebleu")


@query
def rouge_n(spark, sf_dir):
    return _rounded(metrics.rouge_n(_pairs(spark, sf_dir), ("lang",)), "rouge1", "rouge2")


@query
def rouge_n_unicode(spark, sf_dir):
    scores = metrics.rouge_n(_pairs(spark, sf_dir), ("lang",), "unicode")
    return _rounded(scores, "rouge1", "rouge2")


@query
def bootstrap_rouge(spark, sf_dir):
    names = ("rouge1", "rouge2", "rougeL")
    found = bootstrap.bootstrap_text_metrics(_pairs(spark, sf_dir), "pair_id", ("lang",), names)
    return _rounded(found, *[c for c in found.columns if c.startswith("rouge")])


@query
def bootstrap_bleu(spark, sf_dir):
    found = bootstrap.bootstrap_text_metrics(_pairs(spark, sf_dir), "pair_id", ("lang",), ("sacrebleu",))
    return _rounded(found, *[c for c in found.columns if c.startswith("sacrebleu")])


@query
def rouge_l(spark, sf_dir):
    return _rounded(metrics.rouge_l(_turns(spark, sf_dir)))


@query
def rouge_lsum(spark, sf_dir):
    return _rounded(metrics.rouge_lsum(_turns(spark, sf_dir)))


@query
def rouge_l_documents(spark, sf_dir):
    return _rounded(metrics.rouge_l(_pairs(spark, sf_dir), ("lang",)), "rougeL")


@query
def rouge_lines_documents(spark, sf_dir):
    """All ROUGE scores of whole documents whose line breaks count; predictions lack every third line."""
    pairs = _spread(view(spark, sf_dir, "v_line_pairs"), "pair_id")
    names = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    return _rounded(metrics.compute_text_metrics(pairs, ("lang",), names), *names)


@query
def meteor_exact(spark, sf_dir):
    return _rounded(metrics.meteor_exact(_pairs(spark, sf_dir), ("lang",)), "meteor")


@query
def meteor_stems(spark, sf_dir):
    return _rounded(metrics.meteor_stems(_pairs(spark, sf_dir), ("lang",)), "meteor")


@query
def word_stems(spark, sf_dir):
    words = F.explode(F.split(tokens.word_tokens(F.col("text")), " ")).alias("word")
    distinct = _texts(spark, sf_dir).select(words).where("word <> ''").distinct()
    return distinct.select("word", stems.stem("word").alias("stem"))


@query
def embedding_match_f1(spark, sf_dir):
    return _rounded(vectors.embedding_match(view(spark, sf_dir, "v_token_vectors")))


@query
def safe_mean(spark, sf_dir):
    customers, orders = view(spark, sf_dir, "customer"), view(spark, sf_dir, "orders")
    joined = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    mean = metrics.safe_mean(F.month("o_orderdate"))
    return joined.groupBy("c_custkey").agg(F.round(mean, 6).alias("mean_month"))


@query
def compute_text_metrics(spark, sf_dir):
    scores = metrics.compute_text_metrics(_turns(spark, sf_dir))
    return _rounded(scores, *metrics.TEXT_METRICS)


# --- runs --------------------------------------------------------------------


@query
def select_groups(spark, sf_dir):
    picked = runs.select_groups(view(spark, sf_dir, "v_experiments"), GROUPS)
    return runs.in_manifest_order(picked).select("group_pos", "pos", "id", "title")


@query
def select_ids(spark, sf_dir):
    urgent = view(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    ids = urgent.select(F.concat(F.lit("run-"), "o_custkey").alias("id"))
    return runs.select_ids(view(spark, sf_dir, "v_experiments"), ids).select("id", "config")


def _summary(spark, sf_dir) -> DataFrame:
    return runs.run_summary(
        runs.select_groups(view(spark, sf_dir, "v_experiments"), ALL_GROUPS),
        *[view(spark, sf_dir, v) for v in ("v_configs", "v_run_metrics", "v_summaries")],
    )


@query
def run_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def report_cells(spark, sf_dir):
    return runs.report_cells(_summary(spark, sf_dir))


@query
def markdown_lines(spark, sf_dir):
    return sinks.markdown_lines(_summary(spark, sf_dir))


@query
def csv_lines(spark, sf_dir):
    """Whole documents as the lines of one CSV file."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return sinks.csv_lines(docs, ("doc_id",), tuple(docs.columns))


@query
def format_metric(spark, sf_dir):
    number = (F.col("l_extendedprice") * F.col("l_discount") - 100) / 64
    return view(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", formats.format_metric(number).alias("formatted")
    )


@query
def format_hms(spark, sf_dir):
    return view(spark, sf_dir, "orders").select(
        "o_orderkey", formats.format_hms(F.col("o_totalprice")).alias("hms")
    )


@query
def compare_runs(spark, sf_dir):
    deltas = runs.compare_runs(
        view(spark, sf_dir, "v_run_scores"), view(spark, sf_dir, "v_comparisons"),
        ("sacrebleu", "rougeL"),
    )
    return _rounded(deltas, "sacrebleu_delta", "rougeL_delta")


@query
def early_stopping(spark, sf_dir):
    return runs.early_stopping(view(spark, sf_dir, "v_epochs"), PATIENCES)


@query
def epoch_mean_loss(spark, sf_dir):
    return _rounded(runs.epoch_mean_loss(view(spark, sf_dir, "v_steps")), "mean_loss")


@query
def explode_training_log(spark, sf_dir):
    record = F.struct("epoch", F.col("val_loss"), (F.col("epoch") * 10).alias("global_step"))
    logs = (
        view(spark, sf_dir, "v_epochs")
        .groupBy(F.concat(F.lit("outputs/"), "run_id").alias("output_dir"))
        .agg(F.sort_array(F.collect_list(record)).alias("training_log"))
    )
    return runs.explode_training_log(logs)


@query
def human_eval_sheet(spark, sf_dir):
    return runs.human_eval_sheet(view(spark, sf_dir, "v_ratings"))


@query
def human_eval_summary(spark, sf_dir):
    summary = runs.human_eval_summary(view(spark, sf_dir, "v_ratings"))
    return _rounded(summary, "fluency", "overall")


# --- batches -----------------------------------------------------------------


def _tokens(spark, sf_dir) -> DataFrame:
    rows = _canonical(spark, sf_dir).select("row_idx", "source", "target")
    return batches.truncate_tokens(rows, 48, 16)


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    return df.select(
        *[F.array_join(c, " ").alias(c) if c in arrays else F.col(c) for c in df.columns]
    )


@query
def truncate_tokens(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return _joined(tokens.drop("attention_mask"), "input_ids", "labels")


@query
def truncate_subwords(spark, sf_dir):
    """Pieces are trained on all rows; the same rows are then cut into their ids."""
    rows = _canonical(spark, sf_dir).select("row_idx", "source", "target")
    words = subwords.word_counts(rows, "source", "target").cache()
    model = subwords.train(words, 4000)
    words.unpersist()
    tokens = batches.truncate_tokens(rows, 384, 64, subwords.tokenizer(model))
    return _joined(tokens.drop("attention_mask"), "input_ids", "labels")


@query
def assign_batches(spark, sf_dir):
    return batches.assign_batches(_canonical(spark, sf_dir).select("row_idx"), 4)


@query
def shuffle_batches(spark, sf_dir):
    return batches.assign_batches(_canonical(spark, sf_dir).select("row_idx"), 4, seed=42)


@query
def shuffled_places(spark, sf_dir):
    """Every document's slot, and the document that the inverse finds there."""
    docs = view(spark, sf_dir, "documents")
    n = docs.agg(F.count(F.lit(1))).scalar()
    dense = ordering.with_dense_index(docs.select("doc_id"), "doc_id", "row_idx")
    placed = [
        shuffling.shuffled_batches(dense, 32, seed).withColumn("seed", F.lit(seed)) for seed in (7, 42)
    ]
    both = reduce(DataFrame.union, placed).withColumn("n", n)
    back = [F.when(F.col("seed") == s, shuffling.batch_rows(F.col("batch_id"), F.col("batch_pos"), 32, F.col("n"), s)) for s in (7, 42)]
    return both.select("seed", "doc_id", "batch_id", "batch_pos", F.coalesce(*back).alias("row_at_slot"))


@query
def pad_batches(spark, sf_dir):
    rows = _canonical(spark, sf_dir).select("row_idx", "source", "target")

    def lengths(c):
        return F.transform(batches.words(c), lambda w: F.length(w))

    tokens = batches.truncate_tokens(rows, 48, 16, lengths)
    padded = batches.pad_batches(batches.assign_batches(tokens, 4), F.lit(0))
    return _joined(padded.drop("truncated"), "input_ids", "attention_mask", "labels")
