"""Scores of generated texts against references.

Input is a table of pairs. Everything about a pair is computed inside its row,
so that a score is one narrow pass and one small aggregate, whatever the groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.functions import tokens
from clozemill.functions.overlap import (
    clipped_matches,
    lcs_length,
    union_lcs_hits,
    word_alignment,
)
from clozemill.operators.vectors import embedding_match

ORDERS = (1, 2, 3, 4)
BLEU_SIGNATURE = "orders=4|tok=13a|smooth=exp"
TEXT_METRICS = ("sacrebleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor")
# Metric families that fail on their own, the name their error is kept under, and
# the columns of a pair that can hold it.
FAMILIES = (
    ("rouge_error", ("rouge1", "rouge2", "rougeL", "rougeLsum"), ("rouge_m", "lcs", "hits")),
    ("meteor_error", ("meteor",), ("align",)),
)


def safe_mean(c: Column) -> Column:
    """The mean, or 0.0 where there is nothing to average."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def align_pairs(predictions: DataFrame, references: DataFrame, key: str = "row_idx") -> DataFrame:
    """Predictions and references paired by row; a row on one side only is an error.

    The error is raised by a filter of the job itself, which no selection of
    columns removes, and the join runs once.
    """
    message = F.lit("A row has a prediction or a reference, but not both")
    joined = predictions.select(key, "prediction", F.lit(1).alias("p")).join(
        references.select(key, "reference", F.lit(1).alias("r")), key, "full"
    )
    one_sided = F.col("p").isNull() | F.col("r").isNull()
    whole = F.when(one_sided, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return joined.where(whole).select(key, "prediction", "reference")


# --- per pair ----------------------------------------------------------------


def _f_measure(hits: Column, n_prediction: Column, n_reference: Column) -> Column:
    total = n_prediction + n_reference
    return F.when(hits > 0, 2.0 * hits / total).otherwise(F.lit(0.0))


def _lines(text: Column, tokenizer: str) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    return F.array_join(
        F.transform(lines, lambda line: tokens.rouge_tokens(line, tokenizer)), "\n"
    )


def _token_columns(metrics: tuple[str, ...], tokenizer: str) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for side, name in (("p", "prediction"), ("r", "reference")):
        text = F.coalesce(F.col(name), F.lit(""))
        if "sacrebleu" in metrics:
            columns[f"bleu_{side}"] = tokens.tokens_13a(text)
        if {"rouge1", "rouge2", "rougeL", "rougeLsum"} & set(metrics):
            columns[f"rouge_{side}"] = tokens.rouge_tokens(text, tokenizer)
        if "rougeLsum" in metrics:
            columns[f"lines_{side}"] = _lines(text, tokenizer)
        if "meteor" in metrics:
            columns[f"words_{side}"] = tokens.word_tokens(text)
    return columns


def _overlap_columns(metrics: tuple[str, ...], with_synonyms: bool, stems: bool) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    if "sacrebleu" in metrics:
        columns["bleu_m"] = clipped_matches(F.col("bleu_p"), F.col("bleu_r"), ORDERS)
    if {"rouge1", "rouge2"} & set(metrics):
        columns["rouge_m"] = clipped_matches(F.col("rouge_p"), F.col("rouge_r"), (1, 2))
    if "rougeL" in metrics:
        columns["lcs"] = lcs_length(F.col("rouge_p"), F.col("rouge_r"))
    if "rougeLsum" in metrics:
        columns["hits"] = union_lcs_hits(F.col("lines_p"), F.col("lines_r"))
    if "meteor" in metrics:
        known = F.col("synonyms") if with_synonyms else None
        columns["align"] = word_alignment(F.col("words_p"), F.col("words_r"), known, stems)
    return columns


def _with_synonyms(counted: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Adds the synonyms (word, synonym) that join a predicted word to a referred one.

    Pairs of equal words are looked up once, under a hash of both texts.
    """
    key = F.sha2(F.concat_ws("\n", "words_p", "words_r"), 256)
    counted = counted.withColumn("__texts", key)
    texts = counted.select("__texts", "words_p", "words_r").dropDuplicates(["__texts"])

    def words(side: str, name: str) -> DataFrame:
        each = F.explode(F.array_distinct(F.split(side, " "))).alias(name)
        return texts.select("__texts", each)

    table = synonyms.select("word", "synonym").distinct()
    found = (
        words("words_p", "word")
        .join(table, "word")
        .join(words("words_r", "synonym"), ["__texts", "synonym"])
        .groupBy("__texts")
        .agg(F.collect_list(F.struct("word", "synonym")).alias("synonyms"))
    )
    return counted.join(found, "__texts", "left").drop("__texts")


def _check_options(
    metrics: tuple[str, ...] = TEXT_METRICS, tokenizer: str = "ascii", synonyms: DataFrame | None = None, **_
) -> None:
    """A wrong option is the caller's error, not one of the texts."""
    if unknown := set(metrics) - set(TEXT_METRICS):
        raise ValueError(f"Unknown metrics: {sorted(unknown)}")
    if tokenizer not in tokens.ROUGE_CLASSES:
        raise ValueError(f"Unknown tokenizer {tokenizer!r}: not one of {sorted(tokens.ROUGE_CLASSES)}")
    if synonyms is not None and not {"word", "synonym"} <= set(synonyms.columns):
        raise ValueError("Synonyms are a table with the columns word and synonym")


def _score_columns(metrics: tuple[str, ...], guarded: bool) -> dict[str, Column]:
    def value(name: str, kind: str, alone: bool = True) -> Column:
        """The outcome of a pair; an error fails the job unless its family is guarded."""
        if guarded and alone:
            return F.col(f"{name}.value")
        error = F.col(f"{name}.error")
        return F.when(error.isNotNull(), F.raise_error(error).cast(kind)).otherwise(
            F.col(f"{name}.value")
        )

    def sizes(kind: str) -> tuple[Column, Column]:
        return tokens.token_count(F.col(f"{kind}_p")), tokens.token_count(F.col(f"{kind}_r"))

    columns: dict[str, Column] = {}
    if "sacrebleu" in metrics:
        p, r = sizes("bleu")
        columns["bleu_m"] = value("bleu_m", "array<int>", alone=False)
        columns["bleu_np"], columns["bleu_nr"] = p, r
    for n, name in ((1, "rouge1"), (2, "rouge2")):
        if name in metrics:
            p, r = sizes("rouge")
            columns[name] = _f_measure(
                F.get(value("rouge_m", "array<int>"), n - 1),
                F.greatest(p - (n - 1), F.lit(0)),
                F.greatest(r - (n - 1), F.lit(0)),
            )
    if "rougeL" in metrics:
        columns["rougeL"] = _f_measure(value("lcs", "int"), *sizes("rouge"))
    if "rougeLsum" in metrics:
        columns["rougeLsum"] = _f_measure(value("hits", "int"), *sizes("rouge"))
    if "meteor" in metrics:
        p, r = sizes("words")
        aligned = value("align", "array<int>")
        matches, chunks = F.get(aligned, 0), F.get(aligned, 1)
        mean = (matches / p) * (matches / r) / (0.9 * matches / p + 0.1 * matches / r)
        penalty = 0.5 * F.pow(chunks / matches, 3)
        columns["meteor"] = F.when(matches > 0, (1 - penalty) * mean).otherwise(F.lit(0.0))
    return columns


def pair_scores(
    pairs: DataFrame,
    by: tuple[str, ...] = (),
    metrics: tuple[str, ...] = TEXT_METRICS,
    tokenizer: str = "ascii",
    synonyms: DataFrame | None = None,
    guarded: bool = False,
    stems: bool = False,
) -> DataFrame:
    """Per pair: the ``by`` columns and the score (for BLEU: the counts) of each metric.

    ``synonyms`` is a table (word, synonym) for METEOR; ``stems`` lets it match
    words of one stem before that. With ``guarded``, what fails in a pair's
    ROUGE or METEOR is kept as text in a column per family.
    """
    _check_options(metrics, tokenizer, synonyms)
    text = _token_columns(metrics, tokenizer)
    counted = pairs.select(*by, *[c.alias(n) for n, c in text.items()])
    use_synonyms = synonyms is not None and "meteor" in metrics
    if use_synonyms:
        counted = _with_synonyms(counted, synonyms)
    overlaps = _overlap_columns(metrics, use_synonyms, stems)
    counted = counted.select("*", *[c.alias(n) for n, c in overlaps.items()])
    errors = {}
    if guarded:
        for name, _, outcomes in FAMILIES:
            if own := [F.col(f"{c}.error") for c in outcomes if c in overlaps]:
                errors[name] = F.coalesce(*own)
    scores = _score_columns(metrics, guarded) | errors
    return counted.select(*by, *[c.alias(n) for n, c in scores.items()])


# --- per group ---------------------------------------------------------------


def _bleu_sums() -> list[Column]:
    sums = [F.sum("bleu_np").alias("np"), F.sum("bleu_nr").alias("nr")]
    for n in ORDERS:
        sums.append(F.sum(F.get("bleu_m", n - 1).cast("bigint")).alias(f"m{n}"))
        sums.append(F.sum(F.greatest(F.col("bleu_np") - (n - 1), F.lit(0))).alias(f"t{n}"))
    return sums


def _bleu_score() -> Column:
    """Corpus BLEU from summed counts, with exponential smoothing of zero orders."""

    def zero(n: int) -> Column:
        return F.when(F.col(f"m{n}") == 0, 1).otherwise(0)

    logs = []
    for n in ORDERS:
        halvings = reduce(lambda a, b: a + b, [zero(k) for k in ORDERS[:n]])
        smoothed = 100.0 / (F.pow(F.lit(2.0), halvings) * F.col(f"t{n}"))
        exact = 100.0 * F.col(f"m{n}") / F.col(f"t{n}")
        logs.append(F.log(F.when(F.col(f"m{n}") == 0, smoothed).otherwise(exact)))
    mean_log = reduce(lambda a, b: a + b, logs) / len(ORDERS)
    brevity = F.when(F.col("np") >= F.col("nr"), F.lit(1.0)).otherwise(
        F.exp(1 - F.col("nr") / F.col("np"))
    )
    # Unigrams bound all orders, so no unigram match means no match at all; the
    # longest order has the fewest n-grams.
    scored = (F.col("m1") > 0) & (F.col(f"t{ORDERS[-1]}") > 0)
    return F.when(scored, brevity * F.exp(mean_log)).otherwise(F.lit(0.0))


def compute_text_metrics(
    pairs: DataFrame,
    by: tuple[str, ...] = (),
    metrics: tuple[str, ...] = TEXT_METRICS,
    tokenizer: str = "ascii",
    synonyms: DataFrame | None = None,
    guarded: bool = False,
    stems: bool = False,
) -> DataFrame:
    """One row per group: num_examples and every metric, in one pass over the pairs.

    With ``guarded`` a group in which a family failed has its error text and no
    scores of that family.
    """
    scores = pair_scores(pairs, by, metrics, tokenizer, synonyms, guarded, stems)
    bleu = "sacrebleu" in metrics
    means = [m for m in metrics if m != "sacrebleu"]
    grouped = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_examples"),
        *(_bleu_sums() if bleu else []),
        *[safe_mean(F.col(m)).alias(m) for m in means],
        *[F.max(e).alias(e) for e, *_ in FAMILIES if e in scores.columns],
    )
    errors = {m: e for e, names, _ in FAMILIES if e in scores.columns for m in names}
    means = [F.when(F.col(errors[m]).isNull(), F.col(m)).alias(m) if m in errors else m for m in means]
    means += [e for e, *_ in FAMILIES if e in scores.columns]
    named = []
    if bleu:
        named = [_bleu_score().alias("sacrebleu"), F.lit(BLEU_SIGNATURE).alias("sacrebleu_signature")]
    return grouped.select(*by, "num_examples", *named, *means)


def corpus_bleu(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return compute_text_metrics(pairs, by, ("sacrebleu",))


def rouge_n(pairs: DataFrame, by: tuple[str, ...] = (), tokenizer: str = "ascii") -> DataFrame:
    return compute_text_metrics(pairs, by, ("rouge1", "rouge2"), tokenizer)


def rouge_l(pairs: DataFrame, by: tuple[str, ...] = (), tokenizer: str = "ascii") -> DataFrame:
    return compute_text_metrics(pairs, by, ("rougeL",), tokenizer)


def rouge_lsum(pairs: DataFrame, by: tuple[str, ...] = (), tokenizer: str = "ascii") -> DataFrame:
    return compute_text_metrics(pairs, by, ("rougeLsum",), tokenizer)


def meteor_exact(
    pairs: DataFrame, by: tuple[str, ...] = (), synonyms: DataFrame | None = None
) -> DataFrame:
    return compute_text_metrics(pairs, by, ("meteor",), synonyms=synonyms)


def meteor_stems(
    pairs: DataFrame, by: tuple[str, ...] = (), synonyms: DataFrame | None = None
) -> DataFrame:
    """METEOR with all its stages: equal words, words of one stem, synonyms."""
    return compute_text_metrics(pairs, by, ("meteor",), synonyms=synonyms, stems=True)


def isolated_text_metrics(
    pairs: DataFrame,
    by: tuple[str, ...] = (),
    token_vectors: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The full record of scores; a failing family leaves its error text instead.

    One pass over the pairs. A family fails alone both when its plan cannot be
    built and when a pair breaks it; BLEU is not guarded, and a wrong option is
    raised at once. ``token_vectors`` (see ``embedding_match``, with the ``by``
    columns) adds bertscore_f1 by a join of one row per group.
    """
    _check_options(**options)
    if unknown := set(options) - {"tokenizer", "synonyms", "stems"}:
        raise TypeError(f"Unknown options: {sorted(unknown)}")
    metrics, failed = ["sacrebleu"], {}
    for error, names, _ in FAMILIES:
        try:
            pair_scores(pairs, by, names, guarded=True, **options)
        except Exception as failure:  # whatever broke must not take the others along
            failed[error] = str(failure)
        else:
            metrics += names
    result = compute_text_metrics(pairs, by, tuple(metrics), guarded=True, **options)
    if token_vectors is not None:
        try:
            matched = embedding_match(token_vectors, by).select(
                *[F.col(c).alias(f"__of_{c}") for c in by], "bertscore_f1"
            )
        except Exception as failure:
            failed["bertscore_error"] = str(failure)
        else:
            same = reduce(
                lambda a, b: a & b,
                [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by],
                F.lit(True),
            )
            result = result.join(matched, same, "left").drop(*[f"__of_{c}" for c in by])
    return result.withColumns({e: F.lit(text) for e, text in failed.items()})
