"""Experiment manifests, run summaries, training traces and ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill import fixed_values as fv
from clozemill.functions.formats import format_metric
from clozemill.operators.metrics import safe_mean
from clozemill.operators.ordering import DENSE_WIDTH, with_running


def select_groups(manifest: DataFrame, groups: list[str]) -> DataFrame:
    """The experiments of the requested groups, in request order.

    Adds ``group_pos``. An unknown group gives no rows; a group asked for twice
    comes twice. The request is a literal list, exploded in place, not a join.
    """
    places: dict[str, list[int]] = {}
    for i, group in enumerate(groups):
        places.setdefault(group, []).append(i)
    asked: Column | None = None
    for group, at in places.items():
        hit = F.col("group") == group
        positions = F.array(*[F.lit(i) for i in at])
        asked = F.when(hit, positions) if asked is None else asked.when(hit, positions)
    if asked is None:
        return manifest.withColumn("group_pos", F.lit(0)).limit(0)
    wanted = manifest.where(F.col("group").isin(*places))
    return wanted.select("*", F.explode(asked).alias("group_pos"))


def in_manifest_order(experiments: DataFrame) -> DataFrame:
    return experiments.orderBy("group_pos", "pos")


def select_ids(experiments: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Only the experiments asked for; an empty request keeps all.

    ``ids`` is a list, or a table with an ``id`` column. Use
    ``require_experiments`` where an empty result is an error.
    """
    if isinstance(ids, DataFrame):
        return experiments.join(ids.select("id"), "id", "left_semi").select(*experiments.columns)
    return experiments.where(F.col("id").isin(*ids)) if ids else experiments


def require_experiments(experiments: DataFrame) -> DataFrame:
    if experiments.isEmpty():
        raise ValueError("The selection holds no experiment")
    return experiments


_TEXT_FIELDS = (
    "title", "scenario", "model_family", "train_language", "eval_language", "dataset",
)


def run_summary(
    experiments: DataFrame,
    configs: DataFrame,
    metrics: DataFrame,
    summaries: DataFrame,
) -> DataFrame:
    """One row per experiment with its settings, paths, training outcome and scores.

    ``configs`` (config, output_dir, config_model_name), ``metrics`` and
    ``summaries`` (both keyed by output_dir) hold one row per key, so nothing
    multiplies. Spark sizes the lookups when the job runs and broadcasts one
    only if it is small. Numbers that are missing stay null.
    """

    def text(name: str) -> Column:
        if name not in experiments.columns:
            return F.lit("").alias(name)
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    def number(df: DataFrame, name: str, dtype: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast(dtype).alias(name)
        return F.col(name).cast(dtype).alias(name)

    order = [c for c in ("group_pos", "pos") if c in experiments.columns]
    given_name = F.col("model_name") if "model_name" in experiments.columns else F.lit(None)
    scores = metrics.select(
        "output_dir",
        number(metrics, "num_examples", "bigint"),
        *[number(metrics, m, "double") for m in fv.METRIC_COLUMNS],
    )
    outcomes = summaries.select(
        "output_dir",
        number(summaries, "best_val_loss", "double"),
        number(summaries, "elapsed_hms", "string"),
        number(summaries, "device", "string"),
    )
    configured = experiments.join(
        configs.select("config", "output_dir", "config_model_name"), "config", "left"
    )
    missing = F.concat(F.lit("No config for experiment "), F.col("id"))
    known = F.when(F.col("output_dir").isNull(), F.raise_error(missing).cast("boolean"))
    return (
        configured.where(known.otherwise(F.lit(True)))
        .join(scores, "output_dir", "left")
        .join(outcomes, "output_dir", "left")
        .select(
            *order,
            "id",
            *[text(c) for c in _TEXT_FIELDS[:3]],
            F.coalesce(given_name, F.col("config_model_name"), F.lit("")).alias("model_name"),
            *[text(c) for c in _TEXT_FIELDS[3:]],
            "config",
            "output_dir",
            F.concat(F.col("output_dir"), F.lit("/checkpoints/best")).alias("checkpoint"),
            "best_val_loss",
            F.coalesce("elapsed_hms", F.lit("")).alias("elapsed_hms"),
            F.coalesce("device", F.lit("")).alias("device"),
            "num_examples",
            *fv.METRIC_COLUMNS,
        )
    )


def report_cells(summary: DataFrame) -> DataFrame:
    """The ten report columns as text: doubles with four decimals, missing ones ''."""
    order = [c for c in ("group_pos", "pos") if c in summary.columns]
    cells = []
    for name in fv.REPORT_COLUMNS:
        if name not in summary.columns:
            cells.append(F.lit("").alias(name))
            continue
        dtype = summary.schema[name].dataType
        fractional = isinstance(dtype, (T.DoubleType, T.FloatType))
        cell = format_metric(F.col(name)) if fractional else F.col(name).cast("string")
        cells.append(F.coalesce(cell, F.lit("")).alias(name))
    return summary.select(*order, *cells)


def compare_runs(
    summary: DataFrame, pairs: DataFrame, metrics: tuple[str, ...] = fv.METRIC_COLUMNS
) -> DataFrame:
    """Metric differences left - right for every (comparison, left_id, right_id)."""
    deltas = [
        (F.col(f"left.{m}") - F.col(f"right.{m}")).alias(f"{m}_delta") for m in metrics
    ]
    return (
        pairs.alias("pair")
        .join(summary.select("id", *metrics).alias("left"), F.col("left_id") == F.col("left.id"))
        .join(
            summary.select("id", *metrics).alias("right"), F.col("right_id") == F.col("right.id")
        )
        .select("comparison", "left_id", "right_id", *deltas)
    )


# --- training traces ---------------------------------------------------------


def explode_training_log(summaries: DataFrame, key: str = "output_dir") -> DataFrame:
    """The nested epoch records of training summaries as rows."""
    return summaries.select(key, F.inline("training_log"))


def epoch_mean_loss(steps: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean step loss per (run_id, epoch), summed before the shuffle."""
    return steps.groupBy("run_id", "epoch").agg(safe_mean(F.col(loss)).alias("mean_loss"))


def with_early_stopping(epochs: DataFrame, patience: int = fv.DEFAULT_PATIENCE) -> DataFrame:
    """Adds improved, best_val_loss, best_epoch, epochs_since_best and stops.

    Rows are (run_id, epoch, val_loss). An epoch improves when its loss is
    strictly below all earlier ones; NaN never is. ``stops`` marks every epoch
    at which the patience is used up, not only the first.
    """
    limit = max(int(patience), 1)
    loss = F.when(F.isnan("val_loss") | F.col("val_loss").isNull(), float("inf")).otherwise(
        F.col("val_loss")
    )
    by = ("run_id",)
    rows = epochs.withColumn("__loss", loss)
    earlier = {
        "__before": ("min", F.col("__loss")),
        "__earlier": ("sum", F.lit(1).cast("bigint")),
    }
    # The epoch numbers of a run need not be dense, so the wait is counted in rows.
    rows = with_running(rows, "epoch", earlier, by, inclusive=False).select(
        "*",
        (F.col("__earlier") + 1).alias("epoch_number"),
        (F.col("__loss") < F.coalesce("__before", F.lit(float("inf")))).alias("improved"),
    )
    best = {
        "best_epoch": ("max", F.when(F.col("improved"), F.col("epoch"))),
        "__best_number": ("max", F.when(F.col("improved"), F.col("epoch_number"))),
    }
    rows = with_running(rows, "epoch", best, by)
    since = F.col("epoch_number") - F.coalesce("__best_number", F.lit(0))
    return rows.select(
        *epochs.columns,
        "epoch_number",
        "improved",
        F.least("__before", "__loss").alias("best_val_loss"),
        "best_epoch",
        since.alias("epochs_since_best"),
        (since >= limit).alias("stops"),
    )


def _same(*columns: str) -> Column:
    """Equal with nulls together, between the aliases ``left`` and ``right``."""
    return reduce(lambda a, b: a & b, [F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}")) for c in columns])


def early_stopping(epochs: DataFrame, patience: int | tuple[int, ...] = fv.DEFAULT_PATIENCE) -> DataFrame:
    """Per run: epochs_run, stop_epoch, best_epoch, best_val_loss, stopped_early.

    Several patiences are answered from one trace, with a column ``patience``.
    Only record lows matter: the run stops at the first of them that no other
    follows within the patience. A chunk of epochs is summed up by its number of
    rows and its own record lows; what earlier chunks carry into it, their rows
    and their lowest loss, leaves a part of these, and the stop of any patience
    is the first gap between neighbours. Only one small row per chunk goes
    through the window of a run, and a long run is spread over its chunks.
    """
    patiences = (patience,) if isinstance(patience, int) else tuple(patience)
    infinite = F.lit(float("inf"))
    missing = F.raise_error(F.lit("Rows without epoch have no place")).cast("bigint")
    loss = F.col("val_loss").cast("double")
    rows = epochs.select(
        "run_id",
        "epoch",
        F.when(F.isnan(loss) | loss.isNull(), infinite).otherwise(loss).alias("loss"),
        F.shiftright(F.coalesce(F.col("epoch").cast("bigint"), missing), DENSE_WIDTH).alias("chunk"),
    )
    inside = Window.partitionBy("run_id", "chunk").orderBy("epoch", "loss")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(
        "*", F.row_number().over(inside).cast("bigint").alias("place"), F.min("loss").over(earlier).alias("before")
    )
    low = F.when(F.col("loss") < F.coalesce("before", infinite), F.struct("place", "epoch", "loss"))
    chunks = placed.groupBy("run_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(low)).alias("lows")
    )
    carried = _carried(chunks, infinite)

    # A chunk's record lows among all: those below what earlier chunks had, after the last of these.
    own = F.transform(
        F.filter("lows", lambda x: x["loss"] < F.col("before_low")),
        lambda x: F.struct(
            (F.col("before_n") + x["place"]).alias("number"), x["epoch"].alias("epoch"), x["loss"].alias("loss")
        ),
    )
    beyond = F.when(F.col("ends"), F.array(F.col("total") + 1)).otherwise(F.array().cast("array<bigint>"))
    gaps = F.arrays_zip(
        F.concat(F.array("last"), "own").alias("low"),
        F.concat(F.transform("own", lambda x: x["number"]), beyond).alias("next"),
    )

    def first_gap(wait: Column) -> Column:
        return F.get(F.filter("gaps", lambda x: x["next"] - x["low"]["number"] > wait), 0)["low"]

    waits = [F.lit(max(int(p), 1)).cast("bigint") for p in patiences]
    found = (
        chunks.alias("left")
        .join(carried.alias("right"), _same("run_id", "chunk"))
        .select("left.run_id", "left.chunk", "left.n", "before_n", "total", "ends", "last", own.alias("own"))
        .select("run_id", "chunk", "n", "before_n", "total", gaps.alias("gaps"))
        .select(
            "run_id", "chunk", "n", "before_n", "total",
            F.element_at("gaps", -1)["low"].alias("last"),
            *[first_gap(w).alias(f"first_{i}") for i, w in enumerate(waits)],
        )
    )
    run = Window.partitionBy("run_id")
    options = [
        F.struct(F.lit(p).alias("patience"), w.alias("wait"), F.min(f"first_{i}").over(run).alias("first"))
        for i, (p, w) in enumerate(zip(patiences, waits, strict=True))
    ]
    stops = (
        found.select("run_id", "chunk", "n", "before_n", "total", F.max("last").over(run).alias("last"), F.array(*options).alias("x"))
        .select("*", F.explode("x").alias("option"))
        .select(
            "run_id", "chunk", "n", "before_n",
            "option.patience",
            F.col("option.first").isNotNull().alias("stopped_early"),
            F.coalesce("option.first", "last").alias("best"),
            F.coalesce(F.col("option.first.number") + F.col("option.wait"), "total").alias("epochs_run"),
        )
    )
    # The epoch of a number stands in one chunk of the run, at one place.
    place = F.col("epochs_run") - F.col("before_n")
    stops = stops.where((place > 0) & (place <= F.col("n"))).withColumn("place", place)
    last = stops.alias("left").join(placed.alias("right"), _same("run_id", "chunk", "place"))
    return last.select(
        "left.run_id",
        *([] if isinstance(patience, int) else ["patience"]),
        "epochs_run",
        F.col("right.epoch").alias("stop_epoch"),
        F.col("best.epoch").alias("best_epoch"),
        F.col("best.loss").alias("best_val_loss"),
        "stopped_early",
    )


def _carried(chunks: DataFrame, infinite: Column) -> DataFrame:
    """Per chunk of a run: rows, lowest loss and last record low before it; the run's rows; whether it ends the run."""
    lowest = F.get("lows", F.size("lows") - 1)
    run = Window.partitionBy("run_id")
    earlier = run.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.select("run_id", "chunk", "n", lowest.alias("lowest")).select(
        "*",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_n"),
        F.coalesce(F.min("lowest.loss").over(earlier), infinite).alias("before_low"),
        F.sum("n").over(run).alias("total"),
    )
    here = F.struct(
        (F.col("before_n") + F.col("lowest.place")).alias("number"),
        F.col("lowest.epoch").alias("epoch"),
        F.col("lowest.loss").alias("loss"),
    )
    lowered = F.when(F.col("lowest.loss") < F.col("before_low"), here)
    none = F.struct(
        F.lit(0).cast("bigint").alias("number"),
        F.lit(None).cast(chunks.schema["lows"].dataType.elementType["epoch"].dataType).alias("epoch"),
        infinite.alias("loss"),
    )
    return sums.select(
        "run_id", "chunk", "n", "before_n", "before_low", "total",
        F.coalesce(F.max(lowered).over(earlier), none).alias("last"),
        (F.col("before_n") + F.col("n") == F.col("total")).alias("ends"),
    )


# --- ratings -----------------------------------------------------------------


def human_eval_sheet(predictions: DataFrame) -> DataFrame:
    """Predictions with the blank rating columns that they lack."""
    blank = {c: F.lit("") for c in fv.RATING_COLUMNS if c not in predictions.columns}
    return predictions.withColumns(blank) if blank else predictions


def human_eval_summary(ratings: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean of every score column that is there; blanks and non-numbers are left out."""
    scores = [c for c in fv.RATING_COLUMNS if c.endswith("_1_5") and c in ratings.columns]
    means = [F.avg(F.col(c).try_cast("double")).alias(c.removesuffix("_score_1_5")) for c in scores]
    return ratings.groupBy(*by).agg(*means)
