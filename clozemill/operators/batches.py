"""Length-limited, batched and padded token tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clozemill.fixed_values import LABEL_PAD
from clozemill.operators.ordering import DENSE_WIDTH, HASH_WIDTH, with_dense_index


def words(c: Column) -> Column:
    """The default tokeniser: pieces between spaces."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def truncate_tokens(
    df: DataFrame,
    max_source_length: int,
    max_target_length: int,
    tokenizer: Callable[[Column], Column] = words,
    source: str = "source",
    target: str = "target",
) -> DataFrame:
    """Replaces source and target by input_ids, attention_mask, labels and truncated.

    ``tokenizer`` maps a text column to an array column: a Column function, or a
    pandas UDF around a subword tokeniser.
    """
    keep = [c for c in df.columns if c not in (source, target)]
    # Cut in a step of its own, so that the tokeniser runs once per text.
    tokens = df.select(
        *keep, tokenizer(F.col(source)).alias("__s"), tokenizer(F.col(target)).alias("__t")
    )
    ids = F.slice("__s", 1, max_source_length)
    return tokens.select(
        *keep,
        ids.alias("input_ids"),
        F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"),
        F.slice("__t", 1, max_target_length).alias("labels"),
        ((F.size("__s") > max_source_length) | (F.size("__t") > max_target_length)).alias(
            "truncated"
        ),
    )


def assign_batches(
    df: DataFrame, batch_size: int, seed: int | None = None, order: str = "row_idx"
) -> DataFrame:
    """Adds batch_id and batch_pos: fixed-size batches in table order or shuffled.

    With a seed the order is that of the first 15 hex digits of md5("row:seed"),
    which is the same on every run and needs no sort into one task.
    """
    if seed is None:
        placed = with_dense_index(df, order, "__place", width=DENSE_WIDTH)
    else:
        text = F.concat(F.col(order).cast("string"), F.lit(f":{seed}"))
        digits = F.substring(F.md5(text.cast("binary")), F.lit(1), F.lit(15))
        hashed = df.withColumn("__hash", F.conv(digits, 16, 10).cast("bigint"))
        placed = with_dense_index(
            hashed, "__hash", "__place", width=HASH_WIDTH, then_by=(order,)
        )
    place = F.col("__place")
    return placed.select(
        *df.columns,
        F.floor(place / batch_size).alias("batch_id"),
        (place % batch_size).cast("int").alias("batch_pos"),
    )


def pad_batches(df: DataFrame, pad: Column, label_pad: Column | None = None) -> DataFrame:
    """Pads every batch to its longest row; a batch is one small window partition.

    input_ids take ``pad``, attention_mask 0 and labels ``label_pad`` (-100).
    """
    batch = Window.partitionBy("batch_id")
    label_pad = F.lit(LABEL_PAD) if label_pad is None else label_pad

    def padded(name: str, value: Column) -> Column:
        missing = F.max(F.size(name)).over(batch) - F.size(name)
        return F.concat(F.col(name), F.array_repeat(value, missing)).alias(name)

    arrays = {
        "input_ids": padded("input_ids", pad),
        "attention_mask": padded("attention_mask", F.lit(0)),
        "labels": padded("labels", label_pad),
    }
    return df.select(*[arrays.get(c, F.col(c)) for c in df.columns])
