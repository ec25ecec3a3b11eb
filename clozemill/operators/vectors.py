"""Embedding-match F1: greedy cosine matching of token vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vectors per block. A block and a block pair are one row each, so this bounds
# what a task holds at a time, however many tokens one pair has.
BLOCK = 256


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


_DOUBLES = T.ArrayType(T.DoubleType())


@F.pandas_udf(
    T.StructType(
        [T.StructField("of_prediction", _DOUBLES), T.StructField("of_reference", _DOUBLES)]
    )
)
def _best_cosines(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(prediction, reference):
        cosines = _unit(a) @ _unit(b).T
        rows.append((cosines.max(axis=1), cosines.max(axis=0)))
    return pd.DataFrame(rows, columns=["of_prediction", "of_reference"])


def _blocks(vectors: DataFrame, side: str, keys: list[str]) -> DataFrame:
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    return (
        vectors.where(F.col("side") == side)
        .groupBy(*keys, block)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("rows"))
        .select(*keys, F.col("block").alias(f"{side}_block"), F.col("rows.vec").alias(side))
    )


def embedding_match(
    vectors: DataFrame, by: tuple[str, ...] = (), pair: str = "pair_id"
) -> DataFrame:
    """Mean precision, recall and F1 over pairs, from (pair, side, pos, vec) rows.

    ``side`` is "prediction" or "reference"; ``pos`` is unique within a side.
    A pair without vectors on one side scores 0. Vectors are packed into blocks
    of bounded size. Each prediction block meets the reference blocks of its
    pair, spread over (pair, reference block), and only the best cosines travel
    on, not the similarities.
    """
    keys = [*by, pair]
    predictions = _blocks(vectors, "prediction", keys)
    references = _blocks(vectors, "reference", keys)
    # How many blocks each pair has on the reference side, one row per pair.
    listed = (
        vectors.where(F.col("side") == "reference")
        .groupBy(*keys)
        .agg(F.collect_set(F.floor(F.col("pos") / BLOCK)).alias("blocks"))
    )
    met = (
        predictions.join(listed, keys)
        .select(*keys, "prediction_block", "prediction", F.explode("blocks").alias("reference_block"))
        .join(references, [*keys, "reference_block"])
        .select(
            *keys,
            "prediction_block",
            "reference_block",
            _best_cosines("prediction", "reference").alias("best"),
        )
    )

    def side(label: str, block: str, cosines: str) -> Column:
        return F.struct(
            F.lit(label).alias("side"), F.col(block).alias("block"), F.col(cosines).alias("cosines")
        )

    sides = F.array(
        side("p", "prediction_block", "best.of_prediction"),
        side("r", "reference_block", "best.of_reference"),
    )
    cosines = (
        met.select(*keys, F.explode(sides).alias("s"))
        .select(*keys, "s.side", "s.block", F.posexplode("s.cosines").alias("place", "cosine"))
        .groupBy(*keys, "side", "block", "place")
        .agg(F.max("cosine").alias("cosine"))
    )
    scored = cosines.groupBy(*keys).agg(
        F.avg(F.when(F.col("side") == "p", F.col("cosine"))).alias("precision"),
        F.avg(F.when(F.col("side") == "r", F.col("cosine"))).alias("recall"),
    )
    every_pair = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_vectors"))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    return (
        every_pair.join(scored, keys, "left")
        .select(*by, F.coalesce(p, zero).alias("p"), F.coalesce(r, zero).alias("r"), f1.alias("f"))
        .groupBy(*by)
        .agg(
            F.avg("p").alias("bertscore_precision"),
            F.avg("r").alias("bertscore_recall"),
            F.avg("f").alias("bertscore_f1"),
        )
    )
