"""Confidence intervals of scores by a Poisson bootstrap in one pass.

A classical resample draws n of n pairs; here every pair takes part in a
replicate with a weight drawn on its own, Poisson with mean one, which tends to
the same distribution and needs no second look at the table. A weight depends on
the pair's key, the replicate and the seed alone, through MD5, so a task that is
run again gives the same sums, and so does any other engine.

Tasks add up ``replicates`` weighted sums per group with numpy; one exchange of
these partial sums follows, never of pairs, and percentiles of the replicates.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.operators.metrics import ORDERS, _bleu_score, pair_scores

# What the scorer's own aggregation uses by default.
REPLICATES, CONFIDENCE = 1000, 0.95
# An MD5 holds eight weights of 16 bits.
PER_DIGEST = 8
# Groups that a task sums at a time; beyond them the sums are passed on.
GROUPS = 64
ROUGE = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def poisson_steps() -> list[int]:
    """From which 16-bit number on a weight is at least 1, 2, 3, …"""
    below, term, steps = 0.0, math.exp(-1.0), []
    for k in range(1, 20):
        below += term
        term /= k
        step = round(below * 65536)
        if step >= 65536:
            break
        steps.append(step)
    return steps


def weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """One row of replicate weights per key."""
    digests = -(-replicates // PER_DIGEST)
    drawn = b"".join(
        hashlib.md5(f"{key}:{i}:{seed}".encode(), usedforsecurity=False).digest()
        for key in keys
        for i in range(digests)
    )
    numbers = np.frombuffer(drawn, ">u2").reshape(len(keys), -1)[:, :replicates]
    return np.searchsorted(poisson_steps(), numbers, side="right").astype(float)


def replicate_sums(
    rows: DataFrame,
    key: str,
    columns: tuple[str, ...],
    by: tuple[str, ...] = (),
    replicates: int = REPLICATES,
    seed: int = 0,
) -> DataFrame:
    """(by, replicate, num_rows, weight, one weighted sum per column): rows of ``rows`` per replicate.

    ``key`` names a row: rows of one key share their weights, and a null key is
    the empty one. A null or NaN in ``columns`` adds nothing.
    """
    if replicates < 1:
        raise ValueError("At least one replicate is needed")
    sums = ("weight", *[f"sum_{i}" for i in range(len(columns))])
    sent = rows.select(
        *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)],
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        *[F.col(c).cast("double").alias(f"value_{i}") for i, c in enumerate(columns)],
    )
    groups = [f for f in sent.schema if f.name.startswith("by_")]
    schema = T.StructType([
        *groups,
        T.StructField("num_rows", T.LongType()),
        *[T.StructField(s, T.ArrayType(T.DoubleType())) for s in sums],
    ])
    width = len(by)

    def run(batches):
        totals: dict[tuple, list] = {}
        firsts: list[pa.RecordBatch] = []

        def flush():
            named = pa.Table.from_batches(firsts).combine_chunks()
            values = [pa.array([n for n, _ in totals.values()], pa.int64())]
            values += [pa.array([t[i].tolist() for _, t in totals.values()]) for i in range(len(sums))]
            arrays = [*[c.combine_chunks() for c in named.columns[:width]], *values]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                drawn = weights(part.column(width).to_pylist(), replicates, seed)
                values = [np.ones(len(part))]
                values += [np.nan_to_num(np.asarray(c.fill_null(0.0))) for c in part.columns[width + 1 :]]
                keys = list(zip(*[c.to_pylist() for c in part.columns[:width]], strict=True)) if width else [()] * len(part)
                members: dict[tuple, list[int]] = {}
                for i, group in enumerate(keys):
                    members.setdefault(group, []).append(i)
                for group, own in members.items():
                    if group not in totals:
                        if len(totals) >= GROUPS:
                            yield from flush()
                            totals.clear()
                            firsts.clear()
                        totals[group] = [0, np.zeros((len(sums), replicates))]
                        firsts.append(part.slice(own[0], 1))
                    totals[group][0] += len(own)
                    totals[group][1] += np.stack([v[own] for v in values]) @ drawn[own]
        if totals:
            yield from flush()

    each = F.posexplode(F.arrays_zip(*sums)).alias("replicate", "x")
    names = [f"by_{i}" for i in range(width)]
    summed = (
        sent.mapInArrow(run, schema)
        .select(*names, "num_rows", each)
        .groupBy(*names, "replicate")
        .agg(F.sum("num_rows").alias("num_rows"), *[F.sum(f"x.{s}").alias(s) for s in sums])
    )
    return summed.select(
        *[F.col(n).alias(c) for n, c in zip(names, by, strict=True)],
        "replicate", "num_rows", "weight",
        *[F.col(s).alias(c) for s, c in zip(sums[1:], columns, strict=True)],
    )


def intervals(
    replicates: DataFrame, scores: dict[str, Column], by: tuple[str, ...], confidence: float
) -> DataFrame:
    """(by, num_examples, low, mid and high per score): percentiles over the replicates of a group.

    A replicate in which no pair of a group takes part says nothing about it and
    is left out.
    """
    if not 0 < confidence < 1:
        raise ValueError("The confidence lies between 0 and 1")
    tail = (1 - confidence) / 2
    places = {"low": tail, "mid": 0.5, "high": 1 - tail}
    there = F.col("weight") > 0
    found = replicates.select(*by, "num_rows", *[F.when(there, c).alias(n) for n, c in scores.items()])
    return found.groupBy(*by).agg(
        F.coalesce(F.max("num_rows"), F.lit(0)).alias("num_examples"),
        *[F.percentile(n, F.lit(q)).alias(f"{n}_{side}") for n in scores for side, q in places.items()],
    )


def bootstrap_text_metrics(
    pairs: DataFrame,
    key: str,
    by: tuple[str, ...] = (),
    metrics: tuple[str, ...] = ROUGE,
    tokenizer: str = "ascii",
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    seed: int = 0,
    synonyms: DataFrame | None = None,
) -> DataFrame:
    """Low, middle and high of every score per group, and num_examples.

    The mean of a score over the pairs, or corpus BLEU from its counts, is taken
    in each replicate; ``key`` names a pair.
    """
    scores = pair_scores(pairs, (*by, key), metrics, tokenizer, synonyms)
    means = [m for m in metrics if m != "sacrebleu"]
    named: dict[str, Column] = {m: F.col(m) / F.col("weight") for m in means}
    summed = list(means)
    if "sacrebleu" in metrics:
        counts = _bleu_counts()
        scores = scores.select(*by, key, *means, *[c.alias(n) for n, c in counts.items()])
        summed += counts
        named["sacrebleu"] = _bleu_score()
    sums = replicate_sums(scores, key, tuple(summed), by, replicates, seed)
    return intervals(sums, {m: named[m] for m in metrics}, by, confidence)


def bootstrap_mean(
    rows: DataFrame,
    key: str,
    columns: tuple[str, ...],
    by: tuple[str, ...] = (),
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    seed: int = 0,
) -> DataFrame:
    """Low, middle and high of the mean of each column; its nulls are left out with their weight."""
    present = {c: F.col(c).isNotNull().cast("int") for c in columns}
    wide = rows.select(*by, key, *columns, *[p.alias(f"__has_{c}") for c, p in present.items()])
    sums = replicate_sums(wide, key, (*columns, *[f"__has_{c}" for c in columns]), by, replicates, seed)
    means: dict[str, Column] = {c: F.try_divide(F.col(c), F.col(f"__has_{c}")) for c in columns}
    return intervals(sums, means, by, confidence)


def _bleu_counts() -> dict[str, Column]:
    """The counts of a pair that corpus BLEU sums, by the names it reads them under."""
    columns: dict[str, Column] = {"np": F.col("bleu_np"), "nr": F.col("bleu_nr")}
    for n in ORDERS:
        columns[f"m{n}"] = F.get("bleu_m", n - 1)
        columns[f"t{n}"] = F.greatest(F.col("bleu_np") - (n - 1), F.lit(0))
    return columns
