"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

A document is described by a few statistics of its whole text. They are
standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel. Every task sums the normal equations of its rows,
Spark adds the sums, and the driver solves one system of fixed size. Scores of
rows that a half-model has not seen, counted in fixed bins, give the isotonic
calibration.

Rows: a null text counts as empty; both get a score like any other. Null labels
and ids teach nothing; several labels of one id count as their mean; repeated
rows count as often as they occur. Without any label every score is 0.5. An
empty table gives an empty result. Other columns of the input stay; one named
like an output is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import append_columns, crc_of_id, one_label, saved

#: Random features; the system to solve has one more row.
FEATURES = 256
#: Width of the Gaussian kernel over standardised statistics.
WIDTH = 4.0
RIDGE = 1e-3
SEED = 17
#: Bins of raw scores between -0.5 and 1.5 for the calibration.
BINS = 1000
#: Standardised statistics are limited to this size.
LIMIT = 6.0
#: Tasks that sum normal equations, whatever the number of rows.
SUMMING_TASKS = 32

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "upper", "digit", "symbol",
    "mark_ends", "bare_marks", "distinct_words", "log_distinct", "repeats", "top_word",
    "distinct_lines", "log_lines", "line_words", "bar", "exclaim", "comma", "stop", "blank",
    "long_words", "hapax",
)

_MARKS = re.compile(r"[^\w\s.,;:'’?!-]")


def statistics(text: str | None) -> list[float]:
    """The numbers named in STATISTICS, over the whole text."""
    text = text or ""
    words = text.split()
    n_chars, n_words = len(text), len(words)
    if not words:
        return [np.log1p(n_chars), *[0.0] * (len(STATISTICS) - 1)]
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n_words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    upper = np.count_nonzero((codes >= 65) & (codes <= 90)) + np.count_nonzero((codes >= 0xC0) & (codes <= 0xDE))
    digit = np.count_nonzero((codes >= 48) & (codes <= 57))
    symbols = _MARKS.findall(text)
    ends = sum(not x[-1].isalnum() for x in words)
    bare = sum(1 for x in ("|", "-", "*", "#", "·", "•") for _ in range(counts.get(x, 0)))
    return [
        np.log1p(n_chars),
        np.log1p(n_words),
        min(lengths.mean(), 40.0),
        min(lengths.std(), 40.0),
        upper / n_chars,
        digit / n_chars,
        len(symbols) / n_chars,
        ends / n_words,
        bare / n_words,
        len(counts) / n_words,
        np.log(len(counts)) / np.log(n_words + 1.0),
        sum(a == b for a, b in pairwise(words)) / n_words,
        max(counts.values()) / n_words,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        min(np.log1p(n_words / len(lines)), 8.0),
        text.count("|") / n_words,
        text.count("!") / n_words,
        text.count(",") / n_words,
        text.count(".") / n_words,
        1 - lengths.sum() / n_chars,
        np.count_nonzero(lengths > 20) / n_words,
        sum(v == 1 for v in counts.values()) / n_words,
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column stats (array of double)."""

    def start():
        return lambda texts: [[statistics(x) for x in texts.to_pylist()]]

    return append_columns(docs, [text], "stats array<double>", start)


@dataclass
class Map:
    """Standardised statistics to random Fourier features and a constant."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -LIMIT, LIMIT)
        rng = np.random.default_rng(SEED)
        waves = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.cos(x @ waves + phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])


@dataclass
class Model:
    """Weights, and the corners of the calibration curve."""

    map: Map | None
    weights: np.ndarray | None
    raw: np.ndarray
    rate: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.map is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.map(stats) @ self.weights, self.raw, self.rate), 0.0, 1.0)


def isotonic(raw: np.ndarray, weight: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; corners (mean raw score, rate) of the pooled blocks."""
    blocks: list[list[float]] = []
    for x, w, v in zip(raw, weight, value, strict=True):
        blocks.append([x * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x, w, v = np.array(blocks).T
    return x / w, (v + 0.5) / (w + 1.0)


def _matrix(stats) -> np.ndarray:
    return np.asarray(stats.flatten().to_numpy(zero_copy_only=False), float).reshape(len(stats), -1)


def _solve(gram: np.ndarray) -> np.ndarray:
    """Ridge weights from the summed [features, label]' [features, label]."""
    a, b, n = gram[:-1, :-1].copy(), gram[:-1, -1], gram[-2, -2]
    a[np.diag_indices(len(a) - 1)] += RIDGE * max(n, 1.0)
    a[-1, -1] += 1e-9
    return np.linalg.solve(a, b)


def fit(rows: DataFrame) -> Model:
    """A model from ``rows`` (stats, label in 0..1, half 0 or 1); one row per labelled document."""
    width = len(STATISTICS)
    at = [F.col("stats")[i] for i in range(width)]
    sums = rows.agg(
        F.count("*"), *[F.avg(x) for x in at], *[F.stddev_pop(x) for x in at]
    ).first()
    if not sums[0]:
        return Model(None, None, np.zeros(1), np.full(1, 0.5))
    mean, scale = np.array(sums[1 : width + 1]), np.array(sums[width + 1 :])
    to = Map(mean, np.where(scale > 1e-9, scale, 1.0))
    size = FEATURES + 2

    def normal_equations(batches):
        total = np.zeros((2, size, size))
        for batch in batches:
            z = to(_matrix(batch.column(0)))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            half = batch.column(2).to_numpy(zero_copy_only=False)
            z = np.hstack([z, label[:, None]])
            for k in (0, 1):
                part = z[half == k]
                total[k] += part.T @ part
        import pyarrow as pa

        for k in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(list(total[k]), pa.list_(pa.float64()))],
                names=["half", "at", "row"],
            )

    summed = (
        rows.select("stats", "label", "half")
        .repartition(SUMMING_TASKS)
        .mapInArrow(normal_equations, "half int, at int, row array<double>")
        .groupBy("half", "at")
        .agg(*[F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(size)])
    )
    halves = np.zeros((2, size, size))
    for r in summed.collect():  # 2 x 258 rows of 258 numbers, whatever the input
        halves[r["half"], r["at"]] = r[2:]
    other = [_solve(halves[1]), _solve(halves[0])]

    def start():
        def unseen(stats, half):
            z, k = to(_matrix(stats)), half.to_numpy(zero_copy_only=False)
            raw = np.where(k == 0, z @ other[0], z @ other[1])
            return [np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(int).tolist(), raw.tolist()]

        return unseen

    binned = (
        append_columns(rows.select("stats", "label", "half"), ["stats", "half"], "bin int, raw double", start)
        .groupBy("bin")
        .agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.avg("label").alias("rate"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    raw, rate = isotonic(*np.array([(r["raw"], r["n"], r["rate"]) for r in binned], float).T)
    return Model(to, _solve(halves.sum(0)), raw, rate)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 3,
    held_out: int = 1,
) -> Model:
    """Fits on every labelled document whose crc32(id) mod ``folds`` is not ``held_out``."""
    crc = crc_of_id(F.col("doc_id"))
    known = one_label(labels, label, doc_id).where(crc % folds != held_out)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = (
        with_statistics(narrow.where(crc % folds != held_out))
        .select("doc_id", "stats")
        .join(known, "doc_id")
        .select("stats", "label", (F.floor(crc / folds) % 2).cast("int").alias("half"))
    )
    return fit(saved(rows))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 from 0.5 on)."""

    def start():
        def compute(texts):
            texts = texts.to_pylist()
            if not texts:
                return [[], []]
            scores = model.score(np.array([statistics(x) for x in texts], float))
            return [scores.tolist(), (scores >= 0.5).astype(int).tolist()]

        return compute

    return append_columns(docs, [text], "score double, predicted int", start)
