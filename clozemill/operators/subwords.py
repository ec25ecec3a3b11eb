"""A unigram piece model: trained on a table of words, and used to cut texts into subword ids.

A word is a sequence of pieces that are drawn independently; expectation
maximisation fits their probabilities. Executors run forward-backward once per
different word, whatever its count, and send back expected counts per piece. The
table of pieces is bounded by its size parameter and is all that the driver holds.
Pieces whose removal costs the least likelihood are dropped until the size is
reached; single characters stay, so that every known character can be spelled.

A word starts with a mark, and longer words than ``LONGEST_WORD`` are cut there,
in training and in use. Ids follow the order of the pieces from 1 on; 0 stands for
a character that training has not met.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.functions.text import normalize_text

MARK = "▁"
LONGEST_PIECE, LONGEST_WORD = 8, 64
SIZE = 8000
# Candidates at first, as a multiple of the size; the share that a pruning keeps at least.
SEEDS, KEEP = 4, 0.75
# Rounds of expectation maximisation before each pruning.
ROUNDS = 2
# Entries of a task's sums, and of a worker's known words; a full table is passed on or starts anew.
TABLE = 200_000
_NEVER = -1e30


@dataclass
class Pieces:
    """Pieces and their log probabilities, and the best way to cut a word into them."""

    scores: dict[str, float]
    longest: int = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - 10.0

    def options(self, word: str, start: int) -> Iterator[tuple[int, float]]:
        """(end, score) of the pieces that begin at ``start``; an unknown character is one, too."""
        for end in range(start + 1, min(len(word), start + self.longest) + 1):
            score = self.scores.get(word[start:end])
            if score is not None:
                yield end, score
            elif end == start + 1:
                yield end, self.unknown

    def segment(self, word: str, without: str | None = None) -> tuple[list[str], float]:
        """The likeliest pieces of a word and their score; of equal ones the one with the longer last pieces."""
        best, back = [0.0] + [_NEVER] * len(word), [0] * (len(word) + 1)
        for start in range(len(word)):
            for end, score in self.options(word, start):
                if best[start] + score > best[end] and word[start:end] != without:
                    best[end], back[end] = best[start] + score, start
        parts, end = [], len(word)
        while end:
            parts.append(word[back[end] : end])
            end = back[end]
        return parts[::-1], best[-1]

    def expected(self, word: str) -> tuple[dict[str, float], float]:
        """Expected counts of the pieces over all ways to cut a word, and the word's log likelihood."""
        n = len(word)
        steps = [list(self.options(word, i)) for i in range(n)]
        ahead, behind = [0.0] + [_NEVER] * n, [_NEVER] * n + [0.0]
        for i in range(n):
            for end, score in steps[i]:
                ahead[end] = _log_add(ahead[end], ahead[i] + score)
        for i in range(n - 1, -1, -1):
            for end, score in steps[i]:
                behind[i] = _log_add(behind[i], score + behind[end])
        counts: dict[str, float] = {}
        for i in range(n):
            for end, score in steps[i]:
                piece = word[i:end]
                if piece in self.scores:
                    share = math.exp(ahead[i] + score + behind[end] - ahead[n])
                    counts[piece] = counts.get(piece, 0.0) + share
        return counts, ahead[n]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b <= _NEVER else a + math.log1p(math.exp(b - a))


def words_in(text: str | None) -> list[str]:
    """Marked words, long ones cut."""
    marked = (MARK + w for w in (text or "").split())
    return [w[i : i + LONGEST_WORD] for w in marked for i in range(0, len(w), LONGEST_WORD)]


def word_counts(texts: DataFrame, *columns: str) -> DataFrame:
    """(word, n): how often each marked word occurs in the columns of all rows."""
    each = F.explode(F.array(*[normalize_text(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    words = texts.select(each.alias("text")).select(F.explode(F.split("text", " ")).alias("word"))
    parts = F.expr(f"transform(sequence(0, (length(word) div {LONGEST_WORD})), i -> substring(word, i * {LONGEST_WORD} + 1, {LONGEST_WORD}))")
    marked = words.where("word <> ''").select(F.concat(F.lit(MARK), "word").alias("word"))
    return (
        marked.select(F.explode(parts).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _summed(words: DataFrame, start: Callable[[], Callable[[str], Iterator[tuple[str, float]]]]) -> DataFrame:
    """(piece, n): what ``start()`` gives per word, times the word's count, summed before the shuffle."""

    def run(batches):
        of = start()
        sums: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["piece", "n"]
            )

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, value in of(word):
                    sums[piece] += value * n
                if len(sums) >= TABLE:
                    yield flush()
                    sums.clear()
        yield flush()

    return words.select("word", "n").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n"))


def substrings(word: str) -> Iterator[tuple[str, float]]:
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + LONGEST_PIECE) + 1):
            yield word[i:j], 1.0


def seeds(words: DataFrame, size: int) -> dict[str, float]:
    """All single characters, and the substrings that cover most of the texts."""
    counted = _summed(words, lambda: substrings)
    single = counted.where(F.length("piece") == 1).collect()
    longer = counted.where(F.length("piece") > 1).where("n > 1")
    many = longer.orderBy((F.col("n") * F.length("piece")).desc(), "piece").limit(size).collect()
    return {r["piece"]: r["n"] for r in [*single, *many]}


def _log_shares(counts: dict[str, float]) -> dict[str, float]:
    total = math.fsum(counts.values())
    return {p: math.log(n / total) for p, n in counts.items()}




_LIKELIHOOD = ""


def round_of(words: DataFrame, model: Pieces) -> tuple[Pieces, dict[str, float], float]:
    """One round of expectation maximisation: the new pieces, their expected counts, and the old log likelihood."""

    def start():
        def of(word: str) -> Iterator[tuple[str, float]]:
            counts, likelihood = model.expected(word)
            yield from counts.items()
            yield _LIKELIHOOD, likelihood  # no piece is empty

        return of

    counts = {r["piece"]: r["n"] for r in _summed(words, start).collect()}
    likelihood = counts.pop(_LIKELIHOOD, 0.0)
    # Single characters stay, however rarely longer pieces leave them to be used.
    kept = {p: max(counts.get(p, 0.0), 1e-6 if len(p) == 1 else 0.0) for p in model.scores}
    kept = {p: n for p, n in kept.items() if n > 1e-9}
    return Pieces(_log_shares(kept)), kept, likelihood


def pruned(model: Pieces, counts: dict[str, float], size: int) -> Pieces:
    """The ``size`` pieces whose loss would cost the most: count times the fall of the score of their own letters."""
    cost = {}
    for piece, n in counts.items():
        if len(piece) > 1:
            cost[piece] = n * (model.scores[piece] - model.segment(piece, without=piece)[1])
    single = [p for p in counts if len(p) == 1]
    room = max(size - len(single), 0)
    kept = sorted(cost, key=lambda p: (-cost[p], p))[:room]
    return Pieces(_log_shares({p: counts[p] for p in [*single, *kept]}))


def train(words: DataFrame, size: int = SIZE, report: list | None = None) -> Pieces:
    """Pieces fitted to a table (word, n), at most ``size`` of them unless there are more characters.

    ``report`` takes the number of pieces and the log likelihood of each round.
    """
    if size < 1:
        raise ValueError("A model has at least one piece")
    model = Pieces(_log_shares(seeds(words, SEEDS * size)))
    while True:
        for _ in range(ROUNDS):
            number = len(model.scores)
            model, counts, likelihood = round_of(words, model)
            if report is not None:
                report.append((number, likelihood))
        if len(model.scores) <= size or all(len(p) == 1 for p in model.scores):
            return model
        model = pruned(model, counts, max(size, int(len(model.scores) * KEEP)))


def ids_of(model: Pieces) -> dict[str, int]:
    """Piece to id: by falling score, then by text."""
    return {p: i for i, p in enumerate(sorted(model.scores, key=lambda p: (-model.scores[p], p)), 1)}


def tokenizer(model: Pieces) -> Callable[[Column], Column]:
    """A text column to an array of ids: what truncate_tokens takes as its tokenizer."""
    number = ids_of(model)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[int]] = {}

        def of(text: str | None) -> list[int]:
            out: list[int] = []
            for word in words_in(text):
                found = known.get(word)
                if found is None:
                    if len(known) >= TABLE:
                        known.clear()
                    found = known[word] = [number.get(p, 0) for p in model.segment(word)[0]]
                out += found
            return out

        for texts in batches:
            yield texts.map(of)

    return lambda c: ids(normalize_text(F.coalesce(c, F.lit(""))))
