"""Toxicity by multiple-instance learning.

Only documents have labels; sentences are what can be toxic. A sentence's
probability is a logistic function of its words, a document's is the noisy-or
of its sentences: one minus the product of their complements. The weights
maximise the likelihood of the document labels, so they learn which sentences
made a document toxic, and the same scores locate those sentences.

Words count as they are and by their beginnings, so that forms of one stem share
a weight. The vocabulary are the words and beginnings whose presence depends
most on the label among a bounded sample of labelled documents. Counts are
taken by Spark; the fit runs over numbers of the sample.

Rows: a null or empty text has no sentence; its score is that of no evidence.
Null labels and ids teach nothing; several labels of one id count as their
mean; repeated rows count as often as they occur. Without labels of both sorts
every document gets the mean label, or 0. An empty table gives an empty result.
Other columns of the input stay; one named like an output is replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import append_columns, crc_of_id, one_label, saved

#: Labelled documents that the model is fitted on, chosen by a hash of the id.
SAMPLE = 20_000
#: Words and beginnings that have a weight.
VOCABULARY = 2_000
#: A word must occur in so many sampled documents.
LEAST_DOCUMENTS = 4
#: Lengths of the beginnings of words that count as features.
BEGINNINGS = (3, 4, 5, 6, 7)
STEPS, RATE, PENALTY = 400, 0.1, 0.3
#: Entries of a task's table of counts or of known words; a full table starts anew.
TABLE = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a whole text, in code points, blanks around them left out."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        inner = m[0].strip()
        if inner:
            start = m.start() + m[0].index(inner[0])
            out.append((start, start + len(inner)))
    return out


def words(sentence: str) -> set[str]:
    return set(_WORD.findall(sentence.lower()))


def forms(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if k < len(word)]]


@dataclass
class Model:
    """Log-odds of a sentence without known words, the weights of forms, and the base rate."""

    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    rate: float | None = None
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def _word(self, word: str) -> float:
        total = sum(self.weights.get(f, 0.0) for f in forms(word))
        if len(word) <= 64:
            if len(self.known) >= TABLE:
                self.known.clear()
            self.known[word] = total
        return total

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        known, out = self.known, []
        for start, end in sentences(text):
            total = self.bias
            for x in words(text[start:end]):
                w = known.get(x)
                total += self._word(x) if w is None else w
            out.append((start, end, 1 / (1 + math.exp(-max(total, -500.0)))))
        return out

    def document(self, scores: list[tuple[int, int, float]]) -> float:
        if self.rate is not None:
            return self.rate
        clean = sum(math.log1p(-min(s, 1 - 1e-12)) for *_, s in scores)
        return -math.expm1(clean)


#: Ends a sentence among its word numbers, which are below it.
_END = 0xFFFF


def _fit(rows: list[tuple[float, bytes, int]], size: int) -> tuple[float, np.ndarray]:
    """Bias and weights of the noisy-or likelihood.

    rows: (label, 16-bit word numbers of the sentences that have some, each ended by _END, number of sentences without).
    """
    label = np.array([r[0] for r in rows])
    empty = np.array([r[2] for r in rows], float)
    coded = np.frombuffer(b"".join(r[1] for r in rows), np.uint16)
    of = np.repeat(np.arange(len(rows)), [len(r[1]) // 2 for r in rows])
    ends = coded == _END
    at, word, of = (np.cumsum(ends) - ends)[~ends], coded[~ends], of[ends]
    sentences = int(ends.sum())
    weights, bias, n = np.zeros(size), -5.0, len(rows)
    moments = [np.zeros(size + 1), np.zeros(size + 1)]
    for step in range(1, STEPS + 1):
        logit = bias + np.bincount(at, weights[word], sentences)
        # log(1 - q) of a sentence is -softplus(logit)
        soft = np.logaddexp(0, logit)
        q = np.exp(logit - soft)
        soft0 = np.logaddexp(0, bias)
        q0 = np.exp(bias - soft0)
        clean = -np.bincount(of, soft, n) - empty * soft0
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loglik / d clean
        pull = (1 - label) - label * (1 - p) / p
        by_sentence = -pull[of] * q
        gradient = np.append(
            np.bincount(word, by_sentence[at], size) / n - PENALTY / n * weights,
            (by_sentence.sum() - (pull * empty * q0).sum()) / n,
        )
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = RATE * moments[0] / (1 - 0.9**step) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights + move[:-1], bias + move[-1]
    return float(bias), weights


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held_out: int = 0,
    sample: int = SAMPLE,
) -> Model:
    """Fits on at most ``sample`` labelled documents whose crc32(id) mod ``folds`` is not ``held_out``."""
    known = one_label(labels, label, doc_id).where(crc_of_id(F.col("doc_id")) % folds != held_out)
    # At most ``sample`` pairs of numbers, so this side may be broadcast.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")

    def start():
        def compute(texts):
            out = []
            for one in texts.to_pylist():
                sets = [sorted(words(one[a:b])) for a, b in sentences(one)]
                out.append(sets)
            return [out]

        return compute

    rows = saved(
        append_columns(found.select("text", "label"), ["text"], "sentences array<array<string>>", start)
        .select("label", "sentences")
        .withColumn("pick", F.xxhash64("sentences", "label"))
    )
    n, mean = rows.agg(F.count("*"), F.avg("label")).first()
    if not n or mean in (0.0, 1.0):
        return Model(rate=float(mean or 0.0))

    def count(batches):
        documents, bad = Counter(), Counter()

        def flush():
            keys = list(documents)
            columns = [keys, [documents[k] for k in keys], [float(bad[k]) for k in keys]]
            documents.clear()
            bad.clear()
            kinds = [pa.string(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["form", "n", "bad"]
            )

        for batch in batches:
            for label, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                present = {f for w in set().union(*found) for f in forms(w)}
                documents.update(present)
                if label:
                    bad.update(dict.fromkeys(present, label))
                if len(documents) >= TABLE:
                    yield flush()
        yield flush()

    counts = (
        rows.select("label", "sentences")
        .mapInArrow(count, "form string, n bigint, bad double")
        .groupBy("form")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        .where(F.col("n") >= LEAST_DOCUMENTS)
    )
    # How far the form's share of bad documents lies from the mean, in standard errors.
    strange = (F.col("bad") - F.col("n") * mean) ** 2 / (F.col("n") * mean * (1 - mean))
    top = counts.orderBy(strange.desc(), "form").limit(VOCABULARY)
    vocabulary = [r["form"] for r in top.select("form").collect()]
    number = {w: i for i, w in enumerate(vocabulary)}

    def reduce():
        def compute(found):
            out, bare = [], []
            for one in found.to_pylist():
                sets = [[number[f] for w in s for f in forms(w) if f in number] for s in one]
                with_words = [s for s in sets if s]
                out.append(array("H", [w for s in with_words for w in (*s, _END)]).tobytes())
                bare.append(len(sets) - len(with_words))
            return [out, bare]

        return compute

    small = append_columns(
        rows.select("label", "sentences", "pick"), ["sentences"], "numbers binary, bare int", reduce
    )
    taken = small.orderBy("pick").select("label", "numbers", "bare").limit(sample).collect()
    fitted = [(r["label"], r["numbers"], r["bare"]) for r in taken]
    bias, weights = _fit(fitted, len(vocabulary))
    return Model(bias, {w: float(weights[i]) for w, i in number.items()})


def score(docs: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` with score, predicted and offending.

    offending: (start, end, score) of the sentences whose own score reaches
    ``limit``; if a document reaches it only by several, its highest sentence.
    """

    def start():
        def compute(texts):
            scores, offending = [], []
            for one in texts.to_pylist():
                parts = model.sentence_scores(one)
                total = model.document(parts)
                bad = [p for p in parts if p[2] >= limit]
                if not bad and parts and total >= limit:
                    bad = [max(parts, key=lambda p: p[2])]
                scores.append(total)
                offending.append([{"start": a, "end": b, "score": float(s)} for a, b, s in bad])
            return [scores, [int(s >= limit) for s in scores], offending]

        return compute

    outputs = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    return append_columns(docs, [text], outputs, start)
