"""Answer mining over a table of documents.

A document is one row, and everything that decides its answers lies in that
row. So the whole chain stays inside the row: sentences, candidates, the
best candidate per key and the top k are array expressions, no stage shuffles,
and no key can be hot. Sentences are carried once per document and attached to
the few winners only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill import fixed_values as fv
from clozemill.functions import mining
from clozemill.functions.text import collapse_whitespace


def _tagged(texts: Column, tier: int, sent: Column) -> Column:
    return F.transform(
        texts,
        lambda t: F.struct(F.lit(tier).alias("tier"), t.alias("text"), sent.alias("sent")),
    )


def _with_sentences(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn(
        "sentences", mining.split_sentences(collapse_whitespace(F.col(text)))
    )


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: key, sent_idx, sentence."""
    pieces = mining.split_sentences(collapse_whitespace(F.col(text)))
    return docs.select(key, F.posexplode(pieces).alias("sent_idx", "sentence"))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentences`` and ``candidates``.

    Candidates keep the order in which they are met: by sentence, then
    quotations, dates and numbers, abbreviations, names, key phrases of three,
    two and one words, then by position.
    """
    words = F.transform("sentences", mining.key_words)

    def of_sentence(s: Column, i: Column) -> Column:
        w = F.get("key_words", i)
        return F.concat(
            _tagged(mining.quoted(s), 0, i),
            _tagged(mining.dates_and_numbers(s), 1, i),
            _tagged(mining.abbreviations(s), 2, i),
            _tagged(mining.proper_names(s), 3, i),
            *[_tagged(mining.key_phrases(w, n), 7 - n, i) for n in (3, 2, 1)],
        )

    return (
        _with_sentences(docs, text)
        .withColumn("key_words", words)
        .withColumn("candidates", F.flatten(F.transform("sentences", of_sentence)))
        .drop("key_words")
    )


def _first_of_run(sorted_array: str) -> Column:
    """From an array sorted by ``key``, the first element of each key."""
    return F.filter(
        sorted_array,
        lambda x, i: (i == 0) | (F.get(sorted_array, i - 1)["key"] != x["key"]),
    )


def with_ranked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentences`` and ``ranked``, the distinct candidates, best first.

    One candidate is kept per lower-cased text: the first of the highest tier.
    They are ordered by tier, then by the place where their key was first met,
    whichever candidate met it.
    """
    placed = with_candidates(docs, text).withColumn(
        "candidates",
        F.transform(
            "candidates",
            lambda c, i: F.struct(
                F.lower(c["text"]).alias("key"), c["tier"], i.alias("place"), c["text"], c["sent"]
            ),
        ),
    )
    # Both arrays end up with one element per key, in key order, so they pair up
    # by position. They are zipped before use: a lambda that reaches for another
    # column may get that column's whole expression inlined, once per element.
    best = placed.select(
        "*",
        F.sort_array("candidates").alias("by_tier"),
        F.sort_array(
            F.transform("candidates", lambda c: F.struct(c["key"], c["place"]))
        ).alias("by_place"),
    ).select(
        *[c for c in placed.columns if c != "candidates"],
        F.arrays_zip(
            _first_of_run("by_tier").alias("best"), _first_of_run("by_place").alias("first")
        ).alias("pairs"),
    )
    ranked = F.sort_array(
        F.transform(
            "pairs",
            lambda p: F.struct(
                p["best"]["tier"], p["first"]["place"], p["best"]["text"], p["best"]["sent"]
            ),
        )
    )
    return best.withColumn("ranked", ranked).drop("pairs")


def top_answers(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_answers: int | None = fv.DEFAULT_MAX_ANSWERS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Ranked answers: key, rank, answer_text, answer_kind, answer_score, source_sentence.

    ``keep`` names document columns to repeat on every answer.
    """
    kinds = F.array(*[F.lit(kind) for kind, _ in fv.TIERS])
    scores = F.array(*[F.lit(score) for _, score in fv.TIERS])
    wanted_columns = [key, text, *[c for c in keep if c != text]]
    mined = with_ranked(docs.select(*wanted_columns), text)
    # The generator reads an expression, not a bare column: from a bare column
    # Catalyst infers "size > 0" and pushes it, with the whole chain copied
    # into it, below every projection.
    wanted = F.size("ranked") if max_answers is None else F.lit(max_answers)
    return mined.select(
        key,
        *keep,
        "sentences",
        F.posexplode(F.slice("ranked", F.lit(1), wanted)).alias("pos", "answer"),
    ).select(
        key,
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("answer.text").alias("answer_text"),
        F.get(kinds, F.col("answer.tier")).alias("answer_kind"),
        F.get(scores, F.col("answer.tier")).alias("answer_score"),
        F.get("sentences", F.col("answer.sent")).alias("source_sentence"),
    )


def documents_without_answers(
    docs: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The keys of documents in which no candidate was found.

    The search ends with the first candidate; key words, which most sentences
    have, are looked for first. A phrase is a candidate only if its words are.
    """

    def has_candidate(s: Column) -> Column:
        found = F.exists(mining.key_phrases(mining.key_words(s), 1), lambda p: F.lit(True))
        for find in (mining.quoted, mining.dates_and_numbers, mining.abbreviations, mining.proper_names):
            found = found | (F.size(find(s)) > 0)
        return found

    mined = _with_sentences(docs.select(key, text), text)
    # Exploding a one-element array keeps the row without a filter, which
    # Catalyst would push below the projections together with a copy of them.
    kept = F.when(~F.exists("sentences", has_candidate), F.array(F.lit(1)))
    return mined.select(key, F.explode(kept).alias("kept")).drop("kept")


def extracted(
    docs: DataFrame, extractor: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """What one extractor finds: key, sent_idx, match_idx, answer_text.

    ``extractor`` is quoted, dates_and_numbers, abbreviations, proper_names or
    key_phrases.
    """
    if extractor == "key_phrases":

        def find(s: Column) -> Column:
            # transform over a one-element array computes the words once
            words = F.array(mining.key_words(s))
            return F.flatten(
                F.transform(
                    words, lambda w: F.concat(*[mining.key_phrases(w, n) for n in (3, 2, 1)])
                )
            )
    else:
        find = getattr(mining, extractor)
    found = sentences(docs, key, text).select(key, "sent_idx", find(F.col("sentence")).alias("f"))
    return found.select(
        key, "sent_idx", F.posexplode(F.slice("f", 1, F.size("f"))).alias("match_idx", "answer_text")
    )


def distinct_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidates after deduplication, with their place in the ranking."""
    return top_answers(docs, key, text, max_answers=None)
