"""Tokenisers of the text scores. Each gives tokens joined by single spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clozemill.fixed_values import WHITESPACE
from clozemill.functions.text import WHITESPACE_CHARS, collapse_whitespace

# The public mteval "13a" rules, in order. The first also lists the
# space, which it only widens; it is left out, as tokens are split at any width.
RULES_13A = (
    (r"([\{-\~\[-\`\!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(c: Column) -> Column:
    """The tokenisation that corpus BLEU is quoted with."""
    line = F.rtrim(c, F.lit(WHITESPACE_CHARS))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        line = F.replace(line, F.lit(old), F.lit(new))
    for old, new in ENTITIES_13A:
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in RULES_13A:
        line = F.regexp_replace(line, pattern, replacement)
    return collapse_whitespace(line)


ROUGE_CLASSES = {"ascii": "[^a-z0-9]+", "unicode": r"[^\p{L}\p{N}]+"}


def rouge_tokens(c: Column, tokenizer: str = "ascii") -> Column:
    """Lower-cased letters and digits.

    ``ascii`` is the usual definition and erases Cyrillic; ``unicode`` keeps the
    letters and digits of every script.
    """
    return F.trim(F.regexp_replace(F.lower(c), ROUGE_CLASSES[tokenizer], " "))


def word_tokens(c: Column) -> Column:
    """Lower-cased words, with every other visible character on its own."""
    pattern = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WHITESPACE[1:]}"
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), " ")


def token_count(tokens: Column) -> Column:
    spaces = F.length(tokens) - F.length(F.replace(tokens, F.lit(" "), F.lit("")))
    return F.when(tokens == "", 0).otherwise(spaces + 1)
