"""URL filters: rules indexed by their rarest literal token.

A rule has a verdict, a host (it fits subdomains too) and a path prefix, or a
regular expression with literal tokens. Every rule becomes one regular
expression over host and path. Tokens are runs of letters and digits; how many
URLs hold each token of a rule is counted over all URLs, and the rule is indexed
by the rarest one alone. The tokens of a URL fetch the rules under them by an
equi-join, and only those rules are tried. Among rules that fit, the higher rank
decides, then the longer rule; without any the default verdict holds.

Each URL is judged once, however many rows have it. The index is an ordinary
join side: Spark broadcasts it only when it measures small enough, and splits a
hot token when it does not.

Rows: a null URL, or one without ://, has an empty host and path, and gets the
default verdict. Repeated rows are judged each. An empty table gives an empty
result. Without rules everything gets the default. Other columns of the input
stay; one named like an output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates tokens: all of ASCII but letters and digits.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands before tokens of the path, so that they differ from those of the host.
_IN_PATH = "/"
_OUTPUTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    """``host`` and ``path`` prefix, or a ``pattern`` over host + path.

    ``tokens`` of a pattern are whole tokens of every host and path ("/" before
    the latter) that it fits.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    tokens: tuple[str, ...] = ()
    rank: int = 0

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    def regex(self) -> str:
        if self.pattern:
            return self.pattern
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}(?![^/]){re.escape(self.path)}"

    def literals(self) -> set[str]:
        """Tokens that every URL this rule fits must have; '' if there are none."""
        if self.pattern:
            return set(self.tokens) or {""}
        # The last token of a prefix may go on in the URL.
        in_path = re.split(_GAPS, self.path)[:-1]
        found = set(re.split(_GAPS, self.host)) | {_IN_PATH + x for x in in_path if x}
        return found - {""} or {""}


def parse(text: str, rank: int = 0) -> Rule:
    """A rule from "allow com/" or "block example.com/en/"."""
    verdict, where = text.split(" ", 1)
    host, slash, path = where.partition("/")
    return Rule(verdict, host.lower(), slash + path, rank=rank)


def host_word(verdict: str, word: str, rank: int = 0) -> Rule:
    """A rule for hosts that hold a word between dots and hyphens."""
    return Rule(verdict, pattern=rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-]|/|$)", tokens=(word,), rank=rank)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    """The different tokens of a URL, and '' for rules without any."""
    in_path = F.transform(F.split(path, _GAPS, -1), lambda x: F.concat(F.lit(_IN_PATH), x))
    return F.array_distinct(F.concat(F.split(host, _GAPS, -1), in_path, F.array(F.lit(""))))


def index(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule under its rarest token: (token, rule, verdict, regex, rank, size, place).

    ``urls`` has host and path; tokens are counted over all its rows.
    """
    kinds = "struct<rule: string, verdict: string, regex: string, rank: int, size: int, place: int, literals: array<string>>"
    rows = [
        F.struct(*[F.lit(x) for x in (r.name, r.verdict, r.regex(), r.rank, len(r.name), i)], F.array(*map(F.lit, sorted(r.literals()))))
        for i, r in enumerate(rules)
    ]
    listed = F.array(*rows).cast(f"array<{kinds}>")
    table = urls.sparkSession.range(1).select(F.inline(listed))
    wanted = table.select("place", F.explode("literals").alias("token"))
    counted = (
        urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
        .join(wanted.select("token").distinct(), "token")
        .groupBy("token")
        .count()
    )
    rarest = (
        wanted.join(counted, "token", "left")
        .groupBy("place")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("best"))
        .select("place", F.col("best.token").alias("token"))
    )
    return table.drop("literals").join(rarest, "place")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    urls = pages.select(F.col(url).alias("__url")).distinct()
    parts = urls.select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    fetched = parts.select(
        "__url",
        F.concat("host", "path").alias("target"),
        F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"),
    ).join(index(parts, rules), "token")
    best = (
        fetched.where(F.expr("target rlike regex"))
        .groupBy("__url")
        # Of equally long ones the first listed.
        .agg(F.max(F.struct("rank", "size", (-F.col("place")).alias("early"), "rule", "verdict")).alias("best"))
    )
    kept = [c for c in pages.columns if c.lower() not in _OUTPUTS]
    own = F.col(f"`{url}`")
    # The row as one value, so that no name of a column can clash with another.
    rows = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), own.alias("__own"))
    judged = rows.join(best, F.col("__own") == F.col("__url"), "left").select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        host_of(F.col("__own")).alias("host"),
        path_of(F.col("__own")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
    return judged
