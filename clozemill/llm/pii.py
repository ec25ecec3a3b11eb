"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed patterns with their checks give the base spans. Wider generators propose
further, overlapping candidates. What the fixed patterns match teaches boosted
trees: a match that passes its check is a positive, one that fails is not.
Candidates of the generators beside those matches get weak labels from format
and context (_weak_label), so that e-mails and phones have negatives, too.
Features are the format (lengths, digit groups, checks) and the context (nearby
words and characters), never the pattern itself. A threshold per kind is the
lowest score from which held-back examples are right often enough; candidates
above it are added if they touch no base span, or go beyond those of their own
kind that they touch. Without enough examples of both sorts of a kind nothing
of that kind is added.

All work on texts stays in the row: no shuffle, no Python. Patterns use
possessive repeats and start only where a run starts (or the last match ended),
so they take time in proportion to the text.

Rows: a null or empty text has no spans; its digest is that of the empty text.
Repeated rows are judged each. An empty table gives an empty result, and trees
are then not fitted. Other columns of the input stay; one named like an output
is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import saved

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
#: The fixed patterns. (?:\G|(?<!…)) only skips starts inside a run that was tried already.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Generators of further candidates: (kind, one of these a text must hold, else two digits, pattern).
WIDE = (
    ("email", ("@",), r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++"),
    (
        "email",
        ("@",),
        rf"(?:\G|(?<![\p{{L}}\p{{N}}._%+-]))[\p{{L}}\p{{N}}._%+-]++@{_LABEL}(?:\.{_LABEL})++",
    ),
    (
        "email",
        ("(at)", "[at]"),
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?[(\[]at[)\]] ?{_LABEL}(?:\.{_LABEL}| ?[(\[]dot[)\]] ?{_LABEL})++",
    ),
    ("ip", (), r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?: ?\. ?[0-9]{1,3}+){3}(?![0-9A-Za-z.])"),
    ("card", (), r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){13,18}+(?![0-9A-Za-z])"),
    ("phone", (), r"(?<![0-9A-Za-z+])[(]?[0-9](?:[ ()./-]{0,2}[0-9]){9,14}+(?![0-9A-Za-z])"),
)
_HINTS = {
    "email": "mail|contact|write|reply|courriel|correo",
    "ip": r"\bip\b|host|server|address|login|adresse|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta|debit",
    "phone": "phone|tel|call|mobile|fax|cell|anruf|appel|llama",
}
#: An address by its form: labels between single dots, and a last label of letters.
_WORD = r"[\p{L}\p{N}_%+-]++"
_DOT = r"(?:\.| ?[(\[]dot[)\]] ?)"
_ADDRESS = rf"^{_WORD}(?:\.{_WORD})*+(?:@| ?[(\[]at[)\]] ?)(?:{_LABEL}{_DOT})++[A-Za-z]{{2,24}}$"
#: What comes before numbers and names in code, decimals and versions.
_CODE = r"[=/\\#$&?]$|[0-9][.,]$|\b(?:version|v|id|isbn|doi)[.: ]*$"
#: Code points before a candidate that count as its context.
CONTEXT = 32
#: Examples that trees are fitted on: about so many, chosen by a hash.
TRAIN_ROWS = 20_000
#: Part of the held-back examples at or above a threshold that must be right, counted
#: together with so many imagined ones of which that part is right.
PRECISION = 0.98
PRIOR, PRIOR_RIGHT = 2.0, 0.9
TREES, DEPTH, SHRINKAGE, PENALTY, LEAST_LEAF = 20, 3, 0.5, 1.0, 5

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_OCTETS = rf"^(?:{_OCTET}|0+)(?: ?\. ?(?:{_OCTET}|0+)){{3}}$"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total, pair):
        doubled = pair["d"] * (1 + pair["i"] % 2)
        return total + doubled - F.when(doubled > 9, 9).otherwise(0)

    backwards = F.transform(
        F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.try_cast("int").alias("d"), i.alias("i"))
    )
    known = F.filter(backwards, lambda p: p["d"].isNotNull())
    return F.aggregate(known, F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The check of a fixed pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(_OCTETS)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(10, 15)


def _spans(text: Column, matches: Column, pattern: str) -> Column:
    """Places of all matches: lengths of what lies between them, added up."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), matches.alias("value")
    )

    def add(state, part):
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["value"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(part["value"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span))).alias("out"),
        )

    empty = F.array().cast(_SPAN)
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(parts, begin, add, lambda s: s["out"])).otherwise(empty)


def _located(docs: DataFrame, text: str, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds an array of spans per pattern; each pattern is run once, or twice where it matches."""
    nothing = F.array().cast("array<string>")
    found = docs.select(
        "*",
        *[
            F.when(guard, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(nothing).alias(f"__m_{n}")
            for n, (guard, p) in patterns.items()
        ],
    )
    return found.select(
        *docs.columns,
        *[_spans(F.col(text), F.col(f"__m_{n}"), p).alias(n) for n, (_, p) in patterns.items()],
    )


def _guards() -> dict[str, Column]:
    return {
        "email": F.col("__text").contains("@"),
        "ip": F.col("__numeric"),
        "card": F.col("__numeric"),
        "phone": F.col("__numeric") & F.col("__text").contains("+"),
    }


def _wide_guard(must: tuple[str, ...]) -> Column:
    guard = F.lit(False) if must else F.col("__numeric")
    for x in must:
        guard = guard | F.col("__text").contains(x)
    return guard


def _with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds __text, __numeric and the matches of the fixed patterns, __base_<kind>."""
    ready = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    ready = ready.withColumn("__numeric", F.col("__text").rlike("[0-9][^A-Za-z]*[0-9]"))
    guards = _guards()
    return _located(ready, "__text", {f"__base_{k}": (guards[k], BASE[k]) for k in KINDS})


FEATURES = (
    *(f"is_{k}" for k in KINDS), "chars", "digits", "letters", "others", "groups", "longest_group",
    "dots", "blanks", "luhn", "octets", "digits_10_15", "at_start", "after_blank", "before_blank", "hint",
    "last_letters", "pluses", "code",
)


def _before(start: Column) -> Column:
    return F.lower(F.substring(F.col("__text"), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))))


def _weak_label(kind: str, span: Column) -> Column:
    """Whether a candidate of a generator looks right; null where that is not known."""
    before, value = _before(span["start"]), span["value"]
    fits = _plausible(kind, value) & ~before.rlike(_CODE)
    if kind == "email":
        return fits
    if kind == "phone":
        return fits & before.rlike(_HINTS[kind])
    return F.when(~(fits & (value.rlike(_OCTETS) if kind == "ip" else _luhn(_digits(value)))), F.lit(False))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _features(kind: str, span: Column) -> Column:
    """Format and context numbers of a candidate, in the order of FEATURES."""
    value, start, end = span["value"], span["start"], span["end"]
    digits = _digits(value)
    n_digits = F.length(digits)
    n_letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    groups = F.filter(F.split(value, "[^0-9]+", -1), lambda g: g != "")
    before = _before(start)
    after = F.substring(F.col("__text"), end + 1, F.lit(1))
    numbers = [
        *[F.lit(float(k == kind)) for k in KINDS],
        F.least(F.length(value), F.lit(99)),
        F.least(n_digits, F.lit(99)),
        F.least(n_letters, F.lit(99)),
        F.least(F.length(value) - n_digits - n_letters, F.lit(99)),
        F.least(F.size(groups), F.lit(99)),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        F.least(F.length(F.regexp_replace(value, "[^.]", "")), F.lit(99)),
        F.least(F.length(F.regexp_replace(value, "[^ ]", "")), F.lit(99)),
        F.when(n_digits.between(12, 24), _luhn(digits)).otherwise(False),
        value.rlike(_OCTETS),
        n_digits.between(10, 15),
        start == 0,
        before.rlike(r"\s$"),
        (after == "") | after.rlike(r"[\s,;.]"),
        before.rlike(_HINTS[kind]),
        F.least(F.length(F.regexp_extract(value, "[A-Za-z]*+$", 0)), F.lit(99)),
        F.least(F.length(F.regexp_replace(value, "[^+]", "")), F.lit(99)),
        before.rlike(_CODE),
    ]
    return F.array(*[n.cast("double") for n in numbers])


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, features, label, pick): every match of a fixed pattern, and whether it passes its check;
    every candidate of a generator. One that touches a passing match is right if it has its bounds; one
    that touches no match has its weak label.
    """
    found = _with_base(docs.select(F.col(text).alias(text)), text)
    found = _located(found, "__text", {f"__wide_{i}": (_wide_guard(must), p) for i, (_, must, p) in enumerate(WIDE)})

    def labelled(kind: str, spans: Column, label) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                _features(kind, s).alias("features"),
                label(s).cast("double").alias("label"),
                F.xxhash64(s["value"], s["start"], F.length("__text")).alias("pick"),
            ),
        )

    def base(kind: str) -> Column:
        return labelled(kind, F.col(f"__base_{kind}"), lambda s: _passes(kind, s["value"]))

    def beside(kind: str) -> Column:
        spans = F.array_distinct(F.concat(*[F.col(f"__wide_{i}") for i, w in enumerate(WIDE) if w[0] == kind]))
        base = F.col(f"__base_{kind}")

        def label(s: Column) -> Column:
            touched = F.filter(base, lambda b: _overlaps(s, b))
            right = F.filter(touched, lambda b: _passes(kind, b["value"]))
            same = F.exists(right, lambda b: (s["start"] == b["start"]) & (s["end"] == b["end"]))
            return (
                F.when(F.size(touched) == 0, _weak_label(kind, s))
                .when(F.size(right) > 0, same)
                .otherwise(F.lit(None).cast("boolean"))
            )

        return labelled(kind, spans, label)

    rows = F.concat(*map(base, KINDS), *map(beside, KINDS))
    return found.select(F.explode(rows).alias("e")).select("e.*").where(F.col("label").isNotNull())


@dataclass
class Model:
    """Trees as nested (feature, limit, left, right) or numbers; thresholds by kind."""

    trees: list = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, features: Column) -> Column:
        """Of each tree the leaf that the features lead to, added up; trees are one array of constants.

        Nodes of a tree stand level by level, so node i leads to 2 i + 1 or 2 i + 2.
        """
        start, *trees = self.trees or [0.0]
        if not trees:
            return 1 / (1 + F.exp(F.lit(-start)))

        def flat(node, depth: int) -> list[list]:
            """Per level the (feature, limit) of its nodes, then the leaves; a leaf above goes left for good."""
            if not depth:
                return [[node]]
            at, limit, left, right = node if isinstance(node, tuple) else (0, float("inf"), node, node)
            below = [x + y for x, y in zip(flat(left, depth - 1), flat(right, depth - 1), strict=True)]
            return [[(at, limit)], *below]

        def constant(tree) -> Column:
            *levels, leaves = flat(tree, DEPTH)
            nodes = [n for level in levels for n in level]
            return F.struct(
                F.array(*[F.lit(at) for at, _ in nodes]).alias("at"),
                F.array(*[F.lit(limit) for _, limit in nodes]).alias("limit"),
                F.array(*[F.lit(leaf) for leaf in leaves]).alias("leaf"),
            )

        def walk(tree: Column) -> Column:
            node: Column = F.lit(0)
            for _ in range(DEPTH):
                left = F.get(features, F.get(tree["at"], node)) <= F.get(tree["limit"], node)
                node = 2 * node + F.when(left, 1).otherwise(2)
            return F.get(tree["leaf"], node - (2**DEPTH - 1))

        total = F.aggregate(F.array(*map(constant, trees)), F.lit(start), lambda sum, tree: sum + walk(tree))
        return 1 / (1 + F.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list:
    """Trees whose sum is the log-odds of y: each follows the gradient that the others leave."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out: list = [float(np.log(rate / (1 - rate)))]
    total = np.full(len(y), out[0])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        step = np.zeros(len(y))
        out.append(_grow(x, gradient, weight, np.arange(len(y)), depth, step))
        total += step
    return out


def _grow(x, gradient, weight, rows, depth, step):
    """A tree over ``rows``: (feature, limit, left, right) or a number, which ``step`` takes, too."""

    def gain(g, w):
        return g * g / (w + PENALTY)

    g, w = gradient[rows], weight[rows]
    best = (1e-6, None)
    for at in range(x.shape[1]) if depth and len(rows) >= 2 * LEAST_LEAF else ():
        order = np.argsort(x[rows, at], kind="stable")
        value = x[rows, at][order]
        left_g, left_w = np.cumsum(g[order])[:-1], np.cumsum(w[order])[:-1]
        gains = gain(left_g, left_w) + gain(g.sum() - left_g, w.sum() - left_w) - gain(g.sum(), w.sum())
        places = np.arange(1, len(rows))
        gains[(value[1:] <= value[:-1]) | (places < LEAST_LEAF) | (len(rows) - places < LEAST_LEAF)] = -1
        if len(gains) and gains.max() > best[0]:
            k = int(gains.argmax())
            best = (gains[k], (at, float((value[k] + value[k + 1]) / 2)))
    if best[1] is None:
        leaf = float(SHRINKAGE * g.sum() / (w.sum() + PENALTY))
        step[rows] = leaf
        return leaf
    at, limit = best[1]
    low = x[rows, at] <= limit
    parts = [_grow(x, gradient, weight, rows[side], depth - 1, step) for side in (low, ~low)]
    return at, limit, *parts


def train(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Boosted trees and thresholds from the matches of the fixed patterns and the generators.

    Trees are fitted on about ``train_rows`` examples, thresholds on all that are held back.
    """
    rows = saved(examples(docs, text))
    held = F.pmod(F.col("pick"), F.lit(4)) == 0
    seen = {r["label"]: r["n"] for r in rows.where(~held).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return Model()
    part = math.ceil(1e6 * min(1.0, train_rows / sum(seen.values())))
    sample = rows.where(~held & (F.pmod(F.shiftright("pick", 8), F.lit(1_000_000)) < part))
    # About ``train_rows`` rows of numbers; sorted, so that their order of arrival does not matter.
    taken = sorted(([*r["features"], r["label"]] for r in sample.select("features", "label").collect()))
    if len({r[-1] for r in taken}) < 2:
        return Model()
    numbers = np.array(taken)
    model = Model(boost(numbers[:, :-1], numbers[:, -1]))
    steps = (
        rows.where(held)
        .groupBy("kind", F.round(model.score(F.col("features")), 3).alias("score"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("right"))
        .orderBy("kind", F.desc("score"))
        .collect()  # at most 1001 rows per kind
    )
    for kind in KINDS:
        own = [r for r in steps if r["kind"] == kind]
        n = right = 0
        for r in own:
            n, right = n + r["n"], right + r["right"]
            if right + PRIOR * PRIOR_RIGHT >= PRECISION * (n + PRIOR):
                model.thresholds[kind] = max(r["score"], 0.5)  # and more likely right than not
    return model


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and found.

    Counts and digest are of the base spans. spans: kind:start:end of all spans
    by start and kind, in code points, comma-joined. found: the same as an array
    (start, rank of the kind, kind, end, score), score null for base spans.
    """
    outputs = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"]
    kept = [c for c in docs.columns if c.lower() not in outputs or c == text]
    ready = _with_base(docs.select(*kept), text)
    wide = {
        f"__wide_{i}": (_wide_guard(must), p)
        for i, (k, must, p) in enumerate(WIDE)
        if k in model.thresholds
    }
    ready = _located(ready, "__text", wide) if wide else ready

    def as_span(kind, s, score):
        return F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("rank"),
            F.lit(kind).alias("kind"),
            s["end"].alias("end"),
            score.cast("double").alias("score"),
        )

    def valid(kind: str) -> Column:
        right = F.filter(F.col(f"__base_{kind}"), lambda s: _passes(kind, s["value"]))
        return F.transform(right, lambda s: as_span(kind, s, F.lit(None)))

    def accepted(name: str) -> Column:
        kind = WIDE[int(name.removeprefix("__wide_"))][0]
        fits = F.filter(F.col(name), lambda s: _plausible(kind, s["value"]))
        # Features first, as values of their own: the trees name them many times.
        known = F.transform(fits, lambda s: F.struct(s.alias("s"), _features(kind, s).alias("f")))
        scored = F.transform(known, lambda x: as_span(kind, x["s"], model.score(x["f"])))
        return F.filter(scored, lambda s: F.round(s["score"], 3) >= model.thresholds[kind])

    ready = ready.withColumn("__base", F.array_sort(F.concat(*map(valid, KINDS))))
    added = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    for name in wide:
        added = F.concat(added, accepted(name))
    ready = ready.withColumn("__added", F.array_sort(F.array_distinct(added)))

    def within(b, a):
        """b is a smaller part of a, of the same kind."""
        inside = (a["start"] <= b["start"]) & (b["end"] <= a["end"])
        return (a["rank"] == b["rank"]) & inside & ((a["end"] - a["start"]) > (b["end"] - b["start"]))

    free = F.filter("__added", lambda a: ~F.exists("__base", lambda b: _overlaps(a, b) & ~within(b, a)))
    ready = ready.withColumn("__free", free)
    # Of added spans that overlap, the best stays, then the first.
    best = F.filter(
        "__free",
        lambda a: ~F.exists(
            "__free",
            lambda b: _overlaps(a, b)
            & ((b["score"] > a["score"]) | ((b["score"] == a["score"]) & (F.struct(b["start"], b["rank"], b["end"]) < F.struct(a["start"], a["rank"], a["end"])))),
        ),
    )
    ready = ready.withColumn("found", F.array_sort(F.concat("__base", best)))

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count_of(kind: str) -> Column:
        return F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("bigint")

    return ready.select(
        *kept,
        *[count_of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        "found",
    )


def _plausible(kind: str, value: Column) -> Column:
    """What a candidate of a wide generator must have before it is scored."""
    if kind == "phone":
        return value.rlike(r"[ ()./-]") & F.length(_digits(value)).between(10, 15)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19)
    if kind == "email":
        return value.rlike(_ADDRESS)
    return F.lit(True)


def redact(docs: DataFrame, model: Model, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind, like [EMAIL]; null texts stay null.

    ``length`` names a column that holds the number of code points, if there is one.
    """
    found = find(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__whole")), model, "__whole")

    def add(state, span):
        gap = F.substring(F.col("__whole"), state["at"] + 1, span["start"] - state["at"])
        mark = F.concat(gap, F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(span["start"] >= state["at"], F.concat(state["out"], F.array(mark))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def rest(state):
        tail = F.substring(F.col("__whole"), state["at"] + 1, F.length("__whole"))
        return F.array_join(F.concat(state["out"], F.array(tail)), "")

    new = F.when(F.size("found") > 0, F.aggregate("found", begin, add, rest)).otherwise(F.col("__whole"))
    marked = found.select("__row", new.alias("__new"))
    return marked.select(
        *[
            F.col("__new").alias(c)
            if c == text
            else F.length("__new").cast(docs.schema[c].dataType).alias(c)
            if c == length
            else F.col(f"__row.`{c}`")
            for c in docs.columns
        ]
    )
