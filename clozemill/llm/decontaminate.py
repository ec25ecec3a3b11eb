"""Benchmark decontamination with Aho-Corasick automata.

Test items are cut into windows of 13 words (a shorter item is one window). An
automaton holds the windows of a block of items; each document is normalised to
its words with single blanks between them, scanned once, and every match is
mapped back to word numbers and to places in the original text. Blocks are
bounded by their length in characters, so the automaton, which each task builds
from a broadcast, has a bounded size; a benchmark of several blocks is scanned
block by block, all documents each time, and hits add up in the document row.

Rows: a null or empty text has no words, no hits, and is not contaminated; so
has a null or empty item no window. Repeated items and windows name every item
they come from; the windows of an item without an id count as hits, but name no
item. Repeated documents are judged each.
Empty tables on either side give empty or hit-free results. Other columns of
the input stay; one named like an output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import append_columns, saved

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Characters of items in one automaton.
BLOCK_CHARS = 4_000_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def windows_of(text: str | None, window: int = WINDOW) -> set[str]:
    words = words_of(text)
    if not words:
        return set()
    return {" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Lists of (item_id, text) of at most ``limit`` characters, or one item."""
    block, size = [], 0
    items = benchmark.select(F.col(item_id).cast("string"), F.col(text)).dropna(subset=[text])
    for item, words in items.toLocalIterator():
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def build(items: list[tuple[str | None, str]], window: int = WINDOW):
    """The automaton over " w1 … wn ", with the window's word count and its items."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for key in windows_of(text, window):
            own = owners.setdefault(key, set())
            if item is not None:
                own.add(item)
    automaton = ahocorasick.Automaton()
    for key, whose in owners.items():
        automaton.add_word(f" {key} ", (key.count(" ") + 1, sorted(whose)))
    automaton.make_automaton()
    return automaton


def scan(words: list[str], automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word ranges (first, last) of all matches, and the items that match."""
    found, items = [], set()
    if words and len(automaton):
        ends, at = {}, 0
        for i, w in enumerate(words):
            at += len(w) + 1
            ends[at] = i
        for end, (n, whose) in automaton.iter(f" {' '.join(words)} "):
            last = ends[end]
            found.append((last - n + 1, last))
            items.update(whose)
    return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def places(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as (start, end) in the original text, in code points, end exclusive."""
    spans = [m.span() for m in _WORD.finditer((text or "").translate(_LOWER))] if hits else []
    return [(spans[a][0], spans[b][1]) for a, b in hits]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, hit_places and contaminated.

    items: sorted ids of the items with occurring windows. hit_places: what to
    cut from the original text, in code points.
    """
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    block, state, known = next(blocks, []), docs, False
    while True:
        following = next(blocks, None)
        state = _pass(state, text, context.broadcast(block), window, known, following is None)
        if following is None:
            return state
        block, state, known = following, saved(state), True


def _pass(docs, text, block, window, known, last):
    """Scans all documents for one block; the last pass gives the final columns."""
    needs = [text, *(["__hits", "__items"] if known else [])]

    def start():
        automaton = build(block.value, window)

        def compute(texts, *before):
            texts = texts.to_pylist()
            earlier = zip(*(b.to_pylist() for b in before), strict=True) if before else (([], []) for _ in texts)
            rows = []
            for one, (hits, items) in zip(texts, earlier, strict=True):
                words = words_of(one)
                new, more = scan(words, automaton)
                hits = merged([(h["first"], h["last"]) for h in hits] + new)
                rows.append((one, len(words), hits, sorted(more | set(items))))
            if not last:
                return [[[{"first": a, "last": b} for a, b in h] for _, _, h, _ in rows], [i for *_, i in rows]]
            n_hit = [sum(b - a + 1 for a, b in h) for _, _, h, _ in rows]
            return [
                [n for _, n, _, _ in rows],
                n_hit,
                [len(i) for *_, i in rows],
                [i for *_, i in rows],
                [[{"start": a, "end": b} for a, b in places(t, h)] for t, _, h, _ in rows],
                [k > 0 and ONE_IN * k >= n for k, (_, n, _, _) in zip(n_hit, rows, strict=True)],
            ]

        return compute

    if not last:
        return append_columns(
            docs, needs, "__hits array<struct<first:bigint,last:bigint>>, __items array<string>", start
        )
    return append_columns(
        docs,
        needs,
        "n_words bigint, n_hit bigint, n_items bigint, items array<string>, "
        "hit_places array<struct<start:bigint,end:bigint>>, contaminated boolean",
        start,
    ).drop("__hits", "__items")
