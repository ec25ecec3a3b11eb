"""Token counts by byte-pair merging with a heap and a linked list.

The library's own rules say where a text is cut before merging; every cut piece
is merged on its own. Its bytes form a linked list, its adjacent pairs a heap by
merge rank. The lowest pair is popped and joined until no pair has a rank; the
number of tokens is the number of bytes less the number of merges, and no
identifiers are made. Counts of pieces are kept in a table of bounded size.

Rows: a null or empty text has 0 bytes and 0 tokens and is not over the limit.
Special strings inside a text are one token each, as the library counts them.
Repeated rows are counted each; an empty table gives an empty result. Other
columns of the input stay; one named like an output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame

from clozemill.llm.common import append_columns, per_worker

LIMIT = 512
#: Entries of a table of known pieces; a full table starts anew.
KNOWN = 400_000

#: Fixed value: the pieces of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between two visible characters always starts a piece, so texts can
#: be cut there first and the parts looked up.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Counter:
    """Counts tokens with the merges of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.parts: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def merge_count(self, piece: str) -> int:
        """Bytes of the piece less its merges."""
        symbols: list[str | None] = [self.letters[b] for b in piece.encode()]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.ranks
        heap = [
            (rank, i)
            for i in range(n - 1)
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue  # the pair has changed since
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (new := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (new, h))
        return n - merges

    def _piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.merge_count(piece)
            if len(piece) <= 64:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[piece] = count
        return count

    def _part(self, part: str) -> int:
        total, rest = 0, [part]
        if self.special:
            rest = self.special.split(part)
            total = len(rest) - 1
        for one in rest:
            total += sum(map(self._piece, self.pieces.findall(one)))
        if len(part) <= 64:
            if len(self.parts) >= KNOWN:
                self.parts.clear()
            self.parts[part] = total
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *others = _BETWEEN.split(text)
        total, get = self._part(first), self.parts.get
        for other in others:
            part = " " + other
            n = get(part)
            total += self._part(part) if n is None else n
        return total


def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    return per_worker(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    ``path`` is the vocabulary file; every worker reads it at this place.
    """

    def start():
        count = counter(path).count

        def compute(texts):
            texts = [x or "" for x in texts.to_pylist()]
            tokens = [count(x) for x in texts]
            return [[len(x.encode()) for x in texts], tokens, [n > limit for n in tokens]]

        return compute

    return append_columns(docs, [text], "n_bytes bigint, n_tokens bigint, over_limit boolean", start)
