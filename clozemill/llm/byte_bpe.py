"""Byte-level BPE encoding by backtracking from longest matches, and decoding.

The bytes of a piece are read as Latin-1 letters, so that one pyahocorasick
automaton over the vocabulary names every token that starts at each byte. The
encoder takes the longest and goes on; a token must be compatible with its left
neighbour: merged on their own, the two must come out as these two tokens. A
sequence is the one that lowest-rank-first merging gives if and only if all
neighbours are compatible, and so is each of its beginnings; hence a place that
cannot be continued is dead for good, every place is tried once, and the time
is linear. Compatibility is memoised.

Merging two tokens alone meets the seam only by the last parts of the left and
the first parts of the right one. They are incompatible if such a part of each
make up a token of lower rank than what either is merged into next.

Rows: a null or empty text has no ids and decodes to no bytes. Special strings
inside a text are ordinary text. Repeated rows are encoded each; an empty table
gives an empty result. Other columns stay; one named like an output, in any
case, is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clozemill.llm.common import append_columns, per_worker
from clozemill.llm.pieces import Splitter

#: Entries of the tables of known pieces and pairs; a full table starts anew.
KNOWN = 300_000
#: Longest piece that is kept, in code points.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a rank file: base64 of its bytes, a blank, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain merging: the leftmost adjacent pair of lowest rank, until none has a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = (ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False))
        best = min(((r, i) for i, r in enumerate(pairs) if r is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Vocabulary:
    """The bytes of each id of a rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.token: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Codec(Vocabulary):
    """Ids of texts, too; ``pattern`` cuts them into pieces."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick

        super().__init__(path)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pieces = per_worker(("splitter", pattern), lambda: Splitter(pattern)).pieces
        self.halves = {t: self._halves(t) for t in self.ranks}
        #: A part is older than what it is merged into; else seams are merged as they are.
        self.ordered = all(
            h is None or max(self.ranks.get(h[0], -1), self.ranks.get(h[1], -1)) < self.ranks[t]
            for t, h in self.halves.items()
        )
        self.size = [len(t) for t in self.token]
        #: The longest other token that a token begins with, and whether merging makes a token at all.
        self.shorter = [self._shorter(t) for t in self.token]
        self.made = [len(t) == 1 or self.halves.get(t) is not None for t in self.token]
        self.first: dict[int, list] = {}
        self.last: dict[int, list] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def _shorter(self, token: bytes) -> int:
        return next((self.ranks[x] for n in range(len(token) - 1, 0, -1) if (x := token[:n]) in self.ranks), -1)

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of a token's last merge; None for a byte, and for a token that merging never makes."""
        if len(token) < 2:
            return None
        others = {token: None}
        left = merged(token, _Without(self.ranks, others))
        return (left[0], left[1]) if len(left) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """A token's outermost parts, largest first, each with the rank of what it is merged into."""
        known = (self.first, self.last)[side]
        if token not in known:
            part, into, out = self.token[token], float("inf"), []
            while True:
                out.append((part, into))
                halves = self.halves.get(part)
                if halves is None:
                    break
                into, part = self.ranks[part], halves[side]
            known[token] = out
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, merged alone, come out as these tokens; memoised."""
        if len(self.pairs) >= KNOWN:
            self.pairs.clear()
        fits = self._seam(left, right) if self.ordered else self._plain(left, right)
        self.pairs[left, right] = fits
        return fits

    def _plain(self, left: int, right: int) -> bool:
        return merged(self.token[left] + self.token[right], self.ranks) == [self.token[left], self.token[right]]

    def _seam(self, left: int, right: int) -> bool:
        if not (self.made[left] and self.made[right]):
            return False
        rank = self.ranks.get
        starts = self._edge(right, 0)
        for a, a_into in self._edge(left, 1):
            for b, b_into in starts:
                across = rank(a + b)
                # Of equal ranks the leftmost merges first: the left token's own, then the seam.
                if across is not None and across < a_into and across <= b_into:
                    return False
        return True

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, known = len(piece), self.size, self.shorter, self.pairs.get
        longest = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # longer ones come later
        if min(longest, default=0) < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        dead = bytearray(n + 1)
        ids: list[int] = []
        at = 0
        while at < n:
            token = longest[at]
            while True:
                end = at + size[token]
                if not dead[end]:
                    if not ids:
                        fits = self.made[token]
                    elif (fits := known((ids[-1], token))) is None:
                        fits = self.compatible(ids[-1], token)
                    if fits:
                        break
                token = shorter[token]
                while token < 0:  # no token goes on from here: take back the one before
                    dead[at] = 1
                    last = ids.pop()
                    at -= size[last]
                    token = shorter[last]
            ids.append(token)
            at = end
        return ids

    def _learn(self, piece: str) -> bytes:
        coded = array("i", self.piece(piece.encode())).tobytes()
        if len(piece) <= SHORT:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[piece] = coded
        return coded

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit numbers."""
        get, learn = self.known.get, self._learn
        return b"".join([get(x) or learn(x) for x in self.pieces(text or "")])


class _Without:
    """Ranks as they were before some tokens were made."""

    def __init__(self, ranks: dict[bytes, int], without: dict):
        self.ranks, self.without = ranks, without

    def get(self, token: bytes) -> int | None:
        return None if token in self.without else self.ranks.get(token)


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, file and pattern."""
    return per_worker(("codec", path, pattern), lambda: Codec(path, pattern))


def vocabulary(path: str) -> Vocabulary:
    return per_worker(("vocabulary", path), lambda: Vocabulary(path))


def lists(rows: list[bytes]) -> pa.ListArray:
    """Rows of 32-bit numbers as an Arrow column."""
    ends = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep_text: bool = True
) -> DataFrame:
    """``docs`` with the token ids of ``text``; workers read the rank file at ``path``."""

    def start():
        one = codec(path, pattern).encode
        return lambda texts: [lists([one(x) for x in texts.to_pylist()])]

    return append_columns(docs, [text], f"`{ids}` array<int>", start, drop=() if keep_text else (text,))


def _each(column: pa.Array) -> Iterator[list[int]]:
    """The lists of an Arrow column; a null is an empty one."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0))
    ends = np.cumsum(sizes)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        yield flat[end - size : end].tolist()


def decode(rows: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their token ids stand for; null ids stand for none."""

    def start():
        one = vocabulary(path).decode
        return lambda column: [[one(x) for x in _each(column)]]

    return append_columns(rows, [ids], f"`{data}` binary", start)


def digests(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` without their ids, with n_tokens and SHA-256 digests of the ids (decimal, comma-joined) and of the bytes that they decode to."""

    def start():
        one = vocabulary(path)
        name = [str(i) for i in range(len(one.token))]

        def compute(column):
            new = []
            for x in _each(column):
                listed = ",".join(map(name.__getitem__, x)).encode()
                new.append((len(x), hashlib.sha256(listed).hexdigest(), hashlib.sha256(one.decode(x)).hexdigest()))
            return list(zip(*new, strict=True)) if new else [[]] * 3

        return compute

    return append_columns(rows, [ids], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", start, drop=(ids,))
