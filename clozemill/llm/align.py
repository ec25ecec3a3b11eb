"""Alignment of two tokenizers over the same bytes, and corpus-wide pair counts.

Both tokenizers encode a whole text first. Where a token of each ends at the
same byte and the next token of both begins with a space, the text is split: such
anchors cut it into windows of token ids, mostly one word each. A window's
alignment depends on its ids alone and is memoised by them: groups between
shared ends, and links between the tokens that end there.

Documents are dealt to blocks of a bounded number of tokens. A block holds, once
each, its different windows and the pairs they link; counts meet blocks, not
documents: pairs of a block are summed before they are shuffled, corpus-wide
counts go back to the blocks that hold the pair, and each block adds them up for
its windows and then its documents. No link of a document is ever a row.

Rows: a text that is null or empty, or whose tokens do not spell its bytes (with
a leading space), has no tokens: numbers are zero and the digest is ''. Repeated
rows are counted each, their links too. An empty table gives an empty result. Of
other columns, those named in ``keep`` stay.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.llm.common import pa_type, per_worker, saved
from clozemill.llm.tokens import PIECES, byte_letters

#: Bytes of text that a block holds, about; documents are not cut.
BLOCK = 1 << 21
#: Windows that a worker keeps, and token ids in them; a full table starts anew.
KNOWN, KNOWN_IDS = 300_000, 4_000_000

COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
OUTPUTS = f"{COUNTS}, n_best bigint, count_sum bigint, groups_sha256 string"


class Side:
    """The bytes of each id of a tokenizer, their number, and whether they begin with a space."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.size = np.array([len(t) for t in token], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in token])
        self.sizes, self.name = self.size.tolist(), [str(i) for i in range(len(token))]

    def spell(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.token.__getitem__, ids)) == data


class ByteLevel(Side):
    """A byte-level tokenizers file; the same merges run in tiktoken. Special strings are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {t["content"] for t in file["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in file["model"]["vocab"].items()
            if token not in special
        }
        token = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            token[i] = data
        super().__init__(token)
        self.encoding = tiktoken.Encoding("side", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a space and the text."""
        return self.encoding.encode_ordinary(" " + text)


class PieceModel(Side):
    """A sentencepiece file; it puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([
            bytes([int(model.id_to_piece(i)[3:-1], 16)])
            if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ])

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


#: Marks ids of the second side in the ids of a window.
SECOND = 1 << 31


class Windows:
    """Windows seen so far: number by ids; by number the text of the groups and the linked pairs."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        #: Keys are a window's ids as 32-bit numbers, those of the second side marked.
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.links, self.ends, self.ids = array("q"), array("q"), 0

    def full(self) -> bool:
        return len(self.text) >= KNOWN or self.ids >= KNOWN_IDS

    def learn(self, key: bytes) -> int:
        """Aligns a window: its groups lie between the ends that both sides share."""
        ids = memoryview(key).cast("I").tolist()
        self.number[key] = new = len(self.text)
        self.ids += len(ids)
        cut = next(i for i, x in enumerate(ids) if x >= SECOND)
        a, b = ids[:cut], [x - SECOND for x in ids[cut:]]
        name_a, name_b = self.a.name, self.b.name
        size_a, size_b = self.a.sizes, self.b.sizes
        groups, from_j, j, end_b, end_a, own = [], 0, 0, 0, 0, []
        for x in a:
            end_a += size_a[x]
            own.append(name_a[x])
            while end_b < end_a:
                end_b += size_b[b[j]]
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(own)}|{','.join([name_b[y] for y in b[from_j:j]])}")
                self.links.append(x << 32 | b[j - 1])
                from_j, own = j, []
        self.text.append(";".join(groups))
        self.ends.append(len(self.links))
        return new

    def encode(self, texts: list[str | None]) -> tuple[list[array], list[array]]:
        """Ids of either side per text; none where they do not spell the text after a space."""
        a, b = [], []
        for text in texts:
            x, y = (self.a.encode(text), self.b.encode(text)) if text else ((), ())
            data = (" " + text).encode() if text else b""
            if not (self.a.spell(x, data) and self.b.spell(y, data)):
                x = y = ()
            a.append(array("I", x))
            b.append(array("I", y))
        return a, b

    def of(self, a: list[array], b: list[array]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of all texts, and where each text's begin and end."""
        ids_a, ids_b = (np.frombuffer(b"".join(map(memoryview, x)), np.uint32) for x in (a, b))
        if not len(ids_a):
            return np.zeros(0, np.int64), np.zeros(len(a) + 1, np.int64)
        size_a, size_b = self.a.size[ids_a], self.b.size[ids_b]
        begin_a, begin_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        # Anchors: tokens of both sides that begin with a space at the same byte. A text's first ones do.
        mark_a, mark_b = np.flatnonzero(self.a.spaced[ids_a]), np.flatnonzero(self.b.spaced[ids_b])
        there = np.zeros(size_a.sum(), bool)
        there[begin_a[mark_a]] = True
        cut_b = mark_b[there[begin_b[mark_b]]]
        there[:] = False
        there[begin_b[cut_b]] = True
        cut_a = mark_a[there[begin_a[mark_a]]]
        # A window's ids of both sides lie together, so that one slice is its key.
        n, m = len(ids_a), len(ids_b)
        until_a, until_b = np.append(cut_a, n), np.append(cut_b, m)
        both = np.empty(n + m, np.uint32)
        both[np.arange(n) + np.repeat(cut_b, np.diff(until_a))] = ids_a
        both[np.arange(m) + np.repeat(until_a[1:], np.diff(until_b))] = ids_b | np.uint32(SECOND)
        data, bounds = both.tobytes(), (4 * (until_a + until_b)).tolist()
        get, learn = self.number.get, self.learn
        numbers = [
            learn(key) if (known := get(key := data[p:q])) is None else known
            for p, q in zip(bounds, bounds[1:], strict=False)
        ]
        ends = np.searchsorted(cut_a, np.cumsum([0, *map(len, a)]))
        return np.array(numbers, np.int64), ends


def packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers, "<u4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)


def block_row(block: int, known: Windows, texts: list[str | None]) -> list:
    """Columns of a block's row; windows and pairs are numbered anew, frequent windows first."""
    a, b = known.encode(texts)
    numbers, ends = known.of(a, b)
    named = numbers.tolist()
    digest = [
        hashlib.sha256(";".join([known.text[w] for w in named[i:j]]).encode()).hexdigest() if j > i else ""
        for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)
    ]
    times = np.bincount(numbers)
    order = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    place = np.zeros(len(times), np.int64)
    place[order] = np.arange(len(order))
    until = np.append(0, np.frombuffer(known.ends, np.int64))
    first, sizes = until[order], np.diff(until)[order]
    shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    pairs, at = np.unique(np.frombuffer(known.links, np.int64)[shift + np.arange(len(shift))], return_inverse=True)
    counts = np.bincount(at, np.repeat(times[order], sizes), len(pairs)).astype(np.int64)
    total = np.append(0, np.cumsum(sizes[place[numbers]]))
    return [
        block, list(map(len, a)), list(map(len, b)), np.diff(total[ends]).tolist(), np.diff(ends).tolist(), digest,
        packed(place[numbers]), packed(sizes), packed(at), pairs.tolist(), counts.tolist(),
    ]


_BLOCK = (
    "block bigint, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, n_windows array<bigint>, digest array<string>, "
    "windows binary, sizes binary, links binary, pairs array<bigint>, times array<bigint>"
)


def blocks(docs: DataFrame, a: str, b: str, text: str, keep: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """One row per block: the kept columns of its documents as lists, and what _BLOCK names."""
    kept = [T.StructField(f"kept_{i}", T.ArrayType(docs.schema[c].dataType)) for i, c in enumerate(keep)]
    schema = T.StructType([*T.StructType.fromDDL(_BLOCK).fields, *kept])
    types = [pa_type(f.dataType) for f in schema]
    names = [f.name for f in schema]
    width = len(keep)

    def run(batches):
        from pyspark import TaskContext

        known = per_worker(("windows", a, b), lambda: Windows(ByteLevel(a), PieceModel(b)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.asarray(pa.compute.binary_length(batch.column(width)).fill_null(0))
            # Blocks end where a multiple of the size is passed; a long text may fill one alone.
            ends = np.flatnonzero(np.diff(np.cumsum(lengths) // size, append=-1)) + 1
            for begin, end in zip([0, *ends], ends, strict=False):
                part = batch.slice(begin, end - begin)
                if known.full():
                    known.clear()
                row = block_row(block, known, part.column(width).to_pylist())
                arrays = [pa.array([v], t) for v, t in zip(row, types, strict=False)]
                arrays += [
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c).cast(t)
                    for c, t in zip(part.columns[:width], types[len(row) :], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                block += 1

    columns = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    return docs.select(*columns, F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pair_counts(entries: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold the pair, and whether its B id has none that is held by more."""
    total = entries.groupBy("pair").agg(F.sum("times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = total.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return (
        total.withColumn("b", b)
        .join(most, "b")
        .select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    )


def align(
    docs: DataFrame, a: str, b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = BLOCK
) -> DataFrame:
    """One row per document: the ``keep`` columns and OUTPUTS.

    ``a`` is a byte-level tokenizers file, ``b`` a sentencepiece file; workers
    read them there. A link's count is how many links of all documents hold its
    pair of ids; n_best says how many have the highest count of their B id.
    """
    rows = saved(blocks(docs, a, b, text, keep, size))
    entries = rows.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select(
        F.col("block").alias("of"), "at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    back = entries.join(pair_counts(entries), "pair").select("of", "at", "count", "best")
    kept = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    schema = T.StructType([*kept, *T.StructType.fromDDL(OUTPUTS).fields])
    types = [pa_type(f.dataType) for f in schema]
    names = [f.name for f in schema]

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("at")
        count, best = (np.asarray(right.column(c)).astype(np.int64) for c in ("count", "best"))
        one = {c: left.column(c)[0].as_py() for c in ("n_windows", "windows", "sizes", "links", "n_a", "n_b", "n_links", "digest")}
        windows, sizes, links = (unpacked(one[c]) for c in ("windows", "sizes", "links"))

        def by_document(values: np.ndarray) -> np.ndarray:
            by_window = np.append(0, np.cumsum(values[links]))[np.append(0, np.cumsum(sizes))]
            total = np.append(0, np.cumsum(np.diff(by_window)[windows]))
            return np.diff(total[np.append(0, np.cumsum(np.array(one["n_windows"], np.int64)))])

        arrays = [left.column(f"kept_{i}").combine_chunks().flatten() for i in range(len(keep))]
        values = [one["n_a"], one["n_b"], one["n_links"], one["n_links"], by_document(best), by_document(count), one["digest"]]
        arrays += [pa.array(v, t) for v, t in zip(values, types[len(keep) :], strict=True)]
        return pa.Table.from_arrays(arrays, names=names)

    return rows.drop("pairs", "times").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(add_up, schema)

