"""Best-fit packing by bin completion.

Documents become token ids with a closing id; longer ones are cut into full
sequences behind a first piece that may be shorter. Pieces of one length are
interchangeable, so the search works on the number of pieces per length, a
table of at most ``capacity`` rows. Bins are completed around the largest piece
left: undominated fillings are enumerated with the best waste first, a filling
is used as often as its pieces last, and a branch is pruned once its waste
shows that it cannot beat the incumbent, which starts as best-fit decreasing.
The search ends at the lower bound, or after a fixed number of fillings with
the best solution found; nothing else limits it.

Pieces meet their places by number: the pieces of a length are numbered in
chunks of a hash, and the plan says which numbers of a length go to which bins.
The plan has at most one filling per length (each use exhausts one), so its
size depends on ``capacity`` alone.

Rows: a null or empty text is one piece that holds the closing id. Repeated
rows are packed each. An empty table gives an empty result. The result has one
row per piece; of other columns, those named in ``keep`` stay.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.llm.common import per_worker, saved
from clozemill.llm.tokens import PIECES, byte_letters

CAPACITY = 2048
CLOSING_ID = 0
#: Fillings looked at in one search, dominated ones and those of all branches included.
STEPS = 20_000
#: Entries of a worker's table of known parts of texts.
KNOWN = 400_000
#: Chunks in which the pieces of one length are numbered.
CHUNKS = 4096

#: See tokens.py: a piece of the vocabulary never crosses such a blank.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")

OUTPUTS = "piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers.

    ``path`` is the tokenizers file. Its vocabulary is handed to tiktoken, which
    merges the same ranks and gives the same ids in a fraction of the time.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in file["model"]["vocab"].items()
            if token not in special
        }
        self.special = set(special)
        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special
        )
        self.parts: dict[str, bytes] = {}

    def _learn(self, part: str) -> bytes:
        ids = self.encoding.encode(part, allowed_special=self.special, disallowed_special=())
        coded = array("I", ids).tobytes()
        if len(part) <= 64:
            if len(self.parts) >= KNOWN:
                self.parts.clear()
            self.parts[part] = coded
        return coded

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *others = _BETWEEN.split(text)
        get, learn = self.parts.get, self._learn
        return b"".join([learn(first), *[get(" " + x) or learn(" " + x) for x in others]])


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return per_worker(("encoder", path), lambda: Encoder(path))


def cut(ids: bytes, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the closing id."""
    ids += int(closing).to_bytes(4, "little")
    n = len(ids) // 4
    first = n % capacity or capacity
    bounds = [0, *range(first, n + 1, capacity)]
    return [
        (i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
    ]


def pieces(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length, ids_crc32."""
    import pyarrow as pa

    schema = T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL(OUTPUTS).fields])
    names, width = [f.name for f in schema], len(keep)

    def run(batches):
        encode = encoder(path).encode
        for batch in batches:
            of, rows = [], []
            for i, one in enumerate(batch.column(width).to_pylist()):
                new = cut(encode(one), capacity)
                rows += new
                of += [i] * len(new)
            kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[:width]]
            values = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*kept, *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=names
            )

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


#: A filling: lengths of one bin, largest first, and how many bins are filled so.
Filling = tuple[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing on counts: each bin takes the largest piece that fits."""
    left, out = dict(counts), []
    while left:
        lengths = sorted(left, reverse=True)
        filling, room = [], capacity
        for n in lengths:
            take = min(left[n], room // n)
            filling += [n] * take
            room -= n * take
        out.append(_use(left, tuple(filling)))
    return out


def _use(left: dict[int, int], filling: tuple[int, ...]) -> Filling:
    """Takes a filling from ``left`` as often as its pieces last."""
    need: dict[int, int] = {}
    for n in filling:
        need[n] = need.get(n, 0) + 1
    times = min(left[n] // k for n, k in need.items())
    for n, k in need.items():
        left[n] -= times * k
        if not left[n]:
            del left[n]
    return filling, times


def fillings(left: dict[int, int], capacity: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings around the largest piece left, least waste first; None stands for a dominated one.

    Bit sets of the sums that the smaller lengths can reach bound the waste of
    every partial filling, so no branch is entered that cannot be completed.
    """
    largest = max(left)
    room = capacity - largest
    lengths = sorted((n for n in left if n <= room), reverse=True)
    stock = [min(left[n] - (n == largest), room // n) for n in lengths]
    everything = (1 << (room + 1)) - 1
    sums = [1]  # sums[-1 - j]: what lengths[j:] reach
    for n, k in zip(reversed(lengths), reversed(stock), strict=True):
        reach, step = sums[-1], 1
        while k > 0:
            step = min(step, k)
            reach |= (reach << (n * step)) & everything
            k -= step
            step *= 2
        sums.append(reach)
    sums.reverse()
    for waste in range(room + 1):
        if not sums[0] >> (room - waste) & 1:
            continue
        stack = [(0, room - waste, ())]
        while stack:
            at, rest, chosen = stack.pop()
            if not rest:
                spare = waste and _dominated(waste, chosen, lengths, stock)
                yield None if spare else (largest, *chosen)
                continue
            while lengths[at] > rest or not stock[at]:
                at += 1
            n = lengths[at]
            for k in range(min(stock[at], rest // n) + 1):  # the most of n is tried first
                if sums[at + 1] >> (rest - k * n) & 1:
                    stack.append((at + 1, rest - k * n, chosen + (n,) * k))


def _dominated(waste: int, chosen: tuple[int, ...], lengths: list[int], stock: list[int]) -> bool:
    """Whether a spare piece would still fit, or fit in place of a smaller one."""
    spare = [n for n, k in zip(lengths, stock, strict=True) if k > chosen.count(n)]
    return any(n <= waste or any(m < n <= m + waste for m in set(chosen)) for n in spare)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[Filling]:
    """Fillings and how often each is used, with as few bins as the search finds.

    Depth first: the next filling of a bin is looked for only when the search
    comes back to it, in the pieces as they were, so that one plan is held.
    """
    left = {n: k for n, k in counts.items() if k}
    total = sum(n * k for n, k in left.items())
    bound = -(-total // capacity)
    best = best_fit(left, capacity)
    fewest = sum(k for _, k in best)
    done: list[Filling] = []
    seen: list[int] = []  # how many fillings of each bin were looked at
    bins = waste = skip = 0
    budget = steps
    while fewest > bound:
        filling = None
        if left and waste <= (fewest - 1) * capacity - total:  # else too much waste for a better plan
            for looked, filling in enumerate(fillings(left, capacity)):
                if looked < skip:
                    filling = None
                    continue
                budget -= 1
                if filling or budget <= 0:
                    break
        if budget <= 0:
            break
        if filling:
            done.append(_use(left, filling))
            seen.append(looked)
            bins, waste, skip = bins + done[-1][1], waste + done[-1][1] * (capacity - sum(filling)), 0
            if not left and bins < fewest:
                best, fewest = list(done), bins
        elif done:
            filling, times = done.pop()
            for n in filling:
                left[n] = left.get(n, 0) + times
            bins, waste, skip = bins - times, waste - times * (capacity - sum(filling)), seen.pop() + 1
        else:
            break
    return best


def runs(plan: list[Filling]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows (length, first number, last number, first bin, copies per bin, offset).

    The pieces of a length with numbers first..last fill consecutive bins, so
    many copies each, side by side from the offset.
    """
    taken: dict[int, int] = {}
    at_bin = 0
    for filling, times in plan:
        offset = 0
        for n in sorted(set(filling), reverse=True):
            k = filling.count(n)
            first = taken.get(n, 0)
            yield n, first, first + k * times - 1, at_bin, k, offset
            taken[n] = first + k * times
            offset += k * n
        at_bin += times


def pack(
    docs: DataFrame,
    path: str,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    steps: int = STEPS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = saved(pieces(named, path, capacity=capacity))
    return place(rows, pack_counts(_counts(rows), capacity, steps), spark)


def _counts(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows


def place(rows: DataFrame, plan: list[Filling], spark) -> DataFrame:
    """Joins the pieces of each length with their places in the plan."""
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CHUNKS))
    rows = rows.withColumn("chunk", chunk)
    sizes = rows.groupBy("length", "chunk").count()
    before = sizes.select(
        "length",
        "chunk",
        (
            F.expr("sum(count) over (partition by length order by chunk)") - F.col("count")
        ).alias("before"),
    )
    inside = F.expr("row_number() over (partition by length, chunk order by doc_id, piece, start) - 1")
    numbered = rows.withColumn("inside", inside).join(before, ["length", "chunk"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("inside"))
    table = spark.createDataFrame(
        list(runs(plan)),
        "length bigint, first bigint, last bigint, first_bin bigint, copies bigint, at bigint",
    )
    by_length = table.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "first_bin", "copies", "at"))).alias("runs")
    )
    run = F.element_at(
        F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (F.col("number") <= r["last"])), 1
    )
    found = numbered.join(F.broadcast(by_length), "length").withColumn("run", run)
    nth = F.col("number") - F.col("run.first")
    return found.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("run.first_bin") + F.floor(nth / F.col("run.copies"))).cast("bigint").alias("sequence_id"),
        (F.col("run.at") + (nth % F.col("run.copies")) * F.col("length")).cast("bigint").alias("offset"),
    )
