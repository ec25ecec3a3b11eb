"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is cut into 32 segments of two bits; its image is the
number of ones in each. The Manhattan distance of two images never exceeds the
Hamming distance of the fingerprints, so pairs are searched among images and
verified on fingerprints. Images are kept as 64 bits, each count in unary (0, 1
and 3), so that the Manhattan distance is the bit count of an exclusive or.

The grid has unit cells over 16 of the 32 counts. Of two images at most three
apart, one half is at most one apart: the pair shares a cell of that half or
lies in cells that differ by one in one count. Every fingerprint is put once
into its own cell per half, and looks into that cell and the (up to 16) cells
above it; the cell below is covered from the other side. So the search is an
equi-join that misses nothing, whatever the data.

Rows: a null or empty text has no words and the fingerprint zero, which links
like any other. Repeated rows and ids are ordinary members of their group. Null
ids never name a group unless it holds nothing else. An empty table gives an
empty result. Other columns of the input stay.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import append_columns, components, saved

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_LOW = 0x5555555555555555
_HALF = 0xFFFFFFFF
#: Shingles hashed at once; longer texts go on in further slices.
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    last = max(1, len(words) - shingle + 1)
    for at in range(0, last, _SLICE):
        part = words[at : min(at + _SLICE, last) + shingle - 1]
        if len(part) < shingle:
            shingles = [b" ".join(part)]
        else:
            shingles = list(map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)))
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits((2 * ones > last).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column fp (bigint)."""

    def start():
        return lambda texts: [[fingerprint(x, shingle) for x in texts.to_pylist()]]

    return append_columns(docs, [text], "fp bigint", start)


def _image(fp: Column) -> Column:
    """Two-bit segments with their ones moved to the low end: 00, 01 or 11."""
    low, above = F.lit(_LOW).cast("bigint"), F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(above).bitwiseAND(low)
    all_ = fp.bitwiseAND(above).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(all_, 1))


def _cells_above(half: Column) -> Column:
    """The half's own cell, and each cell with one of its 16 counts one higher."""
    free = F.filter(
        F.transform(
            F.array([F.lit(1 << (2 * i)).cast("bigint") for i in range(16)]),
            lambda low: F.when(half.bitwiseAND(low) == 0, half.bitwiseOR(low)).when(
                half.bitwiseAND(F.shiftleft(low, 1)) == 0, half.bitwiseOR(F.shiftleft(low, 1))
            ),
        ),
        lambda cell: cell.isNotNull(),
    )
    return F.concat(F.array(half), free)


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints at most ``max_bits`` apart.

    ``nodes`` holds each fingerprint once, as fp. A pair may come twice.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the two halves of the grid cover distances up to 3")
    image = nodes.select("fp", _image(F.col("fp")).alias("image"))
    halves = image.select(
        "fp",
        "image",
        F.posexplode(
            F.array(
                F.col("image").bitwiseAND(F.lit(_HALF).cast("bigint")),
                F.shiftrightunsigned("image", 32),
            )
        ).alias("half", "own"),
    )
    base = halves.select("half", F.col("own").alias("cell"), F.col("fp").alias("b"), F.col("image").alias("image_b"))
    probe = halves.select(
        "half", "own", F.explode(_cells_above(F.col("own"))).alias("cell"), F.col("fp").alias("a"), F.col("image").alias("image_a")
    )
    near = (F.bit_count(F.col("image_a").bitwiseXOR(F.col("image_b"))) <= max_bits) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    )
    once = (F.col("own") != probe["cell"]) | (F.col("a") < F.col("b"))
    on = (probe["half"] == base["half"]) & (probe["cell"] == base["cell"]) & once & near
    return probe.join(base, on).select("a", "b")


def groups(rows: DataFrame, doc_id: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """One row (fp, root, component_id) per fingerprint of ``rows`` (doc_id, fp).

    root is the smallest fingerprint of the component, component_id the smallest
    doc_id in it. ``rows`` is read more than once: save it first.
    """
    nodes = saved(rows.groupBy("fp").agg(F.min(doc_id).alias("first")))
    linked = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
    rooted = saved(
        nodes.join(linked, "fp", "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        )
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``."""
    rows = saved(
        fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select(
            "doc_id", "fp"
        )
    )
    return rows.join(groups(rows, max_bits=max_bits), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id.

    Among rows of that id, the smallest fingerprint, then the smallest hash of
    the text, and one of equal rows.
    """
    mark = F.xxhash64(F.col(text))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), mark.alias("mark"))
    rows = saved(fingerprints(narrow).select("doc_id", "mark", "fp"))
    chosen = (
        rows.join(groups(rows, max_bits=max_bits), "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "mark")).alias("best"))
        .select(F.col("best.doc_id").alias("keep_id"), F.col("best.mark").alias("keep_mark"))
    )
    whole = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("keep_id"), mark.alias("keep_mark"))
    keys = ["keep_id", "keep_mark"]
    on = whole["keep_id"].eqNullSafe(chosen["keep_id"]) & (whole["keep_mark"] == chosen["keep_mark"])
    return whole.join(chosen.distinct(), on, "left_semi").dropDuplicates(keys).select("row.*")
