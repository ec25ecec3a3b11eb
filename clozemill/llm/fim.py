"""Fill-in-the-middle texts from seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME`` code
points, each with the number of code points before it. Prefix, middle and suffix
are ranges of code points: frames inside a range are taken over as they are,
only the frames that a cut falls into are decompressed and stored anew. The
output is such a row of frames, too. Digests stream over the frames in order,
so that no second copy of a text is held.

Two cuts and the form of a document come from a hash of its id. restored()
rebuilds a text from output and form alone, by the places of the markers.

Rows: a null text is empty, and an empty text stays plain, with no frames. A text
that holds a marker stays plain. A null id hashes as the empty text. Repeated
rows are transformed each; an empty table gives an empty result. Other columns
stay; one named like an output, in any case, is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from clozemill.llm.common import append_columns

#: Code points of a frame, at most; level of compression.
FRAME, LEVEL = 1 << 14, 1
#: Markers, and what the hash of an id decides (contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20

FRAMES = "array<struct<first: bigint, units: int, data: binary>>"


@dataclass(frozen=True)
class Frame:
    """Code points before this frame, its own, and its compressed text."""

    first: int
    units: int
    data: bytes


def compressed(text: str) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL).compress(text.encode())


def text_in(frame: Frame) -> str:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(frame.data).decode()


def frames_of(text: str, size: int = FRAME) -> list[Frame]:
    """Independent frames of ``size`` code points; the last may be shorter."""
    parts = (text[i : i + size] for i in range(0, len(text), size))
    return [Frame(i * size, len(x), compressed(x)) for i, x in enumerate(parts)]


def length(frames: list[Frame]) -> int:
    return frames[-1].first + frames[-1].units if frames else 0


def joined(*rows: list[Frame]) -> list[Frame]:
    """Frames one after the other, with their counts carried on; data is not touched."""
    out, at = [], 0
    for frame in (f for row in rows for f in row):
        out.append(Frame(at, frame.units, frame.data))
        at += frame.units
    return out


def between(frames: list[Frame], low: int, high: int) -> list[Frame]:
    """The code points from ``low`` to ``high``: only cut frames are decompressed."""
    out = []
    for frame in frames:
        a, b = max(low - frame.first, 0), min(high - frame.first, frame.units)
        if a >= b:
            continue
        whole = b - a == frame.units
        out.append(Frame(0, b - a, frame.data if whole else compressed(text_in(frame)[a:b])))
    return joined(out)


def digest(frames: list[Frame]) -> str:
    """Lowercase hex SHA-256 of the text in UTF-8, frame by frame."""
    import zstandard

    sha, unpack = hashlib.sha256(), zstandard.ZstdDecompressor()
    for frame in frames:
        sha.update(unpack.decompress(frame.data))
    return sha.hexdigest()


def places(frames: list[Frame], markers: tuple[str, ...]) -> list[int]:
    """Where each marker first starts, in code points; -1 where it does not occur."""
    found, carry = [-1] * len(markers), ""
    keep = max(map(len, markers)) - 1
    for frame in frames:
        text = carry + text_in(frame)
        for i, marker in enumerate(markers):
            if found[i] < 0 and (at := text.find(marker)) >= 0:
                found[i] = frame.first - len(carry) + at
        carry = text[-keep:] if keep else ""
    return found


@dataclass(frozen=True)
class Draw:
    """What the hash of an id says; n is the number of code points."""

    first: int
    second: int
    plain: bool
    spm: bool

    @classmethod
    def of(cls, doc_id: object, n: int, seed: int = SEED) -> Draw:
        text = f"{seed}:{'' if doc_id is None else doc_id}"
        hexed = hashlib.sha256(text.encode()).hexdigest()
        h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        return cls(low, high, h[2] % 100 >= PLAIN_FROM, h[3] % 100 < SPM_BELOW)


def turned(frames: list[Frame], doc_id: object, seed: int = SEED) -> tuple[str, int | None, int | None, list[Frame]]:
    """(form, prefix_chars, middle_chars, output frames) of one text."""
    n = length(frames)
    draw = Draw.of(doc_id, n, seed)
    if not n or draw.plain or max(places(frames, (PREFIX, SUFFIX, MIDDLE))) >= 0:
        return "plain", None, None, frames
    prefix = between(frames, 0, draw.first)
    middle = between(frames, draw.first, draw.second)
    suffix = between(frames, draw.second, n)
    mark = {m: frames_of(m) for m in (PREFIX, SUFFIX, MIDDLE)}
    if draw.spm:
        form, parts = "spm", (mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    else:
        form, parts = "psm", (mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    return form, draw.first, draw.second - draw.first, joined(*parts)


def rebuilt(output: list[Frame], form: str) -> list[Frame]:
    """The text's frames from an output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, b, c = places(output, (first, second, MIDDLE))
    one = between(output, a + len(first), b)
    two = between(output, b + len(second), c)
    middle = between(output, c + len(MIDDLE), length(output))
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return joined(prefix, middle, suffix)


def _read(column) -> Iterator[list[Frame]]:
    for row in column.to_pylist():
        yield [Frame(**x) for x in row or ()]


def _rows(frames: list[Frame]) -> list[dict]:
    return [vars(x) for x in frames]


def framed(docs: DataFrame, text: str = "text", size: int = FRAME) -> DataFrame:
    """``docs`` without the text, with n (code points) and its frames."""

    def start():
        def compute(texts):
            texts = [x or "" for x in texts.to_pylist()]
            return [[len(x) for x in texts], [_rows(frames_of(x, size)) for x in texts]]

        return compute

    return append_columns(docs, [text], f"n bigint, frames {FRAMES}", start, drop=(text,))


def transform(rows: DataFrame, doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Framed rows with form, prefix_chars, middle_chars, output and output_sha256 for their frames."""
    outputs = f"form string, prefix_chars bigint, middle_chars bigint, output {FRAMES}, output_sha256 string"

    def start():
        def compute(ids, frames):
            new = [turned(f, i, seed) for i, f in zip(ids.to_pylist(), _read(frames), strict=True)]
            form, prefix, middle, output = zip(*new, strict=True) if new else [()] * 4
            return [form, prefix, middle, list(map(_rows, output)), list(map(digest, output))]

        return compute

    return append_columns(rows, [doc_id, "frames"], outputs, start, drop=("frames",))


def restored(rows: DataFrame) -> DataFrame:
    """Transformed rows with restored (frames) and restored_sha256 for their output."""

    def start():
        def compute(forms, output):
            new = [rebuilt(o, f) for f, o in zip(forms.to_pylist(), _read(output), strict=True)]
            return [list(map(_rows, new)), list(map(digest, new))]

        return compute

    return append_columns(
        rows, ["form", "output"], f"restored {FRAMES}, restored_sha256 string", start, drop=("output",)
    )


def texts(rows: DataFrame, frames: str, text: str = "text") -> DataFrame:
    """``rows`` with a column of frames read as text again."""

    def start():
        return lambda column: [["".join(map(text_in, x)) for x in _read(column)]]

    return append_columns(rows, [frames], f"{text} string", start, drop=(frames,))
