"""Where byte-level vocabularies cut a text before merging, with the libraries' own letters.

The libraries and Python's regular expressions know different versions of
Unicode: a code point may be a letter to one only. So the letters and numbers of
the pattern are taken from the library itself, which is asked once per worker.
"""

from __future__ import annotations

import re

#: Fixed value: the white space of Unicode; Python's \s also takes U+001C to U+001F.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def every() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def library_class(name: str) -> str:
    """The code points that tiktoken counts to ``name`` (L or N)."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    one = tiktoken.Encoding("bytes", pat_str=rf"\p{{{name}}}+", mergeable_ranks=ranks, special_tokens={})
    return bytes(one.encode_ordinary(every())).decode()


def ranges(letters: str) -> str:
    """Code points as the inside of a character class."""
    points = sorted(set(map(ord, letters)))
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


def spelled(pattern: str, letters: str, numbers: str, space: str) -> str:
    """``pattern`` with the insides of classes in place of \\p{L}, \\p{N} and \\s."""
    known = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space}
    out, inside = [], False
    for part in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        if part in known:
            out.append(known[part] if inside else f"[{known[part]}]")
        elif part == r"\S":
            out.append(f"[^{space}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return "".join(out)


class Splitter:
    """The pieces of a text by ``pattern``.

    Texts of ASCII, and texts without a code point that the library and Python
    judge differently, take faster patterns that cut them at the same places.
    """

    def __init__(self, pattern: str):
        import regex

        letters, numbers = library_class("L"), library_class("N")
        self.disputed = frozenset(
            {*letters}.symmetric_difference("".join(regex.findall(r"\p{L}+", every())))
            | {*numbers}.symmetric_difference("".join(regex.findall(r"\p{N}+", every())))
        )
        self.ascii = re.compile(spelled(pattern, "A-Za-z", "0-9", r"\t-\r\x20"))
        self.plain = regex.compile(spelled(pattern, r"\p{L}", r"\p{N}", SPACE))
        self.exact = regex.compile(spelled(pattern, ranges(letters), ranges(numbers), SPACE))

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        return (self.plain if self.disputed.isdisjoint(text) else self.exact).findall(text)
