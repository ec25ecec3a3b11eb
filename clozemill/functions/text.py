"""Text clean-up as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.fixed_values import WHITESPACE

# Every whitespace run except a lone space, which already is what it should be.
# The look-aheads settle most characters with two range tests: there is no
# whitespace in printable ASCII, nor between U+00A1 and U+167F.
_MAYBE_SPACE = r"(?=[^!-~\x{A1}-\x{167F}])"
_RUN_TO_COLLAPSE = (
    f"{_MAYBE_SPACE}(?:(?! ){WHITESPACE}{WHITESPACE}*| {_MAYBE_SPACE}{WHITESPACE}+)"
)
# The same characters, one by one.
WHITESPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def collapse_whitespace(c: Column) -> Column:
    """Every run of Unicode whitespace becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, _RUN_TO_COLLAPSE, " "))


def strip_whitespace(c: Column) -> Column:
    """Unicode whitespace removed from both ends only."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def falsy_to_empty(c: Column, dtype: T.DataType) -> Column:
    """The column as text, with null, zero, false and empty lists as ''."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("True"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.when(c != 0, _fractional(c.cast("string")))
    elif isinstance(dtype, T.NumericType):
        text = F.when(c != 0, c.cast("string"))
    elif isinstance(dtype, T.ArrayType):
        text = F.when(F.size(c) > 0, c.cast("string"))
    elif isinstance(dtype, T.NullType):
        text = F.lit(None).cast("string")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def _fractional(text: Column) -> Column:
    """A double's text with the exponents that Python's str() uses, and no others.

    The text and its parts are bound once each, in lambdas over one element:
    written out as one expression, they make a method that the JVM does not compile.
    """

    def scientific(p: Column) -> Column:
        digits, power = p["digits"], p["power"]
        plain = F.concat(
            F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, "0"),
            F.lit("."),
            F.coalesce(F.nullif(F.substring(digits, power + 2, F.length(digits)), F.lit("")), F.lit("0")),
        )
        fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits))))
        size = F.abs(power).cast("string")
        written = F.concat(
            F.substring(digits, 1, 1),
            F.coalesce(fraction, F.lit("")),
            F.when(power < 0, "e-").otherwise("e+"),
            F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
        )
        number = (
            F.when(power.between(7, 15), plain)
            .when(power == -4, F.concat(F.lit("0.000"), digits))
            .otherwise(written)
        )
        return F.concat(F.when(p["negative"], "-").otherwise(""), number)

    def parts(t: Column) -> Column:
        # A mantissa has one digit before its point.
        mantissa = F.ltrim(F.substring_index(t, "E", 1), F.lit("-"))
        return F.struct(
            t.startswith("-").alias("negative"),
            F.concat(F.substring(mantissa, 1, 1), F.rtrim(F.substring(mantissa, F.lit(3), F.length(mantissa)), F.lit("0"))).alias("digits"),
            F.substring_index(t, "E", -1).cast("int").alias("power"),
        )

    def render(t: Column) -> Column:
        return (
            F.when(t.contains("E"), _bound(parts(t), scientific))
            .when(t == "NaN", "nan")
            .when(t == "Infinity", "inf")
            .when(t == "-Infinity", "-inf")
            .otherwise(t)
        )

    return _bound(text, render)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _cp1251_table() -> tuple[str, str]:
    """cp1251 characters beyond U+00FF, and the Latin-1 character of the same byte."""
    wide, narrow = [], []
    for byte in range(0x80, 0x100):
        char = bytes([byte]).decode("cp1251", errors="ignore")
        if char and ord(char) > 0xFF:
            wide.append(char)
            narrow.append(chr(byte))
    return "".join(wide), "".join(narrow)


CP1251_WIDE, CP1251_NARROW = _cp1251_table()
# The characters that stand for UTF-8 continuation bytes.
_CONTINUATION = r"\x{80}-\x{BF}" + "".join(
    wide for wide, narrow in zip(CP1251_WIDE, CP1251_NARROW) if narrow <= "\xbf"
)


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 text that was read as cp1251; anything doubtful stays as it is.

    The characters are mapped back to bytes and decoded as UTF-8. The original
    is kept when it shows no sign of the damage (no Р or С), when a character
    has no cp1251 byte, when the bytes are not valid UTF-8, and when decoding
    would add replacement characters.
    """
    # Р and С are lead bytes of two: without a continuation after each the text
    # cannot decode. That clears sound Russian text before the dear mapping.
    suspect = c.rlike("[РС]") & ~c.rlike(f"[РС](?![{_CONTINUATION}])")
    # A character without a byte, or the bytes EF BF BD of a replacement character.
    hopeless = c.rlike(rf"[^\x{{0}}-\x{{FF}}{CP1251_WIDE}]|[пï][ї¿][Ѕ½]")
    single_bytes = F.encode(F.translate(c, CP1251_WIDE, CP1251_NARROW), "ISO-8859-1")
    decoded = F.try_validate_utf8(single_bytes.cast("string"))
    return F.coalesce(F.when(suspect & ~hopeless, decoded), c)


def normalize_text(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Falsy values to '', encoding repaired, whitespace collapsed."""
    return collapse_whitespace(repair_mojibake(falsy_to_empty(c, dtype)))
