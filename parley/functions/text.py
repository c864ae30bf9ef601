"""Text and rounding primitives that Spark's defaults do not cover.

Everything here is a plain ``Column`` expression, so it stays inside the JVM and takes part in
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a Unicode-aware ``strip`` removes. Spark's ``trim`` removes U+0020 only.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
# Every line boundary of a Unicode-aware line split, the longest first.
LINE_SEPARATORS = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

BYTE_ORDER_MARK = "\ufeff"


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace.

    Trimming a set of characters on the right indexes the whole text, so it is done only for text
    that ends in one of them.
    """
    left = lstrip(text)
    each = F.split(F.lit(WHITESPACE), "")
    ends_blank = F.exists(each, lambda c: F.endswith(text, c))
    return F.when(ends_blank, F.rtrim(left, F.lit(WHITESPACE))).otherwise(left)


def is_blank(text: Column) -> Column:
    """True when only whitespace is there; looks no further than the first visible character."""
    return lstrip(text) == ""


def split_lines(text: Column) -> Column:
    """Lines as an array, split at every Unicode line boundary.

    Byte searches for separators that hardly ever occur are much cheaper than one regular expression.
    """
    for separator in LINE_SEPARATORS:
        text = F.replace(text, F.lit(separator), F.lit("\n"))
    return F.split(text, "\n")


def has_boundary(text: Column) -> Column:
    """True when :func:`split_lines` would split."""
    found = F.contains(text, F.lit("\n"))
    for separator in LINE_SEPARATORS[1:]:
        found = found | F.contains(text, F.lit(separator))
    return found


def strip_line(line: Column) -> Column:
    """:func:`strip` that leaves lines alone which visibly need none: those from brace to brace."""
    braced = F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}"))
    return F.when(braced, line).otherwise(strip(line))


def has_non_ascii(text: Column) -> Column:
    """True when some character takes more than one byte in UTF-8."""
    return F.octet_length(text) > F.length(text)


def looks_like_json(text: Column) -> Column:
    """True when the first visible character opens an object or an array."""
    visible = lstrip(text)
    return F.startswith(visible, F.lit("{")) | F.startswith(visible, F.lit("["))


def normalised(text: Column) -> Column:
    return F.lower(strip(text))


def content_hash(text: Column) -> Column:
    """32-byte SHA-256: what is shuffled in place of text when only equality matters."""
    return F.unhex(F.sha2(text, 256))


def snippet(text: Column, width: int = 100) -> Column:
    """The first ``width`` characters, with an ellipsis when something was cut."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def round_half_even(value: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(value, 0).cast("bigint")


def round_half_up(value: Column) -> Column:
    """Nearest integer, ties upwards."""
    return F.floor(value + 0.5).cast("bigint")


def round_one_decimal(value: Column) -> Column:
    """Round a double to one decimal from its exact binary value.

    ``10 * value`` is taken as ``8v + 2v``; both products are exact, and the rounding error of the sum
    is recovered, so a value a hair below or above a tie (0.15 is stored as 0.1499...) goes the way
    its stored value says. Real ties go to even.
    """
    eight, two = value * 8, value * 2
    scaled = eight + two
    carried = scaled - eight
    error = (eight - (scaled - carried)) + (two - carried)
    whole = F.floor(scaled)
    near_tie = (scaled - whole == 0.5) & (error != 0.0)
    return (
        F.when(near_tie, whole + F.when(error > 0.0, 1).otherwise(0))
        .otherwise(F.bround(scaled, 0))
        .cast("double")
        / 10
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """True division; NULL on a zero denominator (ANSI mode would raise)."""
    return numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")


def floor_div(numerator: Column, denominator: Column | int) -> Column:
    """Integer division of non-negative numbers; NULL on a zero denominator."""
    if isinstance(denominator, int):
        denominator = F.lit(denominator)
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))
