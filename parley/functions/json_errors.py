"""Where a text stops being JSON, and why: an automaton over its characters as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a JSON parser words its errors.
VALUE = "Expecting value"
NAME = "Expecting property name enclosed in double quotes"
COLON = "Expecting ':' delimiter"
COMMA = "Expecting ',' delimiter"
EXTRA = "Extra data"
UNTERMINATED = "Unterminated string starting at"
CONTROL = "Invalid control character at"
ESCAPE = "Invalid \\escape"
UNICODE = "Invalid \\uXXXX escape"

_STATE = (
    "struct<mode: string, open: string, start: bigint, rest: string, i: bigint, reason: string, at: bigint>"
)
# What the automaton waits for. Strings and their escapes come twice: in a value, and in a member's name.
_START, _FIRST, _MEMBER, _NEXT_MEMBER, _AFTER, _COLON = "value", "first", "member", "next", "after", "colon"
_STRINGS = {"string": _AFTER, "name": _COLON}
_MINUS, _ZERO, _DIGITS, _DOT, _FRACTION, _E, _SIGN, _EXPONENT = "-", "0", "9", ".", ".9", "e", "e+", "e9"
_LITERAL = "literal"
_UNFINISHED = (_DOT, _E, _SIGN)


def _cases(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    for condition, value in reversed(cases):
        otherwise = F.when(condition, value).otherwise(otherwise)
    return otherwise


def _changed(state: Column, **changes) -> Column:
    fields = ("mode", "open", "start", "rest", "i", "reason", "at")
    changes.setdefault("i", state["i"] + 1)
    values = {name: changes.get(name, state[name]) for name in fields}
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()])


def _failed(state: Column, reason: str | Column, at: Column) -> Column:
    return _changed(state, reason=reason, at=at)


def _step(s: Column, c: Column) -> Column:
    i, mode, depth = s["i"], s["mode"], F.length(s["open"])
    inner = F.substring(s["open"], -1, 1)
    blank = c.isin(" ", "\t", "\n", "\r")
    digit = c.between("0", "9")
    closed = _changed(s, mode=_AFTER, open=F.substring(s["open"], F.lit(1), depth - 1))
    opened = lambda m: _changed(s, mode=m, open=F.concat(s["open"], c))
    begun = lambda m, rest="": _changed(s, mode=m, start=i, rest=rest)
    moved = lambda m: _changed(s, mode=m)
    stays = _changed(s)

    value = _cases(
        [
            (c == '"', begun("string")),
            (c == "{", opened(_MEMBER)),
            (c == "[", opened(_FIRST)),
            (c == "-", begun(_MINUS)),
            (c == "0", begun(_ZERO)),
            (digit, begun(_DIGITS)),
            (c == "t", begun(_LITERAL, "rue")),
            (c == "f", begun(_LITERAL, "alse")),
            (c == "n", begun(_LITERAL, "ull")),
        ],
        _failed(s, VALUE, i),
    )
    # What a value may be followed by where it stands.
    missing = F.when(depth == 0, EXTRA).otherwise(COMMA)
    after = _cases(
        [
            (blank, _changed(s, mode=_AFTER)),
            ((inner == "[") & (c == ","), moved(_START)),
            ((inner == "{") & (c == ","), moved(_NEXT_MEMBER)),
            (((inner == "[") & (c == "]")) | ((inner == "{") & (c == "}")), closed),
        ],
        _failed(s, missing, i),
    )
    dot = _changed(s, mode=_DOT, start=i)
    power = _changed(s, mode=_E, start=i)
    exponent = c.isin("e", "E")
    cut = _failed(s, missing, s["start"])
    left = F.substring(s["rest"], 2, 10)
    cases = [
        (s["reason"].isNotNull(), s),
        (mode.isin(_START, _FIRST, _MEMBER, _NEXT_MEMBER, _COLON) & blank, stays),
        ((mode == _FIRST) & (c == "]"), closed),
        (mode.isin(_START, _FIRST), value),
        ((mode == _MEMBER) & (c == "}"), closed),
        (mode.isin(_MEMBER, _NEXT_MEMBER), F.when(c == '"', begun("name")).otherwise(_failed(s, NAME, i))),
        (mode == _COLON, F.when(c == ":", moved(_START)).otherwise(_failed(s, COLON, i))),
        ((mode == _LITERAL) & (c == F.substring(s["rest"], 1, 1)), F.when(left == "", moved(_AFTER)).otherwise(_changed(s, rest=left))),
        (mode.isin(_LITERAL), _failed(s, VALUE, s["start"])),
        (mode == _MINUS, _cases([(c == "0", moved(_ZERO)), (digit, moved(_DIGITS))], _failed(s, VALUE, s["start"]))),
        (mode.isin(_ZERO, _DIGITS) & (c == "."), dot),
        (mode.isin(_ZERO, _DIGITS, _FRACTION) & exponent, power),
        (mode.isin(_DIGITS, _FRACTION, _EXPONENT) & digit, stays),
        (mode == _DOT, F.when(digit, moved(_FRACTION)).otherwise(cut)),
        ((mode == _E) & c.isin("+", "-"), moved(_SIGN)),
        (mode.isin(_E, _SIGN), F.when(digit, moved(_EXPONENT)).otherwise(cut)),
    ]
    for string, then in _STRINGS.items():
        inside = mode.isin(string, f"{string} after u")
        cases += [
            (
                inside,
                _cases(
                    [(c == '"', moved(then)), (c == "\\", moved(f"{string} escape")), (c < " ", _failed(s, CONTROL, i))],
                    moved(string),
                ),
            ),
            (
                mode == f"{string} escape",
                _cases(
                    [
                        (c == "u", _changed(s, mode=f"{string} u", rest="")),
                        (c.isin('"', "\\", "/", "b", "f", "n", "r", "t"), moved(string)),
                    ],
                    _failed(s, ESCAPE, i - 1),
                ),
            ),
            (
                mode == f"{string} u",
                F.when(
                    c.rlike("^[0-9A-Fa-f]$"),
                    _changed(
                        s,
                        mode=F.when(F.length(s["rest"]) == 3, f"{string} after u").otherwise(f"{string} u"),
                        rest=F.concat(s["rest"], c),
                    ),
                ).otherwise(_failed(s, UNICODE, i - F.length(s["rest"]) - 1)),
            ),
        ]
    # Whatever is left stands behind a whole value.
    return _cases(cases, after).cast(_STATE)


def _finish(s: Column) -> Column:
    mode, end = s["mode"], s["i"]
    missing = F.when(s["open"] == "", EXTRA).otherwise(COMMA)

    def error(reason: str | Column, at: Column) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(reason.alias("reason"), at.cast("bigint").alias("at"))

    open_string = mode.isin(*[m for name in _STRINGS for m in (name, f"{name} escape")])
    open_code = mode.isin(*[m for name in _STRINGS for m in (f"{name} u", f"{name} after u")])
    return _cases(
        [
            (s["reason"].isNotNull(), error(s["reason"], s["at"])),
            (mode.isin(_START, _FIRST), error(VALUE, end)),
            (mode.isin(_MEMBER, _NEXT_MEMBER), error(NAME, end)),
            (mode == _COLON, error(COLON, end)),
            (mode.isin(_LITERAL, _MINUS), error(VALUE, s["start"])),
            (mode.isin(*_UNFINISHED), error(missing, s["start"])),
            (open_string, error(UNTERMINATED, s["start"])),
            (open_code, error(UNICODE, end - F.length(s["rest"]) - 1)),
            (s["open"] != "", error(COMMA, end)),
        ],
        F.lit(None).cast("struct<reason: string, at: bigint>"),
    )


def json_error(text: Column) -> Column:
    """``struct(reason, at)`` of the first error, ``at`` counting characters from 0; NULL for valid JSON.

    ``NaN`` and ``Infinity`` are errors, and so is anything behind the one value. The work is a step per
    character, so ask for lines that are known to be broken.
    """
    nothing = F.lit(None)
    start = F.struct(F.lit(_START), F.lit(""), F.lit(0), F.lit(""), F.lit(0), nothing, nothing).cast(_STATE)
    return F.aggregate(F.array_remove(F.split(text, ""), ""), start, _step, _finish)
