from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from parley.functions.json_errors import NAME, VALUE, json_error
from parley.functions.lines import validate_lines

BROKEN = [
    "", " ", "[1,]", '{"a":1,}', '{"a":1, }', '"a\\x"', '"a\\u12"', '"a\\u12G4"', '"\\u1234', '"\\u12', '"a\x01"', "[1 2]", "1 2", "01", "1.",
    "[1.]", "-", "[-x]", "nul", "[tru]", '{"a" 1}', "{a:1}", '{"a":}', '"abc', '"abc\\', "{", "[", '{"a"', '{"a":1', "[1", "1e", "[1e]",
    "1.5e+", '{"a":1 "b"}', '["a', "tru", "{'a':1}", "[,1]", "{,}", "[1,,2]", "]", "}", '{"a":1]', "[1}", '{"a":[1,{"b":nul}]}', "[1.5.2]",
    "-01", "1E5x", '{"\U0001f600":"\U0001f600"x', "[ 1]", "[1]\t\n[", '{"a":1,"b"', '{"a":1,"b":', '{"a":1,', "[1, ", '{"k\\q":1}', '{"k\x02":1}',
]
VALID = ['{}', "[]", "0", "-0.5e-10", '"\\ud83d\\ude00 \\/ \\u00E9"', ' {"a" : [1 , {"b":null}, true, false] , "": ""} ', "1E+5", '"\U0001f600"']


def parser_says(text):
    """What this interpreter's parser says, in the words and at the place of its earlier versions."""
    try:
        json.loads(text, parse_constant=lambda name: 1 / 0)
    except json.JSONDecodeError as error:
        if error.msg.startswith("Illegal trailing comma"):
            at = error.pos + 1
            at += len(text[at:]) - len(text[at:].lstrip(" \t\n\r"))
            return (VALUE if error.msg.endswith("array") else NAME), at
        return error.msg, error.pos
    except ZeroDivisionError:
        return "constant", None
    return None


def mutated(seed=1):
    random.seed(seed)
    whole = '{"messages": [{"role": "user", "content": "h\\u00e9 \\"x\\" \\n"}, [1.5e3, -0, true, null, {}], []], "n": 12}'
    for _ in range(600):
        text = list(whole)
        for _ in range(random.randint(1, 3)):
            at = random.randrange(len(text))
            kind = random.random()
            if kind < 0.4:
                del text[at]
            elif kind < 0.7:
                text.insert(at, random.choice('{}[]:,"\\ 0-.eu\x03x'))
            elif kind < 0.85:
                text[at] = random.choice('{}[]:,"\\ 0-.eutn\'')
            else:
                del text[at:]
                text = text or ["{"]
        yield "".join(text)


def test_reason_and_place_are_those_of_a_parser(spark):
    texts = [*BROKEN, *VALID, *mutated()]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(4)
    got = {r.k: r.e and (r.e.reason, r.e["at"]) for r in asked.select("k", json_error(F.col("t")).alias("e")).collect()}
    for k, text in enumerate(texts):
        want = parser_says(text)
        assert got[k] == want, (text, got[k], want)
    assert [got[k] for k in range(len(BROKEN))].count(None) == 0


def test_constants_are_no_values_and_lines_tell_the_reason(spark):
    lines = ['{"a": NaN}', "[-Infinity]", '{"messages": [', "{'messages': []}", '{"messages": []} x', "null"]
    asked = spark.createDataFrame([("d", k, t) for k, t in enumerate(lines)], "dataset_id string, line_no bigint, line string")
    rows = {r.line_no: r for r in validate_lines(asked).collect()}
    assert [(rows[k].detail, rows[k].char_no) for k in range(5)] == [
        ("Expecting value", 6), ("Expecting value", 1), ("Expecting value", 14),
        ("Expecting property name enclosed in double quotes", 1), ("Extra data", 17),
    ]
    assert rows[2].message == "Line 2: Invalid JSON - Expecting value"
    assert rows[5].error_code == "not_object" and rows[5].char_no is None
