"""Arguments of tool calls: what parses, what is kept, and nested schemas."""

import json

from shelfcast.llm import tool_calls

CALLS = "conv_id long, seq long, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, seq long, call_id string, content string"


def checked(spark, arguments, parameters):
    """Problems and printed arguments of every text."""
    calls = spark.createDataFrame([(1, i, f"c{i}", "t", a, []) for i, a in enumerate(arguments)], CALLS)
    rows = tool_calls.linked(calls, spark.createDataFrame([], RESULTS), {"t": parameters}).collect()
    return {arguments[r["seq"]]: (r["problems"], json.loads(r["record"])["arguments"]) for r in rows}


def test_only_whole_objects_parse(spark):
    texts = [
        '{"x":5} trailing', '{"x":5},{"x":6}', '{"x":5},"y":6', '{"x":5}],[{"x":1}', '{"x":5}}', '{"x":5', "[1]", "5", "null", '"x"', "", " ",
        '{"x":5,"x":6}', '{"x":5},"value":1', ' {"x":5} ', '{"x":5}\n',
    ]
    found = checked(spark, texts, {"x": ("integer", True)})
    for text, (problems, kept) in found.items():
        if text.strip() == '{"x":5}':
            assert (problems, kept) == ("", {"x": 5})
        else:
            assert (problems, kept) == ("not a JSON object", text), text


def test_texts_are_kept_character_by_character(spark):
    texts = ['line1\nline2\t"q"', "back\\slash \\n", "\x01\x1f\x7f", "é😀", "x" * 100_000, "}", '{"s":"a"}}']
    for text, (problems, kept) in checked(spark, texts, {}).items():
        assert (problems, kept) == ("not a JSON object", text)


def test_integers_by_value(spark):
    whole = ["1", "1.0", "-3e2", "12345678901234567890", "1e300", "0"]
    broken = ["1.5", "1e-3", '"1"', "true", "[1]"]
    found = checked(spark, [f'{{"x":{v}}}' for v in whole + broken], {"x": ("integer", True)})
    assert {found[f'{{"x":{v}}}'][0] for v in whole} == {""}
    assert {found[f'{{"x":{v}}}'][0] for v in broken} == {"x is not integer"}


def test_nested_schemas(spark):
    parameters = {
        "unit": {"type": "string", "enum": ["m", "km"], "required": True},
        "size": {"type": "number", "minimum": 0, "maximum": 10},
        "level": {"type": "integer", "enum": [1, 2]},
        "place": {"type": "object", "properties": {"lat": ("number", True), "tags": {"type": "array", "items": {"type": "string"}}}},
        "rows": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer", "required": True, "minimum": 1}}}},
        "odd key": ("string", False),
    }
    right = {"unit": "km", "size": 10, "level": 2.0, "place": {"lat": 1, "tags": ["a", "b"]}, "rows": [{"id": 1}, {"id": 7}], "odd key": "x"}
    wrong = {
        "size": 10.5, "level": 3, "place": {"lat": "north", "tags": ["a", 5], "more": 1}, "rows": [{"id": 0}, {}, 4], "odd key": 1, "unit": "cm",
    }
    few = {"unit": None, "size": -1, "place": None, "rows": {}, "level": "x"}
    texts = [json.dumps(x) for x in (right, wrong, few)]
    found = checked(spark, texts, parameters)
    assert found[texts[0]] == ("", {**right, "level": 2})
    assert found[texts[1]][0].split("; ") == sorted([
        "level is not allowed", "odd key is not string", "place.lat is not number", "place.tags[1] is not string", "rows[0].id is below 1",
        "missing rows[1].id", "rows[2] is not object", "size is above 10", "unit is not allowed", "unknown place.more",
    ])
    assert found[texts[2]][0].split("; ") == sorted(["level is not integer", "missing unit", "rows is not array", "size is below 0"])
