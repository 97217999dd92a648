"""Tool calls and their results: linked, ordered, checked against schemas, and printed as canonical JSON.

Calls and results meet in a hash join on conversation and call identifier. Levels order
a conversation: a call comes after every call that it names as a dependency, its result
right after it, so sorting by (level, seq) is a topological order without gathering a
conversation anywhere. Schemas are compiled into column expressions: types, required and
unknown keys, enumerations, bounds, and the same for nested objects and for the items of
arrays. A number without a fraction is an integer, however it is written. Canonical JSON has
sorted keys, no spaces and no null fields.

Cases: a null argument text is an empty object; text that is not one JSON object from end to
end makes the call invalid and is kept as a string, character by character; of several results of a call the first by (seq,
content) is linked and all are counted; of several calls with one identifier the first
by (seq, name, arguments) is linked, the others are ``duplicate`` and have no result;
repeated rows are treated alike; calls without an identifier are ``unanswered``; calls on
or behind a cycle have no level; dependencies that do not exist are a problem and
otherwise ignored; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Types of variant values that satisfy a schema type; an integer must also have no fraction.
_KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT", "DOUBLE", "DECIMAL"),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}

#: A parameter is (type, required), or has ``type`` and, where wanted, ``required``, ``enum`` (texts or
#: numbers), ``minimum``, ``maximum``, ``properties`` (parameters of an object) and ``items`` (of an array).
Parameter = tuple[str, bool] | dict
Schemas = dict[str, dict[str, Parameter]]
_NONE = "array<string>"


def _no_problems() -> Column:
    return F.array().cast(_NONE)


def _has(value: Column, kind: str) -> Column:
    own = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    fits = own.isin(*_KINDS[kind])
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        fits &= (own == "BIGINT") | (number == F.floor(number)) | (F.abs(number) >= 2.0**53)
    return fits


def _wrong_value(value: Column, parameter: dict, label: Column) -> Column:
    """What is wrong with a value that is there."""
    kind = parameter["type"]
    inner = [_no_problems()]
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    if "enum" in parameter:
        allowed = parameter["enum"]
        known = number.isin(*[float(x) for x in allowed]) if kind in ("integer", "number") else text.isin(*map(str, allowed))
        inner.append(F.when(~known, F.array(F.concat(label, F.lit(" is not allowed")))).otherwise(_no_problems()))
    for bound, beyond, words in (("minimum", lambda m: number < m, "is below"), ("maximum", lambda m: number > m, "is above")):
        if bound in parameter:
            most = parameter[bound]
            inner.append(F.when(beyond(most), F.array(F.concat(label, F.lit(f" {words} {most}")))).otherwise(_no_problems()))
    if "properties" in parameter:
        inner.append(_wrong_object(value, parameter["properties"], F.concat(label, F.lit("."))))
    if "items" in parameter:
        items = parameter["items"] if isinstance(parameter["items"], dict) else {"type": parameter["items"][0]}
        each = F.transform(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda x, i: _wrong_value(x, items, F.concat(label, F.lit("["), i.cast("string"), F.lit("]"))),
        )
        inner.append(F.coalesce(F.flatten(each), _no_problems()))
    right = F.concat(*inner) if len(inner) > 1 else _no_problems()
    return F.when(F.coalesce(_has(value, kind), F.lit(False)), right).otherwise(F.array(F.concat(label, F.lit(f" is not {kind}"))))


def _wrong_object(value: Column, parameters: dict[str, Parameter], label: Column) -> Column:
    """What is wrong with the keys of an object."""
    found = []
    for key, parameter in sorted(parameters.items()):
        if isinstance(parameter, tuple):
            parameter = {"type": parameter[0], "required": parameter[1]}
        own, name = F.try_variant_get(value, f"$['{key}']", "variant"), F.concat(label, F.lit(key))
        absent = own.isNull() | F.is_variant_null(own)
        missing = F.array(F.concat(F.lit("missing "), name)) if parameter.get("required") else _no_problems()
        found.append(F.when(absent, missing).otherwise(_wrong_value(own, parameter, name)))
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
    surplus = F.array_except(keys, F.array(*[F.lit(k) for k in sorted(parameters)]).cast(_NONE))
    found.append(F.coalesce(F.transform(surplus, lambda k: F.concat(F.lit("unknown "), label, k)), _no_problems()))
    return F.concat(*found)


def parsed_object(text: Column) -> Column:
    """The object that ``text`` is from end to end, else null.

    A parser is content with the first value of a text. So the text becomes a field of an
    object, and a key that the text cannot hold must follow it.
    """
    end = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"'), end, F.lit('":1}')))
    fields = F.try_variant_get(whole, "$", "map<string, variant>")
    value = F.try_variant_get(whole, "$.value", "variant")
    alone = (F.size(fields) == 2) & F.array_contains(F.map_keys(fields), end)
    return F.when(alone & F.schema_of_variant(value).startswith("OBJECT"), value)


def _as_string(text: Column) -> Column:
    """A VARIANT string of exactly these characters."""
    field = F.to_json(F.struct(text.alias("s")))
    return F.try_parse_json(F.substr(field, F.lit(6), F.length(field) - 6))


def problems(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Sorted list of what is wrong with the arguments of a call of that name."""
    found = F.when(parsed.isNull(), F.array(F.lit("not a JSON object")))
    for tool, parameters in sorted(schemas.items()):
        found = found.when(name == tool, F.array_sort(_wrong_object(parsed, parameters, F.lit(""))))
    return found.otherwise(F.array(F.lit("unknown tool")))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``level`` of calls (distinct), 0 for those without dependencies.

    ``edges`` has ``conv_id``, ``call_id``, ``needs``, all of them calls. A round places the
    calls whose dependencies are all placed; there are as many rounds as the longest
    chain. What no round places lies on a cycle or behind one.
    """
    key = ["conv_id", "call_id"]
    waiting = edges
    placed = new = materialize(calls.join(waiting, key, "left_anti").withColumn("level", F.lit(0)), "level")
    level = 0
    while not new.isEmpty():
        level += 1
        ready = new.select("conv_id", F.col("call_id").alias("needs"))
        rest = materialize(waiting.join(ready, ["conv_id", "needs"], "left_anti").select("conv_id", "call_id", "needs"), "waiting")
        new = materialize(
            waiting.select(*key).distinct().join(rest, key, "left_anti").withColumn("level", F.lit(level)), "level"
        )
        waiting, placed = rest, placed.unionByName(new)
    return placed


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call with its level, status, problems and canonical record.

    ``calls``: ``conv_id``, ``seq``, ``call_id``, ``name``, ``arguments`` (JSON text), ``needs`` (array of
    identifiers). ``results``: ``conv_id``, ``seq``, ``call_id``, ``content``.
    """
    key = ["conv_id", "call_id"]
    calls = materialize(calls.select("conv_id", "seq", "call_id", "name", "arguments", "needs"), "calls")
    first = calls.groupBy(*key).agg(F.min(F.struct("seq", "name", "arguments")).alias("first"))
    answers = results.groupBy(*key).agg(F.min(F.struct("seq", "content")).alias("answer"), F.count("*").alias("n_results"))
    known = calls.where("call_id is not null").select(*key).distinct()
    needs = calls.select(*key, F.explode(F.array_distinct("needs")).alias("needs")).where("call_id is not null and needs is not null").distinct()
    edges = needs.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi")
    absent = needs.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_anti").groupBy(*key).agg(
        F.array_sort(F.transform(F.collect_set("needs"), lambda n: F.concat(F.lit("no call "), n))).alias("absent")
    )
    ordered = levels(known, materialize(edges, "edges"))

    # one row for each identifier, so the joins below add no rows
    ids = first.join(answers.hint("shuffle_hash"), key, "left").join(ordered, key, "left").join(absent, key, "left")
    rows = calls.join(ids, key, "left")
    text = F.coalesce("arguments", F.lit("{}"))
    own = F.struct("seq", "name", "arguments").eqNullSafe(F.col("first"))
    status = (
        F.when(F.col("call_id").isNull(), "unanswered").when(~own, "duplicate").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    )
    made = rows.select(
        "conv_id", "call_id", "seq", "name", "level", status.alias("status"), text.alias("_text"), parsed_object(text).alias("_parsed"),
        F.coalesce("absent", F.array().cast("array<string>")).alias("_absent"),
        F.when(status == "linked", F.col("answer.content")).alias("_content"), F.when(own, F.coalesce("n_results", F.lit(0))).otherwise(0).alias("n_results"),
    )
    made = made.withColumn("_wrong", F.concat(problems(F.col("name"), F.col("_parsed"), schemas), "_absent"))
    record = F.to_json(
        F.struct(
            F.coalesce("_parsed", _as_string(F.col("_text"))).alias("arguments"),
            F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.col("_content").alias("result"), F.col("status"),
        )
    )
    return made.select(
        "conv_id", "call_id", "seq", "name", "level", "status", "n_results", (F.size("_wrong") == 0).alias("valid"),
        F.array_join("_wrong", "; ").alias("problems"), record.alias("record"),
    )
