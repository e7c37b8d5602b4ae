"""Declarations against a JSON schema: compiled into one expression that lists what is wrong, by path.

Of JSON Schema: type, enum, const, required, properties, additionalProperties (false), items, minItems, maxItems,
uniqueItems, minProperties, pattern, minLength, maxLength, minimum, maximum. Documents are Variant values, so rows
of different shapes are checked alike, and nothing leaves the plan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "array<struct<path:string,rule:string>>"
_NONE = lambda: F.array().cast(ERRORS)


def _kind(v: Column, name: str) -> Column:
    shape = F.schema_of_variant(v)
    return {
        "object": shape.startswith("OBJECT"),
        "array": shape.startswith("ARRAY"),
        "string": shape == "STRING",
        "boolean": shape == "BOOLEAN",
        "null": shape == "VOID",
        "integer": (shape == "BIGINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$"),
        "number": (shape == "BIGINT") | shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"),
    }[name]


def _found(wrong: Column, at: Column, rule: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule"))).cast(ERRORS)).otherwise(_NONE())


def _member(v: Column, name: str) -> Column:
    return F.element_at(v.try_cast("map<string,variant>"), F.lit(name))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _NONE()


def _errors(v: Column, schema: dict, at: Column) -> Column:
    """Errors of a value that is there."""
    out: list[Column] = []
    kinds = schema.get("type")
    if kinds is not None:
        fits = F.lit(False)
        for k in [kinds] if isinstance(kinds, str) else kinds:
            fits |= _kind(v, k)
        out.append(_found(~fits, at, "type"))
    if "enum" in schema:
        out.append(_found(~F.to_json(v).isin([json.dumps(x, ensure_ascii=False) for x in schema["enum"]]), at, "enum"))
    if "const" in schema:
        out.append(_found(F.to_json(v) != json.dumps(schema["const"], ensure_ascii=False), at, "const"))
    text, number = F.when(_kind(v, "string"), v.try_cast("string")), F.when(_kind(v, "number"), v.try_cast("double"))
    for rule, wrong in (
        ("pattern", lambda x: ~text.rlike(x)),
        ("minLength", lambda x: F.length(text) < x),
        ("maxLength", lambda x: F.length(text) > x),
        ("minimum", lambda x: number < x),
        ("maximum", lambda x: number > x),
    ):
        if rule in schema:
            out.append(_found(wrong(schema[rule]), at, rule))
    items = v.try_cast("array<variant>")
    if "minItems" in schema:
        out.append(_found(F.size(items) < schema["minItems"], at, "minItems"))
    if "maxItems" in schema:
        out.append(_found(F.size(items) > schema["maxItems"], at, "maxItems"))
    if "minProperties" in schema:
        out.append(_found(F.size(v.try_cast("map<string,variant>")) < schema["minProperties"], at, "minProperties"))
    if schema.get("uniqueItems"):
        shown = F.transform(items, lambda x: F.to_json(x))
        out.append(_found(F.size(F.array_distinct(shown)) < F.size(shown), at, "uniqueItems"))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: _errors(x, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        out.append(F.coalesce(each, _NONE()))
    inner = lambda name: F.concat(F.when(at == "", "").otherwise(F.concat(at, F.lit("."))), F.lit(name))
    whole = _kind(v, "object")
    for name in schema.get("required", []):
        out.append(_found(whole & _member(v, name).isNull(), inner(name), "required"))
    for name, below in schema.get("properties", {}).items():
        child = _member(v, name)
        out.append(F.when(child.isNotNull(), _errors(child, below, inner(name))).otherwise(_NONE()))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.map_keys(v.try_cast("map<string,variant>")), F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
        listed = F.transform(F.array_sort(extra), lambda k: F.struct(F.concat(F.when(at == "", "").otherwise(F.concat(at, F.lit("."))), k).alias("path"), F.lit("additionalProperties").alias("rule")))
        out.append(F.coalesce(listed.cast(ERRORS), _NONE()))
    return _joined(out)


def schema_errors(document: Column, schema: dict) -> Column:
    """Errors (path, rule) of a Variant value; a null one, which no JSON gave, has the error `document`."""
    return F.when(document.isNull(), F.array(F.struct(F.lit("").alias("path"), F.lit("document").alias("rule"))).cast(ERRORS)).otherwise(_errors(document, schema, F.lit("")))


def checked(rows: DataFrame, document: str, schema: dict, keys: list[str] | None = None) -> DataFrame:
    """rows with errors: what the schema finds, and `duplicate` where several rows have one key.

    keys: names of the document's members that tell declarations apart; of those without one, none is a duplicate.
    """
    found = rows.withColumn("errors", schema_errors(F.col(document), schema))
    if not keys:
        return found
    own = F.concat_ws("/", *(F.try_variant_get(F.col(document), f"$.{k}", "string") for k in keys))
    whole = F.lit(True)
    for k in keys:
        whole &= F.try_variant_get(F.col(document), f"$.{k}", "string").isNotNull()
    found = found.withColumn("_key", F.when(whole, own))
    # counted apart, so that rows without a key don't meet in one task
    twice = found.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    found = found.join(twice, "_key", "left")
    again = F.array(F.struct(F.lit(".".join(keys)).alias("path"), F.lit("duplicate").alias("rule"))).cast(ERRORS)
    return found.withColumn("errors", F.when(F.col("_n").isNotNull(), F.concat("errors", again)).otherwise(F.col("errors"))).drop("_key", "_n")


#: Ranks of who says something. Fixed values.
TIERS = ["authoritative", "approved_interpretation", "organisational_precedent", "example", "heuristic"]
_SAID = {"type": "string", "minLength": 1}

#: What knowledge bases declare: memories, tests of controls, and contracts of controls, which say all of these.
MEMORY = {"type": "object", "required": ["memory_id", "authority_tier", "statement", "controls"], "properties": {"memory_id": _SAID, "authority_tier": {"enum": TIERS}, "statement": _SAID, "controls": {"type": "array", "minItems": 1}}}
TESTING = {"type": "object", "required": ["control_id", "framework", "title", "testing", "authority_tier", "provenance"], "properties": {"control_id": _SAID, "title": _SAID, "authority_tier": {"enum": TIERS}, "provenance": {"type": "object", "required": ["source_file"], "properties": {"source_file": _SAID}}}}
SAID_OF_CONTROLS = ["title", "requirement", "elements", "boundary", "test_of_design", "test_of_operating_effectiveness", "near_miss_failure_modes", "resolutions"]
CONTRACT = {"type": "object", "required": SAID_OF_CONTROLS, "properties": {name: {"minLength": 1, "minItems": 1, "minProperties": 1} for name in SAID_OF_CONTROLS}}
