"""JSON Schema, the common keywords, compiled to column predicates.

Schemas are plan-time constants: each distinct one becomes one boolean column
over the parsed answer. A keyword outside the list makes the check errored.
"""
from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.jsonpath import kind_of, same_json

KEYWORDS = {"$schema", "$id", "title", "description", "type", "properties", "required", "items", "enum", "const",
            "minimum", "maximum", "minLength", "maxLength", "pattern", "additionalProperties", "minItems", "maxItems"}


class Unsupported(ValueError):
    pass


def _of_type(value: Column, name: str) -> Column:
    if name == "integer":
        number = F.try_variant_get(value, "$", "double")
        return (kind_of(value) == "number") & (number == F.floor(number))
    return kind_of(value) == name


def _key(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def predicate(schema, value: Column) -> Column:
    """Whether a variant satisfies a schema."""
    if schema is True:
        return F.lit(True)
    if schema is False:
        return F.lit(False)
    if not isinstance(schema, dict):
        raise Unsupported("not an object or boolean")
    extra = set(schema) - KEYWORDS
    if extra:
        raise Unsupported(f"keywords {sorted(extra)}")
    holds = F.lit(True)
    kind = kind_of(value)
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        any_of = F.lit(False)
        for name in names:
            any_of = any_of | _of_type(value, name)
        holds = holds & any_of
    for key, test in (("minimum", lambda v: number >= v), ("maximum", lambda v: number <= v)):
        if key in schema:
            holds = holds & ((kind != "number") | test(float(schema[key])))
    for key, test in (("minLength", lambda v: F.char_length(text) >= v), ("maxLength", lambda v: F.char_length(text) <= v),
                      ("pattern", lambda v: text.rlike(v))):
        if key in schema:
            holds = holds & ((kind != "string") | test(schema[key]))
    for key in ("enum", "const"):
        if key in schema:
            allowed = schema["enum"] if key == "enum" else [schema["const"]]
            any_of = F.lit(False)
            for item in allowed:
                any_of = any_of | same_json(value, F.parse_json(F.lit(json.dumps(item))))
            holds = holds & any_of
    for name in schema.get("required", []):
        holds = holds & ((kind != "object") | F.try_variant_get(value, _key(name), "variant").isNotNull())
    for name, inner in schema.get("properties", {}).items():
        part = F.try_variant_get(value, _key(name), "variant")
        holds = holds & ((kind != "object") | part.isNull() | predicate(inner, part))
    if schema.get("additionalProperties", True) is not True:
        named = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        others = F.filter(entries, lambda e: ~F.array_contains(named, e["key"]))
        rule = schema["additionalProperties"]
        holds = holds & ((kind != "object") | F.forall(others, lambda e: predicate(rule, e["value"])))
    items = F.try_variant_get(value, "$", "array<variant>")
    for key, test in (("minItems", lambda v: F.size(items) >= v), ("maxItems", lambda v: F.size(items) <= v)):
        if key in schema:
            holds = holds & ((kind != "array") | test(schema[key]))
    if "items" in schema:
        holds = holds & ((kind != "array") | F.forall(items, lambda v: predicate(schema["items"], v)))
    return F.coalesce(holds, F.lit(False))


def schema_columns(document: Column, schemas: list[str]) -> tuple[Column, Column, Column]:
    raw = F.col("config")["schema"]
    error = F.when(raw.isNull() | (raw == ""), "no_schema").when(F.try_parse_json(raw).isNull(), "schema_not_json")
    passed = F.lit(None).cast("boolean")
    known = F.lit(False)
    for text in dict.fromkeys(schemas):
        try:
            compiled = predicate(json.loads(text), document)
        except (Unsupported, json.JSONDecodeError) as exc:
            error = error.when(raw == text, F.lit(f"unsupported_schema: {exc}"))
            continue
        passed = F.when(raw == text, compiled).otherwise(passed)
        known = known | (raw == text)
    return error.when(~known, "schema_not_compiled"), passed, F.lit("schema_mismatch")
