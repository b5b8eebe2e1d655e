"""JSON documents against a JSON schema, compiled into VARIANT expressions: no Python touches a document.

A schema becomes one column, the array of violations, each a path and the keyword that is broken (``$.actors[0].kind: enum``).
Supported are the keywords below; another one raises an error when the schema is compiled, so that no rule is dropped in
silence. A value of the wrong type is told once, as ``type``.

A document is parsed once, a value is taken from it once and asked for its type once: each is bound to a variable, which all
rules share. Written out, they would be evaluated again for every rule that names them, and inner values for every rule
above them, too.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
_RULES = {"type", "const", "enum", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "minItems", "maxItems", "items", "properties", "required", "additionalProperties", "anyOf", "oneOf", "allOf", "$ref"}
#: What schema_of_variant calls the types.
_KINDS = {"null": "^VOID", "boolean": "^BOOLEAN", "string": "^STRING", "array": "^ARRAY", "object": "^OBJECT", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"}
_FORMATS = ("date-time", "date", "uri")


def _none() -> Column:
    return F.array().cast("array<string>")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a variable that holds value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is(v: Column, of: Column, kind: str) -> Column:
    """Whether v, whose type is named of, is of a kind."""
    if kind == "integer":
        return _is(v, of, "number") & (F.try_variant_get(v, "$", "double") % 1 == 0)
    return of.rlike(_KINDS[kind])


def _equal(v: Column, of: Column, value) -> Column:
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return _is(v, of, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, (int, float)):
        return _is(v, of, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return _is(v, of, "string") & (F.variant_get(v, "$", "string") == value)
    raise ValueError("const and enum hold strings, numbers, booleans and null")


def _format(text: Column, name: str) -> Column:
    if name == "date-time":
        return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$") & F.try_to_timestamp(F.upper(text)).isNotNull()
    if name == "date":
        return text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$")


def _resolved(rule: dict, root: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
    ref = rule.get("$ref")
    if ref is None:
        return rule, seen
    if ref in seen:
        raise ValueError(f"{ref} refers to itself")
    if not ref.startswith("#/"):
        raise ValueError(f"{ref} isn't in this schema")
    at = root
    for part in ref[2:].split("/"):
        at = at[part]
    return _resolved({**at, **{k: v for k, v in rule.items() if k != "$ref"}}, root, (*seen, ref))


def _value(v: Column, rule: dict | bool, path: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """array<string> of the violations of a value, none if it isn't there."""
    inside = lambda x: _bound(F.schema_of_variant(x), lambda of: _checks(x, of, rule, path, root, seen))
    return _bound(v, lambda x: F.when(x.isNotNull(), inside(x)).otherwise(_none()))


def _checks(v: Column, of: Column, rule: dict | bool, path: Column, root: dict, seen: tuple[str, ...]) -> Column:
    """array<string> of the violations of a value that is there, whose type is named of."""
    if isinstance(rule, bool):
        return _none() if rule else F.array(F.concat(path, F.lit(": false")))
    rule, seen = _resolved(rule, root, seen)
    unknown = set(rule) - _RULES - _NOTES
    if unknown:
        raise ValueError(f"unsupported keywords: {', '.join(sorted(unknown))}")
    found: list[Column] = []
    told = lambda keyword, ok: F.when(~F.coalesce(ok, F.lit(False)), F.array(F.concat(path, F.lit(f": {keyword}")))).otherwise(_none())
    when = lambda kind, x: F.when(_is(v, of, kind), x).otherwise(_none())

    if "const" in rule:
        found.append(told("const", _equal(v, of, rule["const"])))
    if "enum" in rule:
        ok = F.lit(False)
        for value in rule["enum"]:
            ok = ok | F.coalesce(_equal(v, of, value), F.lit(False))
        found.append(told("enum", ok))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    for keyword, ok in (("minLength", lambda n: F.length(text) >= n), ("maxLength", lambda n: F.length(text) <= n), ("pattern", lambda p: text.rlike(p))):
        if keyword in rule:
            found.append(when("string", told(keyword, ok(rule[keyword]))))
    if "format" in rule:
        if rule["format"] not in _FORMATS:
            raise ValueError(f"unsupported format: {rule['format']}")
        found.append(when("string", told("format", _format(text, rule["format"]))))
    for keyword, ok in (("minimum", lambda n: number >= n), ("maximum", lambda n: number <= n)):
        if keyword in rule:
            found.append(when("number", told(keyword, ok(rule[keyword]))))

    each = F.try_variant_get(v, "$", "array<variant>")
    for keyword, ok in (("minItems", lambda n: F.size(each) >= n), ("maxItems", lambda n: F.size(each) <= n)):
        if keyword in rule:
            found.append(when("array", told(keyword, ok(rule[keyword]))))
    if "items" in rule:
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        found.append(when("array", F.flatten(F.transform(each, lambda x, i: _value(x, rule["items"], at(i), root, seen)))))

    known = rule.get("properties", {})
    for name in {*known, *rule.get("required", ())}:
        if "'" in name or "\\" in name:
            raise ValueError(f"unsupported name: {name}")
    for name in rule.get("required", ()):
        found.append(when("object", F.when(F.variant_get(v, f"$['{name}']", "variant").isNull(), F.array(F.concat(path, F.lit(f".{name}: required")))).otherwise(_none())))
    for name, inner in known.items():
        value = F.variant_get(v, f"$['{name}']", "variant")
        found.append(when("object", _value(value, inner, F.concat(path, F.lit(f".{name}")), root, seen)))
    more = rule.get("additionalProperties", True)
    if more is not True:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        rest = F.filter(entries, lambda e: ~e["key"].isin(*known)) if known else entries
        inside = lambda e: F.concat(path, F.lit("."), e["key"])
        other = F.transform(rest, lambda e: F.concat(inside(e), F.lit(": additionalProperties"))) if more is False else F.flatten(F.transform(rest, lambda e: _value(e["value"], more, inside(e), root, seen)))
        found.append(when("object", other))

    for inner in rule.get("allOf", ()):
        found.append(_checks(v, of, inner, path, root, seen))
    for keyword, ok in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if keyword in rule:
            fits = [(F.size(_checks(v, of, inner, path, root, seen)) == 0).cast("int") for inner in rule[keyword]]
            found.append(told(keyword, ok(sum(fits[1:], fits[0]))))

    every = F.concat(*found) if found else _none()
    if "type" not in rule:
        return every
    kinds = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
    fits = F.lit(False)
    for kind in kinds:
        fits = fits | F.coalesce(_is(v, of, kind), F.lit(False))
    return F.when(fits, every).otherwise(F.array(F.concat(path, F.lit(": type"))))


def violations(document: Column, schema: dict | str) -> Column:
    """The violations of a JSON text, sorted; ``$: json`` for null and for what isn't JSON."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    told = lambda v: F.array_sort(F.array_distinct(_value(v, schema, F.lit("$"), schema, ())))
    return _bound(F.try_parse_json(document), lambda v: F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(told(v)))


def broken(df: DataFrame, document: str, schema: dict | str) -> DataFrame:
    """The rows of df whose document breaks the schema, with their violations."""
    # a filter on the column would be pushed below it and take the violations again
    found = F.filter(F.array(violations(F.col(document), schema)), lambda x: F.size(x) > 0)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != "violations"), F.explode(found).alias("violations"))
