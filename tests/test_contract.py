"""Documents against schemas."""

import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions import canonical
from trendloom.sources import contract

SCHEMA = {
    "$schema": "x", "title": "a record", "type": "object", "additionalProperties": False, "required": ["version", "id", "seen_at"],
    "$defs": {"time_or_null": {"anyOf": [{"type": "null"}, {"type": "string", "format": "date"}, {"type": "string", "format": "date-time"}]}},
    "properties": {
        "version": {"type": "string", "const": "0.2.0"}, "id": {"type": "string", "minLength": 3, "maxLength": 9, "pattern": "^[a-z]"}, "seen_at": {"type": "string", "format": "date-time"},
        "made_at": {"$ref": "#/$defs/time_or_null"}, "url": {"type": ["string", "null"], "format": "uri"}, "kind": {"enum": ["a", 2, True, None]}, "share": {"type": "number", "minimum": 0, "maximum": 1},
        "count": {"type": "integer"}, "flags": {"type": "object", "additionalProperties": {"type": ["boolean", "number"]}},
        "people": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 1}, "tags": {"type": "array", "items": {"type": "string"}}}}},
        "either": {"oneOf": [{"type": "string"}, {"type": "string", "minLength": 3}]}, "both": {"allOf": [{"minimum": 2}, {"maximum": 4}]}, "never": False,
    },
}
GOOD = {"version": "0.2.0", "id": "abc", "seen_at": "2024-02-29T10:00:00Z"}

CASES = [
    ({}, []), ({"made_at": None}, []), ({"made_at": "2024-02-29"}, []), ({"made_at": "2024-02-29T10:00:00.5+02:00"}, []), ({"url": None}, []), ({"url": "https://a.b/c"}, []), ({"kind": 2}, []), ({"kind": None}, []), ({"kind": True}, []),
    ({"share": 0}, []), ({"share": 1.0}, []), ({"count": 3}, []), ({"count": 3.0}, []), ({"flags": {"x": True, "y": 1.5}}, []), ({"people": [{"name": "Ä", "tags": ["t"]}]}, []), ({"either": "ab"}, []), ({"both": 3}, []), ({"both": "text"}, []),
    ({"version": "0.3.0"}, ["$.version: const"]), ({"version": 2}, ["$.version: type"]), ({"id": "ab"}, ["$.id: minLength"]), ({"id": "abcdefghij"}, ["$.id: maxLength"]), ({"id": "Abc"}, ["$.id: pattern"]), ({"id": None}, ["$.id: type"]),
    ({"seen_at": "2024-02-30T10:00:00Z"}, ["$.seen_at: format"]), ({"seen_at": "2024-02-28T10:00:00"}, ["$.seen_at: format"]), ({"made_at": "yesterday"}, ["$.made_at: anyOf"]), ({"made_at": 5}, ["$.made_at: anyOf"]), ({"url": "no url"}, ["$.url: format"]),
    ({"kind": "b"}, ["$.kind: enum"]), ({"kind": 1}, ["$.kind: enum"]), ({"share": -0.1}, ["$.share: minimum"]), ({"share": 2}, ["$.share: maximum"]), ({"share": "1"}, ["$.share: type"]), ({"count": 1.5}, ["$.count: type"]),
    ({"flags": {"x": "yes", "y": 1}}, ["$.flags.x: type"]), ({"flags": []}, ["$.flags: type"]), ({"people": []}, ["$.people: minItems"]), ({"people": [{"name": "x"}] * 4}, ["$.people: maxItems"]),
    ({"people": [{"name": "x"}, {"name": "", "age": 3, "tags": ["a", 1]}, {}]}, ["$.people[1].age: additionalProperties", "$.people[1].name: minLength", "$.people[1].tags[1]: type", "$.people[2].name: required"]),
    ({"extra": 1}, ["$.extra: additionalProperties"]), ({"either": "abc"}, ["$.either: oneOf"]), ({"either": 1}, ["$.either: oneOf"]), ({"both": 1}, ["$.both: minimum"]), ({"never": 1}, ["$.never: false"]),
]


def test_each_rule_and_its_path(spark):
    rows = [(i, json.dumps({**GOOD, **more}, ensure_ascii=False), want) for i, (more, want) in enumerate(CASES)]
    rows += [(100, None, ["$: json"]), (101, "{", ["$: json"]), (102, "[1]", ["$: type"]), (103, '{"id": "abc"}', ["$.seen_at: required", "$.version: required"])]
    df = spark.createDataFrame(rows, "i int, doc string, want array<string>")
    got = {r.i: (r.got, r.want) for r in df.select("i", "want", contract.violations(F.col("doc"), SCHEMA).alias("got")).collect()}
    assert {i: g for i, (g, _) in got.items()} == {i: w for i, (_, w) in got.items()}
    assert contract.broken(df, "doc", json.dumps(SCHEMA)).count() == sum(bool(w) for _, _, w in rows)


def test_what_a_schema_may_not_ask(spark):
    for bad in ({"dependentRequired": {}}, {"format": "ipv4"}, {"enum": [[1]]}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, {"$ref": "other.json"}, {"required": ["it's"]}):
        with pytest.raises(ValueError):
            contract.violations(F.col("doc"), bad)


def test_canonical_json_is_one_text_for_all_of_a_document(spark):
    docs = [{"b": 1, "a": [1, 2, {"z": None, "y": True}], "ä": 'ü\n\t"\\/', "é": "日本𝔘"}, {"n": 12345678901234567890, "x": 1.5, "e": -0.25}, [], {}, "s", 3, {"a b": {"": 1}}, {"\u0001": "\u0001\b\f\r"}]
    rows = [(i, json.dumps(d, ensure_ascii=ascii_, indent=indent, sort_keys=sort)) for i, d in enumerate(docs) for ascii_, indent, sort in ((True, 1, False), (False, None, True))]
    df = spark.createDataFrame([*rows, (99, None), (99, "{")], "i int, t string").select("i", canonical.canonical_json(F.col("t")).alias("c"), canonical.content_id(F.col("t"), "page-").alias("id"))
    for r in df.collect():
        assert r.c == (None if r.i == 99 else json.dumps(docs[r.i], sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    assert df.select("i", "id").distinct().count() == len(docs) + 1
