"""Steps whose cost grew faster than their input, or was paid more than once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.operators import state
from trendloom.sources import contract


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_parsed_once_and_asked_for_its_type_once(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string", "minLength": 2}, "b": {"type": ["integer", "null"], "minimum": 1}}}
    df = spark.createDataFrame([('{"a": "x", "b": 0}',), ('{"a": "xy", "b": null}',)], "doc string")
    found = contract.broken(df, "doc", schema)
    plan = _plan(found).lower()
    # the document, and each of its two fields
    assert plan.count("parsejson") + plan.count("parse_json") == 1
    assert plan.count("schemaofvariant(") + plan.count("schema_of_variant(") == 3
    assert [r.violations for r in found.collect()] == [["$.a: minLength", "$.b: minimum"]]
    assert found.columns == ["doc", "violations"]


def test_a_vector_is_normalised_without_its_length_for_each_entry(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    found = df.select(vectors.normalised(F.transform("v", lambda x: x * 2)).alias("u"))
    assert _plan(found).count("SQRT(") == 1
    assert [r.u for r in found.collect()] == [[0.6, 0.8], None, None]


def test_small_keys_share_products(spark):
    """300 keys of two clusters and three states: the best state of each, in one call for all of a batch's keys."""
    rng = np.random.default_rng(5)
    made = [(f"k{k}", rng.normal(size=(2, 4 + k % 2)), rng.normal(size=(3, 4 + k % 2))) for k in range(300)]
    for _, c, s in made:
        s[2] = s[1] = c[0] * 2
    clusters = spark.createDataFrame([(k, f"{k}-{i}", v.tolist()) for k, c, _ in made for i, v in enumerate(c)] + [("k0", "none", None), ("k1", "zero", [0.0] * 5)], "key string, cluster_id string, centroid array<double>")
    states = spark.createDataFrame([(k, f"{k}-s{i}", 9 - i, v.tolist()) for k, _, s in made for i, v in enumerate(s)], "key string, trend_id string, created_at int, centroid array<double>")
    got = {r.cluster_id: (r.trend_id, r.similarity) for r in state.nearest(clusters, states, ["key"], 0.3).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {f"{k}-{i}": (f"{k}-s{2 if row.argmax() else 0}", row.max()) for k, c, s in made for i, row in enumerate(unit(c) @ unit(s).T) if row.max() >= 0.3}
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(abs(got[k][1] - x) < 1e-12 for k, (_, x) in want.items())
    lists = lambda kind, rows: pa.array(rows, pa.list_(pa.struct([("id", pa.string()), *kind, ("v", pa.list_(pa.float64()))])))
    own = lists([], [[{"id": f"{k}-{i}", "v": v.tolist()} for i, v in enumerate(c)] for k, c, _ in made[::2]])
    held = lists([("created_at", pa.int32())], [[{"id": f"{k}-s{i}", "created_at": 9 - i, "v": v.tolist()} for i, v in enumerate(s)] for k, _, s in made[::2]])
    both = state._matched(own, held, 0.3).to_pylist()
    assert {r["cluster_id"]: r["trend_id"] for r in both} == {k: t for k, (t, _) in want.items() if int(k[1:].split("-")[0]) % 2 == 0}
