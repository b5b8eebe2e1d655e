"""Durable trend states: planning a batch of clusters against a snapshot, and applying it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scalars, vectors
from trendloom.sources.shared import materialize


#: Vectors of a block; two blocks meet in one product.
BLOCK = 1000
#: Pairs of two blocks up to which they are multiplied together with others, and pairs that are multiplied at once.
FEW, PAIRS = 4096, 1 << 16


def _blocks(df: DataFrame, keys: list[str], name: str, vector: str) -> DataFrame:
    """keys, dim_ (the vectors' length) and arrays of about BLOCK rows of df each, as column name."""
    df = df.where(F.col(vector).isNotNull()).withColumn("dim_", F.size(vector))
    group = [*keys, "dim_"]
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks_"))
    dealt = df.join(sizes, group).withColumn("block_", F.pmod(F.xxhash64("id"), F.col("blocks_")))
    rest = [c for c in df.columns if c not in group]
    return dealt.groupBy(*group, "block_").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("block_")


def _unit(rows: pa.StructArray) -> np.ndarray:
    v = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    with np.errstate(all="ignore"):
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matched(own: pa.ListArray, held: pa.ListArray, threshold: float) -> pa.RecordBatch:
    """cluster_id, similarity, created_at, trend_id of the best of a row's states for each of its clusters, if it is near
    enough. One row is one product; several rows, which are small, are multiplied pair by pair, all at once."""
    n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, held))
    c, s = own.flatten(), held.flatten()
    # equal products: the first in this order counts
    keys = {"row": pa.array(np.repeat(np.arange(len(m)), m)), "a": s.field("created_at"), "b": s.field("id")}
    s = s.take(pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys]))
    if len(n) == 1:
        product = np.nan_to_num(_unit(c) @ _unit(s).T, nan=-2.0)
        top = product.argmax(axis=1)
        value = product[np.arange(len(top)), top]
    else:
        times = np.repeat(m, n)
        start = np.cumsum(times) - times
        left = np.repeat(np.arange(len(c)), times)
        right = np.repeat(np.repeat(np.cumsum(m) - m, n) - start, times) + np.arange(len(left))
        product = np.nan_to_num(np.einsum("ij,ij->i", _unit(c)[left], _unit(s)[right]), nan=-2.0)
        value = np.maximum.reduceat(product, start)
        equal = np.flatnonzero(product == value[left])
        top = right[equal[np.flatnonzero(np.diff(left[equal], prepend=-1))]]
    hit = np.flatnonzero(value >= threshold)
    at = pa.array(top[hit])
    return pa.RecordBatch.from_arrays([c.field("id").take(pa.array(hit)), pa.array(value[hit]), s.field("created_at").take(at), s.field("id").take(at)], ["cluster_id", "similarity", "created_at", "trend_id"])


def nearest(clusters: DataFrame, states: DataFrame, keys: list[str], threshold: float = 0.82) -> DataFrame:
    """cluster_id, trend_id, similarity of the best state of each cluster among those with equal keys; ties go
    to the state that was created first, then to the least id. Vectors meet in blocks, each pair of which is one
    product, so that a key of any size is dealt over tasks and no pair becomes a row; small keys share products. Null vectors, and those
    that have no direction or another length, match nothing."""
    own = _blocks(clusters.select(*keys, F.col("cluster_id").alias("id"), F.col("centroid").cast("array<double>").alias("v")), keys, "c", "v")
    ids = states.select(*keys, F.col("trend_id").alias("id"), "created_at", F.col("centroid").cast("array<double>").alias("v"))
    met = own.join(_blocks(ids, keys, "s", "v"), [*keys, "dim_"]).select("c", "s")
    shape = f"cluster_id {clusters.schema['cluster_id'].dataType.simpleString()}, similarity double, created_at {states.schema['created_at'].dataType.simpleString()}, trend_id {states.schema['trend_id'].dataType.simpleString()}"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = batch.column(0), batch.column(1)
            n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, held))
            few = n * m <= FEW
            for row in np.flatnonzero(~few):
                yield _matched(own.slice(row, 1), held.slice(row, 1), threshold)
            # vectors of a row have one length
            size = own.flatten().field("v").value_lengths().to_numpy(zero_copy_only=False)[np.cumsum(n) - n]
            for length in np.unique(size[few]):
                rows = np.flatnonzero(few & (size == length))
                pairs = n[rows] * m[rows]
                for part in np.split(rows, np.flatnonzero(np.diff((np.cumsum(pairs) - pairs) // PAIRS)) + 1):
                    yield _matched(own.take(pa.array(part)), held.take(pa.array(part)), threshold)

    first = met.mapInArrow(best, shape).groupBy("cluster_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "created_at", "trend_id")).alias("best"))
    return first.select("cluster_id", F.col("best.trend_id").alias("trend_id"), (-F.col("best.s")).alias("similarity"))


def owners(clusters: DataFrame, ownership: DataFrame) -> DataFrame:
    """cluster_id, owner of clusters that hold an observation a trend already has. Two owners raise an error."""
    met = clusters.select("cluster_id", F.explode("member_ids").alias("observation_id")).join(ownership, "observation_id")
    found = met.groupBy("cluster_id").agg(F.min("trend_id").alias("owner"), F.max("trend_id").alias("other"))
    clash = F.raise_error(F.concat(F.lit("cluster bridges two trends: "), F.col("cluster_id")))
    return found.select("cluster_id", F.when(F.col("owner") != F.col("other"), clash).otherwise(F.col("owner")).alias("owner"))


def plan(clusters: DataFrame, states: DataFrame, ownership: DataFrame, threshold: float = 0.82) -> DataFrame:
    """clusters (cluster_id, profile, direction_key, model, member_ids, centroid, first_seen) with trend_id and
    reason, and fresh, the observations that it brings. All are planned against the states before the batch, so clusters
    of one batch never join each other: deterministic_replay (nothing is new), existing_observation, centroid, or new.
    An observation that several clusters of a trend share counts for the first of them alone."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    near = nearest(clusters, states, ["profile", "direction_key", "model"], threshold)
    new = scalars.trend_id(F.col("profile"), F.col("direction_key"), F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("cluster_id"))
    aimed = clusters.join(owners(clusters, ownership), "cluster_id", "left").join(near, "cluster_id", "left")
    aimed = materialize(aimed.select("cluster_id", F.coalesce("owner", "trend_id", new).alias("trend_id"), "similarity", "owner", F.col("trend_id").isNotNull().alias("near"), "member_ids"), "aimed")
    fresh = first_bringers(aimed, ownership).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("fresh"))
    df = clusters.join(aimed.drop("member_ids"), "cluster_id").join(fresh, "cluster_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    reason = F.when(F.col("owner").isNotNull() & (F.col("fresh") == 0), "deterministic_replay").when(F.col("owner").isNotNull(), "existing_observation").when(F.col("near"), "centroid").otherwise("new")
    return df.select(*clusters.columns, "trend_id", "similarity", reason.alias("reason"), "fresh")


def first_bringers(aimed: DataFrame, ownership: DataFrame) -> DataFrame:
    """(trend_id, observation_id, cluster_id) of the observations that no trend owns yet: of a trend's clusters that
    hold one, the first in order of cluster_id brings it, since clusters are applied in that order."""
    each = aimed.select("trend_id", "cluster_id", F.explode("member_ids").alias("observation_id")).join(ownership.select("observation_id"), "observation_id", "left_anti")
    return each.groupBy("trend_id", "observation_id").agg(F.min("cluster_id").alias("cluster_id"))


def applied_centroids(planned: DataFrame, states: DataFrame) -> DataFrame:
    """trend_id, n, centroid after the batch: clusters are folded into the old centroid in order of cluster_id,
    each normalised and weighted by its new observations; the sum is normalised after each step."""
    steps = planned.where("fresh > 0").groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "fresh", "centroid"))).alias("steps"))
    df = steps.join(states.select("trend_id", F.col("observation_count").alias("old_n"), F.col("centroid").alias("old")), "trend_id", "left")
    kind = "struct<n:bigint,v:array<double>>"
    start = F.struct(F.coalesce("old_n", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("old").cast("array<double>"), F.array().cast("array<double>")).alias("v")).cast(kind)

    def fold(s, c):
        mixed = F.zip_with(s["v"], vectors.normalised(c["centroid"].cast("array<double>")), lambda a, b: a * s["n"] + b * c["fresh"])
        v = F.when(F.size(s["v"]) == 0, c["centroid"].cast("array<double>")).otherwise(mixed)
        return F.struct((s["n"] + c["fresh"]).alias("n"), vectors.normalised(v).alias("v")).cast(kind)

    return df.withColumn("s", F.aggregate("steps", start, fold)).select("trend_id", F.col("s.n").alias("n"), F.col("s.v").alias("centroid"))


def new_members(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members (trend_id, observation_id) that their trend doesn't have yet, so that a replay changes nothing."""
    return members.distinct().join(known, ["trend_id", "observation_id"], "left_anti")


def single_direction(members: DataFrame) -> DataFrame:
    """cluster_id, direction_key; a cluster whose observations name several directions raises an error."""
    by = members.groupBy("cluster_id").agg(F.min("direction_key").alias("direction_key"), F.count_distinct("direction_key").alias("n"))
    return by.select("cluster_id", F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("several directions in "), F.col("cluster_id")))).otherwise(F.col("direction_key")).alias("direction_key"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn_ = 1").drop("rn_")
