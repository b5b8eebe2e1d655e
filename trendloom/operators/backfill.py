"""Historical backfill: which window of the past to query for a trend, and when to widen it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Months of the first window, of a widening, at most, and margin, by profile (fixed values).
POLICIES = {"software_ai": (24, 12, 60, 2), "hardware_semiconductor": (36, 18, 96, 3), "materials_energy": (48, 24, 120, 4), "bio_medtech": (48, 24, 120, 4), "mixed": (36, 18, 84, 3)}


def _months(profile: Column, which: int) -> Column:
    out = F.lit(POLICIES["mixed"][which])
    for p, row in POLICIES.items():
        out = F.when(profile == p, row[which]).otherwise(out)
    return out


def windows(trends: DataFrame, as_of: date, most: int = 12) -> DataFrame:
    """(trend_id, step, start, end): the first window ends at as_of; while the trend was first seen within the
    margin of a window's start, the next one reaches further back, up to the profile's limit. Every step is a
    row of one sequence, cut where the rule stops, so nothing loops over trends."""
    p = F.col("profile")
    first = F.add_months(F.trunc(F.lit(as_of), "MM"), 1 - _months(p, 0))
    limit = F.add_months(F.trunc(F.lit(as_of), "MM"), 1 - _months(p, 2))
    df = trends.select("trend_id", "profile", F.to_date("first_seen").alias("first_seen"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("step"))
    at = lambda k: F.greatest(limit, F.add_months(first, -k * _months(p, 1)))
    df = df.withColumns({"start": at(F.col("step")), "end": F.when(F.col("step") == 0, F.lit(as_of)).otherwise(F.date_sub(at(F.col("step") - 1), 1)), "limit_": limit, "margin_": _months(p, 3)})
    go_on = (F.col("start") > F.col("limit_")) & (F.col("first_seen") < F.add_months("start", F.col("margin_")))
    before = Window.partitionBy("trend_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("allowed", F.coalesce(F.min(go_on).over(before), F.lit(True))).where("allowed and start <= end").select("trend_id", "step", "start", "end")


def query_text(medoid: Column, topics: Column, cap: int = 320) -> Column:
    """The medoid's title and up to two topics that aren't part of it, cut at cap characters."""
    new = F.slice(F.filter(topics, lambda t: ~F.contains(F.lower(medoid), F.lower(t))), 1, 2)
    return F.substring(F.concat_ws(" ", medoid, new), 1, cap)


def top_labels(df: DataFrame, key: str, labels: str, n: int = 5) -> DataFrame:
    """The n most frequent labels of each key; ties go to the one that came first, then to the lesser label."""
    each = df.select(key, F.posexplode(labels).alias("pos", "label"), F.col("seq") if "seq" in df.columns else F.lit(0).alias("seq"))
    counts = each.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first", "label"))
    return counts.withColumn("place", place).where(F.col("place") <= n).select(key, "place", "label", "n")
