"""Evaluation: retrieval metrics, confusion matrices, threshold choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def ranked(similarities: DataFrame, query: str = "query_id", doc: str = "doc_id", similarity: str = "similarity") -> DataFrame:
    """Rank of each document of a query: similarity and then id, both falling."""
    return similarities.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(similarity), F.desc(doc))))


def retrieval(ranks: DataFrame, by: list[str], query: str = "query_id") -> DataFrame:
    """Recall at 1, 3, 5, mean reciprocal rank, and the share of queries whose best relevant document beats all
    hard negatives (of *all* queries, also those without any). ranks has relevant and hard flags."""
    hit = lambda k: F.count_if(F.col("relevant") & (F.col("rank") <= k)) / F.nullif(F.count_if(F.col("relevant")), F.lit(0))
    each = ranks.groupBy(*by, query).agg(
        *(hit(k).alias(f"r{k}") for k in (1, 3, 5)),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("best"),
        F.min(F.when(F.col("hard"), F.col("rank"))).alias("worst"),
    )
    return averaged(each.withColumn("won", F.coalesce(F.col("best") < F.col("worst"), F.lit(False))), by)


def averaged(each: DataFrame, by: list[str]) -> DataFrame:
    """The means of queries' own figures: r1, r3, r5, best (a rank, or null), won."""
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(F.coalesce(f"r{k}", F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in (1, 3, 5)), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("won").cast("double")), 6).alias("hard_negative_win_rate"))


def confusion(df: DataFrame, by: list[str], expected: Column, predicted: Column) -> DataFrame:
    e, p = F.coalesce(expected, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*by).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    return counts.select("*", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"), F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("fpr"))


def thresholds(df: DataFrame, grid: list[float], expected: str = "expected", score: str = "score") -> DataFrame:
    """Counts at each threshold of the grid (a fixed number of rows), in one pass."""
    each = df.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    return confusion(each, ["threshold"], F.col(expected), F.col(score) >= F.col("threshold"))


def chosen_threshold(counts: DataFrame, most_fp: int = 0, least_recall: float = 0.8) -> DataFrame:
    return counts.where((F.col("fp") <= most_fp) & (F.col("recall") >= least_recall)).agg(F.max("threshold").alias("threshold"))
