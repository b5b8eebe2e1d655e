"""Queries to providers as rows: validation, stable ids and request parameters by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _outside(c: str, low: int, high: int | None = None) -> Column:
    return ~F.coalesce((F.col(c) >= low) & (F.col(c) <= (high if high is not None else (1 << 31) - 1)), F.lit(False))


def _checked(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """df with violations, an array of the names of broken rules."""
    return df.withColumn("violations", F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules))))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0).drop("violations")


def works(df: DataFrame) -> DataFrame:
    """technology_direction, source_profile, from_date, to_date, query_text, query_id, per_page, max_pages and
    extra_filters (array), with effective_text, effective_id, filter and violations."""
    text = F.trim(F.coalesce("query_text", "technology_direction"))
    raw = F.concat_ws("|", F.lower(F.trim("technology_direction")), F.lower(F.trim("source_profile")), F.col("from_date").cast("string"), F.col("to_date").cast("string"), F.lower(text), F.array_join("extra_filters", ","))
    dates = F.array(F.concat(F.lit("from_publication_date:"), F.col("from_date").cast("string")), F.concat(F.lit("to_publication_date:"), F.col("to_date").cast("string")))
    out = df.withColumns({"effective_text": text, "effective_id": F.coalesce(F.nullif("query_id", F.lit("")), F.concat(F.lit("openalex:"), F.substring(F.sha1(raw), 1, 12))), "filter": F.array_join(F.concat(dates, "extra_filters"), ",")})
    return _checked(out, [("technology_direction", _blank("technology_direction")), ("source_profile", _blank("source_profile")), ("dates", ~F.coalesce(F.col("from_date") <= F.col("to_date"), F.lit(False))), ("per_page", _outside("per_page", 1, 200)), ("max_pages", _outside("max_pages", 1))])


def repositories(df: DataFrame) -> DataFrame:
    rules = [(c, _blank(c)) for c in ("technology_direction", "source_profile", "query_text", "query_id")]
    rules += [("per_page", _outside("per_page", 1, 100)), ("max_pages", _outside("max_pages", 1)), ("sort", ~F.col("sort").isin("stars", "forks", "help-wanted-issues", "updated")), ("order", ~F.col("order").isin("asc", "desc"))]
    return _checked(df, rules)


def histories(df: DataFrame) -> DataFrame:
    """A repository needs owner and name, and at least one alias or distinctive term."""
    some = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return _checked(df, [("repository", ~F.coalesce(F.col("repository").rlike("^[^/].*/.*[^/]$"), F.lit(False))), ("technology_direction", _blank("technology_direction")), ("source_profile", _blank("source_profile")), ("terms", ~(some("aliases") | some("distinctive_terms")))])


def patents(df: DataFrame) -> DataFrame:
    """A bounded CQL query; its pages start at 1."""
    raw = F.concat_ws("|", F.lower(F.trim("technology_direction")), F.col("source_profile"), F.col("cql"), F.col("per_page").cast("string"))
    out = df.withColumns({"effective_id": F.coalesce(F.nullif("query_id", F.lit("")), F.concat(F.lit("epo_ops:"), F.substring(F.sha2(raw, 256), 1, 16))), "start": F.lit(1)})
    return _checked(out, [("technology_direction", _blank("technology_direction")), ("source_profile", _blank("source_profile")), ("cql", _blank("cql") | (F.length("cql") > 500) | F.col("cql").rlike(r"[\r\n]")), ("per_page", _outside("per_page", 1, 25)), ("max_pages", _outside("max_pages", 1, 20))])


def monthly_samples(records: DataFrame, key: str, at: str, order: list[str], most: int = 15) -> DataFrame:
    """key, period, n and up to most sample ids (the first by order) of each month."""
    from pyspark.sql import Window

    df = records.withColumn("period", F.date_format(at, "yyyy-MM"))
    place = F.row_number().over(Window.partitionBy(key, "period").orderBy(*order))
    n = df.groupBy(key, "period").agg(F.count(F.lit(1)).alias("n"))
    few = df.withColumn("place_", place).where(F.col("place_") <= most).groupBy(key, "period").agg(F.transform(F.array_sort(F.collect_list(F.struct("place_", order[-1]))), lambda x: x[order[-1]]).alias("samples"))
    return n.join(few, [key, "period"])
