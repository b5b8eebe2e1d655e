"""Monthly series: buckets, calendars, runs, sustained periods, leak-free prefixes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.scalars import month_index, month_key, shift_month


def monthly(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("trend_id", month_key(F.col("event_time")).alias("period"), "evidence_type", "provider").agg(F.count(F.lit(1)).alias("n"))


def monthly_totals(evidence: DataFrame) -> DataFrame:
    """A bucket's total, and its counts by type and by provider, in one pass. Rows go to their trend's month first, and
    make a row for each grouping set only there, so that one narrow row of each is shuffled."""
    df = evidence.select("trend_id", month_key(F.col("event_time")).alias("period"), "evidence_type", "provider").repartition("trend_id", "period")
    df = df.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("set_"))
    df = df.withColumns({c: F.when(F.col("set_") == i, F.col(c)) for i, c in ((1, "evidence_type"), (2, "provider"))})
    return df.groupBy("trend_id", "period", "set_", "evidence_type", "provider").agg(F.count(F.lit(1)).alias("n")).drop("set_")


def coverage(evidence: DataFrame) -> DataFrame:
    """Distinct trends and observations of each profile, its first day and its providers. A piece of evidence makes a row for
    its trend and one for its observation, of a number alone; days go with the few providers."""
    df = evidence.select("profile", "trend_id", "observation_id", "provider", "event_time", F.explode(F.array(*map(F.lit, range(3)))).alias("kind_"))
    id_ = F.when(F.col("kind_") == 0, F.col("trend_id")).when(F.col("kind_") == 1, F.col("observation_id")).alias("id_")
    few = lambda c: F.when(F.col("kind_") == 2, F.col(c)).alias(c)
    found = df.select("profile", "kind_", id_, few("provider"), few("event_time")).groupBy("profile", "kind_", "id_", "provider").agg(F.min("event_time").alias("at_"))
    count = lambda i: F.count(F.when(F.col("kind_") == i, F.col("id_")))
    return found.groupBy("profile").agg(count(0).alias("trends"), count(1).alias("observations"), F.date_format(F.min("at_"), "yyyy-MM-dd").alias("coverage_start"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers_used"))


def longest_active_run(evidence: DataFrame) -> DataFrame:
    """Gaps and islands over each trend's active months."""
    active = evidence.select("trend_id", month_index(F.col("event_time")).alias("mi")).distinct()
    island = active.withColumn("island", F.col("mi") - F.row_number().over(Window.partitionBy("trend_id").orderBy("mi")))
    return island.groupBy("trend_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("trend_id").agg(F.max("n").alias("longest"))


def recent_months(evidence: DataFrame, as_of: date, months: int) -> DataFrame:
    """Each trend's last months up to as_of, with zeros."""
    first = shift_month(F.lit(as_of), 1 - months)
    calendar = evidence.select("trend_id").distinct().select("trend_id", F.explode(F.sequence(first, F.trunc(F.lit(as_of), "MM"), F.expr("interval 1 month"))).alias("d"))
    calendar = calendar.select("trend_id", month_key(F.col("d")).alias("period"))
    counts = evidence.groupBy("trend_id", month_key(F.col("event_time")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, ["trend_id", "period"], "left").select("trend_id", "period", F.coalesce("n", F.lit(0)).alias("n"))


def trajectory(evidence: DataFrame, n: int) -> DataFrame:
    """An array of each trend's last n buckets, oldest first."""
    counts = evidence.groupBy("trend_id", month_key(F.col("event_time")).alias("period")).agg(F.count(F.lit(1)).alias("total"))
    whole = counts.groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("period", "total"))).alias("all"))
    size = F.least(F.size("all"), F.lit(n))
    return whole.select("trend_id", F.slice("all", F.size("all") - size + 1, size).alias("trajectory"))


def sustained(curve: DataFrame, key: str = "case_id", period: str = "period", count: str = "n") -> DataFrame:
    """First and first sustained active period of each case: a period counts as sustained when it is active and
    at least one of the next two is. curve has a row for each period, also for those without evidence."""
    w = Window.partitionBy(key).orderBy(period)
    later = (F.coalesce(F.lead(count, 1).over(w), F.lit(0)) > 0).cast("int") + (F.coalesce(F.lead(count, 2).over(w), F.lit(0)) > 0).cast("int")
    marked = curve.withColumn("ok_", (F.col(count) > 0) & (later >= 1))
    return marked.groupBy(key).agg(F.min(F.when(F.col(count) > 0, F.col(period))).alias("first_active"), F.min(F.when(F.col("ok_"), F.col(period))).alias("first_sustained"))


def prefix_sustained(curve: DataFrame, key: str = "case_id", period: str = "period", count: str = "n") -> DataFrame:
    """For each period, what ``sustained`` would say had the curve ended there. Period i is confirmed by the
    first active one of the next two, so a running minimum over confirmations never looks ahead."""
    w = Window.partitionBy(key).orderBy(period)
    next_active = F.when(F.lead(count, 1).over(w) > 0, F.lead(period, 1).over(w)).when(F.lead(count, 2).over(w) > 0, F.lead(period, 2).over(w))
    marked = curve.withColumn("confirmed_at", F.when(F.col(count) > 0, next_active))
    confirmed = marked.where("confirmed_at is not null").groupBy(key, F.col("confirmed_at").alias(period)).agg(F.min(period).alias("start_"))
    every = marked.join(confirmed, [key, period], "left")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return every.select(key, period, count, F.min("start_").over(upto).alias("first_sustained"), F.sum(count).over(upto).alias("running"))


def before_origin(curve: DataFrame, origin, key: str = "case_id", start: str = "start", end: str = "end", count: str = "n") -> DataFrame:
    """Evidence in windows that start before the origin, and in those that end before it."""
    return curve.groupBy(key).agg(F.sum(F.when(F.col(start) < origin, F.col(count)).otherwise(0)).alias("started_before"), F.sum(F.when(F.col(end) < origin, F.col(count)).otherwise(0)).alias("ended_before"))


def calendar_windows(start, end):
    """array<struct<period, start, end>> of the months from start to end, the last one cut at end."""
    firsts = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(firsts, lambda d: F.struct(F.date_format(d, "yyyy-MM").alias("period"), F.greatest(d, start).alias("start"), F.least(F.last_day(d), end).alias("end")))


def first_periods(curve: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """by and, for each field, the first period in which it is above 0; a field that never is raises an error."""
    never = lambda f: F.raise_error(F.concat(F.lit(f"no active period for {f}: "), F.col(by).cast("string")))
    found = curve.groupBy(by).agg(*(F.min(F.when(F.col(f) > 0, F.col("period"))).alias(f) for f in fields))
    return found.select(by, *(F.coalesce(f, never(f)).alias(f"first_{f}") for f in fields))
