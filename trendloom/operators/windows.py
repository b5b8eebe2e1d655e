"""Joins of rows with windows of time that overlap and differ by case, without a nested loop.

A window is dealt over bins of a fixed number of days, a row is in one bin, and both meet by case and bin; what a bin holds
beyond the window is tested afterwards. A window is in as many bins as it covers, so bins about as long as a window
keep both few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(day)) / days).cast("int")


def within(rows: DataFrame, windows: DataFrame, case: str, time: str, days: int = 31, start: str = "start", end: str = "end") -> DataFrame:
    """Each row with each window of its case that holds its time: rows' columns, then windows' (without the case). Both ends
    are days and included. Null cases, times and ends meet nothing, nor do windows that end before they start."""
    if days < 1:
        raise ValueError("days must be at least 1")
    dealt = windows.where(F.col(start) <= F.col(end)).withColumn("bin_", F.explode(F.sequence(_bin(F.col(start), days), _bin(F.col(end), days))))
    dealt = dealt.withColumnRenamed(case, "case_")
    held = rows.where(F.col(time).isNotNull()).withColumn("at_", _bin(F.col(time), days))
    day = F.to_date(F.col(time))
    met = held.join(dealt, (F.col(case) == F.col("case_")) & (F.col("at_") == F.col("bin_")) & day.between(F.col(start), F.col(end)))
    return met.drop("case_", "at_", "bin_")


def counted(rows: DataFrame, windows: DataFrame, case: str, time: str, days: int = 31, start: str = "start", end: str = "end") -> DataFrame:
    """windows with n, the rows of their case within each: 0 where there are none. Rows are counted by day before they meet a
    window, so a case of any number of rows has as many as days."""
    daily = rows.where(F.col(case).isNotNull() & F.col(time).isNotNull()).groupBy(case, F.to_date(F.col(time)).alias("day_")).agg(F.count(F.lit(1)).alias("rows_"))
    keys = [case, start, end]
    hit = within(daily, windows.select(*keys).distinct(), case, "day_", days, start, end).groupBy(*keys).agg(F.sum("rows_").alias("n"))
    return windows.join(hit, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
