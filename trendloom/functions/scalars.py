"""Scalar expressions: clamping, months, hashes, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIOR = 25.0


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def shrink(x: Column, reliability: Column, prior: float = PRIOR) -> Column:
    """x pulled to a prior as far as it is unreliable."""
    return clamp(reliability * x + (1 - reliability) * prior)


def log_saturation(n: Column, full: int) -> Column:
    return F.log1p(F.greatest(n, F.lit(0))) / F.log1p(F.lit(float(full)))


def month_index(ts: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_distance(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0), month_index(later) - month_index(earlier))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def shift_month(ts: Column, months: int) -> Column:
    """First of the month that many months away."""
    return F.trunc(F.add_months(F.trunc(ts, "MM"), months), "MM")


def canonical_time(text: Column) -> Column:
    """A date or timestamp as UTC seconds; a date alone is its midnight, a time without a zone is UTC."""
    return F.date_trunc("second", F.try_to_timestamp(text))


def strict_zoned_time(text: Column) -> Column:
    """A timestamp that names its zone, else null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def non_empty(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def required(x: Column, name: str) -> Column:
    """x trimmed, or an error that names it where it is null or blank."""
    trimmed = non_empty(x)
    return F.when(trimmed.isNull(), F.raise_error(F.lit(f"{name} must be a non-empty string"))).otherwise(trimmed)


def short_hash(*parts: Column, kind: str = "sha256", length: int = 16, by: str = "|") -> Column:
    joined = F.concat_ws(by, *parts)
    return F.substring(F.sha2(joined, 256) if kind == "sha256" else F.sha1(joined), 1, length)


def cluster_id(profile: Column, members: Column) -> Column:
    """A name that depends on the profile and the members alone, whatever their order."""
    return F.concat(F.lit("micro:"), profile, F.lit(":"), short_hash(profile, F.array_join(F.array_sort(members), "\n"), by="\n"))


def trend_id(profile: Column, direction: Column, first_seen: Column, cluster: Column) -> Column:
    return F.concat(F.lit("trend:"), profile, F.lit(":"), short_hash(profile, direction, first_seen, cluster, length=20))


def merge_counts(a: Column, b: Column) -> Column:
    """Two counter maps added up by key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull())


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """Seconds to wait: what the server says, or a doubling delay, within a bound."""
    return F.least(F.lit(most), F.coalesce(retry_after, F.lit(base) * F.pow(F.lit(2.0), attempt)))
