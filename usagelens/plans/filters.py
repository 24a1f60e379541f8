"""Scope, date range and eligibility filters of the reports."""

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.clock import days_back, local_day
from usagelens.schema import TOKEN_COLUMNS

# Days before the report date that each named range reaches back.
_REACH = {"7": 6, "period": 6, "30": 29}


def in_scope(usage: DataFrame, username: str | None = None) -> DataFrame:
    """All users, or one of them."""
    return usage if not username else usage.where(F.col("username") == username)


def in_range(usage: DataFrame, as_of: date, name: str = "period") -> DataFrame:
    """Named range on the stored day; ``all`` has no bound, an unknown name is the current period."""
    if name == "all":
        return usage
    if name == "today":
        return usage.where(F.col("day") == as_of.isoformat())
    reach = _REACH.get(name, _REACH["period"])
    return usage.where(F.col("day") >= days_back(as_of, reach))


def rolling_days(usage: DataFrame, now_ms: int, days: float | None, tz: str) -> DataFrame:
    """Rows of the last ``days`` times 24 hours; no days means all time.

    The day bound is implied by the time bound and prunes folders.  It is one
    day wider because a row may be stored under the day of another zone.
    """
    if not days:
        return usage
    since = int(now_ms - days * 86_400_000)
    first = local_day(F.lit(since - 86_400_000).cast("long"), tz)
    return usage.where((F.col("ts_ms") >= since) & (F.col("day") >= first))


def select_usage(usage: DataFrame, as_of: date, name: str = "period",
                 username: str | None = None) -> DataFrame:
    return in_range(in_scope(usage, username), as_of, name)


def has_tokens() -> Column:
    """Any token at all, counting NULL as zero."""
    total = F.lit(0).cast("long")
    for column in TOKEN_COLUMNS:
        total = total + F.coalesce(F.col(column), F.lit(0).cast("long"))
    return total > 0
