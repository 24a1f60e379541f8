"""Grouped reports.  Each takes ledger rows or cube rows, already filtered."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from usagelens.plans.cube import aggregate, with_hour
from usagelens.plans.filters import in_scope


def _cost_first(rows: DataFrame, *before, ties):
    return rows.orderBy(*before, F.desc("cost_micros"), *ties)


def by_user(source: DataFrame) -> DataFrame:
    rows = aggregate(source, ["username"], ["reqs", "it", "ot", "cw", "cr", "cost_micros"])
    return _cost_first(rows, ties=["username"])


def newest_first(days: DataFrame, newest: int | None) -> DataFrame:
    """Days from the newest on, at most ``newest`` of them; None means all."""
    ordered = days.orderBy(F.desc("day"))
    return ordered if newest is None else ordered.limit(newest)


def by_day(source: DataFrame, newest: int | None = 30) -> DataFrame:
    """Newest days with data: a top-k report."""
    rows = aggregate(source, ["day"], ["reqs", "it", "ot", "io", "cost_micros"])
    return newest_first(rows, newest)


def by_model(source: DataFrame) -> DataFrame:
    """NULL and empty model stay separate groups."""
    rows = aggregate(source, ["model"], ["reqs", "it", "ot", "cost_micros"])
    return _cost_first(rows, ties=["model"])


def by_user_client(source: DataFrame) -> DataFrame:
    rows = source.withColumn("client", F.coalesce("client", F.lit("other")))
    rows = aggregate(rows, ["username", "client"], ["reqs", "io", "cost_micros"])
    return _cost_first(rows, "username", ties=["client"])


def _labelled_model(source: DataFrame) -> DataFrame:
    return source.withColumn("model", F.coalesce("model", F.lit("-")))


def by_user_model(source: DataFrame, label: bool = True) -> DataFrame:
    """``label`` shows a NULL model as a dash; without it NULL is its own group."""
    rows = _labelled_model(source) if label else source
    rows = aggregate(rows, ["username", "model"], ["reqs", "io", "cost_micros"])
    return _cost_first(rows, "username", ties=["model"])


def by_day_user(source: DataFrame) -> DataFrame:
    rows = aggregate(source, ["day", "username"], ["reqs", "io", "cost_micros"])
    return _cost_first(rows, F.desc("day"), ties=["username"])


def by_day_user_model(source: DataFrame) -> DataFrame:
    rows = aggregate(_labelled_model(source), ["day", "username", "model"], ["io", "cost_micros"])
    return _cost_first(rows, "day", "username", ties=["model"])


def today_cells(usage: DataFrame, as_of: date, tz: str, username: str | None = None) -> DataFrame:
    """Hours of the report date by user, in no order; takes no other date range."""
    rows = in_scope(usage, username).where(F.col("day") == as_of.isoformat())
    return aggregate(with_hour(rows, tz), ["hour", "username"], ["reqs", "io", "cost_micros"])


def today_hour_user(usage: DataFrame, as_of: date, tz: str, username: str | None = None) -> DataFrame:
    return _cost_first(today_cells(usage, as_of, tz, username), "hour", ties=["username"])


def by_day_hour_user(source: DataFrame, tz: str) -> DataFrame:
    """Stored day, hour of the time stamp."""
    rows = aggregate(with_hour(source, tz), ["day", "hour", "username"], ["io", "cost_micros"])
    return rows.orderBy("day", "hour", "username")


def by_hour_of_day(source: DataFrame, tz: str) -> DataFrame:
    return aggregate(with_hour(source, tz), ["hour"], ["io", "cost_micros"]).orderBy("hour")


def today_counters(usage: DataFrame, as_of: date) -> DataFrame:
    """Requests and tokens of the day per user, as the quota counters restart from."""
    rows = usage.where(F.col("day") == as_of.isoformat())
    rows = aggregate(rows, ["username"], ["reqs", "all4"])
    return rows.select("username", F.col("reqs").alias("requests"),
                       F.coalesce("all4", F.lit(0)).alias("tokens"))


def summary(source: DataFrame) -> DataFrame:
    """Totals, and the cost of the newest day that has data."""
    days = aggregate(source, ["day"], ["reqs", "it", "ot", "cw", "cr", "cost_micros"])

    def total(name):
        return F.coalesce(F.sum(name), F.lit(0).cast("long"))

    return days.agg(
        total("reqs").alias("total_reqs"),
        (total("it") + total("ot") + total("cw") + total("cr")).alias("total_tokens"),
        total("cost_micros").alias("total_cost_micros"),
        F.coalesce(F.max_by(F.coalesce("cost_micros", F.lit(0)), "day"), F.lit(0))
        .cast("long").alias("latest_day_cost_micros"),
    )


def users_summary(users: DataFrame) -> DataFrame:
    return users.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("enabled") != 0).alias("enabled"))
