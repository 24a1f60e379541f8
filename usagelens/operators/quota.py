"""Quota counters, quota status and the request-limit decision in closed form."""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.clock import local_day
from usagelens.operators.ordered import running_before

MINUTE_MS = 60_000


def binds(limit) -> Column:
    """A limit of NULL or zero never binds."""
    return F.coalesce(F.col(limit) if isinstance(limit, str) else limit, F.lit(0)) != 0


def quota_status(users: DataFrame, counters: DataFrame) -> DataFrame:
    """Daily limits of every key against its user's counters; reserves nothing."""
    counted = users.join(counters.select("username", "requests", "tokens"), "username", "left")
    used_requests = F.coalesce("requests", F.lit(0).cast("long"))
    used_tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    request_limit, token_limit = F.col("daily_request_limit"), F.col("daily_token_limit")

    def left(limit, used):
        return F.when(binds(limit), F.greatest(limit - used, F.lit(0).cast("long")))

    return counted.select(
        "api_key", "username", used_requests.alias("requests"), used_tokens.alias("tokens"),
        F.when(binds(request_limit) & (used_requests >= request_limit), "request_limit")
        .when(binds(token_limit) & (used_tokens >= token_limit), "token_limit")
        .otherwise("ok").alias("status"),
        left(request_limit, used_requests).alias("requests_left"),
        left(token_limit, used_tokens).alias("tokens_left"))


def counter_events(requests: DataFrame, tz: str) -> DataFrame:
    """Requests by start day and tokens by completion day, per user.

    Both events of a row come out of one scan and are summed before the shuffle.
    A completion without tokens leaves no event.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    tokens = F.coalesce("total_tokens", zero)
    events = requests.select("username", F.inline(F.array(
        F.struct(local_day("start_ms", tz).alias("day"), one.alias("requests"), zero.alias("tokens")),
        F.struct(local_day("end_ms", tz).alias("day"), zero.alias("requests"), tokens.alias("tokens")))))
    return (
        events.where((F.col("requests") != 0) | (F.col("tokens") != 0))
        .groupBy("username", "day")
        .agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))
    )


def admission_request_limit(requests: DataFrame, tz: str, limit="daily_request_limit") -> DataFrame:
    """Admission when only a daily request limit is set: the first ``limit`` of each user's day.

    Positions are counted per minute and then inside the minute, so a user's day
    is spread over its minutes.
    """
    rows = requests.withColumns({"day": local_day("start_ms", tz), "_one": F.lit(1).cast("long")})
    placed = running_before(rows, ["username", "day"], ["start_ms", "id"], {"_one": "earlier"}, MINUTE_MS)
    bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return placed.withColumn(
        "decision", F.when(binds(bound) & (F.col("earlier") >= bound), "request_limit").otherwise("ok")
    ).drop("_one")
