"""Live counters over a ledger stream, in local time of the report zone.

Each function aggregates the rows of one micro-batch (or of a table); ``sinks`` stores and adds the parts up.
"""

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.clock import wall_clock, wall_clock_text


def _timed(usage: DataFrame, time_ms: str, tz: str) -> DataFrame:
    return usage.withColumn("local_ts", wall_clock(time_ms, tz))


def _all_tokens():
    return (F.col("input_tokens") + F.col("output_tokens")
            + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


def day_counters(usage: DataFrame, tz: str) -> DataFrame:
    """Requests and tokens per user and local day."""
    grouped = _timed(usage, "ts_ms", tz).groupBy(F.window("local_ts", "1 day"), "username").agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum(_all_tokens()), F.lit(0)).alias("tokens"))
    return grouped.select(F.substring(wall_clock_text(F.col("window.start")), 1, 10).alias("day"),
                          "username", "requests", "tokens")


def window_totals(usage: DataFrame, tz: str, width: str = "1 hour") -> DataFrame:
    """Tumbling totals per hour (or per minute)."""
    grouped = _timed(usage, "ts_ms", tz).groupBy(F.window("local_ts", width)).agg(
        F.count(F.lit(1)).alias("reqs"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("io"),
        F.sum("cost_micros").alias("cost_micros"))
    start = wall_clock_text(F.col("window.start")).alias("window_start")
    return grouped.select(start, "reqs", "io", "cost_micros")


def request_rate(requests: DataFrame, tz: str, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Requests per user in sliding windows over start times: monitoring, not admission."""
    grouped = _timed(requests, "start_ms", tz).groupBy(F.window("local_ts", width, step), "username").agg(
        F.count(F.lit(1)).alias("reqs"))
    start = wall_clock_text(F.col("window.start")).alias("window_start")
    return grouped.select(start, "username", "reqs")
