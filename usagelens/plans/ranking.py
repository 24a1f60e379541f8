"""Shares, ranks and trailing counts over aggregated rows."""

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions.clock import local_day
from usagelens.functions.pricing import round_micros


MINUTE_MS = 60_000
HOT_SHARE = 1000  # a value is hot if it has more than one in so many rows


def chart_totals(rows: DataFrame, key: str) -> DataFrame:
    """Chart values of a report: input plus output tokens, cost to 4 digits."""
    zero = F.lit(0).cast("long")
    return rows.select(
        key, (F.coalesce("it", zero) + F.coalesce("ot", zero)).alias("tok"),
        round_micros(F.coalesce("cost_micros", zero), 4).alias("cost_micros"))


def share_of_max(rows: DataFrame, value: str) -> DataFrame:
    """Percent of the largest value, at most 100; a largest value of zero divides by one.

    The maximum is a scalar subquery, not a window over all rows in one task.
    """
    own = F.coalesce(F.col(value), F.lit(0))
    top = rows.agg(F.max(own)).scalar()
    top = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(1)).otherwise(top)
    return rows.withColumn("pct_of_max", F.least(own / top * 100.0, F.lit(100.0)))


def share_of_total(rows: DataFrame, value: str) -> DataFrame:
    """Rows with a positive value and their part of the total."""
    positive = rows.where(F.col(value) > 0)
    total = positive.agg(F.sum(value)).scalar()
    return positive.withColumn("share", F.col(value) / total).orderBy(F.desc(value))


def global_rank(rows: DataFrame, value: str, target: str = "rank") -> DataFrame:
    """SQL ``rank()`` of a non-negative integer value, largest first, without one big sort task.

    Values fall into at most 16129 fixed bands by magnitude.  A rank is one, plus
    the rows in higher bands, plus the rows above it inside the band.  A value
    with more than a thousandth of all rows is hot: there are fewer than 1000, so
    their ranks are broadcast, and their rows are spread by their content in the
    join on the other values.
    """
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    banded = rows.withColumn("_v", amount).withColumn(
        "_band", F.floor(F.log2(F.greatest(F.col("_v"), F.lit(0)).cast("double") + 1) * 256).cast("int"))
    values = banded.groupBy("_band", "_v").agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = (
        values.groupBy("_band").agg(F.sum("_n").alias("_in_band"))  # at most 16129 rows
        .select("_band", F.coalesce(F.sum("_in_band").over(higher), F.lit(0)).alias("_above"))
    )
    inside = Window.partitionBy("_band").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        values.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(bands), "_band")
        .select("_v", "_n", (F.col("_above") + F.col("_before") + 1).alias("_rank"))
    )
    hot = F.col("_n") * HOT_SHARE > values.agg(F.sum("_n")).scalar()
    hot_ranks = ranks.where(hot).select("_v", F.col("_rank").alias("_hot_rank"))  # fewer than HOT_SHARE rows
    cold_ranks = ranks.where(~hot).select(F.col("_v").alias("_key"), F.col("_rank").alias("_cold_rank"))
    # The key of a hot value's row may be that of a cold value by chance; its own rank comes first.
    content = F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns])
    keyed = banded.join(F.broadcast(hot_ranks), "_v", "left").withColumn(
        "_key", F.when(F.col("_hot_rank").isNull(), F.col("_v")).otherwise(content))
    return keyed.join(cold_ranks, "_key", "left").select(
        *[F.col(f"`{name}`") for name in rows.columns], F.coalesce("_hot_rank", "_cold_rank").alias(target))


def rank_users(rows: DataFrame, metric: str = "cost_micros") -> DataFrame:
    """Users ordered by tokens or cost, with their rank."""
    return global_rank(rows, metric).orderBy("rank", "username")


def rpm_trailing(requests: DataFrame, tz: str, slice_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Requests of the same user and local day in the minute up to each request.

    Rows are first counted per user and millisecond.  Each time slice gets the
    last minute of the slice before it as context, so one user's day is spread
    over many windows, each bounded by the clock: at most ``slice_ms + 60000``
    rows.  The counts go back to the rows by an equi-join on user, day and time.
    """
    rows = requests.withColumn("day", local_day("start_ms", tz))
    ticks = rows.groupBy("username", "day", "start_ms").agg(F.count(F.lit(1)).alias("_n"))
    own = F.call_function("div", F.col("start_ms"), F.lit(slice_ms))
    following = F.call_function("div", F.col("start_ms") + (MINUTE_MS - 1), F.lit(slice_ms))
    spread = ticks.withColumn("_own", own).withColumn(
        "_slice", F.explode(F.sequence(F.col("_own"), following)))
    minute = (
        Window.partitionBy("username", "day", "_slice").orderBy("start_ms")
        .rangeBetween(-(MINUTE_MS - 1), Window.currentRow)
    )
    counts = (
        spread.withColumn("trailing", F.sum("_n").over(minute))
        .where(F.col("_slice") == F.col("_own"))
        .select("username", "day", "start_ms", "trailing")
    )
    return rows.join(counts, ["username", "day", "start_ms"])
