"""Cross-tabs, dense series and totals made from the grouped reports."""

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions.labels import CLIENTS, FAMILIES, FAMILY_COLUMNS, UNKNOWN_MODEL, client_bucket, model_family
from usagelens.functions.pricing import round_micros
from usagelens.plans import reports
from usagelens.plans.cube import aggregate, with_hour


def _zero(column):
    return F.coalesce(column, F.lit(0).cast("long"))


def _matrix(source: DataFrame, bucket, columns: dict) -> DataFrame:
    """One row per user: token and cost of each bucket, and the row totals.

    The bucket list is fixed, so this is one conditional aggregate with a stable
    schema and no extra pass for the distinct buckets.
    """
    cells = aggregate(source.withColumn("_bucket", bucket), ["username", "_bucket"], ["io", "cost_micros"])
    sums = []
    for value, name in columns.items():
        for part, out in (("io", "tok"), ("cost_micros", "cost_micros")):
            hit = F.when(F.col("_bucket") == value, F.col(part))
            sums.append(_zero(F.sum(hit)).alias(f"{name}_{out}"))
    sums.append(_zero(F.sum("io")).alias("total_tok"))
    sums.append(_zero(F.sum("cost_micros")).alias("total_cost_micros"))
    return cells.groupBy("username").agg(*sums).orderBy(F.desc("total_cost_micros"), "username")


def pivot_user_family(source: DataFrame) -> DataFrame:
    return _matrix(source, model_family("model"), FAMILY_COLUMNS)


def pivot_user_client(source: DataFrame) -> DataFrame:
    bucket = client_bucket(F.coalesce("client", F.lit("other")))
    return _matrix(source, bucket, {name: name for name in CLIENTS})


def active_buckets(matrix: DataFrame, names) -> DataFrame:
    """Which bucket columns a display keeps: those where some user has tokens."""
    flags = matrix.agg(*[
        F.coalesce(F.max(F.col(f"{name}_tok") != 0), F.lit(False)).alias(name) for name in names
    ])
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("bucket"), F.col(name).alias("active"))
        for i, name in enumerate(names)
    ])
    return flags.select(F.inline(pairs))


def family_names():
    return [FAMILY_COLUMNS[name] for name in FAMILIES]


def _newest_days(source: DataFrame, newest: int | None = 30):
    """Days with data, newest ``newest`` only, ascending: a bounded scalar array."""
    days = reports.newest_first(source.select("day").distinct(), newest)
    return days.agg(F.array_sort(F.collect_list("day"))).scalar()


def day_user_matrix(source: DataFrame, newest: int | None = 30) -> DataFrame:
    """Day by user tokens, long form: newest days, users by their cost over the whole range."""
    cells = aggregate(source, ["day", "username"], ["io", "cost_micros"])
    # A user has one cell per day, so this window stays small.
    user_cost = _zero(F.sum("cost_micros").over(Window.partitionBy("username")))
    days = cells.groupBy("day").agg(_zero(F.sum("io")).alias("day_tok"),
                                    _zero(F.sum("cost_micros")).alias("day_cost_micros"))
    days = reports.newest_first(days, newest)
    return (
        cells.withColumn("user_cost_micros", user_cost)
        .join(days, "day")
        .select("day", "username", _zero(F.col("io")).alias("tok"), "day_tok", "day_cost_micros",
                "user_cost_micros")
        .orderBy(F.desc("day"), F.desc("user_cost_micros"), "username")
    )


def day_user_wide(source: DataFrame, usernames, newest: int | None = 30) -> DataFrame:
    """Wide form for users the caller names; totals still cover all users."""
    cells = aggregate(source, ["day", "username"], ["io", "cost_micros"])
    columns = [_zero(F.sum(F.when(F.col("username") == name, F.col("io")))).alias(name) for name in usernames]
    wide = cells.groupBy("day").agg(*columns, _zero(F.sum("io")).alias("total_tok"),
                                    _zero(F.sum("cost_micros")).alias("total_cost_micros"))
    return reports.newest_first(wide, newest)


def series_user_day(source: DataFrame, scoped: bool = False, newest: int | None = 30) -> DataFrame:
    """Dense day series per user, cost to 4 digits, users by their rounded total.

    A report scoped to one user has no such series.  Users that only occur on
    days off the axis keep a row of zeros.
    """
    days = _newest_days(source, newest)
    cells = _rounded_cells(source, ["day", "username"])
    if scoped:
        cells = cells.where(F.lit(False))
    return _series(cells, ["username"], days, user_cost_micros=F.sum("cost_micros"))


def _rounded_cells(source: DataFrame, keys) -> DataFrame:
    cells = aggregate(source, keys, ["io", "cost_micros"])
    return cells.select(*keys, _zero(F.col("io")).alias("tok"),
                        round_micros(_zero(F.col("cost_micros")), 4).alias("cost_micros"))


def _series(cells: DataFrame, keys, days, **sums) -> DataFrame:
    """Zero-filled series over the day axis, with further aggregates of each series.

    ``cells`` has a row per key and day, so a map holds at most one entry per
    axis day, and every key is written out once per axis day.
    """
    on_axis = F.array_contains(days, F.col("day"))
    cell = F.struct(F.col("tok"), F.col("cost_micros"))
    flagged = cells.withColumn("_kept", F.when(on_axis, F.struct("day", cell.alias("cell"))))
    series = flagged.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list("_kept")).alias("_cells"),
        *[value.alias(name) for name, value in sums.items()])
    extra = list(sums)
    axis = series.select(*keys, *extra, "_cells", F.explode(days).alias("day"))
    cell = F.try_element_at(F.col("_cells"), F.col("day"))
    return axis.select(*keys, "day",
                       _zero(cell.getField("tok")).alias("tok"),
                       _zero(cell.getField("cost_micros")).alias("cost_micros"), *extra)


def _nested_series(source: DataFrame, keys, label, newest: int | None) -> DataFrame:
    days = _newest_days(source, newest)
    cells = _rounded_cells(source.withColumn("model", label), ["day", "username", "model"])

    def drawn(value):
        return F.coalesce(F.max(F.when(F.col("_kept").isNotNull(), F.col(value))) > 0, F.lit(False))

    return _series(cells, keys, days, any_tok=drawn("tok"), any_cost=drawn("cost_micros"))


def series_user_model_day(source: DataFrame, newest: int | None = 30) -> DataFrame:
    """Dense day series per user and model; an empty model has a label, a NULL one a dash.

    ``any_tok`` and ``any_cost`` tell which series a chart of that metric draws.
    """
    label = F.coalesce("model", F.lit("-"))
    label = F.when(label == "", UNKNOWN_MODEL).otherwise(label)
    return _nested_series(source, ["username", "model"], label, newest)


def series_model_user_day(source: DataFrame, newest: int | None = 30) -> DataFrame:
    """Dense day series per model and user; an empty model stays empty."""
    return _nested_series(source, ["model", "username"], F.coalesce("model", F.lit("-")), newest)


def grid_day_hour_user(source: DataFrame, tz: str) -> DataFrame:
    """Hour grid of each day: its users by its observed hours, cost to 6 digits."""
    cells = aggregate(with_hour(source, tz), ["day", "hour", "username"], ["io", "cost_micros"])
    entry = F.struct("hour", F.struct(_zero(F.col("io")).alias("tok"),
                                      _zero(F.col("cost_micros")).alias("cost_micros")).alias("cell"))
    users = cells.groupBy("day", "username").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_cells"),  # at most 24 entries
        _zero(F.sum("cost_micros")).alias("user_day_cost_micros"))
    hours = cells.groupBy("day").agg(F.collect_set("hour").alias("_hours"))  # at most 24 entries
    grid = users.join(hours, "day").withColumn("hour", F.explode("_hours"))
    cell = F.try_element_at(F.col("_cells"), F.col("hour"))
    return (
        grid.select("day", "hour", "username",
                    _zero(cell.getField("tok")).alias("tok"),
                    _zero(cell.getField("cost_micros")).alias("cost_micros"),
                    "user_day_cost_micros")
        .orderBy("day", F.desc("user_day_cost_micros"), "username", "hour")
    )


def hours_dense(source: DataFrame, tz: str) -> DataFrame:
    """All 24 hours of the day, zero-filled, cost to 4 digits."""
    rows = aggregate(with_hour(source, tz), ["hour"], ["io", "cost_micros"])
    hours = source.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return (
        hours.join(rows, "hour", "left")
        .select("hour", _zero(F.col("io")).alias("tok"),
                round_micros(_zero(F.col("cost_micros")), 4).alias("cost_micros"))
        .orderBy("hour")
    )


def series_total(source: DataFrame, newest: int | None = 30) -> DataFrame:
    """Totals per day, oldest first, cost to 4 digits."""
    return reports.by_day(source, newest).select(
        "day", _zero(F.col("io")).alias("tok"), _zero(F.col("it")).alias("inp"),
        _zero(F.col("ot")).alias("out"),
        round_micros(_zero(F.col("cost_micros")), 4).alias("cost_micros"),
    ).orderBy("day")


def today_hour_cube(usage: DataFrame, as_of: date, tz: str) -> DataFrame:
    """Cells, row totals, column totals and grand total of today's hour by user matrix.

    ``level`` is 0 for cells, 1 for hour totals, 2 for user totals, 3 for the
    grand total.  The cube expands the aggregated cells, not the ledger.
    """
    cells = reports.today_cells(usage, as_of, tz)
    return (
        cells.cube("hour", "username")
        .agg(F.grouping_id().alias("level"), _zero(F.sum("reqs")).alias("reqs"),
             _zero(F.sum("io")).alias("tok"), _zero(F.sum("cost_micros")).alias("cost_micros"))
        .orderBy(F.desc("level"), F.desc("cost_micros"), "username", "hour")
    )


def today_hour_scoped(usage: DataFrame, as_of: date, tz: str, username: str) -> DataFrame:
    """Today's hours of one user."""
    cells = reports.today_cells(usage, as_of, tz, username)
    return (
        cells.groupBy("hour")
        .agg(F.sum("reqs").alias("reqs"), _zero(F.sum("io")).alias("tok"),
             _zero(F.sum("cost_micros")).alias("cost_micros"))
        .orderBy("hour")
    )
