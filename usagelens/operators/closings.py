"""Where in a day the daily limits are reached, by sums over clock minutes.

As long as totals are not negative, a limit that is reached stays reached, so its first event, the closing, tells every
start of the day. Requests shrink to sums per minute before any shuffle; only the minutes in which a limit is reached are
put in order.
"""

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.operators.per_minute import GROUP, MINUTE_MS
from usagelens.runtime import materialize

KINDS = ("request", "token")


def _place(at, phase, step):
    """Order of events: a completion comes before starts of the same time, but after its own start."""
    return F.struct(F.col(at).alias("at"), phase.alias("phase"), F.col("id").alias("id"), F.lit(step).alias("step"))


def _start():
    return _place("start_ms", F.lit(1), 0)


def _each_kind(*values):
    """One row for each kind of limit, with a value of its own."""
    return F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), *[value(kind) for value in values]) for kind in KINDS]))


def limits_of(rows: DataFrame) -> DataFrame:
    """(username, day, kind, limit): the daily limits that may close a day for some start."""
    pairs = rows.where("settled IS NULL").select(*GROUP, "request_limit", "token_limit").distinct()
    return pairs.select(*GROUP, _each_kind(lambda kind: F.col(f"{kind}_limit").alias("limit"))).where("limit > 0").distinct()


def attach_daily(rows: DataFrame, closings: DataFrame | None) -> DataFrame:
    """``rows`` with ``daily``, the daily limit that refuses a start; negative limits always do."""
    joined, reached = rows, {}
    for kind in KINDS:
        negative = F.col(f"{kind}_limit") < 0
        if closings is None:
            reached[kind] = negative
            continue
        own = closings.where(F.col("kind") == kind).select(
            *GROUP, F.col("limit").alias(f"{kind}_limit"), F.col("place").alias(f"_{kind}"))
        joined = joined.join(own, [*GROUP, f"{kind}_limit"], "left")
        reached[kind] = negative | F.coalesce(_start() > F.col(f"_{kind}"), F.lit(False))
    daily = F.when(reached["request"], "request_limit").when(reached["token"], "token_limit")
    return joined.select(*rows.columns, F.when(F.col("settled").isNull(), daily).alias("daily"))


def _minute(at):
    return F.expr(f"{at} div {MINUTE_MS}")


def _by_minute(admitted: DataFrame) -> DataFrame:
    """Starts and finished tokens of each minute that has any; most requests finish in the minute of their start."""
    zero = F.lit(0).cast("long")

    def part(day, at, n, tokens):
        return F.struct(F.col(day).alias("day"), _minute(at).alias("minute"), n.alias("n"), tokens.alias("tok"))

    weight, total = F.col("weight"), F.col("total")
    at_once = (total == 0) | ((F.col("end_day") == F.col("day")) & (_minute("end_ms") == _minute("start_ms")))
    return admitted.select("username", F.inline(
        F.when(at_once, F.array(part("day", "start_ms", weight, total)))
        .otherwise(F.array(part("day", "start_ms", weight, zero), part("end_day", "end_ms", zero, total)))))


def _events(admitted: DataFrame) -> DataFrame:
    """Starts and finishes with their places, finishes on the day of their end."""
    zero = F.lit(0).cast("long")
    phase = F.when(F.col("end_ms") == F.col("start_ms"), 1).otherwise(0)
    start = F.struct(F.col("day").alias("day"), _start().alias("place"), F.col("weight").alias("n"), zero.alias("tok"))
    finish = F.struct(F.col("end_day").alias("day"), _place("end_ms", phase, 1).alias("place"), zero.alias("n"),
                      F.col("total").alias("tok"))
    return admitted.select("username", F.inline(
        F.when(F.col("total") != 0, F.array(start, finish)).otherwise(F.array(start)))).withColumn(
        "minute", _minute("place.at"))


def _first_reached(sums: DataFrame, limits: DataFrame, keys, first: str) -> DataFrame:
    """``limits`` with the least ``first`` among the sums of the same keys that reach them; without one they are dropped.

    Sums and limits are put in order together, so no sum meets every limit.
    """
    both = sums.unionByName(limits.withColumn("value", F.col("limit")), allowMissingColumns=True)
    upward = Window.partitionBy(*keys, "kind").orderBy(F.desc("value"))
    least = F.min(F.when(F.col("limit").isNull(), F.col(first))).over(upward)
    return both.withColumn(first, least).where(F.col("limit").isNotNull() & F.col(first).isNotNull()).select(
        *keys, "kind", "limit", first)


def _sums(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(username, day, kind, value, near): sums up to each minute of the days with ``limits``, and the sums before it."""
    minutes = _by_minute(rows).join(limits.select(*GROUP).distinct(), list(GROUP), "left_semi").groupBy(
        *GROUP, "minute").agg(F.sum("n").alias("request"), F.sum("tok").alias("token"))
    day = Window.partitionBy(*GROUP).orderBy("minute")
    return minutes.withColumns({f"_{kind}": F.sum(kind).over(day) for kind in KINDS}).select(
        *GROUP, _each_kind(lambda kind: F.col(f"_{kind}").alias("value"), lambda kind: F.struct(
            "minute", (F.col(f"_{kind}") - F.col(kind)).alias("before")).alias("near")))


def horizons(certain: DataFrame, limits: DataFrame) -> DataFrame:
    """(username, day, upto), staged: the minute by which all limits of a day are reached, NULL if that is not sure.

    Only starts that are let in whatever becomes of the others are summed up, so no limit is reached later than that.
    """
    sure = certain.where("settled = 'ok' OR (settled IS NULL AND request_limit = 0 AND token_limit = 0)")
    reached = _first_reached(_sums(sure, limits), limits, list(GROUP), "near")
    return materialize(limits.join(reached, [*GROUP, "kind", "limit"], "left").groupBy(*GROUP).agg(
        F.when(F.bool_and(F.col("near").isNotNull()), F.max("near.minute")).alias("upto")))


def within_horizon(rows: DataFrame, upto: DataFrame) -> DataFrame:
    """Starts that may come before a closing of their day."""
    return rows.join(upto, list(GROUP)).where(F.col("upto").isNull() | (_minute("start_ms") <= F.col("upto"))).drop("upto")


def find_closings(admitted: DataFrame, limits: DataFrame) -> DataFrame:
    """(username, day, kind, limit, place), staged: what closes each day first if just ``admitted`` count and ``limits`` are open.

    Later limits are left out: from the first closing on, other starts are refused. Starts and finishes of days without
    ``limits`` are passed over.
    """
    reached = _first_reached(_sums(admitted, limits), limits, list(GROUP), "near").select(
        *GROUP, "near.minute", "kind", "limit", "near.before")
    near = materialize(_earliest(reached, "minute"))
    spots = near.groupBy(*GROUP, "minute").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col("before"))).alias(f"_{kind}") for kind in KINDS])
    within = Window.partitionBy(*GROUP, "minute").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _events(admitted).join(spots, [*GROUP, "minute"]).withColumns({
        "_request": F.col("_request") + F.sum("n").over(within), "_token": F.col("_token") + F.sum("tok").over(within)})
    inner = placed.select(*GROUP, "minute", "place", _each_kind(lambda kind: F.col(f"_{kind}").alias("value")))
    return materialize(_earliest(
        _first_reached(inner, near.drop("before"), [*GROUP, "minute"], "place").drop("minute"), "place"))


def _earliest(rows: DataFrame, column: str) -> DataFrame:
    """Rows with the least ``column`` of their day."""
    least = F.min(column).over(Window.partitionBy(*GROUP))
    return rows.withColumn("_least", least).where(F.col("_least") == F.col(column)).drop("_least")
