"""The per-minute rule over all starts: certain ones by counting, contested stretches in order.

A start is certain if the starts of the last minute, itself included, do not pass its limit: whatever becomes of the
others, it is let in. Only starts past that are contested, together with the starts of the minute before each of them.
A clock minute without any of them cuts a day, so contested starts fall into stretches that are decided apart. A long
stretch with a limit of one is cut into slices of time as well; one with a higher limit is one task's work.
"""

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from usagelens.operators import minute
from usagelens.runtime import materialize

# Tasks get the rule with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(minute)

MINUTE_MS = minute.MINUTE_MS
GROUP = ("username", "day")
STRETCH = (*GROUP, "stretch")
_TICKS = "username string, day string, at long, place long, let_in long"


def _near_contested(ticks: DataFrame) -> DataFrame:
    """Contested ticks and those in the minute before one.

    A window holds three minutes of one user: a tick counts those before it, and looks for contested ones behind it.
    """
    own = F.expr(f"at div {MINUTE_MS}")
    spread = ticks.withColumn("minute", own).withColumn(
        "_slice", F.explode(F.array(F.col("minute") - 1, F.col("minute"), F.col("minute") + 1)))
    slices = Window.partitionBy(*GROUP, "_slice").orderBy("at")
    counted = spread.withColumn("_lately", F.sum("starts").over(slices.rangeBetween(1 - MINUTE_MS, Window.currentRow)))
    unsafe = counted.withColumn("_unsafe", (F.col("minute") >= F.col("_slice")) & (F.col("_lately") > F.col("least")))
    ahead = F.max(F.coalesce("_unsafe", F.lit(False))).over(slices.rangeBetween(Window.currentRow, MINUTE_MS - 1))
    return unsafe.withColumn("_near", ahead).where("_slice = minute AND _near").select(
        *GROUP, "at", "minute", "least", "most", "held")


def _stretches(ticks: DataFrame) -> DataFrame:
    """Ticks numbered by stretch: runs of clock minutes, so a user's day has 1440 of them at most to be put in order."""
    day = Window.partitionBy(*GROUP).orderBy("minute")
    opens = F.coalesce(F.col("minute") - F.lag("minute").over(day) > 1, F.lit(True))
    runs = ticks.select(*GROUP, "minute").distinct().withColumn("_opens", opens.cast("long")).withColumn(
        "stretch", F.sum("_opens").over(day)).drop("_opens")
    return ticks.join(runs, [*GROUP, "minute"])


def _by_slices(ticks: DataFrame) -> DataFrame:
    """Ticks of stretches with a limit of one: slices are mapped apart, chained, and decided apart."""
    sliced = ticks.select(*STRETCH, "at", F.expr(f"at div {minute.SLICE_MS}").alias("part"))
    keys = minute.KEYS
    head = "username string, day string, stretch long, part long, entry long"

    def sorted_by(rows, within, *more):
        return rows.repartition(*within).sortWithinPartitions(*keys, *more)

    ways = sorted_by(sliced, keys, "at").mapInPandas(minute.slice_ways, f"{head}, exit long")
    entries = sorted_by(ways, STRETCH, "entry").mapInPandas(minute.chained_entries, head)
    return sorted_by(sliced.join(entries, keys, "left"), keys, "at").mapInPandas(minute.slice_decisions, _TICKS)


def contested_starts(rows: DataFrame) -> DataFrame | None:
    """Starts that counting alone does not let in, and those near them, staged: (id, username, day, at, stretch, ...).

    ``rows`` has id, username, day, start_ms, rpm_limit (not 0) and ``settled``; settled starts count and are not decided.
    All other rows are let in, whatever else is refused; None stands for no contested start at all.
    """
    fixed = F.col("settled").isNotNull()
    given = rows.select("id", *GROUP, F.col("start_ms").alias("at"), "rpm_limit", fixed.alias("fixed"))
    ticks = given.groupBy(*GROUP, "at").agg(
        F.count(F.lit(1)).alias("starts"), F.min(F.when(~F.col("fixed"), F.col("rpm_limit"))).alias("least"),
        F.max("rpm_limit").alias("most"), F.bool_or("fixed").alias("held"))
    near = materialize(_near_contested(ticks))
    if near.isEmpty():
        return None
    parts = _stretches(near)
    kinds = parts.groupBy(*STRETCH).agg(
        ((F.min("least") == F.max("most")) & ~F.bool_or("held")).alias("_one"), F.max("most").alias("_most"),
        (F.max("at") - F.min("at") >= minute.SLICE_MS).alias("_long"))
    one = F.coalesce("_one", F.lit(False))
    told = parts.join(kinds, list(STRETCH)).select(
        *STRETCH, "at", (one & (F.col("_most") == 1) & F.col("_long")).alias("sliced"), one.alias("_one"))
    # Starts of one time count together where the stretch has one limit and nothing is decided yet, else each for itself.
    return materialize(given.join(told, [*GROUP, "at"]).withColumn(
        "place", F.when(F.col("_one"), F.lit(-1).cast("long")).otherwise(F.col("id"))).drop("_one"))


def decide_contested(starts: DataFrame) -> DataFrame:
    """``contested_starts``, or those of them that still ask to be let in, with ``in_minute``."""
    looped = starts.where("NOT sliced").groupBy(*STRETCH, "at", "place", "rpm_limit", "fixed").agg(
        F.count(F.lit(1)).alias("starts")).repartition(*STRETCH).sortWithinPartitions(*STRETCH, "at", "place").mapInPandas(
        minute.admitted_starts, _TICKS)
    let_in = looped.unionByName(_by_slices(starts.where("sliced").select(*STRETCH, "at").distinct()))
    rank = F.row_number().over(Window.partitionBy(*GROUP, "at", "place").orderBy("id"))
    return starts.withColumn("_rank", rank).join(let_in, [*GROUP, "at", "place"]).select(
        *starts.columns, (F.col("_rank") <= F.col("let_in")).alias("in_minute"))
