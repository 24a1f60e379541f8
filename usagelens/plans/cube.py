"""Additive measures and the finest-grain aggregate shared by all reports."""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.clock import local_hour
from usagelens.runtime import materialize

MEASURES = ("reqs", "it", "ot", "cw", "cr", "io", "all4", "cost_micros")
GRAIN = ("day", "hour", "username", "model", "client")


def with_hour(usage: DataFrame, tz: str) -> DataFrame:
    return usage if "hour" in usage.columns else usage.withColumn("hour", local_hour("ts_ms", tz))


def measure(name: str, source: DataFrame) -> Column:
    """One measure over ledger rows, or merged over cube rows.

    A sum over nothing but NULL stays NULL.  ``io`` and ``all4`` are measures of
    their own because a NULL part drops the whole row from them.
    """
    if "reqs" in source.columns:
        return F.sum(name).alias(name)
    it, ot = F.col("input_tokens"), F.col("output_tokens")
    cw, cr = F.col("cache_creation_tokens"), F.col("cache_read_tokens")
    inputs = {"it": it, "ot": ot, "cw": cw, "cr": cr, "io": it + ot,
              "all4": it + ot + cw + cr, "cost_micros": F.col("cost_micros")}
    if name == "reqs":
        return F.count(F.lit(1)).alias(name)
    return F.sum(inputs[name]).alias(name)


def aggregate(source: DataFrame, keys, measures) -> DataFrame:
    return source.groupBy(*keys).agg(*[measure(name, source) for name in measures])


def usage_cube(usage: DataFrame, tz: str) -> DataFrame:
    """Ledger at (day, hour, username, model, client); every report merges from it."""
    return aggregate(with_hour(usage, tz), GRAIN, MEASURES)


def stored_cube(usage: DataFrame, tz: str) -> DataFrame:
    """The cube, computed once and kept in the shared folder for several reports."""
    return materialize(usage_cube(usage, tz))
