"""Re-pricing of recorded usage with the current price book."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.functions.pricing import PriceBook, attach_cost
from usagelens.plans.filters import has_tokens
from usagelens.runtime import materialize
from usagelens.sources.ledger import overwrite_days, read_usage

# A ledger whose costs were rounded as floating-point dollars differs by this much without any change of price.
ROUNDING_MICROS = 1


def _recomputed(usage: DataFrame, book: PriceBook, tolerance: int) -> DataFrame:
    """Add ``new_cost``, ``eligible`` (a known model and any tokens) and ``changed``.

    A recorded cost within ``tolerance`` micro-dollars of the new one keeps; no recorded cost counts as zero.
    """
    priced = attach_cost(usage, book, "new_cost")
    old = F.coalesce("cost_micros", F.lit(0).cast("long"))
    return priced.withColumn("eligible", F.col("priced") & has_tokens()).drop("priced").withColumn(
        "changed", F.col("eligible") & (F.abs(old - F.col("new_cost")) > tolerance))


def reprice_preview(usage: DataFrame, book: PriceBook, tolerance: int = 0) -> DataFrame:
    """One row: eligible, changed, and the cost before and after in micro-dollars."""
    rows = _recomputed(usage, book, tolerance).where("eligible")
    old = F.coalesce("cost_micros", F.lit(0).cast("long"))
    new = F.when(F.col("changed"), F.col("new_cost")).otherwise(old)
    zero = F.lit(0).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("eligible"),
        F.count_if("changed").alias("changed"),
        F.coalesce(F.sum(old), zero).alias("before_micros"),
        F.coalesce(F.sum(new), zero).alias("after_micros"),
    )


def reprice_apply(usage: DataFrame, book: PriceBook, tolerance: int = 0) -> DataFrame:
    """The ledger with the cost of every eligible row replaced; others stay as they are."""
    rows = _recomputed(usage, book, tolerance)
    near = F.col("cost_micros").isNotNull() & ~F.col("changed")
    cost = F.when(F.col("eligible") & ~near, F.col("new_cost")).otherwise(F.col("cost_micros"))
    return rows.withColumn("cost_micros", cost).select(*usage.columns)


def reprice_days(usage: DataFrame, book: PriceBook, tolerance: int = 0) -> DataFrame:
    """Days in which some cost changes: the folders a rewrite has to touch."""
    rows = _recomputed(usage, book, tolerance)
    unset = F.col("eligible") & F.col("cost_micros").isNull()
    return rows.where(F.col("changed") | unset).select("day").distinct()


def reprice_ledger(spark: SparkSession, path: str, book: PriceBook, tolerance: int = 0) -> None:
    """Re-price a ledger where it is: only days with a changed cost are rewritten.

    The new days are staged in full before any folder is replaced. A second run finds no changed day, and a run after
    a failure finds those that are left.
    """
    usage = read_usage(spark, path)
    days = materialize(reprice_days(usage, book, tolerance))
    if days.isEmpty():
        return
    overwrite_days(materialize(reprice_apply(usage.join(days, "day", "left_semi"), book, tolerance)), path)


def write_repriced(spark: SparkSession, source: str, book: PriceBook, target: str, tolerance: int = 0) -> None:
    """Write a re-priced copy of the ledger at ``source`` to another folder; writing it again replaces its days."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("the copy needs a folder of its own; reprice_ledger works in place")
    overwrite_days(reprice_apply(read_usage(spark, source), book, tolerance), target)
