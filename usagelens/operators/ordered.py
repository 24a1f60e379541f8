"""Ordered operators that split a hot key over many tasks.

Rows are cut into slices of the order column.  The work inside a slice is a
window over (key, slice); what crosses slices is one summary row per slice.
"""

from pyspark.sql import DataFrame, Window, functions as F


def _slice(order: str, width: int):
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def last_before(rows: DataFrame, keys, order: str, value: str, target: str, width: int) -> DataFrame:
    """Nearest earlier non-NULL ``value`` of the same key, strictly before each row."""
    keys = list(keys)
    sliced = rows.withColumn("_slice", _slice(order, width))
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    slices = (
        sliced.groupBy(*keys, "_slice").agg(F.max_by(value, at).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across))
        .drop("_last")
    )
    return (
        sliced.withColumn("_near", F.last(value, ignorenulls=True).over(within))
        .join(slices, [*keys, "_slice"])
        .withColumn(target, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_slice")
    )


def running_before(rows: DataFrame, keys, order, values: dict, width: int) -> DataFrame:
    """Sums of ``values`` over the earlier rows of the same key, strictly before each row.

    ``order`` lists the sort columns; the first one is numeric and is sliced.
    ``values`` maps a numeric column to the name of its running sum.
    """
    keys, order = list(keys), list(order)
    sliced = rows.withColumn("_slice", _slice(order[0], width))
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    slices = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(value).alias(f"_sum_{value}") for value in values])
    carried = slices.select(*keys, "_slice", *[
        F.coalesce(F.sum(f"_sum_{value}").over(across), zero).alias(f"_carry_{value}") for value in values
    ])
    summed = sliced.withColumns({
        target: F.coalesce(F.sum(value).over(within), zero) for value, target in values.items()
    }).join(carried, [*keys, "_slice"])
    return summed.withColumns({
        target: F.col(target) + F.col(f"_carry_{value}") for value, target in values.items()
    }).drop("_slice", *[f"_carry_{value}" for value in values])
