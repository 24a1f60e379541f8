"""Places of rows in the order of their group, however large one group is."""

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.llm.common import free_name, stage


def ranked(rows: DataFrame, group: list[str], order: list[str], place: str = "place", number: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0, in their group's order, and the group's row count ``number`` if it is named.

    Rows are sorted by ranges of (group, order) and staged, so that a group may fill many tasks; a task's rows of a
    group get their places by the number of rows that earlier tasks hold of it. Nulls come first and null is a group
    of its own. Rows alike in all of group and order may take either place.
    """
    part, at, offset, total = (free_name(rows, name) for name in ("__part", "__at", "__offset", "__total"))
    keys = [F.col(f"`{name}`").asc_nulls_first() for name in [*group, *order]]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *rows.columns, F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(at))
    written, _ = stage(cut, "ranked")
    names = [f"__group{k}" for k in range(len(group))]
    sizes = written.groupBy(*[F.col(f"`{c}`").alias(n) for c, n in zip(group, names)], F.col(part).alias("__in")).agg(
        F.count("*").alias("__n"), F.min(at).alias("__first"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *names, "__in", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias(offset),
        F.sum("__n").over(whole).alias(total))
    same = reduce(lambda one, two: one & two, [written[f"`{c}`"].eqNullSafe(offsets[n]) for c, n in zip(group, names)],
                  written[part] == offsets["__in"])
    more = [F.col(total).alias(number)] if number else []
    return written.join(offsets, same).select(
        *[written[f"`{c}`"] for c in rows.columns], (F.col(at) + F.col(offset)).alias(place), *more)
