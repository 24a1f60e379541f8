"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import drop_stage, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest smaller neighbour to the other smaller ones and to itself."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    handed = down.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return handed.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in a link; ``root`` is the smallest node reachable.

    ``links`` has two long columns a and b; nulls, loops, repeats and either order are allowed. An empty table gives
    none. Each round is written to the shared folder, so that plans stay short and lost executors cost one round;
    the tables of earlier rounds are removed. Stars are shared out by joins on partial minima: no node's neighbours
    are gathered in one place.
    """
    spark = links.sparkSession
    now, path = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "links")
    state = None
    while True:
        larger, middle = stage(_large_star(now), "links")
        following, next_path = stage(_small_star(larger), "links")
        drop_stage(spark, middle)
        drop_stage(spark, path)
        # Count and two order-free checksums: equal ones mean that a full round changed nothing.
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                             F.bit_xor(F.hash("b", "a"))).first()
        now, path = following, next_path
        if seen == state:
            break
        state = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
