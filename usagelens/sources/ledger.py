"""The usage ledger and the user dimension as Parquet tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.functions.labels import masked_key
from usagelens.functions.pricing import micros_of_dollars
from usagelens.runtime import materialize
from usagelens.schema import USAGE, USERS
from usagelens.sources import request_ids


def conform(rows: DataFrame, schema=USAGE) -> DataFrame:
    """Bring rows of an older layout to ``schema``: missing columns become NULL."""
    present = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Scan the ledger; files written before a column existed read as NULL there."""
    return spark.read.schema(USAGE).parquet(path).select(*USAGE.names)


def from_dollar_rows(rows: DataFrame) -> DataFrame:
    """Rows of a ledger that keeps ``ts`` and the cost in dollars as ``cost_usd``."""
    return conform(rows.withColumns({"ts_ms": F.col("ts"), "cost_micros": micros_of_dollars("cost_usd")}))


def _by_day(rows: DataFrame):
    """Writer of ledger rows, one folder per day, files sorted by user and time.

    Rebalancing gathers each day into files of a useful size: adaptive execution
    splits a large day over several tasks and merges small ones.
    """
    return (
        conform(rows).hint("rebalance", "day")
        .sortWithinPartitions("day", "username", "ts_ms").write.partitionBy("day")
    )


def overwrite_days(rows: DataFrame, path: str) -> None:
    """Replace the folders of the days that occur in ``rows``; other days stay."""
    _by_day(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_new(rows: DataFrame, path: str) -> None:
    """Append the rows whose id the ledger does not have yet, on whatever day; rows without an id are all appended.

    ``rows`` must have each id once. Ids are looked up in the ledger's index of ids; a ledger without one gets it first,
    otherwise the ledger itself is not read. Rows are written before their ids are: after a batch that failed in
    between, which its mark tells, ids that the index lacks are looked for in the ledger, on the days of ``rows``. A
    failed batch must be run again before another one, as streams do.
    """
    spark = rows.sparkSession
    request_ids.ensure(spark, path)
    asked = materialize(rows.where(F.col("id").isNotNull()).select("id", "day"))
    known = request_ids.indexed(asked, path)
    fresh = asked.join(known, "id", "left_anti")
    if request_ids.failed(spark, path):
        known = known.unionByName(materialize(_on_day(fresh, path)))
    request_ids.begin(spark, path)
    append_usage(rows.join(known, "id", "left_anti"), path)
    request_ids.add(fresh, path)
    request_ids.done(spark, path)


def _on_day(asked: DataFrame, path: str) -> DataFrame:
    """(id): those of (id, day) that the ledger has on that day; only those days are read."""
    try:
        ledger = read_usage(asked.sparkSession, path).select("id", "day")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return asked.select("id").limit(0)
    days = asked.select("day").distinct()
    return asked.join(ledger.join(days, "day", "left_semi"), ["id", "day"], "left_semi").select("id")


def append_usage(rows: DataFrame, path: str) -> None:
    """Append to the ledger as it is; after that ``request_ids.rebuild`` makes later calls of ``append_new`` see the ids."""
    _by_day(rows).mode("append").parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Users by name; a missing table is an empty one."""
    try:
        users = spark.read.schema(USERS).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        users = spark.createDataFrame([], USERS)
    return list_users(users, mask_keys=False)


def list_users(users: DataFrame, mask_keys: bool = True) -> DataFrame:
    """Users by name; unless told otherwise only the end of each key shows."""
    rows = conform(users, USERS).orderBy("username", "api_key")
    return rows.withColumn("api_key", masked_key("api_key")) if mask_keys else rows
