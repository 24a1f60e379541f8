"""Live aggregates in the shared folder: one partial result per micro-batch, merged on reading."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.runtime import folder_entries, remove_folder

ONCE_THROUGH = {"availableNow": True}
KEPT_BATCHES = 64


def write_partials(rows: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                   keys=None, kept_batches: int = KEPT_BATCHES, **trigger) -> StreamingQuery:
    """Write the ``aggregate`` of each micro-batch to a folder of that batch.

    Counts and sums of batches add up, so no state is kept and a row counts however late it comes. A batch that is run
    again after a failure overwrites its own folder. With the ``keys`` of the aggregate, the stream merges its batches
    whenever more than ``kept_batches`` folders lie there, so their number stays bounded however long it runs.
    ``checkpoint`` and ``path`` belong together: both are kept or both are new. The default trigger takes what is there
    and stops; the source's options bound the size of a batch.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        aggregate(batch).write.mode("overwrite").parquet(f"{path}/partial/batch_id={batch_id}")
        if keys is not None and len(_numbers(batch.sparkSession, f"{path}/partial")) > kept_batches:
            compact_partials(batch.sparkSession, path, keys)

    return (
        rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE_THROUGH)).start()
    )


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have a folder there."""
    return sorted(int(name.split("=")[1]) for name in folder_entries(spark, folder) if "=" in name)


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Rows of the last compaction and of all batches after it, and the last batch that the compaction holds."""
    base, partial = _stored(spark, path, "base"), _stored(spark, path, "partial")
    upto = -1 if base is None else base.agg(F.max("upto")).first()[0]
    if upto is None:
        upto = -1
    rows = partial.where(F.col("batch_id") > upto).drop("batch_id")
    if base is not None:
        rows = rows.unionByName(base.where(F.col("upto") == upto).drop("upto"))
    return rows, upto


def _merged(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in rows.columns if name not in keys])


def read_partials(spark: SparkSession, path: str, keys) -> DataFrame:
    """Current value of every group."""
    return _merged(_parts(spark, path)[0], keys)


def compact_partials(spark: SparkSession, path: str, keys) -> None:
    """Merge all batches so far into one folder, so that reading does not grow with their number.

    Readers take a compaction only when it is whole. What an earlier compaction has merged or replaced is removed then;
    what this one merges stays until the next, for those who are reading it.
    """
    last = _numbers(spark, f"{path}/partial")[-1:]
    rows, upto = _parts(spark, path)
    if not last or last[0] <= upto:
        return
    _merged(rows, keys).write.mode("overwrite").parquet(f"{path}/base/upto={last[0]}")
    for kind, name, kept in (("partial", "batch_id", upto + 1), ("base", "upto", upto)):
        for number in _numbers(spark, f"{path}/{kind}"):
            if number < kept:
                remove_folder(spark, f"{path}/{kind}/{name}={number}")
