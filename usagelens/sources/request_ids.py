"""Ids of all requests of a ledger, in a hidden folder beside its days: which ids of a batch it has already.

Ids lie in folders by their hash, so a batch reads only those its own ids fall in. Ids of the latest batches, a bounded
number of them, lie in small folders of their own, which all batches read. An id may stand there twice; that does no harm.
While a batch is written a mark stands in the index; one that is found there tells of a batch that failed.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.runtime import folder_entries, materialize, remove_folder, touch
from usagelens.schema import USAGE

FOLDER = "_request_ids"  # Spark's readers pass over names that start so
BUCKETS = 256
RECENT = 64  # batches whose ids wait for their buckets


def bucket_of(column: str = "id"):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _store(ids: DataFrame, path: str, mode: str) -> None:
    ids.select("id", bucket_of().alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").mode(mode).option(
        "partitionOverwriteMode", "static").parquet(f"{path}/{FOLDER}/by_bucket")


def rebuild(spark: SparkSession, path: str) -> None:
    """Index a ledger from its rows, as after rows that were not written by ``append_new``; reads its ids only."""
    remove_folder(spark, f"{path}/{FOLDER}")
    try:
        ids = spark.read.schema(USAGE).parquet(path).select("id").where("id IS NOT NULL")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        _store(ids, path, "overwrite")
    touch(spark, f"{path}/{FOLDER}/ready")  # last: without it, the index is built again


def ensure(spark: SparkSession, path: str) -> None:
    if "ready" not in folder_entries(spark, f"{path}/{FOLDER}"):
        rebuild(spark, path)


def failed(spark: SparkSession, path: str) -> bool:
    return "open" in folder_entries(spark, f"{path}/{FOLDER}")


def begin(spark: SparkSession, path: str) -> None:
    touch(spark, f"{path}/{FOLDER}/open")


def done(spark: SparkSession, path: str) -> None:
    remove_folder(spark, f"{path}/{FOLDER}/open")


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema("id long").parquet(*folders) if folders else spark.createDataFrame([], "id long")


def _recent(path: str, names: list[str]) -> list[str]:
    return [f"{path}/{FOLDER}/recent/{name}" for name in names]


def candidates(asked: DataFrame, path: str) -> DataFrame:
    """Indexed ids that may be among ``asked``: those in its buckets and those of the latest batches.

    Only the folders of these are listed and read.
    """
    spark, home = asked.sparkSession, f"{path}/{FOLDER}/by_bucket"
    stored = [name for name in folder_entries(spark, home) if name.startswith("bucket=")]
    if stored:
        wanted = {f"bucket={row.bucket}" for row in asked.select(bucket_of().alias("bucket")).distinct().collect()}  # BUCKETS at most
        stored = [f"{home}/{name}" for name in stored if name in wanted]
    return _read(spark, stored + _recent(path, folder_entries(spark, f"{path}/{FOLDER}/recent")))


def indexed(asked: DataFrame, path: str) -> DataFrame:
    """(id): those of ``asked`` that the index has, staged."""
    return materialize(asked.select("id").join(candidates(asked, path), "id", "left_semi"))


def add(ids: DataFrame, path: str) -> None:
    """Add ids; when more than RECENT batches wait, all of them go to their buckets.

    Their folders go after that, so a failure in between leaves ids twice, never none.
    """
    spark = ids.sparkSession
    ids.select("id").hint("rebalance").write.parquet(f"{path}/{FOLDER}/recent/{uuid.uuid4().hex}")
    names = folder_entries(spark, f"{path}/{FOLDER}/recent")
    if len(names) > RECENT:
        waiting = _recent(path, names)
        _store(_read(spark, waiting), path, "append")
        for folder in waiting:
            remove_folder(spark, folder)
