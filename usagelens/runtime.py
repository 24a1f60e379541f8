"""Session helpers: the shared folder and the tables staged in it."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as the session names it.

    It is the setting ``spark.checkpoint.dir`` or the folder given to ``setCheckpointDir``; without either, jobs that
    stage data are refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/usagelens-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession, purpose: str) -> str:
    return f"{_session_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def materialize(rows: DataFrame, *partition_by: str) -> DataFrame:
    """Write rows to the shared folder and read them back, cutting their lineage."""
    spark = rows.sparkSession
    path = work_folder(spark, "stage")
    rows.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_entries(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(one.getPath().getName() for one in files.listStatus(target)) if files.exists(target) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True).close()


def remove_staged(spark: SparkSession) -> None:
    """Remove everything that this application has staged; DataFrames that read it are void from then on."""
    remove_folder(spark, _session_folder(spark))
