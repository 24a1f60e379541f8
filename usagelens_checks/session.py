"""Folder for staged tables of local runs, where the session names none."""

import tempfile

from pyspark.sql import SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Give a local session a checkpoint folder unless it has one; a cluster has to name its own."""
    context = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir()
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="usagelens-"))
