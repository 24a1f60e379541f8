"""Admission over a stream: each micro-batch is decided after what has been decided before.

Decisions are stored by day, ``day_part=<day>/batch_id=<n>`` below the output, and the finishes of admitted requests on
a later day once more by that day, in ``<output>-finishes``. So a batch reads the folders of its own days and no others,
however long the stream has run.
"""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.functions.clock import epoch_ms, local_day
from usagelens.operators.admission import admission_replay
from usagelens.runtime import materialize
from usagelens.streaming.sinks import ONCE_THROUGH

REQUEST = ("id", "username", "start_ms", "end_ms", "total_tokens", "daily_request_limit", "daily_token_limit", "rpm_limit")
_HISTORY = ("id long, username string, start_ms long, end_ms long, total_tokens long, daily_request_limit long, "
            "daily_token_limit long, rpm_limit long, day string, end_day string, decision string")
PART = "day_part"


def _folder(day: str | None) -> str:
    return f"{PART}={day or 'none'}"


def stored_days(spark, path: str, days: list[str], batch_id: int) -> DataFrame:
    """What earlier batches have stored of some days; a batch that is run again does not see itself."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [folder for day in days
             if system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder := f"{path}/{_folder(day)}"))]
    if not there:
        return spark.createDataFrame([], _HISTORY)
    rows = spark.read.schema(f"{_HISTORY}, {PART} string, batch_id long").option("basePath", path).parquet(*there)
    return rows.where(F.col("batch_id") < batch_id).drop(PART, "batch_id")


def _store(rows: DataFrame, path: str, day: str, batch_id: int) -> None:
    """Write rows to the folders of their days; a batch that is run again puts the same folders in place."""
    rows.withColumns({PART: F.coalesce(F.col(day), F.lit("none")), "batch_id": F.lit(batch_id)}).hint("rebalance", PART).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, "batch_id").parquet(path)


def admission_stream(requests: DataFrame, tz: str, path: str, checkpoint: str, opening: DataFrame | None = None,
                     **trigger) -> StreamingQuery:
    """Append the decisions of finished requests to ``path``, columns as for the batch replay.

    The rows of a batch meet the settled requests of their own users and days, and those that finish in them. The driver
    learns the days of a batch, which the source's options bound as they do its rows. Decisions
    stay as they are once written: a start that comes late is judged at its own time, with everything counted that has
    been let in by then. ``opening`` (username, day, requests, tokens) are counters from before the stream. The
    source's options bound the size of a batch.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*REQUEST).withColumns({
            "day": local_day("start_ms", tz), "end_day": local_day(F.coalesce("end_ms", "start_ms"), tz)})
        days = materialize(fresh.select("username", "day").distinct())
        listed = [row.day for row in days.select("day").distinct().collect()]
        same = stored_days(spark, path, listed, batch_id).join(days, ["username", "day"], "left_semi")
        ending = stored_days(spark, f"{path}-finishes", listed, batch_id).join(
            days.withColumnRenamed("day", "end_day"), ["username", "end_day"], "left_semi").join(
            days, ["username", "day"], "left_anti")
        known = same.unionByName(ending).withColumnRenamed("decision", "settled").select(*REQUEST, "settled")
        if opening is not None:
            known = known.unionByName(_opening_rows(opening, days, tz), allowMissingColumns=True)
        every = fresh.select(*REQUEST, F.lit(None).cast("string").alias("settled")).unionByName(known, allowMissingColumns=True)
        found = admission_replay(every, tz).select("id", "decision")
        decided = materialize(fresh.join(found, "id").select(*REQUEST, "day", "end_day", "decision"))
        _store(decided.where("day != end_day AND decision = 'ok'"), f"{path}-finishes", "end_day", batch_id)
        _store(decided, path, "day", batch_id)

    return (
        requests.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE_THROUGH)).start()
    )


def _opening_rows(opening: DataFrame, days: DataFrame, tz: str) -> DataFrame:
    """Stored counters as one settled request of their weight at the beginning of the day."""
    begin = epoch_ms(F.to_timestamp_ntz("day", F.lit("yyyy-MM-dd")), tz)
    limits = [F.lit(None).cast("long").alias(name) for name in REQUEST[5:]]
    return opening.join(days, ["username", "day"], "left_semi").select(
        F.lit(-1).cast("long").alias("id"), "username", begin.alias("start_ms"), begin.alias("end_ms"),
        F.col("tokens").alias("total_tokens"), *limits, F.lit("ok").alias("settled"), F.col("requests").alias("weight"))
