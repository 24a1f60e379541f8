import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from test_admission import DAY, MIDNIGHT, SCHEMA, TZ, brute
from usagelens.functions.pricing import default_prices
from usagelens.operators import extract
from usagelens.plans import reports
from usagelens.schema import USAGE
from usagelens.runtime import remove_folder
from usagelens.sources import request_ids
from usagelens.sources.ledger import append_new, append_usage, conform, read_usage
from usagelens.streaming import admission, counters, ingest, sinks
from usagelens_checks import tables

RESPONSES = ("request_id long, ts_ms long, start_ms long, username string, api_key string, model string, stream int, "
             "client string, status int, path string, error string, body string")


def write_files(spark, folder, frames):
    """One file per frame, read in this order."""
    os.makedirs(folder, exist_ok=True)
    for i, frame in enumerate(frames):
        pq.write_table(frame.toArrow(), f"{folder}/part-{i}.parquet")
        os.utime(f"{folder}/part-{i}.parquet", (1_700_000_000 + i * 10,) * 2)


def read_files(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def response(i, ts, body, status=200, stream=0):
    return (i, ts, ts - 7, "a", "k", "gpt-5.5", stream, "cli", status, "/p", "x" * 300, body)


GOOD = '{"usage":{"input_tokens":10,"output_tokens":1,"input_tokens_details":{"cached_tokens":4}}}'


def run_ingest(spark, source, out, state):
    rows = read_files(spark, source, RESPONSES)
    ingest.ingest(rows, default_prices(), TZ, out, state).awaitTermination()
    return {row.id: row for row in read_usage(spark, out).collect()}


def test_ingest_takes_repeats_once_and_late_rows_all(spark, tmp_path):
    first = [response(1, MIDNIGHT + 9 * DAY, GOOD), response(2, MIDNIGHT - 1, "oops"), response(3, MIDNIGHT + 5, GOOD, status=500)]
    second = [response(1, MIDNIGHT + 9 * DAY, GOOD), response(4, MIDNIGHT + DAY, GOOD), response(4, MIDNIGHT + DAY, GOOD),
              response(5, MIDNIGHT + 9 * DAY - 4 * 3_600_000, GOOD)]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(spark, source, [spark.createDataFrame(rows, RESPONSES) for rows in (first, second)])
    found = run_ingest(spark, source, out, state)
    assert sorted(found) == [1, 2, 3, 4, 5] and read_usage(spark, out).count() == 5
    assert (found[1].cost_micros, found[1].latency_ms, len(found[1].error)) == (30 + 2 + 30, 7, 300)
    assert (found[2].day, found[2].input_tokens, found[3].input_tokens) == ("2023-12-31", 0, 0)
    run_ingest(spark, source, out, state)
    assert read_usage(spark, out).count() == 5
    # A batch that is run again without its state adds nothing twice.
    run_ingest(spark, source, out, str(tmp_path / "other"))
    assert read_usage(spark, out).count() == 5


def test_ingest_takes_a_request_once_whatever_its_day(spark, tmp_path):
    batches = [[response(1, MIDNIGHT, GOOD), response(2, MIDNIGHT + DAY, GOOD), response(2, MIDNIGHT + 3 * DAY, GOOD)],
               [response(1, MIDNIGHT + 2 * DAY, GOOD), response(3, MIDNIGHT + DAY, GOOD), response(None, MIDNIGHT, GOOD)],
               [response(2, MIDNIGHT - DAY, GOOD), response(3, MIDNIGHT, GOOD), response(4, MIDNIGHT, GOOD)]]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(spark, source, [spark.createDataFrame(rows, RESPONSES) for rows in batches])
    found = run_ingest(spark, source, out, state)
    assert {i: row.ts_ms for i, row in found.items()} == {
        1: MIDNIGHT, 2: MIDNIGHT + DAY, 3: MIDNIGHT + DAY, None: MIDNIGHT, 4: MIDNIGHT}
    assert read_usage(spark, out).count() == 5
    # Rows that were written, but whose ids were not: the batch runs again and completes the index.
    names = sorted(os.listdir(f"{out}/_request_ids/recent"), key=lambda name: os.path.getmtime(f"{out}/_request_ids/recent/{name}"))
    remove_folder(spark, f"{out}/_request_ids/recent/{names[-1]}")
    request_ids.begin(spark, out)
    append_new(spark.createDataFrame([found[4]], USAGE), out)
    append_new(spark.createDataFrame([found[4]], USAGE).withColumns({"day": F.lit("2024-02-02")}), out)
    assert read_usage(spark, out).count() == 5


def test_a_batch_reads_the_folders_of_its_own_ids(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    first = spark.range(3000).select(F.col("id"), F.lit("2024-01-01").alias("day"))
    append_usage(first, path)  # a ledger without an index gets one
    append_new(conform(spark.range(2990, 3010).withColumn("day", F.lit("2024-01-02"))), path)
    assert read_usage(spark, path).count() == 3010
    asked = spark.createDataFrame([(5,), (3005,), (9999,)], "id long")
    buckets = {row[0] for row in asked.select(request_ids.bucket_of()).collect()}
    files = request_ids.candidates(asked, path).inputFiles()
    read = {int(file.split("bucket=")[1].split("/")[0]) for file in files if "bucket=" in file}
    assert read <= buckets and sum("recent" in file for file in files) == 1
    assert {row.id for row in request_ids.indexed(asked, path).collect()} == {5, 3005}
    monkeypatch.setattr(request_ids, "RECENT", 2)
    for k in range(4):
        append_new(conform(spark.range(3000 + k, 3020 + k).withColumn("day", F.lit("2024-01-03"))), path)
    assert len(os.listdir(f"{path}/_request_ids/recent")) <= 2
    ids = [row.id for row in read_usage(spark, path).collect()]
    assert sorted(ids) == list(range(3023))
    request_ids.rebuild(spark, path)
    append_new(conform(spark.range(3023).withColumn("day", F.lit("2024-01-09"))), path)
    assert read_usage(spark, path).count() == 3023


def test_batches_of_many_rows_lie_in_files_of_a_bounded_size(spark, tmp_path, monkeypatch):
    """Batches stay what they are, but no task has to write or read one of them alone."""
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 100)
    rows = spark.createDataFrame([response(i, MIDNIGHT + i * 7919, GOOD) for i in range(1200)], RESPONSES)
    makers = {"late": (tables.stream_of_parts, 3), "moved": (tables.moved_deliveries, 4)}
    for name, (make, batches) in makers.items():
        folder, seen = str(tmp_path / name), []
        stream = make(rows, folder)
        sizes = [pq.ParquetFile(file).metadata.num_rows for file in glob.glob(f"{folder}/**/*.parquet", recursive=True)]
        assert max(sizes) < 200 and len(sizes) >= batches * 4
        stream.writeStream.foreachBatch(lambda batch, _: seen.append(sorted(batch.collect()))).option(
            "checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == batches
        first = {}
        for number, batch in enumerate(seen):
            for row in batch:
                first.setdefault(row.request_id, (number, row.ts_ms))
        assert {i: at for i, (_, at) in first.items()} == {i: MIDNIGHT + i * 7919 for i in range(1200)}
        assert {number for number, _ in first.values()} == set(range(3 if name == "late" else 2))
        assert sum(map(len, seen)) > 1300


def test_ingest_reads_event_streams(spark, tmp_path):
    text = f'data: {{"type":"x"}}\n\ndata: {{"response":{GOOD}}}\n\ndata: [DONE]\n\n'
    rows = [response(1, MIDNIGHT, text, stream=1), response(2, MIDNIGHT, text), response(3, MIDNIGHT, GOOD, stream=1),
            response(4, MIDNIGHT, text + "data: 12\n", stream=1), response(5, MIDNIGHT, text, status=404, stream=1)]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(spark, source, [spark.createDataFrame(rows, RESPONSES)])
    found = run_ingest(spark, source, out, state)
    assert {i: (row.input_tokens, row.cache_read_tokens, row.status) for i, row in found.items()} == {
        1: (10, 4, 200), 2: (0, 0, 200), 3: (0, 0, 200), 4: (0, 0, 502), 5: (0, 0, 404)}
    assert found[4].error == extract.VOID_STREAM[1] and found[4].cost_micros == 0


@pytest.fixture(scope="module")
def ledger_files(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        ts = MIDNIGHT + i * 400_000
        day = f"2024-01-{1 + (ts - MIDNIGHT) // DAY:02d}"
        rows.append((i, ts, day, rng.choice("abc"), "k", "gpt-5.5", 1, 200, rng.choice([None, 3]), 2, 0, 1, i, 5, "/p", None, "cli"))
    folder = str(tmp_path_factory.mktemp("ledger"))
    write_files(spark, folder, [spark.createDataFrame(rows[a:a + 100], USAGE) for a in range(0, 400, 100)])
    return folder, spark.createDataFrame(rows, USAGE)


def run_live(spark, rows, aggregate, path, keys):
    sinks.write_partials(rows, aggregate, f"{path}/rows", f"{path}/state").awaitTermination()
    return sinks.read_partials(spark, f"{path}/rows", keys)


def test_day_counters_equal_the_batch(spark, ledger_files, tmp_path):
    folder, ledger = ledger_files
    keys = ["day", "username"]
    found = run_live(spark, read_files(spark, folder, USAGE), lambda batch: counters.day_counters(batch, TZ), str(tmp_path), keys)
    before = sorted(tuple(row) for row in found.collect())
    for _ in range(2):
        sinks.compact_partials(spark, f"{tmp_path}/rows", keys)
        assert sorted(tuple(row) for row in sinks.read_partials(spark, f"{tmp_path}/rows", keys).collect()) == before
    assert os.listdir(f"{tmp_path}/rows/base") == ["upto=3"]
    expected = ledger.groupBy("day", "username").agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.expr("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens")), F.lit(0)))
    assert sorted(tuple(row) for row in found.select("day", "username", "requests", "tokens").collect()) == sorted(
        tuple(row) for row in expected.collect())


def test_folders_of_a_long_stream_stay_few(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    frames = [spark.range(k, k + 3).selectExpr("id % 4 as k", "id as n").coalesce(1) for k in range(9)]
    counted = lambda batch: batch.groupBy("k").agg(F.sum("n").alias("n"))
    most = []
    for upto in (4, 9):  # stops once and goes on
        write_files(spark, source, frames[:upto])
        rows = read_files(spark, source, "k long, n long")
        sinks.write_partials(rows, counted, path, str(tmp_path / "state"), keys=["k"], kept_batches=2).awaitTermination()
        most.append([len(os.listdir(f"{path}/{kind}")) for kind in ("partial", "base")])
        expected = {}
        for one in (number for k in range(upto) for number in range(k, k + 3)):
            expected[one % 4] = expected.get(one % 4, 0) + one
        assert {row.k: row.n for row in sinks.read_partials(spark, path, ["k"]).collect()} == expected
    assert all(partial <= 3 and base <= 2 for partial, base in most)


def test_minute_and_hour_totals(spark, ledger_files, tmp_path):
    folder, ledger = ledger_files
    for width, size in (("1 hour", 3_600_000), ("1 minute", 60_000)):
        found = run_live(spark, read_files(spark, folder, USAGE), lambda batch: counters.window_totals(batch, TZ, width),
                         str(tmp_path / width.replace(" ", "")), ["window_start"])
        expected = ledger.groupBy((F.col("ts_ms") / size).cast("long")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost_micros").alias("c"))
        assert sorted((row.reqs, row.cost_micros) for row in found.collect()) == sorted((row.n, row.c) for row in expected.collect())
    assert found.orderBy("window_start").first().window_start == "2024-01-01 00:00:00"


def log(seed, count=300):
    rng = random.Random(seed)
    limits = {name: (rng.choice([None, 20]), rng.choice([None, 100]), rng.choice([None, 1, 2])) for name in "abcde"}
    rows, at = [], MIDNIGHT
    for i in range(count):
        at += rng.choice([0, 500, 30_000, 600_000, 2_000_000])
        name = rng.choice("abcde")
        rows.append((i, name, at, at + rng.choice([0, 1000, 50_000_000]), rng.choice([0, 10]), *limits[name]))
    return rows


def decisions(spark, source, out, state, initial=None):
    admission.admission_stream(read_files(spark, source, SCHEMA), TZ, out, state, initial).awaitTermination()
    return {row.id: row.decision for row in spark.read.parquet(out).collect()}


def test_admission_stream_equals_the_loop_over_a_restart(spark, tmp_path):
    rows = log(4)
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    frames = [spark.createDataFrame(rows[a:a + 100], SCHEMA) for a in range(0, 300, 100)]
    write_files(spark, source, frames[:2])
    assert len(decisions(spark, source, out, state)) == 200
    write_files(spark, source, frames)
    found = decisions(spark, source, out, state)
    assert found == brute(rows)
    assert {"ok", "rpm", "request_limit", "token_limit"} == set(found.values())


def test_admission_stream_starts_from_stored_counters(spark, tmp_path):
    """After a restart without state the counters of the day come from the ledger."""
    used = [("a", 2, 0), ("b", 0, 50)]
    start = spark.createDataFrame(used, "username string, requests long, tokens long").withColumn("day", F.lit("2024-01-01"))
    rows = [(0, "a", MIDNIGHT + 5, None, 0, 3, None, None), (1, "a", MIDNIGHT + 6, None, 0, 3, None, None),
            (2, "b", MIDNIGHT + 7, None, 0, None, 50, None), (3, "a", MIDNIGHT + DAY, None, 0, 3, None, None)]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(spark, source, [spark.createDataFrame(rows, SCHEMA)])
    found = decisions(spark, source, out, state, start)
    assert found == {0: "ok", 1: "request_limit", 2: "token_limit", 3: "ok"}


def test_request_rate(spark, ledger_files, tmp_path):
    folder, ledger = ledger_files
    requests = read_files(spark, folder, USAGE).withColumn("start_ms", F.col("ts_ms"))
    found = run_live(spark, requests, lambda batch: counters.request_rate(batch, TZ), str(tmp_path), ["window_start", "username"])
    assert found.agg(F.sum("reqs")).first()[0] == 6 * 400


def test_today_counters_feed_the_stream(ledger_files):
    from datetime import date

    _, ledger = ledger_files
    assert set(reports.today_counters(ledger, date(2024, 1, 1)).columns) == {"username", "requests", "tokens"}


def test_a_batch_reads_its_own_days_only(spark, tmp_path):
    """A day in each batch: what a batch meets of the past does not grow with their number."""
    rows = [(d * 10 + k, "a", MIDNIGHT + d * DAY + k * 1000, MIDNIGHT + d * DAY + k * 1000 + (DAY if k == 9 else 0), 5, 8, None, None)
            for d in range(6) for k in range(10)]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    write_files(spark, source, [spark.createDataFrame(rows[d * 10:d * 10 + 10], SCHEMA) for d in range(6)])
    assert decisions(spark, source, out, state) == brute(rows)
    sizes = [admission.stored_days(spark, out, [f"2024-01-0{d + 1}"], 99).count() for d in range(6)]
    assert sizes == [10] * 6
    assert len(admission.stored_days(spark, out, ["2024-01-03"], 99).inputFiles()) == 1
    assert admission.stored_days(spark, out, ["2024-01-03"], 2).count() == 0
    assert admission.stored_days(spark, out, ["2030-01-01"], 99).count() == 0
