from datetime import date

import pytest
from pyspark.sql import functions as F

from usagelens.functions.pricing import PriceBook, default_prices
from usagelens.operators import reprice
from usagelens.plans import filters, ranking, reports, reshape
from usagelens.plans.cube import usage_cube
from usagelens.plans.dashboard import command_report, dashboard
from usagelens.schema import USAGE
from usagelens.sources.ledger import append_usage, conform, from_dollar_rows, list_users, read_usage, read_users

TZ = "Asia/Shanghai"
MIDNIGHT = 1704038400000  # 2024-01-01 00:00 in TZ
HOUR = 3_600_000


def usage(spark, rows):
    """Rows as dicts over defaults; ids count up."""
    filled = []
    for i, row in enumerate(rows):
        full = {"id": i, "ts_ms": MIDNIGHT, "day": "2024-01-01", "username": "a", "api_key": "k", "model": "gpt-5.5",
                "stream": 1, "status": 200, "input_tokens": 1, "output_tokens": 1, "cache_creation_tokens": 0,
                "cache_read_tokens": 0, "cost_micros": 10, "latency_ms": 5, "path": "/p", "error": None, "client": "cli"}
        full.update(row)
        filled.append(tuple(full[name] for name in USAGE.names))
    return spark.createDataFrame(filled, USAGE)


def rows(frame, *names):
    return [tuple(row[name] for name in names or frame.columns) for row in frame.collect()]


@pytest.fixture(scope="module")
def sample(spark):
    return usage(spark, [
        {"username": "a", "model": None, "input_tokens": None, "output_tokens": 5, "cost_micros": 149},
        {"username": "a", "model": "", "input_tokens": 3, "cost_micros": 150, "client": None},
        {"username": "b", "model": "gpt-5-codex", "day": "2024-01-02", "ts_ms": MIDNIGHT + 25 * HOUR, "client": "desktop"},
        {"username": "b", "model": "x", "input_tokens": 0, "output_tokens": 0, "cost_micros": 7, "client": "web",
         "day": "2024-01-02", "ts_ms": MIDNIGHT + 30 * HOUR},
        # stored under another day than its time says
        {"username": "c", "day": "2024-01-02", "ts_ms": MIDNIGHT + 50 * HOUR, "cache_read_tokens": None, "cost_micros": 300},
    ])


def test_null_parts(sample):
    assert rows(reports.by_user(sample), "username", "reqs", "it", "ot", "cr", "cost_micros") == [
        ("c", 1, 1, 1, None, 300), ("a", 2, 3, 6, 0, 299), ("b", 2, 1, 1, 0, 17)]
    # A NULL part drops the row from the sum over both.
    assert rows(reports.by_day(sample), "day", "it", "ot", "io") == [("2024-01-02", 2, 2, 4), ("2024-01-01", 3, 6, 4)]
    assert rows(reports.summary(sample)) == [(5, 5 + 8, 616, 317)]


def test_model_labels_stay_apart(sample):
    assert {row[0] for row in rows(reports.by_model(sample))} == {None, "", "gpt-5-codex", "x", "gpt-5.5"}
    assert {row[1] for row in rows(reports.by_user_model(sample))} == {"-", "", "gpt-5-codex", "x", "gpt-5.5"}
    series = {row[:2] for row in rows(reshape.series_user_model_day(sample), "username", "model")}
    assert ("a", "未知模型") in series and ("a", "-") in series
    assert ("", "a") in {row[:2] for row in rows(reshape.series_model_user_day(sample), "model", "username")}


def test_stored_day_with_hour_of_time(sample):
    found = rows(reports.by_day_hour_user(sample, TZ), "day", "hour", "username")
    assert found == [("2024-01-01", 0, "a"), ("2024-01-02", 1, "b"), ("2024-01-02", 2, "c"), ("2024-01-02", 6, "b")]


def test_cube_gives_the_same_reports(sample):
    cube = usage_cube(sample, TZ)
    for report in (reports.by_user, reports.by_day, reports.by_model, reports.by_user_client, reports.by_user_model,
                   reports.by_day_user, reports.by_day_user_model, reports.summary, reshape.pivot_user_family,
                   reshape.pivot_user_client, reshape.series_user_day, reshape.day_user_matrix):
        assert sorted(map(repr, rows(report(cube)))) == sorted(map(repr, rows(report(sample))))


def test_totals_agree(sample):
    total = sample.agg(F.sum("cost_micros")).first()[0]
    for frame in (reports.by_user(sample), reports.by_day_user(sample), reports.by_day_hour_user(sample, TZ)):
        assert frame.agg(F.sum("cost_micros")).first()[0] == total
    assert reports.summary(sample).first().total_cost_micros == total


def test_ranges(spark):
    frame = usage(spark, [{"day": f"2024-01-{day:02d}", "username": str(day)} for day in range(1, 32)])
    as_of = date(2024, 1, 31)
    sizes = {name: filters.in_range(frame, as_of, name).count() for name in ("today", "7", "period", "30", "nonsense")}
    assert sizes == {"today": 1, "7": 7, "period": 7, "30": 30, "nonsense": 7}
    assert filters.select_usage(frame, as_of, "30", "5").count() == 1
    assert filters.select_usage(frame, as_of, "7", "5").count() == 0
    assert reports.by_day(frame).count() == 30


def test_rolling_days(spark):
    now = MIDNIGHT + 48 * HOUR
    frame = usage(spark, [{"ts_ms": now - 36 * HOUR, "day": "2024-01-01"}, {"ts_ms": now - 36 * HOUR - 1, "day": "2024-01-01"},
                          {"ts_ms": now, "day": "2024-01-03"}])
    assert filters.rolling_days(frame, now, 1.5, TZ).count() == 2
    assert filters.rolling_days(frame, now, None, TZ).count() == 3
    assert filters.rolling_days(frame, now, 0, TZ).count() == 3


def test_pivot_and_active_buckets(sample):
    matrix = reshape.pivot_user_family(sample)
    found = {row[0]: row[1:] for row in rows(matrix, "username", "gpt_tok", "codex_tok", "other_tok", "other_cost_micros",
                                            "total_tok", "total_cost_micros")}
    assert found == {"c": (2, 0, 0, 0, 2, 300), "a": (0, 0, 4, 299, 4, 299), "b": (0, 2, 0, 7, 2, 17)}
    assert [row[0] for row in rows(matrix, "username")] == ["c", "a", "b"]
    # User b has cost but no tokens in the last bucket; user a keeps it active.
    only_b = reshape.active_buckets(matrix.where("username = 'b'"), reshape.family_names())
    assert rows(only_b, "bucket", "active") == [("gpt", False), ("codex", True), ("other", False)]
    clients = {row[0]: row[1:] for row in rows(reshape.pivot_user_client(sample), "username", "cli_tok", "desktop_tok", "other_tok")}
    assert clients == {"a": (0, 0, 4), "b": (0, 2, 0), "c": (2, 0, 0)}


def test_dense_series(sample):
    found = rows(reshape.series_user_day(sample), "username", "day", "tok", "cost_micros", "user_cost_micros")
    assert sorted(found) == [
        ("a", "2024-01-01", 4, 300, 300), ("a", "2024-01-02", 0, 0, 300), ("b", "2024-01-01", 0, 0, 0),
        ("b", "2024-01-02", 2, 0, 0), ("c", "2024-01-01", 0, 0, 300), ("c", "2024-01-02", 2, 300, 300)]
    assert reshape.series_user_day(sample, scoped=True).count() == 0
    flags = {row[:2]: row[2:] for row in rows(reshape.series_user_model_day(sample), "username", "model", "any_tok", "any_cost")}
    assert flags[("a", "-")] == (False, True) and flags[("b", "x")] == (False, False)


def test_series_keep_only_the_newest_days(spark):
    frame = usage(spark, [{"day": f"2024-01-{day:02d}", "username": "old" if day == 1 else "new"} for day in range(1, 32)])
    found = rows(reshape.series_user_day(frame), "username", "day", "tok")
    assert len(found) == 60 and sum(tok for name, _, tok in found if name == "old") == 0


def test_hour_grid(sample):
    found = rows(reshape.grid_day_hour_user(sample, TZ), "day", "username", "hour", "tok", "cost_micros", "user_day_cost_micros")
    second = [row[1:] for row in found if row[0] == "2024-01-02"]
    assert second == [("c", 1, 0, 0, 300), ("c", 2, 2, 300, 300), ("c", 6, 0, 0, 300),
                      ("b", 1, 2, 10, 17), ("b", 2, 0, 0, 17), ("b", 6, 0, 7, 17)]
    dense = rows(reshape.hours_dense(sample, TZ), "hour", "tok")
    assert len(dense) == 24 and dict(dense)[0] == 4 and dict(dense)[5] == 0


def test_today(sample):
    cube = rows(reshape.today_hour_cube(sample, date(2024, 1, 2), TZ), "level", "hour", "username", "tok", "cost_micros")
    assert cube[0] == (3, None, None, 4, 317)
    assert [row[2:] for row in cube if row[0] == 2] == [("c", 2, 300), ("b", 2, 17)]
    assert rows(reshape.today_hour_scoped(sample, date(2024, 1, 2), TZ, "b")) == [(1, 1, 2, 10), (6, 1, 0, 7)]
    assert rows(reports.today_counters(sample, date(2024, 1, 1))) == [("a", 2, 4)]
    assert sorted(rows(reports.today_counters(sample, date(2024, 1, 2)))) == [("b", 2, 2), ("c", 1, 0)]


def test_empty_ledger(spark):
    frame = usage(spark, [])
    assert rows(reports.summary(frame)) == [(0, 0, 0, 0)]
    assert rows(reports.by_user(frame)) == [] and rows(reshape.series_user_day(frame)) == []
    assert rows(reshape.active_buckets(reshape.pivot_user_family(frame), ["gpt"])) == [(0, "gpt", False)]
    assert sum(row[1] for row in rows(reshape.hours_dense(frame, TZ))) == 0
    assert rows(reprice.reprice_preview(frame, default_prices())) == [(0, 0, 0, 0)]
    assert rows(reshape.today_hour_cube(frame, date(2024, 1, 1), TZ)) == []


def test_shares_and_ranks(spark):
    frame = spark.createDataFrame([("a", 30), ("b", 60), ("c", 0), ("d", 30), ("e", None)], "username string, cost_micros long")
    assert dict(rows(ranking.share_of_max(frame, "cost_micros"), "username", "pct_of_max")) == {
        "a": 50.0, "b": 100.0, "c": 0.0, "d": 50.0, "e": 0.0}
    zero = ranking.share_of_max(frame.where("cost_micros = 0"), "cost_micros")
    assert rows(zero, "pct_of_max") == [(0.0,)]
    assert rows(ranking.share_of_total(frame, "cost_micros"), "username", "share")[0] == ("b", 0.5)
    assert rows(ranking.rank_users(frame), "username", "rank") == [("b", 1), ("a", 2), ("d", 2), ("c", 4), ("e", 4)]


def test_rank_over_many_magnitudes(spark):
    values = [0, 1, 2, 3, 15, 16, 17, 1023, 1024, 10**6, 10**6 + 1, 10**12, 2**53, 2**53 + 1, 2**62, 2**63 - 1] * 2
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v long")
    found = rows(ranking.global_rank(frame, "v"), "v", "rank")
    assert all(rank == 1 + sum(other > value for other in values) for value, rank in found) and len(found) == len(values)


def test_rank_when_half_of_the_rows_share_a_value(spark):
    values = [7] * 3000 + [0] * 1000 + [k % 700 * 3 for k in range(2000)] + [None] * 50
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v long")
    held = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for name, value in zip(held, ("false", "-1")):
            spark.conf.set(name, value)
        ranked = ranking.global_rank(frame, "v").withColumn("part", F.spark_partition_id())
        found = rows(ranked, "i", "v", "rank", "part")
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    plain = sorted((v or 0 for v in values), reverse=True)
    first = {v: plain.index(v) + 1 for v in set(plain)}
    assert sorted(((i, v, rank) for i, v, rank, _ in found), key=lambda row: row[0]) == [(i, v, first[v or 0]) for i, v in enumerate(values)]
    parts = [part for _, v, _, part in found if v == 7]
    assert len(set(parts)) == 8 and max(map(parts.count, set(parts))) < 600


def test_trailing_minute(spark):
    at = [0, 0, 1, 59_999, 60_000, 60_001, 120_000, 299_999, 300_000, 359_998, 359_999, 86_399_999, 86_400_000]
    frame = spark.createDataFrame([(i, "u", MIDNIGHT + value) for i, value in enumerate(at)], "id long, username string, start_ms long")
    for slice_ms in (60_000, 300_000):
        found = dict(rows(ranking.rpm_trailing(frame, TZ, slice_ms), "id", "trailing"))
        for i, value in enumerate(at):
            same_day = [x for x in at if x // 86_400_000 == value // 86_400_000]
            assert found[i] == sum(value - 60_000 < x <= value for x in same_day)


REPRICE = [
    {"id": 1, "model": "gpt-5.6-sol", "input_tokens": 10**6, "output_tokens": 10**6, "cost_micros": 0},
    {"id": 2, "model": "unknown-model", "input_tokens": 10**6, "output_tokens": 10**6, "cost_micros": 0},
    {"id": 3, "model": "gpt-5.6-sol", "input_tokens": 0, "output_tokens": 0, "cost_micros": 0, "status": 500},
]


def test_reprice(spark, tmp_path):
    frame, book = usage(spark, REPRICE), default_prices()
    assert rows(reprice.reprice_preview(frame, book)) == [(1, 1, 0, 24_000_000)]
    again = reprice.reprice_apply(frame, book)
    assert again.columns == frame.columns
    assert sorted(rows(again, "id", "cost_micros")) == [(1, 24_000_000), (2, 0), (3, 0)]
    assert rows(reprice.reprice_preview(again, book)) == [(1, 0, 24_000_000, 24_000_000)]
    assert rows(reprice.reprice_days(frame, book)) == [("2024-01-01",)]
    source, copy = str(tmp_path / "v1"), str(tmp_path / "v2")
    append_usage(frame, source)
    for _ in range(2):
        reprice.write_repriced(spark, source, book, copy)
        assert sorted(rows(read_usage(spark, copy), "id", "cost_micros")) == [(1, 24_000_000), (2, 0), (3, 0)]
    with pytest.raises(ValueError):
        reprice.write_repriced(spark, source, book, source + "/")


def test_reprice_in_place_touches_changed_days_only(spark, tmp_path):
    import os

    book, path = default_prices(), str(tmp_path / "ledger")
    right = {**REPRICE[0], "id": 9, "day": "2024-01-02", "cost_micros": 24_000_000}
    append_usage(usage(spark, [*REPRICE, right]), path)
    kept = os.listdir(f"{path}/day=2024-01-02")
    for _ in range(2):
        reprice.reprice_ledger(spark, path, book)
        assert sorted(rows(read_usage(spark, path), "id", "cost_micros")) == [
            (1, 24_000_000), (2, 0), (3, 0), (9, 24_000_000)]
    assert os.listdir(f"{path}/day=2024-01-02") == kept


def test_rounding_of_imported_rows_is_no_change(spark):
    """Costs kept as floating-point dollars may be a micro-dollar off; with that tolerance nothing changes."""
    book = default_prices()
    frame = usage(spark, [{"id": 1, "model": "gpt-5.6-sol", "input_tokens": 10**6, "output_tokens": 10**6, "cost_micros": 23_999_999}])
    assert rows(reprice.reprice_preview(frame, book)) == [(1, 1, 23_999_999, 24_000_000)]
    assert rows(reprice.reprice_preview(frame, book, reprice.ROUNDING_MICROS)) == [(1, 0, 23_999_999, 23_999_999)]
    assert rows(reprice.reprice_apply(frame, book, reprice.ROUNDING_MICROS), "cost_micros") == [(23_999_999,)]
    assert rows(reprice.reprice_days(frame, book, reprice.ROUNDING_MICROS)) == []


def test_reprice_with_a_missing_cost(spark):
    frame = usage(spark, [{"cost_micros": None, "model": "free", "input_tokens": 5}])
    assert rows(reprice.reprice_preview(frame, PriceBook.from_dollars([("free", "0", "0", "0", "0")]))) == [(1, 0, 0, 0)]


def test_ledger_round_trip(spark, sample, tmp_path):
    path = str(tmp_path / "ledger")
    append_usage(sample, path)
    append_usage(sample.drop("client"), path)
    back = read_usage(spark, path)
    assert back.schema.names == USAGE.names
    assert sorted(map(repr, rows(back.where("client IS NOT NULL")))) == sorted(map(repr, rows(sample.where("client IS NOT NULL"))))
    assert back.count() == 10
    assert conform(sample.select("id", "day")).schema.names == USAGE.names
    assert read_users(spark, str(tmp_path / "missing")).count() == 0
    people = spark.createDataFrame([("sk-0123456789", "b"), ("short", "a")], "api_key string, username string")
    assert rows(list_users(people, mask_keys=True), "api_key", "username") == [("***", "a"), ("***6789", "b")]
    old = sample.withColumnsRenamed({"ts_ms": "ts"}).withColumn("cost_usd", F.col("cost_micros") / 1e6).drop("cost_micros", "client")
    assert sorted(map(repr, rows(from_dollar_rows(old).drop("client")))) == sorted(map(repr, rows(sample.drop("client"))))


def test_dashboard(sample):
    page = dashboard(sample, date(2024, 1, 2), TZ)
    assert page["summary"].first().total_reqs == 5
    assert {name: frame.count() for name, frame in page.items()}["by_day"] == 2
    own = dashboard(sample, date(2024, 1, 2), TZ, username="b")
    assert own["summary"].first().total_reqs == 2 and own["series_user_day"].count() == 0
    assert rows(own["today_hours"], "hour") == [(1,), (6,)]
    report = command_report(sample, MIDNIGHT + 60 * HOUR, TZ, days=1)
    assert rows(report["by_user"], "username") == [("c",)] and "day_user_matrix" in report
    assert "day_user_matrix" not in command_report(sample, MIDNIGHT, TZ, username="a")
