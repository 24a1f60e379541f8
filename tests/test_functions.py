from datetime import date

import pytest
from pyspark.sql import functions as F

from usagelens.functions import clock, labels, pricing, tokens
from usagelens.functions.pricing import PriceBook, default_prices

M = 1_000_000
USAGE_ROW = "model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long"


def costs(spark, rows, book=None):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + USAGE_ROW)
    priced = pricing.attach_cost(frame, book or default_prices())
    return [row.cost_micros for row in priced.orderBy("i").collect()]


def test_costs_of_known_models(spark):
    models = ["gpt-6-astra", "gpt-6.1-sol", "gpt-6-sol", "gpt-6-luna", "gpt-5.6-sol", "gpt-5.6-terra",
              "gpt-5.6-luna", "gpt-5.5", "gpt-5.3-codex", "gpt-5.2"]
    expected = [51.0, 10.1, 10.2, 0.51, 20.4, 12.2, 1.22, 30.5, 14.175, 14.175]
    found = costs(spark, [(model, M, M, 0, M) for model in models])
    assert found == [round(value * M) for value in expected]


def test_cost_edges(spark):
    rows = [
        ("gpt-6.1-sol", M, M, 0, 0),
        ("gpt-6-astra", 0, 0, M, 0),
        ("gpt-5.6-sol-2026-08-01", 1, 0, 0, 0),
        ("unknown", M, M, M, M),
        (None, M, M, 0, 0),
        ("", M, M, 0, 0),
        ("GPT-5.5", M, 0, 0, 0),
        ("gpt-5.5", 10, 0, 0, 1000),     # cached is cut to the input
        ("gpt-5.5", 10, 0, 0, -5),       # negative cached counts as none
        ("gpt-6-luna", 0, 1, 0, 0),      # half a micro-dollar rounds up
        ("gpt-5.5", None, None, None, None),
        ("gpt-5.5", 1, -1, 0, 0),        # negative counts are priced too
    ]
    assert costs(spark, rows) == [12 * M, 0, 4, 0, 0, 0, 0, 5, 50, 1, 0, -25]


def test_longest_prefix_wins_both_ways(spark):
    book = PriceBook.from_dollars([("gpt-5", "1", "1", "0", "0"), ("gpt-5.5", "2", "2", "0", "0"), ("g", "3", "0", "0", "0")])
    models = ["gpt-5.5-x", "gpt-5.4", "gpt-4", "claude", "", None, "gpt-5"]
    frame = spark.createDataFrame([(model,) for model in models], "model string")
    results = []
    for inline in (10, 0):
        rows = pricing.attach_prices(frame, book, inline_prefixes=inline)
        results.append({row.model: (row.price.in_milli if row.price else None, row.priced) for row in rows.collect()})
    assert results[0] == results[1]
    assert results[0] == {"gpt-5.5-x": (2000, True), "gpt-5.4": (1000, True), "gpt-4": (3000, True),
                          "claude": (None, False), "": (None, False), None: (None, False), "gpt-5": (1000, True)}


def test_price_book_is_validated(spark, tmp_path):
    for rows in ([("a", "0.0001", "0", "0", "0")], [("a", "-1", "0", "0", "0")],
                 [("", "1", "0", "0", "0")], [("a", "1", "0", "0", "0")] * 2):
        with pytest.raises(ValueError):
            PriceBook.from_dollars(rows)
    path = tmp_path / "prices.csv"
    path.write_text("prefix,in,out,cw,cr\ngpt-x,1.5,2,0,0.001\n")
    book = PriceBook.from_csv(str(path))
    assert book.rows == (("gpt-x", 1500, 2000, 0, 1),)
    assert PriceBook.from_dataframe(book.dataframe(spark)) == book


def test_no_prices_at_all(spark):
    assert costs(spark, [("gpt-5.5", M, M, 0, 0)], PriceBook(())) == [0]


def test_rounding_of_micros(spark):
    row = spark.range(1).select(
        pricing.round_micros(F.lit(149), 4).alias("a"), pricing.round_micros(F.lit(150), 4).alias("b"),
        pricing.micros_of_dollars(F.lit(0.1234565)).alias("c")).first()
    assert (row.a, row.b, row.c) == (100, 200, 123457)


def test_labels(spark):
    agents = {"codex-cli/0.131": "cli", "Codex Desktop": "desktop", "CODEX.APP": "desktop", "openai-node/4": "cli",
              "OpenAI-Python/1": "cli", "curl": "other", "": "other", None: "other"}
    rows = spark.createDataFrame([(key,) for key in agents], "ua string").select("ua", labels.client_class("ua").alias("c"))
    assert {row.ua: row.c for row in rows.collect()} == agents
    models = {"gpt-5-codex": "Codex", "gpt-4.1": "GPT", "other": "其他", None: "其他", "GPT-X": "GPT"}
    rows = spark.createDataFrame([(key,) for key in models], "m string").select("m", labels.model_family("m").alias("f"))
    assert {row.m: row.f for row in rows.collect()} == models
    tags = {"legacy": "过渡", "auto-1": "测试", "alice": None}
    rows = spark.createDataFrame([(key,) for key in tags], "n string").select("n", labels.user_tag("n").alias("t"))
    assert {row.n: row.t for row in rows.collect()} == tags


def test_caller_key(spark):
    cases = [("k", "Bearer x", "k"), ("", "Bearer  x\t", "x"), (None, "Bearer x", "x"), ("", "bearer x", ""),
             (None, None, ""), ("", "Bearer ", "")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    found = rows.select("i", labels.caller_key("a", "b").alias("k")).orderBy("i").collect()
    assert [row.k for row in found] == [case[2] for case in cases]


def test_local_time_over_a_clock_change(spark):
    # 2024-03-10 07:00 UTC is the moment New York goes from 02:00 to 03:00.
    instants = [1710053999000, 1710054000000, 1704038399999, 1704038400000]
    rows = spark.createDataFrame([(value,) for value in instants], "ts_ms long")
    found = rows.select("ts_ms", clock.local_hour("ts_ms", "America/New_York").alias("h"),
                        clock.local_day("ts_ms", "Asia/Shanghai").alias("d")).collect()
    by_ts = {row.ts_ms: (row.h, row.d) for row in found}
    assert [by_ts[value][0] for value in instants[:2]] == [1, 3]
    assert [by_ts[value][1] for value in instants[2:]] == ["2023-12-31", "2024-01-01"]
    for zone in ("Asia/Shanghai", "+08:00"):
        assert clock.local_day_start_ms(date(2024, 1, 1), zone) == 1704038400000


def test_fixed_offsets_equal_named_zones(spark):
    instants = [-1, 0, 1, -86400001, 1704038399999, 1704038400000, 1710053999000, 1710054000000, 1719835199999]
    rows = spark.createDataFrame([(value,) for value in instants], "ts_ms long")
    for named, fixed in (("Asia/Kolkata", "+05:30"), ("Etc/GMT+7", "-07:00"), ("Etc/UTC", "UTC")):
        found = rows.select(*[
            function("ts_ms", zone).alias(f"{function.__name__}_{i}")
            for i, zone in enumerate((named, fixed))
            for function in (clock.local_timestamp, clock.local_day, clock.local_hour)]).collect()
        for row in found:
            assert tuple(row)[:3] == tuple(row)[3:]


def test_epoch_of_wall_clock(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 08:00:00.1239' AS ts")
    row = rows.select(clock.epoch_ms("ts").alias("utc"), clock.epoch_ms("ts", "Asia/Shanghai").alias("cn")).first()
    assert (row.utc, row.cn) == (1704096000123, 1704067200123)
    # This wall-clock time does not exist in the session zone, New York.
    gap = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.5' AS ts").withColumn("ms", clock.epoch_ms("ts"))
    found = gap.select("ms", clock.ntz_text(clock.local_timestamp("ms", "UTC")).alias("text"),
                       clock.wall_clock_text(clock.wall_clock("ms", "UTC")).alias("wall")).first()
    assert tuple(found) == (1710037800500, "2024-03-10 02:30:00", "2024-03-10 02:30:00")


def test_expiry(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, None)], "i int, days double")
    made = rows.withColumn("e", clock.expiry_ms(1704038400000, F.col("days")))
    found = {row.i: (row.e, row.d) for row in made.withColumn("d", clock.expiry_day("e", "Asia/Shanghai")).collect()}
    assert found == {1: (1704081600000, "2024-01-01"), 2: (None, None), 3: (None, None)}


COUNTS = {
    None: (0, False), "null": (0, False), "0": (0, False), "false": (0, False), '""': (0, False), "[]": (0, False),
    "{}": (0, False), "0.0": (0, False), "12": (12, False), "10.7": (10, False), "1e3": (1000, False),
    '"12"': (12, False), '" +1_000 "': (1000, False), "true": (1, False), '"abc"': (0, True), '"10.7"': (0, True),
    "[1]": (0, True), '{"a":1}': (0, True), "99999999999999999999999": (0, True), "-3": (-3, False),
}


def usage_counts(spark, usages):
    rows = spark.createDataFrame([(i, usage) for i, usage in enumerate(usages)], "i int, text string")
    parsed = tokens.attach_document(rows, "text", "usage")
    counted = tokens.attach_usage_counts(parsed).orderBy("i").collect()
    return [(row.input_tokens, row.output_tokens, row.cache_read_tokens, row.bad_usage) for row in counted]


def test_count_truth_table(spark):
    usages, expected = [], []
    for text, (value, bad) in COUNTS.items():
        usages.append('{"prompt_tokens":5}' if text is None else f'{{"input_tokens":{text},"prompt_tokens":5}}')
        # An absent key falls back to the other dialect, a present one never does.
        expected.append((5 if text is None else value, 0, 0, bad))
    assert usage_counts(spark, usages) == expected


def test_cached_fall_back_on_falsiness(spark):
    assert usage_counts(spark, [
        '{"input_tokens_details":null,"prompt_tokens_details":{"cached_tokens":2}}',
        '{"input_tokens_details":{},"prompt_tokens_details":{"cached_tokens":2}}',
        '{"input_tokens_details":{"cached_tokens":0},"cached_tokens":7}',
        '{"input_tokens_details":{"cached_tokens":3},"prompt_tokens_details":{"cached_tokens":2},"cached_tokens":7}',
        '{"input_tokens_details":[1],"input_tokens":4}',
        '{"input_tokens_details":{"cached_tokens":"x"},"input_tokens":4,"cached_tokens":1}',
        "{}", "[]", "null", "5", '"text"',
    ]) == [(0, 0, 2, False), (0, 0, 2, False), (0, 0, 7, False), (0, 0, 3, False), (0, 0, 0, True), (0, 0, 0, True),
           (0, 0, 0, False), (0, 0, 0, False), (0, 0, 0, False), (0, 0, 0, True), (0, 0, 0, True)]


def test_document_is_one_whole_text(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "", "x", None, "[1]", "7"]
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string")
    found = tokens.attach_document(rows, "t").select("i", F.to_json("doc").alias("d")).orderBy("i").collect()
    assert [row.d for row in found] == ['{"a":1}', '{"a":1}', None, None, None, None, None, None, "[1]", "7"]
