import heapq
import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import admission, auth, quota

TZ = "Asia/Shanghai"
MIDNIGHT = 1704038400000
DAY = 86_400_000
SCHEMA = ("id long, username string, start_ms long, end_ms long, total_tokens long, daily_request_limit long, "
          "daily_token_limit long, rpm_limit long")


def brute(requests):
    """One event after the other, as the rules say."""
    state, found = {}, {}
    for row, name, start, end, total, drl, dtl, rpm in sorted(requests, key=lambda r: (r[2], r[0])):
        own = state.setdefault(name, {"day": None, "n": 0, "tok": 0, "times": [], "open": []})

        def enter(time):
            day = (time - MIDNIGHT) // DAY
            if own["day"] != day:
                own.update(day=day, n=0, tok=0, times=[])

        while own["open"] and own["open"][0][0] <= start:
            finished, tokens = heapq.heappop(own["open"])
            enter(finished)
            own["tok"] += tokens
        enter(start)
        recent = [t for t in own["times"] if start - t < 60_000]
        if drl and own["n"] >= drl:
            found[row] = "request_limit"
        elif dtl and own["tok"] >= dtl:
            found[row] = "token_limit"
        elif rpm and len(recent) >= rpm:
            found[row] = "rpm"
        else:
            found[row] = "ok"
            own["n"] += 1
            if rpm:
                own["times"] = recent + [start]
            if total and end is not None:
                heapq.heappush(own["open"], (end, total))
    return found


def replay(spark, requests):
    frame = spark.createDataFrame(requests, SCHEMA)
    return {row.id: row.decision for row in admission.admission_replay(frame, TZ).collect()}


def one_user(spark, starts, drl=None, dtl=None, rpm=None, total=0, latency=0, name="u"):
    rows = [(i, name, MIDNIGHT + at, MIDNIGHT + at + latency, total, drl, dtl, rpm) for i, at in enumerate(starts)]
    found = replay(spark, rows)
    assert found == brute(rows)
    return [found[i] for i in range(len(starts))]


def test_request_limit_and_rpm(spark):
    assert one_user(spark, [0, 0, 0], drl=2, rpm=2) == ["ok", "ok", "request_limit"]
    assert one_user(spark, [0, 0, 0], rpm=2) == ["ok", "ok", "rpm"]
    assert one_user(spark, [0, 0, 0], drl=0, rpm=0, dtl=0) == ["ok"] * 3


def test_minute_border(spark):
    assert one_user(spark, [0, 59_999, 60_000, 60_001], rpm=1) == ["ok", "rpm", "ok", "rpm"]


def test_midnight_clears_the_minute_and_the_counters(spark):
    assert one_user(spark, [DAY - 1, DAY - 1, DAY], rpm=1) == ["ok", "rpm", "ok"]
    assert one_user(spark, [DAY - 2, DAY - 1, DAY], drl=1) == ["ok", "request_limit", "ok"]


def test_refused_requests_do_not_count(spark):
    # Refused by the minute: not counted against the day.
    assert one_user(spark, [0, 1, 60_000, 120_000], drl=2, rpm=1) == ["ok", "rpm", "ok", "request_limit"]


def test_tokens_count_on_completion(spark):
    assert one_user(spark, [0, 5, 10, 11], dtl=10, total=10, latency=10) == ["ok", "ok", "token_limit", "token_limit"]
    # A request without any duration counts for the next one of the same time.
    assert one_user(spark, [0, 0], dtl=10, total=10) == ["ok", "token_limit"]
    assert one_user(spark, [0, 0, 1], dtl=10, total=10, rpm=5) == ["ok", "token_limit", "token_limit"]


def test_completion_after_midnight_counts_there(spark):
    # The open request of the old day uses up the new day's tokens when it ends.
    assert one_user(spark, [DAY - 5, DAY, DAY + 10], dtl=10, total=10, latency=10) == ["ok", "ok", "token_limit"]


def test_limits_of_each_key_with_shared_counters(spark):
    rows = [(0, "u", MIDNIGHT, MIDNIGHT, 0, 1, None, None), (1, "u", MIDNIGHT + 1, MIDNIGHT + 1, 0, None, None, None),
            (2, "u", MIDNIGHT + 2, MIDNIGHT + 2, 0, 3, None, None), (3, "u", MIDNIGHT + 3, MIDNIGHT + 3, 0, 1, None, None)]
    assert replay(spark, rows) == brute(rows) == {0: "ok", 1: "ok", 2: "ok", 3: "request_limit"}


def test_wrong_assumptions_over_many_midnights(spark):
    """Each day's only late request decides the next day, for ten days."""
    rows = []
    for day in range(10):
        base = MIDNIGHT + day * DAY
        rows.append((2 * day, "u", base + 1000, base + 1000 + DAY, 10, None, 10, None))
    assert replay(spark, rows) == brute(rows)
    assert sorted(set(brute(rows).values())) == ["ok", "token_limit"]


def random_log(rng, users, mixed):
    rows, row = [], 0
    for name in range(users):
        limits = [(rng.choice([0, None, 3, 20]), rng.choice([0, None, 50, 400]), rng.choice([0, None, 1, 3])) for _ in range(2)]
        at = rng.randrange(3 * DAY)
        for _ in range(rng.randint(1, 120)):
            at += rng.choice([0, 0, 1, 100, 7_000, 30_000, 60_000, 900_000, 8_000_000])
            length = rng.choice([0, 0, 5, 2_000, 100_000, 30_000_000, 100_000_000])
            end = None if rng.random() < 0.05 else MIDNIGHT + at + length
            rows.append((row, f"u{name}", MIDNIGHT + at, end, rng.choice([0, 1, 10, 60, None]),
                         *(rng.choice(limits) if mixed else limits[0])))
            row += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_logs(spark, seed, mixed):
    rows = random_log(random.Random(seed), 40, mixed)
    plain = [tuple(0 if value is None and i == 4 else value for i, value in enumerate(row)) for row in rows]
    assert replay(spark, rows) == brute(plain)


def test_negative_totals_open_a_day_again(spark):
    rows = [(i, "u", MIDNIGHT + i, MIDNIGHT + i, (-10 if i % 3 == 2 else 10), None, 10, None) for i in range(9)]
    assert replay(spark, rows) == brute(rows)


def test_hot_user_with_mixed_limits(spark):
    """A third of all rows is one user's, whose keys differ in every limit; the day falls into many stretches."""
    rng = random.Random(11)
    sets = [(None, None, 2), (200, None, 1), (None, 900, None), (300, 1500, 3), (None, None, None)]
    rows, at = [], 0
    for i in range(900):
        at += rng.choice([0, 1, 500, 20_000, 61_000])
        rows.append((i, "hot", MIDNIGHT + at, MIDNIGHT + at + rng.choice([0, 3_000, 400_000]), 5, *rng.choice(sets)))
    rows += [(1000 + i, f"u{i % 30}", MIDNIGHT + i * 1000, None, 0, 20, None, 2) for i in range(1800)]
    assert replay(spark, rows) == brute(rows)


def test_one_user_with_most_rows(spark):
    """A hot user: many requests in the same milliseconds of one minute."""
    rng = random.Random(5)
    rows = [(i, "hot", MIDNIGHT + rng.randrange(70_000), None, 0, 900, None, 700) for i in range(4000)]
    rows += [(5000 + i, f"u{i}", MIDNIGHT, None, 0, 900, None, 700) for i in range(50)]
    assert replay(spark, rows) == brute(rows)


def test_closed_form_equals_replay(spark):
    rng = random.Random(7)
    rows = [(i, f"u{rng.randrange(3)}", MIDNIGHT + rng.randrange(2 * DAY), None, 0, 40, None, None) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    closed = {row.id: row.decision for row in quota.admission_request_limit(frame, TZ).collect()}
    assert closed == replay(spark, rows) == brute(rows)


def test_quota_status(spark):
    users = spark.createDataFrame([("k1", "a", 10, 2), ("k2", "a", None, 0), ("k3", "b", 10, None), ("k4", "c", 10, 9)],
                                  "api_key string, username string, daily_token_limit long, daily_request_limit long")
    counters = spark.createDataFrame([("a", 2, 50), ("b", 1, 10)], "username string, requests long, tokens long")
    found = {row.api_key: tuple(row)[4:] for row in quota.quota_status(users, counters).collect()}
    assert found == {"k1": ("request_limit", 0, 0), "k2": ("ok", None, None), "k3": ("token_limit", None, 0), "k4": ("ok", 9, 10)}


def test_counter_events(spark):
    rows = [(0, "a", MIDNIGHT + DAY - 1, MIDNIGHT + DAY, 5, None, None, None), (1, "a", MIDNIGHT, MIDNIGHT + 1, 0, None, None, None)]
    found = quota.counter_events(spark.createDataFrame(rows, SCHEMA), TZ).collect()
    assert sorted(tuple(row) for row in found) == [("a", "2024-01-01", 2, 0), ("a", "2024-01-02", 0, 5)]


USERS = [("on", "alice", 1, None), ("off", "bob", 0, None), ("old", "carl", 1, 999), ("zero", "dora", 1, 0), ("edge", "eve", 1, 1000)]


def users(spark):
    frame = spark.createDataFrame(USERS, "api_key string, username string, enabled int, expires_at long")
    return frame.withColumns({name: F.lit(None).cast("long") for name in auth.LIMIT_COLUMNS})


def test_auth_decisions(spark):
    keys = ["on", "off", "old", "zero", "edge", "stranger", "x", ""]
    requests = spark.createDataFrame([(key, 1000) for key in keys], "api_key string, start_ms long")
    strict = {row.api_key: row.auth for row in auth.auth_decision(requests, users(spark), strict=True).collect()}
    assert strict == {"on": "ok", "off": "disabled", "old": "expired", "zero": "ok", "edge": "ok", "stranger": "unknown_key",
                      "x": "unknown_key", "": "unknown_key"}
    lax = {row.api_key: (row.auth, row.username, row.registered)
           for row in auth.auth_decision(requests, users(spark), strict=False).collect()}
    assert lax["stranger"] == ("ok", "auto-ranger", True) and lax["x"] == ("ok", "auto-x", True)
    assert lax[""] == ("unknown_key", None, False) and lax["off"] == ("disabled", "bob", False)


def test_outcomes(spark):
    base = {"id": 0, "auth": "ok", "admission": "ok", "method": "POST", "path": "/v1/responses", "content_length": 10,
            "payload": '{"stream":true}', "has_credentials": True, "upstream_status": 200, "client_gone": False}
    cases = [
        ({}, (200, "upstream", True), None),
        ({"auth": "unknown_key", "admission": None}, (401, "unknown_key", False), None),
        ({"auth": "expired", "admission": None}, (403, "expired", False), None),
        ({"admission": "rpm", "path": "/x"}, (429, "quota", False), None),
        ({"path": "/x", "content_length": 10**9}, (404, "endpoint", False), None),
        ({"path": "/models", "method": "GET", "content_length": 0, "payload": None}, (200, "upstream", True), (404, "endpoint", False)),
        ({"content_length": 20 * 1024 * 1024 + 1}, (413, "too_large", False), None),
        ({"content_length": 20 * 1024 * 1024}, (200, "upstream", True), None),
        ({"payload": "[]"}, (400, "not_object", False), None),
        ({"payload": "[]", "method": "GET"}, (200, "upstream", True), None),
        ({"payload": "not json"}, (200, "upstream", True), None),
        ({"payload": "{}"}, (200, "upstream", True), (400, "not_stream", False)),
        ({"has_credentials": False, "upstream_status": None}, (503, "no_credentials", True), None),
        ({"client_gone": True}, (200, "client_gone", False), None),
        ({"upstream_status": None}, (502, "upstream_failed", True), None),
        ({"upstream_status": 429}, (429, "upstream", True), None),
    ]
    schema = ("id long, auth string, admission string, method string, path string, content_length long, payload string, "
              "has_credentials boolean, upstream_status int, client_gone boolean")
    rows = [tuple({**base, "id": i, **change}.values()) for i, (change, _, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, schema)
    for login in (False, True):
        found = {row.id: (row.http_status, row.outcome, row.recorded) for row in auth.request_outcome(frame, login).collect()}
        for i, (change, plain, in_login) in enumerate(cases):
            assert found[i] == ((in_login or plain) if login else plain), change


def test_unsorted_rows_are_refused():
    import pandas as pd

    from usagelens.operators import keylife, minute

    ticks = pd.DataFrame({"username": ["b", "a"], "day": ["d", "d"], "stretch": [1, 1], "at": [1, 2], "place": [0, 0],
                          "starts": [1, 1], "rpm_limit": [1, 1], "fixed": [False, False]})
    with pytest.raises(ValueError):
        list(minute.admitted_starts(iter([ticks])))
    lives = pd.DataFrame({"api_key": ["k", "k"], "username": ["a", "b"], "seq": [2, 1], "ends": [None, None]})
    with pytest.raises(ValueError):
        list(keylife.lives(iter([lives])))


def contested(spark, rows):
    from usagelens.operators.per_minute import contested_starts

    frame = admission._prepared(spark.createDataFrame(rows, SCHEMA), TZ)
    return contested_starts(frame.where("rpm_limit != 0"))


def test_steady_traffic_within_the_limit_is_not_contested(spark):
    rows = [(i, "hot", MIDNIGHT + i * 10_000, None, 0, None, None, 6) for i in range(3000)]
    assert contested(spark, rows) is None
    burst = rows + [(5000, "hot", MIDNIGHT + 15_000_001, None, 0, None, None, 6)]
    near = contested(spark, burst).agg(F.min("at"), F.max("at"), F.countDistinct("stretch")).first()
    assert near[0] > MIDNIGHT + 14_900_000 and near[1] < MIDNIGHT + 15_100_000 and near[2] == 1
    assert replay(spark, burst) == brute(burst)


def test_a_saturated_user_is_cut_into_slices(spark):
    """A limit of one and starts all day long: slices of time are decided apart, none holds 2 % of the user's rows."""
    from usagelens.operators import minute

    rng = random.Random(3)
    rows, at = [], 0
    while at < 2 * DAY:
        rows.append((len(rows), "hot", MIDNIGHT + at, None, 0, None, None, 1))
        at += rng.choice([1, 500, 9_000, 20_000, 30_000])
    rows += [(10**6 + i, "b", MIDNIGHT + i * 59_999, None, 0, 30, None, 1) for i in range(400)]
    starts = contested(spark, rows)
    sizes = starts.where("sliced").groupBy("username", "day", "stretch", F.expr(f"at div {minute.SLICE_MS}")).count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    assert total > 0.9 * len(rows) and largest < 0.02 * total
    assert replay(spark, rows) == brute(rows)


def test_slices_in_small_batches():
    import pandas as pd

    from usagelens.operators import minute

    times = sorted(random.Random(1).sample(range(10 * minute.SLICE_MS), 3000))
    table = pd.DataFrame({"username": "u", "day": "d", "stretch": 1, "part": [t // minute.SLICE_MS for t in times], "at": times})
    cut = [table.iloc[k:k + 7].reset_index(drop=True) for k in range(0, len(table), 7)]
    ways = pd.concat(minute.slice_ways(iter(cut))).sort_values(["part", "entry"])
    entries = pd.concat(minute.chained_entries(iter([ways])))
    told = table.merge(entries, how="left")
    cut = [told.iloc[k:k + 7].reset_index(drop=True) for k in range(0, len(told), 7)]
    found = pd.concat(minute.slice_decisions(iter(cut)))
    expected, last = [], -minute.MINUTE_MS
    for time in times:
        expected.append(int(time - last >= minute.MINUTE_MS))
        last = time if expected[-1] else last
    assert found["at"].tolist() == times and found["let_in"].tolist() == expected


def test_tokens_over_midnight_against_the_loop(spark):
    """One pair of limits a day, long requests: each day's close depends on the days before."""
    for seed in range(3):
        rng = random.Random(seed)
        rows = []
        for user in range(6):
            at, limits = 0, (rng.choice([None, 15]), rng.choice([90, 200]), rng.choice([None, 1, 2]))
            while at < 8 * DAY:
                rows.append((len(rows), f"u{user}", MIDNIGHT + at, MIDNIGHT + at + rng.choice([0, 5, 3_000_000, 40_000_000, 200_000_000]),
                             rng.choice([0, 5, 20]), *limits))
                at += rng.choice([0, 1000, 59_000, 1_000_000, 5_000_000])
        assert replay(spark, rows) == brute(rows)
