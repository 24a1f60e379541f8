import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import users as ops
from usagelens.schema import USER_CHANGES, USERS

NAMES = [field.name for field in USERS.fields]


def brute(users, changes):
    """Applies one change after the other; returns the users and the touched counts."""
    table = {row[0]: dict(zip(NAMES, row)) for row in users}
    counts = {}
    for seq, op, key, name, fields in sorted(changes):
        fields = fields or {}
        if op == "add":
            counts[seq] = 0
            if key not in table:
                row = dict.fromkeys(NAMES)
                row.update(api_key=key, username=name, enabled=1, created_at=int(fields.get("created_at") or 0))
                for column, kind in ops.UPDATABLE.items():
                    if fields.get(column) is not None:
                        row[column] = int(fields[column]) if kind == "long" else fields[column]
                table[key] = row
                counts[seq] = 1
            continue
        hit = [k for k, row in table.items() if (k == key if key else row["username"] == name)]
        written = {c: v for c, v in fields.items() if c in ops.UPDATABLE}
        counts[seq] = len(hit) if op != "update" or written else 0
        for k in hit:
            if op == "delete":
                del table[k]
            elif op in ("enable", "disable"):
                table[k]["enabled"] = int(op == "enable")
            else:
                for column, value in written.items():
                    number = ops.UPDATABLE[column] == "long" and value is not None
                    table[k][column] = int(value) if number else value
    return sorted(tuple(row.values()) for row in table.values()), counts


def check(spark, users, changes):
    user_frame = spark.createDataFrame(users, USERS)
    change_frame = spark.createDataFrame(changes, USER_CHANGES)
    expected, counts = brute(users, changes)
    after = ops.apply_user_changes(user_frame, change_frame)
    assert after.schema.names == NAMES
    assert sorted((tuple(row) for row in after.collect()), key=lambda r: r[0]) == expected
    assert {row.seq: row.affected for row in ops.change_counts(user_frame, change_frame).collect()} == counts
    return {row[0]: dict(zip(NAMES, row)) for row in expected}


def user(key, name, **more):
    row = {"api_key": key, "username": name, "enabled": 1, "created_at": 0, **more}
    return tuple(row.get(column) for column in NAMES)


def test_changes_by_name_and_key(spark):
    users = [user("k1", "a", daily_token_limit=5), user("k2", "a"), user("k3", "b", note="n")]
    after = check(spark, users, [
        (1, "disable", None, "a", None), (2, "enable", "k1", None, None),
        (3, "update", None, "a", {"daily_token_limit": None, "rpm_limit": "7"}),
        (4, "update", "k1", "a", {"note": "x", "username": "ignored"}),
        (5, "update", "k3", None, {"username": "b2"}),
        (6, "delete", None, "b", None), (7, "add", "k3", "c", {"created_at": "9"}), (8, "add", "k3", "d", {}),
        (9, "update", None, "nobody", {"note": "y"})])
    assert (after["k1"]["enabled"], after["k2"]["enabled"]) == (1, 0)
    assert after["k1"]["daily_token_limit"] is None and after["k2"]["rpm_limit"] == 7 and after["k1"]["note"] == "x"
    assert after["k3"]["username"] == "c" and after["k3"]["note"] is None


def test_writes_before_a_new_life_do_not_reach_it(spark):
    after = check(spark, [user("k", "a")], [
        (1, "update", None, "b", {"note": "early"}), (2, "update", "k", None, {"rpm_limit": "3"}),
        (3, "delete", "k", None, None), (4, "update", "k", None, {"rpm_limit": "4"}), (5, "add", "k", "b", {"note": "new"})])
    assert (after["k"]["note"], after["k"]["rpm_limit"]) == ("new", None)


def test_add_refused_while_alive_under_another_name(spark):
    after = check(spark, [], [
        (1, "add", "k", "a", None), (2, "add", "k", "b", None), (3, "delete", None, "b", None),
        (4, "delete", None, "a", None), (5, "add", "k", "b", None), (6, "add", "k", "a", None), (7, "delete", None, "a", None)])
    assert after["k"]["username"] == "b"


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    keys, names = [f"k{i}" for i in range(6)], ["a", "b", "c"]
    users = [user(key, rng.choice(names)) for key in keys[:3]]
    changes = []
    for seq in range(300):
        op = rng.choice(["add", "add", "enable", "disable", "update", "update", "delete"])
        by_key = op == "add" or rng.random() < 0.5
        fields = None
        if op == "update":
            fields = {column: rng.choice([None, str(seq)]) for column in rng.sample([*ops.UPDATABLE, "other"], rng.randint(0, 2))}
        elif op == "add":
            fields = {"created_at": str(seq), "note": rng.choice([None, "n"])}
        changes.append((seq, op, rng.choice(keys) if by_key else rng.choice([None, ""]),
                        rng.choice(names) if op == "add" or not by_key else None, fields))
    check(spark, users, changes)


def test_auto_register_and_seed(spark):
    users = spark.createDataFrame([user("known", "a")], USERS)
    traffic = spark.createDataFrame([("known",), ("sk-test-123456",), ("abc",), ("abc",), ("",), (None,)], "api_key string")
    found = {row.api_key: (row.username, row.enabled, row.created_at, row.note)
             for row in ops.auto_register(users, traffic, 77).collect()}
    assert found == {"sk-test-123456": ("auto-123456", 1, 77, "auto (transition)"), "abc": ("auto-abc", 1, 77, "auto (transition)")}
    assert ops.seed_user(users, "", 1).count() == 1 and ops.seed_user(users, "known", 1).count() == 1
    seeded = ops.seed_user(users, "shared", 1).where("api_key = 'shared'").first()
    assert (seeded.username, seeded.note) == ("legacy", "transition key")
    new = spark.createDataFrame([user("known", "z"), user("n1", "z"), user("n2", "z"), user("n2", "z2")], USERS)
    assert sorted(row.api_key for row in ops.duplicate_adds(users, new).collect()) == ["known", "n2", "n2"]


def test_limit_fields(spark):
    frame = spark.createDataFrame([(0, 5), (None, 3)], "a long, b long")
    found = frame.select(ops.cli_limit_fields(daily_token_limit=F.col("a"), rpm_limit=F.col("b")).alias("f")).collect()
    assert [row.f for row in found] == [{"daily_token_limit": None, "rpm_limit": "5"}, {"rpm_limit": "3"}]
    boxes = spark.createDataFrame([(" 12 ", ""), ("-1", "0")], "a string, b string")
    found = boxes.select(ops.form_limit_fields(daily_token_limit=F.col("a"), rpm_limit=F.col("b")).alias("f")).collect()
    assert [row.f for row in found] == [{"daily_token_limit": "12", "rpm_limit": None}, {"daily_token_limit": None, "rpm_limit": "0"}]
