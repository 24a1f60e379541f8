import random
import re
from collections import Counter

from pyspark.sql import functions as F

from usagelens.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(lines), sum(any(c.isalpha() for c in w) for w in words),
            sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", line)) for line in lines),
            sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", line)) for line in lines))


def texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "#x", "12", "...", "…", "-", "•", "中文", "😀|", "½"]
    breaks = [" ", " ", " ", "\n", "\t", "\r\n", "\x0b", "  ", " ", " "]
    made = ["".join(rng.choice(alphabet) + rng.choice(breaks) for _ in range(rng.randrange(120))) for _ in range(150)]
    one = " ".join(f"w{k}" for k in range(8))
    return [None, "", " \n\t", one, f"{one} {one}", f"{one} x {one}", "a " * 7, "a " * 9, "l\n" * 50, "\n" * 90,
            "x" * 200_000, "a b " * 20_000, " ".join(map(str, range(30_000))), *made, *made[:20]]


def test_measurements_equal_plain_ones(spark):
    given = texts()
    table = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in rules.MEASURES) for r in rules.ledger(table, keep=["doc_id"]).collect()}
    assert got == {k: plain(text) for k, text in enumerate(given)}


def test_bits_policies_and_ablations_equal_plain_ones(spark):
    given = texts()
    table = spark.createDataFrame([(k, t, "mine", 5, "other") for k, t in enumerate(given)],
                                  "doc_id long, text string, words string, FAILED int, k0 string")
    book = rules.ledger(table)
    assert book.columns == ["doc_id", "text", "words", "k0", *rules.MEASURES, "failed"]
    rows = book.collect()
    assert len(rows) == len(given) and {r["words"] for r in rows} == {"mine"} and {r["k0"] for r in rows} == {"other"}
    for row in rows:
        for rule in rules.RULES:
            m = {name: row[name] for name in rules.MEASURES}
            assert bool(row.failed >> rule.bit & 1) == rule.fails(m)

    def dropped(failed, hard, soft, tolerance):
        return bool(failed & hard) or bin(failed & soft).count("1") > tolerance

    for policy in rules.POLICIES:
        kept = {r.doc_id: r.kept for r in rules.apply_policy(book, policy).collect()}
        assert kept == {r.doc_id: not dropped(r.failed, policy.hard, policy.soft, policy.tolerance) for r in rows}
    found = {(r.policy, r.rule): tuple(r)[2:] for r in rules.ablations(book).collect()}
    for policy in rules.POLICIES:
        for rule in rules.RULES:
            looked, out = policy.hard | policy.soft, ~rule.mask
            assert found[policy.version, rule.name] == (
                len(rows), sum(bool(r.failed & rule.mask) for r in rows),
                sum(dropped(r.failed, policy.hard, policy.soft, policy.tolerance) for r in rows),
                sum(r.failed & looked == rule.mask for r in rows),
                sum(dropped(r.failed, policy.hard & out, policy.soft & out, policy.tolerance) for r in rows))


def test_empty_table_and_bad_rules(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rules.ledger(empty).collect() == [] and rules.ablations(rules.ledger(empty)).collect() == []
    try:
        rules.ledger(empty, rules=[*rules.RULES, rules.Rule(0, "again", lambda m: m["n_words"] < 1)])
    except ValueError:
        return
    raise AssertionError("two rules on one bit")


def test_no_python_and_no_shuffle_in_the_plan(spark):
    table = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.apply_policy(rules.ledger(table))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange"))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    kept = rules.apply_policy(rules.ledger(docs, keep=["doc_id", "quality"])).where("n_words >= 20")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share[0] < 0.5
