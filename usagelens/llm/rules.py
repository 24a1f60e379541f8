"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, policies are read off the bits.

``ledger`` measures each text and stores one bit for each rule that fails. A bit keeps its place for good; a changed rule
gets a new one. Policies are versioned masks over those bits, so a new policy or an ablation reads the ledger and never
the texts again.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import carried

WINDOW = 8
BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words",
            "n_bullet_lines", "n_open_lines")


@dataclass(frozen=True)
class Rule:
    """A bit of the ledger; ``fails`` takes the measurements as columns."""

    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]

    @property
    def mask(self) -> int:
        return 1 << self.bit


# The first two are the base rules of the query's contract; thresholds of the others are those of published web filters.
RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule(2, "short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule(3, "long_words", lambda m: m["word_chars"] > 12 * m["n_words"]),
    Rule(4, "symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule(5, "duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule(6, "few_letters", lambda m: 10 * m["n_alpha_words"] < 7 * m["n_words"]),
    Rule(7, "bullets", lambda m: 10 * m["n_bullet_lines"] > 9 * m["n_lines"]),
    Rule(8, "open_lines", lambda m: 10 * m["n_open_lines"] > 3 * m["n_lines"]),
)
BIT = {rule.name: rule.mask for rule in RULES}


def mask(*names: str) -> int:
    return reduce(lambda bits, name: bits | BIT[name], names, 0)


@dataclass(frozen=True)
class Policy:
    """A text goes if it fails a rule of ``hard``, or more than ``tolerance`` of ``soft``."""

    version: str
    hard: int
    soft: int = 0
    tolerance: int = 0

    def drops(self, failed: Column) -> Column:
        soft = F.bit_count(failed.bitwiseAND(F.lit(self.soft))) > self.tolerance
        return (failed.bitwiseAND(F.lit(self.hard)) != 0) | soft


BASE = mask("few_words", "repeated_words")
POLICIES = (
    Policy("base", BASE),
    Policy("strict", mask(*BIT)),
    Policy("tolerant", BASE | mask("symbols", "few_letters"), mask("short_words", "long_words", "duplicate_lines", "bullets", "open_lines"), 1),
)
CURRENT = POLICIES[2]


def _through(value, then) -> Column:
    """``then`` of a value that is computed once; the optimizer may copy a plain column into a lambda's body."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeats(words: Column) -> Column:
    """Words inside windows that the text has twice or more.

    Window hashes are all different in most texts. Where they aren't, windows of equal hash are compared as words.
    """
    def same_as_beside(pairs, key):
        return F.filter(pairs, lambda pair, at: F.coalesce(pair[key] == F.get(pairs, at - 1)[key], F.lit(False))
                        | F.coalesce(pair[key] == F.get(pairs, at + 1)[key], F.lit(False)))

    def windows(hashes):
        starts = F.when(F.size(hashes) >= WINDOW, F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.xxhash64(F.slice(hashes, at, F.lit(WINDOW))))

    def hashed(found):
        return F.sort_array(F.transform(found, lambda h, at: F.struct(h.alias("h"), at.alias("at"))))

    def spelled(pairs):
        return F.sort_array(F.transform(pairs, lambda pair: F.struct(
            F.array_join(F.slice(words, pair["at"] + 1, F.lit(WINDOW)), " ").alias("w"), pair["at"].alias("at"))))

    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def covered(starts):
        return F.aggregate(F.sort_array(starts), begin, lambda so_far, at: F.struct(
            (so_far["n"] + at + WINDOW - F.greatest(at, so_far["end"])).alias("n"), (at + WINDOW).alias("end")),
            lambda so_far: so_far["n"])

    def repeated(found):
        return _through(hashed(found), lambda pairs: _through(same_as_beside(pairs, "h"), lambda close: _through(
            spelled(close), lambda texts: covered(F.transform(same_as_beside(texts, "w"), lambda pair: pair["at"])))))

    return _through(F.transform(words, lambda word: F.xxhash64(word)), lambda hashes: _through(
        windows(hashes), lambda found: F.when(F.size(F.array_distinct(found)) < F.size(found), repeated(found)).otherwise(0)))


def measured(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """Kept columns and MEASURES of each text, whole; null is a text without words. All are whole numbers."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{name}`") for name in carried(docs, MEASURES, keep).columns]
    names = [f"k{k}" for k in range(len(kept))]
    given = docs.select(*[c.alias(n) for c, n in zip(kept, names)], text.alias("text"))
    words = given.select(
        *names, "text", F.filter(F.split("text", BREAK, -1), lambda word: word != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    def lacking(characters):
        return F.length("text") - F.length(F.translate("text", characters, ""))

    def lines(pattern):
        return F.size(F.filter("lines", lambda line: line.rlike(pattern)))

    found = {
        "n_words": F.size("words"), "word_chars": F.length("text") - lacking(" \t\n\x0b\x0c\r"),
        "n_symbols": lacking(SYMBOLS), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _through(F.col("words"), _repeats), "n_lines": F.size("lines"),
        "n_alpha_words": F.size(F.filter("words", lambda word: word.rlike(r"\p{L}"))),
        "n_bullet_lines": lines(r"\A[\x20\x09-\x0D]*[-*•]"),
        "n_open_lines": lines(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"),
    }
    return words.select(*names, *[value.cast("long").alias(name) for name, value in found.items()]).select(
        *[F.col(n).alias(c) for n, c in zip(names, carried(docs, MEASURES, keep).columns)], *MEASURES)


def ledger(docs: DataFrame, text_col: str = "text", keep=None, rules=RULES) -> DataFrame:
    """Kept columns, MEASURES and ``failed``, a bitmask of the rules that each text fails.

    A null text is one without words and fails few_words. Repeated rows have a row each, an empty table none. Kept
    columns that are called like a measurement or ``failed`` give way. Texts are read once, nothing is shuffled.
    """
    if len({rule.bit for rule in rules}) < len(rules) or not all(0 <= rule.bit < 63 for rule in rules):
        raise ValueError("each rule needs a bit of its own, 0 to 62")
    outputs = (*MEASURES, "failed")
    rows = measured(docs, text_col, carried(docs, outputs, keep).columns)
    values = {name: F.col(name) for name in MEASURES}
    bits = [F.when(rule.fails(values), F.lit(rule.mask)).otherwise(0).cast("long") for rule in rules]
    return rows.withColumn("failed", reduce(lambda one, two: one.bitwiseOR(two), bits, F.lit(0).cast("long")))


def apply_policy(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with ``policy``, ``reasons`` (the failed bits that the policy looks at) and ``kept``."""
    return rows.withColumns({
        "policy": F.lit(policy.version), "reasons": F.col("failed").bitwiseAND(F.lit(policy.hard | policy.soft)),
        "kept": ~policy.drops(F.col("failed"))})


def ablations(rows: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """What each rule does in each policy: (policy, rule, n_docs, n_failed, n_dropped, n_only, n_without).

    ``n_dropped`` texts go by the policy, ``n_failed`` fail the rule, ``n_only`` fail it and nothing else that the policy
    looks at, and ``n_without`` would go if the rule were taken out of the policy. The ledger is summed up by bitmask
    first, whose values are bounded by the rules; policies and rules meet those sums. An empty ledger gives no rows.
    """
    sums = rows.groupBy("failed").agg(F.count("*").alias("n"))

    def case(policy, rule):
        failed, looked_at = F.col("failed"), policy.hard | policy.soft
        without = Policy(policy.version, policy.hard & ~rule.mask, policy.soft & ~rule.mask, policy.tolerance)
        return F.struct(
            F.lit(policy.version).alias("policy"), F.lit(rule.name).alias("rule"),
            (failed.bitwiseAND(F.lit(rule.mask)) != 0).alias("fails"), policy.drops(failed).alias("drops"),
            (failed.bitwiseAND(F.lit(looked_at)) == rule.mask).alias("only"), without.drops(failed).alias("without"))

    cases = sums.select("n", F.inline(F.array(*[case(p, r) for p in policies for r in rules])))

    def texts(flag):
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))

    return cases.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), texts("fails").alias("n_failed"), texts("drops").alias("n_dropped"),
        texts("only").alias("n_only"), texts("without").alias("n_without"))
