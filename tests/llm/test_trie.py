import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import trie
from usagelens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, place string, piece int, words string"


def rebuilt(rows):
    """Turns of each conversation, started with those of its twentieth, by plain lists."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()  # orders turns of one number
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    lists = {conv: [t[3:] for t in sorted(turns)] for conv, turns in own.items()}
    found = {}
    for conv, turns in lists.items():
        head = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        found[conv] = (*lists.get(base, [])[:head], *turns[head:])
    return found


def plain(convs):
    members = defaultdict(list)
    for conv, turns in convs.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(members[node]) - 1) * words
    found = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if convs[c] == node)))
        found.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node], leaves[node],
                      saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def nodes(spark, rows, tmp_path, **limits):
    table = spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA)
    turns = trie.turn_rows(table)
    base = F.col("conv_id") - F.col("conv_id") % 20
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return sorted([tuple(r) for r in trie.trie(trie.rebranched(turns, base, head, 3), **limits).collect()], key=str)


def logs(seed, convs=120):
    rng = random.Random(seed)
    texts = ["a", "a b", " ", "", None, "c\td e"]
    rows = []
    for conv in [None, -41, -40, -7, 3_000_000_000_000, *range(convs)]:
        if rng.random() < 0.1:
            continue  # some bases are absent
        many = rng.choice([1, 1, 2, 3, 4, 9])
        hot = conv is not None and conv % 3 == 0
        for turn in range(many):
            rows.append((conv, rng.choice([turn, turn, None, 0]), None if hot else rng.choice(["user", "bot", None]),
                         "same" if hot else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 1}, {"shard_rows": 5}, {"shard_turns": 4}])
def test_nodes_equal_the_plain_trie(spark, tmp_path, limits):
    rows = logs(len(str(limits)))
    assert nodes(spark, rows, tmp_path, **limits) == plain(rebuilt(rows))


def test_turnless_repeated_and_missing(spark, tmp_path):
    # Its hash takes a turn at least, and its base is absent, so it is a member of the root alone.
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "gone")]
    assert nodes(spark, rows, tmp_path) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    rows = [(40, 1, "user", "a"), (40, 1, "user", "a"), (60, 1, "user", "a")]
    assert nodes(spark, rows, tmp_path) == plain(rebuilt(rows))
    assert nodes(spark, [], tmp_path) == [] == nodes(spark, [(None, 1, "user", "a")], tmp_path)


def test_a_long_conversation_and_its_copies(spark, tmp_path):
    rows = [(20 * c, t, "user", f"t {t}") for c in range(4) for t in range(300)]
    rows += [(100, t, "user", f"t {t}") for t in range(120)]
    assert nodes(spark, rows, tmp_path, shard_turns=100) == plain(rebuilt(rows))


def test_findclose_and_range_minima():
    rng = random.Random(5)
    for size in (1, 2, 40, 700, 5000):
        bits, depth, opened = [], 0, 0
        while opened < size or depth:
            up = opened < size and (depth == 0 or rng.random() < 0.55 or opened < size // 3)
            bits.append(up)
            depth += 1 if up else -1
            opened += up
        stack, close = [], {}
        for at, up in enumerate(bits):
            if up:
                stack.append(at)
            else:
                close[stack.pop()] = at
        opens = np.flatnonzero(np.array(bits))
        assert trie.Excess(np.array(bits)).findclose(opens).tolist() == [close[o] for o in opens]
        values = np.array([rng.randrange(1000) for _ in range(size)])
        first = np.array([rng.randrange(size) for _ in range(50)])
        behind = np.array([rng.randrange(a + 1, size + 1) for a in first])
        assert trie.RangeMin(values).between(first, behind).tolist() == [min(values[a:b]) for a, b in zip(first, behind)]


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op11_trie"](spark, sf).collect()], key=str) == plain(rebuilt(rows))
