import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from usagelens.llm import simhash
from usagelens.llm.components import components


def plain_fingerprint(text, shingle=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(part.encode(), 42) for part in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_groups(rows, radius=4):
    """(doc_id, fingerprint, component) by comparing every pair."""
    prints = [plain_fingerprint(text) for _, text in rows]
    sets, least = Sets(), {}
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                sets.join(a, b)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            root = sets.find(k)
            least[root] = min(least.get(root, doc), doc)
    return [(doc, f"{prints[k]:016x}", least.get(sets.find(k))) for k, (doc, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=lambda row: tuple((v is not None, v) for v in row))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBé \t\n\x0b\x0c\r\x1c\x85 ", max_size=60))
def test_fingerprint_equals_plain_form(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_bit_sliced_lanes_find_all_within_radius():
    random_ = np.random.default_rng(4)
    base = random_.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << k for k in random_.choice(64, random_.integers(0, 7), replace=False)) for _ in base],
                     np.uint64)
    fps = np.concatenate([base, base ^ flips])
    for radius in (0, 1, 3, 4, 7):
        query_of = np.repeat(np.arange(len(fps)), -(-len(fps) // 64))
        word_of = np.tile(np.arange(-(-len(fps) // 64)), len(fps))
        alive, lanes = simhash.near_lanes(simhash.bit_planes(fps), fps, query_of, word_of, radius)
        found = set()
        for at, mask in zip(alive, lanes.tolist()):
            for lane in range(64):
                if mask >> lane & 1 and word_of[at] * 64 + lane < len(fps):
                    found.add((query_of[at], word_of[at] * 64 + lane))
        near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
        assert found == set(zip(*np.nonzero(near)))


def test_components_of_long_paths_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (9, 1), (None, 3), (5, None)]
    random.Random(2).shuffle(chain)
    found = {row.node: row.root for row in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def near_copies(seed, number):
    chance = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(number):
        base = [chance.choice(words) for _ in range(120)]
        rows.append((3 * k + 50, " ".join(base)))
        for copy in range(chance.randint(0, 3)):
            changed = list(base)
            changed[chance.randrange(120)] = "Other"
            rows.append((3 * k + 5000 + copy * 1000, " ".join(changed)))
    return rows


def test_groups_equal_all_pairs(spark):
    rows = near_copies(1, 60) + [(None, None), (3, ""), (4, " \n"), (9, "one two"), (9, "one two"), (8, "ONE two"),
                                 (None, "one two"), (2, "x " * 20000)]
    docs = spark.createDataFrame([(text, doc, "k", 1) for doc, text in rows],
                                 "text string, doc_id long, component_id string, fp int")
    got = [tuple(row) for row in simhash.simhash_groups(docs).collect()]
    assert order(got) == order(plain_groups(rows))


def test_crowded_buckets_in_blocks(spark):
    chance = random.Random(5)
    fps = [chance.getrandbits(64) for _ in range(40)]
    near = {fp ^ sum(1 << k for k in chance.sample(range(64), chance.randint(0, 5))) for fp in fps[:4] for _ in range(60)}
    every = sorted(near | set(fps))
    table = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp,) for fp in every], "fp long")
    sets = Sets()
    for a in every:
        for b in every:
            if (a ^ b).bit_count() <= 4:
                sets.join(a, b)
    for block in (7, 4096):
        joined = Sets()
        for row in simhash.near_links(table, 4, block=block).collect():
            a, b = row.a % (1 << 64), row.b % (1 << 64)
            assert sets.find(a) == sets.find(b)
            joined.join(a, b)
        assert all((sets.find(a) == sets.find(b)) == (joined.find(a) == joined.find(b)) for a in every for b in every)


def test_keep_first_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "quite other words here now"), (None, "a b c d e f"), (4, None)]
    docs = spark.createDataFrame([(doc, text, 7) for doc, text in rows], "doc_id long, text string, fp int")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert order([row.doc_id, row.text] for row in kept.collect()) == order(
        [[1, "a b c d e f"], [3, "quite other words here now"], [4, None], [None, "a b c d e f"]])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).collect() == []
    assert simhash.keep_first(docs).collect() == []


def test_radius_must_leave_an_equal_part(spark):
    with pytest.raises(ValueError):
        simhash.near_links(spark.range(1).select(F.col("id").alias("fp")), radius=6)
