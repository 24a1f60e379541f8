import math

import numpy as np
import pytest
from usagelens.llm import vectors


def plain(rows, cosine=0.93):
    """(vec_id, links, component) by comparing every pair."""
    up, links, by = list(range(len(rows))), [0] * len(rows), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, vector, label) in enumerate(rows):
        if label is None or not vector or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        by.setdefault((label, len(vector)), []).append(k)
    for places in by.values():
        units = np.array([rows[k][1] for k in places], float)
        units /= np.abs(units).max(1, keepdims=True)
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(units @ units.T >= cosine, 1))):
            a, b = places[a], places[b]
            links[a] += 1
            links[b] += 1
            up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)] = min(least.get(find(k), row[0]), row[0])
    return sorted(((row[0], links[k], least.get(find(k))) for k, row in enumerate(rows)), key=str)


def turned(base, cosine, random):
    """Vectors with the given cosine to those of ``base``."""
    other = random.standard_normal(base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * base + np.sqrt(1 - cosine ** 2) * other


def test_links_equal_all_pairs(spark):
    random = np.random.default_rng(5)
    base = random.standard_normal((120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(1000 + k, v.tolist(), 1 + k % 2) for k, v in enumerate(base)]
    for number, cosine in enumerate((0.935, 0.96, 0.925, 0.99)):
        rows += [(number * 120 + k, v.tolist(), 1 + k % 2) for k, v in enumerate(turned(base, cosine, random))]
    hot = turned(np.repeat(base[:1], 150, 0), 0.995, random)
    rows += [(3000 + k, v.tolist(), 1) for k, v in enumerate(hot)] + [(4000 + k, hot[0].tolist(), 1) for k in range(80)]
    rows += [
        (9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0, 2.0], 1), (9004, [1.0, 2.0], 1),
        (9004, [1.0, 2.0], 1), (9005, [1.0, 2.0], None), (9006, [], 1), (9007, [3.0], 1), (9008, [2.0], 1),
        (9009, [1e-200, 0.0], 1), (9010, [1e200, 0.0], 1), (9011, [None, 1.0], 1), (None, [2.0, 4.0], 1),
        (9012, [float("inf"), 1.0], 1)]
    table = spark.createDataFrame([(v, i, l, "x") for i, v, l in rows],
                                  "embedding array<double>, vec_id long, label int, kept string")
    expected = plain(rows)
    for block in (32, vectors.BLOCK):
        got = vectors.near_vectors(table, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == expected
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_list_decoding_equals_full_search():
    random = np.random.default_rng(3)
    for parts in (1, 2, 3):
        (_, books), = vectors.directions(24, 1, 1, parts, 9)
        for _ in range(20):
            vector = random.standard_normal(24)
            vector /= np.linalg.norm(vector)
            sums = np.zeros(1)
            for part, words in books:
                sums = (sums[:, None] + (words @ vector[part])[None]).ravel()
            assert sorted(vectors.list_decode(vector, books, 0.2)) == np.flatnonzero(sums >= 0.2).tolist()


def test_directions_have_length_one():
    for _, books in vectors.directions(10, 2, 2, 3, 4):
        assert abs(sum((words[0] ** 2).sum() for _, words in books) - 1) < 1e-12


def test_empty_table_and_no_sound_vector(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    alone = vectors.near_vectors(spark.createDataFrame([(4, None, 1)], schema)).collect()
    assert [tuple(row) for row in alone] == [(4, 0, 4, True)]


def test_tiny_and_huge_vectors_at_the_threshold(spark):
    base = [(1, [1.0, 0.0]), (2, [0.93, math.sqrt(1 - 0.93 ** 2)]), (3, [0.92, math.sqrt(1 - 0.92 ** 2)])]
    for scale in (1e-200, 1e-150, 1e200):
        rows = [(k, "a", [x * scale for x in v]) for k, v in base] + [(4, "a", [5.0 * scale, 1e-9 * scale])]
        table = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
        found = {r.vec_id: r.component_id for r in vectors.near_vectors(table, cosine=0.93).collect()}
        assert found[4] == 1 and len(found) == 4
        assert vectors._exact_cosine([x * scale for x in base[0][1]], [x * scale for x in base[2][1]]) == pytest.approx(0.92)
