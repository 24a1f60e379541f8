import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from usagelens.llm import merkle
from usagelens.llm.queries import QUERIES


def hashed(text):
    return sha256(text.encode()).hexdigest()


def encoded(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = k - k % 3
            paths[leaf] += ["".join(nodes[run:k]), "".join(nodes[k + 1:run + 3])]
        nodes = [hashed("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, siblings) of rows (doc_id, source, text)."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(((row[0] is not None, row[0] or 0), hashed(encoded(row)), row[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda leaf: leaf[:2])
        trees[name] = tree([leaf[1] for leaf in groups[name]])
    root, above = tree([trees[name][0] for name in names])
    return sorted([(leaf[2], leaf[1], trees[name][0], root, own + up) for name, up in zip(names, above)
                   for leaf, own in zip(groups[name], trees[name][1])], key=str)


def manifest(spark, rows, keep=("doc_id",)):
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    table = table.withColumn("leaf", merkle.leaf_digest(["doc_id", "source", "text"]))
    return merkle.build(table, "source", ["doc_id"], list(keep))


def proofs(book):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.siblings) for r in merkle.proofs(book).collect()], key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [1, 2, 4, 28], [700, 5, 1, 730], [1] * 10, [2200, 1]])
def test_proofs_equal_the_plain_tree(spark, sizes):
    names = [None, "", "a", "é", "B", "z", "中", "b", "ab", "~"]
    rows = [(k, name, f"t{k}") for name, size in zip(names, sizes) for k in range(size)]
    book = manifest(spark, rows)
    assert proofs(book) == plain(rows)
    assert book.root == plain(rows)[0][3]
    assert {r.source: r.subroot for r in book.subroots.collect()}.keys() == set(names[:len(sizes)])


def test_several_layers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "LEAVES", 9)

    rows = [(k, "hot" if k % 3 else f"s{k % 61}", None if k % 7 else "x") for k in range(1000)]
    book = manifest(spark, rows)
    assert len(book.layers) == 3 and len(book.top) == 2
    assert proofs(book) == plain(rows)


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rows = [(None, None, None), (None, None, None), (None, "a", ""), (5, "a", "x"), (5, "a", "x"), (5, "a", None), (-3, "a", "é" * 100_000),
            (2**62, None, "-")]
    assert proofs(manifest(spark, rows)) == plain(rows)
    empty = manifest(spark, [])
    assert empty.root is None and proofs(empty) == [] and empty.subroots.collect() == []


def test_a_changed_leaf_is_found(spark):
    rows = [(k, f"s{k % 3}", f"t{k}") for k in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tree", merkle.F.lit("x")).withColumn(
        "leaf", merkle.leaf_digest(["doc_id", "source", "text"])).withColumn(
        "shown", merkle.F.when(merkle.F.col("doc_id") == 7, merkle.F.sha2(merkle.F.lit(b"no"), 256)).when(merkle.F.col("doc_id") < 50, merkle.F.col("leaf")))
    found = merkle.verify(merkle.build(table, "source", ["doc_id"], ["doc_id", "shown", "tree"]), "shown").collect()
    assert len(found) == 100 and {r.doc_id for r in found if not r.verified} == {7} and {r.tree for r in found} == {"x"}
    ways = {d: (s, root) for d, _, _, root, s in plain(rows)}
    for row in found:
        assert row.proof_sha256 == hashed("".join(ways[row.doc_id][0]))
        assert row.folded_root == merkle.fold(row.shown or row.leaf, ways[row.doc_id][0])


def test_addresses_are_the_recursive_layout():
    def laid(levels, depth, index):
        """Nodes of a subtree in store order, by plain recursion."""
        if levels == 1:
            return [(depth, index)]
        upper = (levels + 1) // 2
        nodes = laid(upper, depth, index)
        for tree_ in range(3**upper):
            nodes += laid(levels - upper, depth + upper, index * 3**upper + tree_)
        return nodes

    for levels in range(1, 8):
        order = laid(levels, 0, 0)
        assert len(order) == merkle.node_count(levels)
        for depth in range(levels):
            found = merkle.address(levels, depth, np.arange(3**depth))
            assert found.tolist() == [order.index((depth, k)) for k in range(3**depth)]


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_merkle"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and len({r.root for r in got.values()}) == 1
    for doc in random.Random(1).sample(docs, 20):
        assert got[doc.doc_id].leaf == hashed(encoded((doc.doc_id, doc.source, doc.lang, doc.n_chars, doc.text)))
    assert all(got[d.doc_id].verified for d in docs if d.text is None or "\n" not in d.text)
