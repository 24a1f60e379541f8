"""Merkle manifest of a table: digests of rows, of each group and of all, with proofs for single rows.

A group's rows in order are the leaves of its tree. Three consecutive nodes make the next one (the last run of a level
fewer, even one) while a level has more than one. Group roots in order make one tree above them in the same way.

A tree is cut into aligned subtrees of HEIGHT levels. A subtree is one row of a staged table, its digests in one binary
in van Emde Boas order: the upper half of its levels first, then each subtree below them, both laid out in the same way.
Subtree roots are the leaves of the next layer, so a table of n rows has some log(n) / log(729) layers, and a group of
any size is spread over tasks. Construction goes up the layers; proofs go down, one path for each subtree.
"""

from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from usagelens.llm.common import stage
from usagelens.llm.ranked import ranked

FANOUT = 3
HEIGHT = 6
LEAVES = FANOUT**HEIGHT
DIGEST = 32


def leaf_digest(columns) -> Column:
    """SHA-256 in hex of the columns' values: ``-`` for null, else the value's UTF-8 bytes, ``:`` and the value."""
    def field(name):
        value = F.col(f"`{name}`").cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(name) for name in columns]).cast("binary"), 256)


def node_count(levels: int) -> int:
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, index):
    """Place of node ``index`` (a number or an array) at ``depth`` below the root in a subtree of so many levels.

    The upper half of the levels stands first, then the trees below it from left to right; each part is laid out alike.
    """
    if levels == 1:
        return index * 0
    upper = (levels + 1) // 2
    if depth < upper:
        return address(upper, depth, index)
    tree, inner = index // FANOUT ** (depth - upper), index % FANOUT ** (depth - upper)
    return node_count(upper) + tree * node_count(levels - upper) + address(levels - upper, depth - upper, inner)


@lru_cache(maxsize=None)
def _places(height: int, level: int) -> np.ndarray:
    """Addresses of all nodes of a level, counted from the leaves."""
    return address(height + 1, height - level, np.arange(FANOUT ** (height - level)))


def subtree_height(number: int) -> int:
    """Levels above the leaves of a tree's subtrees: as many as a small tree needs, HEIGHT in a larger one."""
    height = 0
    while height < HEIGHT and FANOUT**height < number:
        height += 1
    return height


def filled(leaves: list[bytes], height: int) -> np.ndarray:
    """Digests of a subtree by address; places right of its last leaf are zero."""
    store = np.zeros((node_count(height + 1), DIGEST), dtype=np.uint8)
    nodes = leaves
    for level in range(height + 1):
        store[_places(height, level)[:len(nodes)]] = np.frombuffer(b"".join(nodes), np.uint8).reshape(-1, DIGEST)
        shown = b"".join(nodes).hex().encode()
        run = FANOUT * 2 * DIGEST
        nodes = [sha256(shown[at:at + run]).digest() for at in range(0, len(shown), run)]
    return store


def sibling_pairs(store: np.ndarray, height: int, leaves: int) -> list[list[str]]:
    """For each leaf the hex digests left and right of its path, level by level: [left, right, left, right, ...]."""
    found: list[list[str]] = [[] for _ in range(leaves)]
    count = leaves
    for level in range(height):
        shown = store[_places(height, level)[:count]].tobytes().hex()
        one = 2 * DIGEST
        sides = []
        for node in range(count):
            run = node - node % FANOUT
            sides.append((shown[run * one:node * one], shown[(node + 1) * one:(run + FANOUT) * one]))
        for leaf in range(leaves):
            found[leaf] += sides[leaf // FANOUT**level]
        count = -(-count // FANOUT)
    return found


def _build(batches):
    """Adds to rows of (leaves, number, ...) the subtree's store and root."""
    for batch in batches:
        numbers = batch.column("number").to_pylist()
        digests = batch.column("leaves")
        stores, roots = [], []
        for row, number in enumerate(numbers):
            store = filled(digests[row].as_py(), subtree_height(number))
            stores.append(store.tobytes())
            roots.append(store[0].tobytes())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(stores, pa.binary()), pa.array(roots, pa.binary())],
            names=[*batch.schema.names, "store", "root"])


def _store(batch, row):
    return np.frombuffer(batch.column("store")[row].as_py(), np.uint8).reshape(-1, DIGEST)


@dataclass
class Manifest:
    """Staged subtrees, layer by layer: of the groups' trees and of the tree above them."""

    group: str
    keep: list[T.StructField]
    layers: list[DataFrame]
    top: list[DataFrame]

    @property
    def subroots(self) -> DataFrame:
        """(group, subroot) of each group."""
        return _tops(self.layers).select("tree", F.lower(F.hex("root")).alias("subroot")).withColumnRenamed("tree", self.group)

    @property
    def root(self) -> str | None:
        """Root of all rows; None for an empty table."""
        row = _tops(self.top).select(F.lower(F.hex("root"))).first()
        return row and row[0]


def _tops(layers) -> DataFrame:
    """Subtrees that hold their tree's root."""
    wanted = [layer.where(F.col("number") <= LEAVES).select("tree", "block", "number", "root") for layer in layers]
    return reduce(DataFrame.unionByName, wanted)


def _grown(rows: DataFrame, keep: list[str]) -> list[DataFrame]:
    """Layers of subtrees over rows of (tree, place, number, digest, keep); a group is never larger than LEAVES."""
    layers: list[DataFrame] = []
    extra = [F.col(f"`{name}`") for name in keep]
    while True:
        member = F.struct("place", "digest", *[c.alias(f"k{i}") for i, c in enumerate(extra)])
        blocks = rows.groupBy("tree", F.expr(f"place div {LEAVES}").alias("block")).agg(
            F.first("number").alias("number"), F.sort_array(F.collect_list(member)).alias("members")).select(
            "tree", "block", "number", F.col("members.digest").alias("leaves"),
            *[F.col(f"members.k{i}").alias(f"k{i}") for i in range(len(extra))])
        schema = T.StructType([*blocks.schema.fields, T.StructField("store", T.BinaryType()), T.StructField("root", T.BinaryType())])
        built, _ = stage(blocks.mapInArrow(_build, schema).drop("leaves"), "merkle")
        layers.append(built)
        if (built.agg(F.max("number")).first()[0] or 0) <= LEAVES:
            return layers
        rows = built.where(F.col("number") > LEAVES).select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("number") / LEAVES).alias("number"), F.col("root").alias("digest"))
        extra = []


def build(leaves: DataFrame, group: str, order: list[str], keep: list[str], leaf: str = "leaf") -> Manifest:
    """Manifest of rows with a hex digest ``leaf``; ``keep`` names what proofs carry along.

    Groups are the values of ``group``, in their order with null first. Rows are taken by ``order``, null first, and by
    their digest where that is the same, so repeated rows are leaves of their own. An empty table has no root. Digests
    are all that is shuffled; the rows' texts are read once, by whoever made the leaves.
    """
    taken = leaves.select(
        F.col(f"`{group}`").alias("tree"), F.unhex(F.col(f"`{leaf}`")).alias("digest"),
        *[F.col(f"`{name}`").alias(f"o{k}") for k, name in enumerate(order)],
        *[F.col(f"`{name}`").alias(f"c{k}") for k, name in enumerate(keep)])
    staged, _ = stage(taken, "leaves")
    placed = ranked(staged, ["tree"], [*[f"o{k}" for k in range(len(order))], "digest"], number="number")
    layers = _grown(placed, [f"c{k}" for k in range(len(keep))])
    roots = ranked(_tops(layers).select(F.col("tree").alias("name"), "root"), [], ["name"], number="number")
    top = _grown(roots.select(F.lit(0).alias("tree"), "place", "number", F.col("root").alias("digest"), "name"), ["name"])
    return Manifest(group, [leaves.schema[name] for name in keep], layers, top)


def _opened(batches):
    """One row for each leaf of a subtree: its place in the layer below and the siblings on its way to the top."""
    for batch in batches:
        trees, places, paths = [], [], []
        for row, (block, number, upper) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "number", "upper")))):
            count = min(number - block * LEAVES, LEAVES)
            pairs = sibling_pairs(_store(batch, row), subtree_height(number), count)
            trees += [row] * count
            places += range(block * LEAVES, block * LEAVES + count)
            paths += [own + upper for own in pairs]
        kept = [n for n in batch.schema.names if n not in ("block", "number", "store", "upper", "k0")]
        names = [batch.column(n).take(pa.array(trees, pa.int64())) for n in kept]
        if "k0" in batch.schema.names:
            kept.append("k0")
            names.append(batch.column("k0").flatten())
        yield pa.RecordBatch.from_arrays(
            [*names, pa.array(places, pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=[*kept, "block", "upper"])


def _descended(layers, upper: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of the lowest layer's subtrees; ``upper`` has (tree, upper, carried) for each tree."""
    def start(layer):
        tops = layer.where(F.col("number") <= LEAVES)
        own = tops.join(upper.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree")))
        return own.select("tree", "block", "number", "store", *carried, "upper")

    given = start(layers[-1])
    for layer, below in zip(reversed(layers[1:]), reversed(layers[:-1])):
        fields = [given.schema[c] for c in ["tree", *carried]]
        schema = T.StructType([*fields, T.StructField("block", T.LongType()), given.schema["upper"]])
        paths = given.mapInArrow(_opened, schema)
        met = below.select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), "number", "store").join(
            paths, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
        given = met.select("tree", "block", "number", "store", *carried, "upper").unionByName(start(below))
    return given


def _proven(answer):
    """Rows of ``answer(pairs, leaf, presented, root)`` for each leaf of a subtree."""
    def run(batches):
        for batch in batches:
            kept = [n for n in batch.schema.names if n.startswith("k")]
            source, places, answers = [], [], []
            for row in range(batch.num_rows):
                number, block = batch.column("number")[row].as_py(), batch.column("block")[row].as_py()
                height, store = subtree_height(number), _store(batch, row)
                count = min(number - block * LEAVES, LEAVES)
                upper = batch.column("upper")[row].as_py()
                given = batch.column("presented")[row].as_py() if "presented" in batch.schema.names else [None] * count
                own = store[_places(height, 0)[:count]].tobytes().hex()
                one = 2 * DIGEST
                shared = answer.upper(upper)
                for leaf, pairs in enumerate(sibling_pairs(store, height, count)):
                    shown = own[leaf * one:(leaf + 1) * one]
                    answers.append((shown, *answer(pairs, shared, given[leaf] or shown)))
                source += [row] * count
            rows = pa.array(source, pa.int64())
            arrays = [batch.column(n).flatten() for n in kept] + [batch.column(n).take(rows) for n in ("subroot", "root")]
            columns = list(zip(*answers)) or [()] * (1 + len(answer.names))
            arrays += [pa.array(values, kind) for values, kind in zip(columns, [pa.string(), *answer.kinds])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "subroot", "root", "leaf", *answer.names])
    return run


class _Siblings:
    """The proof itself."""

    names, kinds = ["siblings"], [pa.list_(pa.string())]

    def upper(self, pairs):
        return pairs

    def __call__(self, pairs, upper, presented):
        return (pairs + upper,)


class _Folded:
    """Digest of the proof, and the root that the presented leaf gives with it."""

    names, kinds = ["proof_sha256", "folded_root"], [pa.string(), pa.string()]

    def upper(self, pairs):
        return pairs, "".join(pairs), {}

    def __call__(self, pairs, upper, presented):
        above, shown, seen = upper
        proof = sha256(("".join(pairs) + shown).encode()).hexdigest()
        here = fold(presented, pairs)
        if here not in seen:  # leaves of one subtree that are as recorded share the rest of the way
            if len(seen) > LEAVES:
                seen.clear()
            seen[here] = fold(here, above)
        return proof, seen[here]


def fold(leaf: str, pairs: list[str]) -> str:
    """Root that a leaf gives with its siblings."""
    for left, right in zip(pairs[::2], pairs[1::2]):
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _answered(manifest: Manifest, answer, schema: str, presented: str | None) -> DataFrame:
    names = [field.name for field in manifest.keep]
    last = F.lower(F.hex("root"))
    above = _tops(manifest.top).select("tree", F.array().cast("array<string>").alias("upper"), last.alias("top_root"))
    roots = _descended(manifest.top, above, ["top_root"])
    opened = roots.join(
        manifest.top[0].select(F.col("tree").alias("__t"), F.col("block").alias("__b"), "k0"),
        F.col("tree").eqNullSafe(F.col("__t")) & (F.col("block") == F.col("__b"))).select(
        "tree", "block", "number", "store", "top_root", "upper", "k0")
    kind = manifest.top[0].schema["k0"].dataType.elementType
    paths = opened.mapInArrow(_opened, T.StructType([
        T.StructField("tree", T.IntegerType()), T.StructField("top_root", T.StringType()), T.StructField("k0", kind),
        T.StructField("block", T.LongType()), T.StructField("upper", T.ArrayType(T.StringType()))]))
    own = _tops(manifest.layers).select(F.col("tree").alias("__name"), last.alias("subroot"))
    groups = paths.join(own, F.col("k0").eqNullSafe(F.col("__name"))).select(
        F.col("__name").alias("tree"), "upper", "subroot", F.col("top_root").alias("total_root"))
    blocks = _descended(manifest.layers, groups, ["subroot", "total_root"])
    kept = [F.col(f"k{k}") for k in range(len(names))]
    low = manifest.layers[0].select(F.col("tree").alias("__t"), F.col("block").alias("__b"), *kept)
    met = blocks.join(low, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("block") == F.col("__b")))
    shown = [F.col(f"k{names.index(presented)}").alias("presented")] if presented else []
    given = met.select("block", "number", "store", "upper", "subroot", F.col("total_root").alias("root"), *kept, *shown)
    fields = [T.StructField(f"k{k}", field.dataType) for k, field in enumerate(manifest.keep)]
    tail = T._parse_datatype_string(f"subroot string, root string, leaf string, {schema}").fields
    found = given.mapInArrow(_proven(answer), T.StructType([*fields, *tail]))
    return found.select(*[F.col(f"k{k}").alias(name) for k, name in enumerate(names)], *[f.name for f in tail])


def proofs(manifest: Manifest) -> DataFrame:
    """Every row's kept columns with leaf, subroot, root and ``siblings``, [left, right] of each level up to the root.

    Siblings are hex digests, those of one side in one string; an empty string stands for none.
    """
    return _answered(manifest, _Siblings(), "siblings array<string>", None)


def verify(manifest: Manifest, presented: str) -> DataFrame:
    """As ``proofs``, with the proof's digest, and the root that the kept digest ``presented`` gives with it.

    A null ``presented`` stands for the recorded leaf. ``verified`` says whether the folded root is the manifest's.
    """
    found = _answered(manifest, _Folded(), "proof_sha256 string, folded_root string", presented)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
