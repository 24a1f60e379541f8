"""Near-duplicate vectors by spherical-cap filters: vectors that exceed the same filter directions are compared."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import stage
from usagelens.llm.components import components
from usagelens.llm.simhash import merge_labels

TABLES = 3  # independent rotations
PARTS = 2  # parts of a direction, each from a codebook of its own
CODEWORDS = 64  # directions of a table: CODEWORDS ** PARTS
CAP = 2.5  # a vector passes a direction above CAP standard deviations of a random product
WIDEST = 0.35  # least product asked for in few dimensions, where CAP deviations are out of reach
BLOCK = 2048  # vectors that one comparison task takes from a filter
CLOSE = 1e-9  # products this near to the threshold are computed once more with exact sums


def directions(dim: int, seed: int, tables: int, parts: int, codewords: int):
    """(rotation, codebooks) of each table: directions are all sums of one codeword of each part, of length one."""
    made = []
    for number in range(tables):
        random = np.random.default_rng([seed, dim, number])
        rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        books = []
        for part in np.array_split(np.arange(dim), min(parts, dim)):
            words = random.standard_normal((codewords, len(part)))
            books.append((part, words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(min(parts, dim))))
        made.append((rotation, books))
    return made


def list_decode(vector: np.ndarray, books, threshold: float) -> np.ndarray:
    """Numbers of all directions whose product with the vector reaches the threshold.

    Parts are added one after another. A beginning goes on only with those words of the next part, in falling order,
    that can still reach the threshold with the best words of the rest.
    """
    products = [words @ vector[part] for part, words in books]
    rest = np.cumsum([0.0, *[p.max() for p in reversed(products)]])[::-1]  # the best that parts from k on can add
    numbers, totals = np.zeros(1, np.int64), np.zeros(1)
    for k, product in enumerate(products):
        order = np.argsort(-product, kind="stable")
        falling = product[order]
        count = np.searchsorted(-falling, totals - (threshold - rest[k + 1]), "right")
        begun = np.repeat(np.arange(len(numbers)), count)
        word = np.arange(len(begun)) - np.repeat(np.cumsum(count) - count, count)
        numbers = numbers[begun] * len(product) + order[word]
        totals = totals[begun] + falling[word]
    return numbers


def _filter_batches(seed, tables, parts, codewords, cap, dtype):
    """Vectors and the numbers of their filters as bytes, and the heads: all but the last codeword of their filters.

    Filters of one head go to the same task, so a vector travels once for each head, not for each filter.
    """
    def run(batches):
        made = {}
        for batch in batches:
            vectors, filters, every = [], [], []
            for values in batch.column(1).to_pylist():
                values = np.array(values, dtype)
                vector = unit_rows([values])[0]
                dim = len(vector)
                if dim not in made:
                    made[dim] = directions(dim, seed, tables, parts, codewords)
                found = np.sort(np.concatenate([
                    number * codewords ** len(books) + list_decode(rotation @ vector, books, min(cap / math.sqrt(dim), WIDEST))
                    for number, (rotation, books) in enumerate(made[dim])]))
                vectors.append(values.tobytes())
                filters.append(found.astype("<i4").tobytes())
                every.append(np.unique(found // codewords))
            kept = [batch.column(name) for name in ("cid", "label", "copies")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(v) // np.dtype(dtype).itemsize for v in vectors], pa.int32()),
                 pa.array(vectors, pa.binary()), pa.array(filters, pa.binary()), pa.array(every, pa.list_(pa.int32()))],
                ["cid", "label", "copies", "dim", "vector", "filters", "heads"])
    return run


def unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _scaled(values) -> list[float]:
    """Components times a power of two that brings the largest near one, so that squares neither vanish nor overflow."""
    power = math.frexp(max(abs(float(x)) for x in values))[1]
    return [math.ldexp(float(x), -power) for x in values]


def _exact_cosine(a, b) -> float:
    a, b = _scaled(a), _scaled(b)
    product = math.fsum(x * y for x, y in zip(a, b))
    return product / (math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(y * y for y in b)))


def compare(vectors, units, filters, own, at: int, cosine: float, cross: bool):
    """Pairs (a, b) of rows with a cosine of at least ``cosine`` that no earlier filter holds together.

    ``units`` are the vectors brought to length one, ``filters`` the rows' sorted arrays of filter numbers and ``at`` the one that brings them together. With ``cross`` only
    pairs of different ``own`` count.
    """
    pairs = []
    for begin in range(0, len(units), 512):
        products = units[begin:begin + 512] @ units.T
        a, b = np.nonzero(products >= cosine - CLOSE)
        keep = b > a + begin
        if cross:
            keep &= own[a + begin] != own[b]
        a, b = a[keep], b[keep]
        edge = np.flatnonzero(np.abs(products[a, b] - cosine) <= CLOSE)
        wrong = [k for k in edge if _exact_cosine(vectors[a[k] + begin], vectors[b[k]]) < cosine]
        if wrong:
            a, b = np.delete(a, wrong), np.delete(b, wrong)
        if len(a):
            # A pair belongs to its first common filter: a product of membership rows tells of earlier ones.
            rows = np.unique(np.concatenate([a + begin, b]))
            earlier = [filters[r][:np.searchsorted(filters[r], at)] for r in rows]
            known, column = np.unique(np.concatenate(earlier), return_inverse=True)
            if len(known):
                member = np.zeros((len(rows), len(known)), np.float32)
                member[np.repeat(np.arange(len(rows)), [len(part) for part in earlier]), column] = 1
                left, right = np.searchsorted(rows, a + begin), np.searchsorted(rows, b)
                firsts, back = np.unique(left, return_inverse=True)
                met = member[firsts] @ member.T
                fresh = met[back, right] == 0
                a, b = a[fresh], b[fresh]
        pairs.append((a + begin, b))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def _link_batches(cosine, dtype, codewords):
    def pairs_of(rows, vectors, own):
        """Pairs of one task, filter by filter."""
        filters = [np.frombuffer(f, "<i4") for f in rows["filters"]]
        head, cross = rows["head"][0], rows["i"][0] != rows["j"][0]
        units = unit_rows(vectors)
        inside = [f[np.searchsorted(f, head * codewords):np.searchsorted(f, (head + 1) * codewords)] for f in filters]
        number = np.concatenate(inside)
        row = np.repeat(np.arange(len(inside)), [len(part) for part in inside])
        order = np.argsort(number, kind="stable")
        number, row = number[order], row[order]
        cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        for begin, end in zip(cuts, np.append(cuts[1:], len(number))):
            if end - begin > 1:
                met = row[begin:end]
                a, b = compare(vectors[met], units[met], [filters[k] for k in met], own[met], number[begin], cosine, cross)
                if len(a):
                    yield met[a], met[b]

    def solve(rows):
        """Links of each row and spanning links of one task: (class, links, root)."""
        cids, weights = np.array(rows["cid"]), np.array(rows["copies"], np.int64)
        own = np.array(rows["own"])
        vectors = np.stack([np.frombuffer(v, dtype) for v in rows["vector"]])
        links, roots = np.zeros(len(cids)), np.arange(len(cids))
        for a, b in pairs_of(rows, vectors, own):
            links += np.bincount(a, weights[b], len(cids)) + np.bincount(b, weights[a], len(cids))
            roots = merge_labels(roots, a, b)
        linked = np.flatnonzero(links)
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(cids[linked], pa.int64()), pa.array(links[linked].astype(np.int64)),
             pa.array(cids[roots[linked]], pa.int64())], ["cid", "links", "root"])

    def run(batches):
        names = ("cid", "copies", "vector", "filters", "own", "head", "i", "j")
        held, key = None, None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("label", "dim", "head", "i", "j")]
            keys = list(zip(*columns))
            cuts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
            for begin, end in zip(cuts, [*cuts[1:], len(keys)]):
                part = batch.slice(begin, end - begin)
                rows = {name: part.column(name).to_pylist() for name in names}
                if keys[begin] == key:
                    for name in names:
                        held[name] += rows[name]
                    continue
                if held is not None and (done := solve(held)) is not None:
                    yield done
                held, key = rows, keys[begin]
        if held is not None and (done := solve(held)) is not None:
            yield done
    return run


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                 cosine: float = 0.93, seed: int = 11, tables: int = TABLES, parts: int = PARTS,
                 codewords: int = CODEWORDS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Two rows link if their labels are equal and not null, their vectors equally long and the cosine in double precision
    is at least ``cosine``. ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` marks the row that has it. Without ``label_col`` all rows are of one label.

    Equal vectors of a label are one class from the start. Every class is decoded to all filter directions it exceeds,
    and only classes with a common filter are compared; a pair counts in its first common filter. A head of more than
    ``block`` classes is dealt into blocks whose pairs are tasks of their own. Tasks return sums and spanning links, not
    pairs. More ``tables`` or a lower ``cap`` find pairs that have no common filter; with the defaults and 64 dimensions
    that is less than one in ten thousand at the threshold, and fewer above it.

    A row whose label or vector is null, or whose vector is empty, zero or holds null or non-finite components, links
    with none. A null id has the smallest id of its group, if any, and is not kept. Rows that repeat an id count each.
    An empty table gives none; other columns are not read. Runs jobs before it returns.
    """
    label = F.col(f"`{label_col}`").cast("string") if label_col else F.lit("")
    vector = F.col(f"`{vector_col}`")
    sound = (label.isNotNull() & vector.isNotNull()
             & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(vector, lambda x: x != 0))
    given, _ = stage(rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"),
                                 vector.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound")), "vectors")
    classes = given.filter("sound").groupBy("label", "vector").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes, _ = stage(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    dtype = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    listed = classes.select("cid", "vector", "label", "copies").mapInArrow(
        _filter_batches(seed, tables, parts, codewords, cap, dtype),
        "cid long, label string, copies long, dim int, vector binary, filters binary, heads array<int>")
    listed, _ = stage(listed, "vector-filters")
    # Tasks are made of ids; the vectors join them at the end, so they are shuffled once.
    keys = listed.select("cid", "label", "dim", F.explode("heads").alias("head"))
    crowded = (keys.groupBy("label", "dim", "head").agg(F.count("*").alias("n")).filter("n > 1")
               .select("label", "dim", "head", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = keys.join(crowded, ["label", "dim", "head"]).withColumn(
        "own", F.pmod(F.hash("cid", "head"), F.col("blocks")))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    tasks = tasks.join(listed.select("cid", "vector", "copies", "filters"), "cid")
    order = ["label", "dim", "head", "i", "j"]
    met = tasks.repartition(*order).sortWithinPartitions(*order, "cid").mapInArrow(
        _link_batches(cosine, dtype, codewords), "cid long, links long, root long")
    met, _ = stage(met, "vector-links")

    linked = met.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(roots, classes.cid == roots.node, "left").select(
        "cid", "least", F.coalesce("root", "cid").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    told, _ = stage(
        grouped.join(smallest, "root").join(linked, "cid", "left").join(
            classes.select("cid", "label", "vector", "copies"), "cid").select(
            "label", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")),
        "vector-classes")
    sound_rows = given.filter("sound").join(told, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = given.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                             F.col("vec_id").alias("component_id"))
    return sound_rows.union(alone).select(
        "vec_id", "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
