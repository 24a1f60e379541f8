"""SimHash near-duplicates: fingerprints from word shingles, links by bit-sliced comparison."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import carried, free_name, stage, utf8
from usagelens.llm.components import components

SEED = 42
LANES = 64  # fingerprints in a machine word of a bit plane
BLOCK = 4096  # fingerprints that one comparison task takes from a bucket
CHUNK = 1 << 18  # (fingerprint, word of lanes) pairs in one vector operation


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit k is set if it is set in over half the hashes of the shingles, repeats included.

    ASCII capitals become small; words are what lies between ASCII white space. Fewer words than ``shingle`` make one
    shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[:len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 16384):
        ones += np.unpackbits(values[at:at + 16384], axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle, text_index):
    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(text, shingle) for text in utf8(batch.column(text_index))),
                                np.uint64, batch.num_rows).view(np.int64)
            rest = [batch.column(i) for i in range(batch.num_columns) if i != text_index]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(found)],
                                             [batch.schema.names[i] for i in range(batch.num_columns)
                                              if i != text_index] + ["fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one 64-bit fingerprint for each row, as a signed long. Null text counts as empty: 0."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(_fingerprints(shingle, 1), "doc_id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row k holds bit k of all fingerprints, 64 of them in each word."""
    words = -(-len(fps) // LANES)
    padded = np.zeros(words * LANES, np.uint64)
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_lanes(planes, queries, query_of, word_of, radius):
    """For pairs of a query and a word of lanes, the lanes within ``radius`` bits.

    Distances of all 64 lanes grow together: the differing bits of one plane are added to vertical counters with
    carry-save steps. Pairs whose lanes have all passed the radius are abandoned every eighth plane.
    Returns the surviving pairs' positions and their lanes as bit masks.
    """
    levels = (radius + 1).bit_length()
    alive = np.arange(len(query_of))
    asked, words = queries[query_of], word_of
    counters = [np.zeros(len(alive), np.uint64) for _ in range(levels)]
    past = np.zeros(len(alive), np.uint64)
    full = ~np.uint64(0)
    for plane in range(64):
        carry = planes[plane][words] ^ (np.uint64(0) - ((asked >> np.uint64(plane)) & np.uint64(1)))
        for level in range(levels):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        past |= carry
        if plane % 8 == 7:
            over = np.zeros_like(past)  # lanes whose count is above the radius
            equal = np.full_like(past, full)
            for level in reversed(range(levels)):
                if radius >> level & 1:
                    equal &= counters[level]
                else:
                    over |= equal & counters[level]
                    equal &= ~counters[level]
            past |= over
            keep = np.flatnonzero(past != full)
            if len(keep) < len(alive):
                alive, asked, words, past = alive[keep], asked[keep], words[keep], past[keep]
                counters = [counter[keep] for counter in counters]
            if not len(alive):
                break
    return alive, ~past


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the classes of a[i] and b[i]; a label is the smallest position of its class."""
    while True:
        left, right = labels[a], labels[b]
        apart = left != right
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def bucket_links(fps: np.ndarray, group: np.ndarray, radius: int):
    """Spanning links (a, b) of rows within ``radius`` bits among rows of equal ``group``; groups are contiguous."""
    planes = bit_planes(fps)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(fps))
    last = np.repeat(ends, np.diff(ends, prepend=0)) - 1
    rows = np.arange(len(fps))
    first_word, counts = rows // LANES, last // LANES - rows // LANES + 1
    labels, upto = rows.copy(), np.cumsum(counts)
    begin = 0
    while begin < len(fps):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + CHUNK, "right")))
        query_of = np.repeat(rows[begin:end], counts[begin:end])
        offset = np.arange(len(query_of)) - np.repeat(upto[begin:end] - counts[begin:end] - done, counts[begin:end])
        word_of = first_word[query_of] + offset
        alive, lanes = near_lanes(planes, fps, query_of, word_of, radius)
        for at in range(0, len(alive), 1 << 14):
            bits = np.unpackbits(lanes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            pair, lane = np.nonzero(bits)
            a, b = query_of[alive[at + pair]], word_of[alive[at + pair]] * LANES + lane
            ok = (b > a) & (b <= last[a])
            labels = merge_labels(labels, a[ok], b[ok])
        begin = end
    moved = np.flatnonzero(labels != rows)
    return moved, labels[moved]


def _links(radius):
    def solve(table):
        fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        keys = np.stack([table.column(name).to_numpy() for name in ("part", "key", "i", "j")])
        new = np.zeros(len(fps), np.int64)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
        a, b = bucket_links(fps, np.cumsum(new), radius)
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    def run(batches):
        held = None  # rows of the last bucket seen, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch]).combine_chunks()
            keys = np.stack([rows.column(name).to_numpy() for name in ("part", "key", "i", "j")])
            whole = np.flatnonzero((keys != keys[:, -1:]).any(0))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield solve(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut)
        if held is not None:
            yield solve(held.combine_chunks())
    return run


def near_links(fps: DataFrame, radius: int = 4, segments: int = 6, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits, without listing every pair.

    Of ``segments`` parts of a fingerprint, ``segments - radius`` are equal in any such pair, so every choice of that
    many parts is a bucket key. Buckets of one row are dropped. A bucket of more than ``block`` rows is dealt into
    blocks by hash, and each pair of blocks is a task of its own.
    """
    equal = segments - radius
    if equal < 1:
        raise ValueError("segments must exceed radius")
    bounds = [64 * k // segments for k in range(segments + 1)]
    masks = []
    for chosen in combinations(range(segments), equal):
        mask = 0
        for k in chosen:
            mask |= ((1 << bounds[k + 1] - bounds[k]) - 1) << bounds[k]
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks]))
                       .alias("part", "key"))
    crowded = (keyed.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
               .select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = keyed.join(crowded, ["part", "key"]).withColumn(
        "own", F.pmod(F.hash("fp", "part"), F.col("blocks")))
    tasks = dealt.select(
        "fp", "part", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("fp", "part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    together = tasks.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j", "fp")
    return together.mapInArrow(_links(radius), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                   radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits, itself included.
    Only distinct fingerprints are compared, so exact copies never meet. Null text counts as empty; a row with a null
    id gets the smallest known id of its group, null if there is none. Repeated rows are returned as often as given;
    an empty table gives none; further columns are not read. Runs jobs before it returns.
    """
    marked, _ = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots, _ = stage(components(near_links(classes.select("fp"), radius)), "simhash-roots")
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
               radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns.

    Rows with a null id stay, since nothing tells which of a group they are. Rows that repeat one id stay together.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, radius)
    name = free_name(docs, "simhash_kept")
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, docs[id_col].cast("long") == first[name], "left_semi")
    return kept.unionByName(carried(docs.filter(F.col(id_col).isNull()), ()))
