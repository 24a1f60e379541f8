"""Benchmark decontamination: one automaton over all benchmark windows, each text scanned once."""

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.common import carried, numbered, utf8, with_text

WINDOW = 10
# One automaton holds the windows of at most this many bytes of benchmark text (about 200 bytes of memory for each).
# A larger benchmark is taken in several passes, each over a part of its own.
AUTOMATON_BYTES = 256 * 1024
# Letters and digits stay, capitals become small, bytes of other scripts stay, all else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
             for c in range(256))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.LongType()))])
OUTPUTS = FOUND.names
_HITS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()),
                            ("start", pa.int64()), ("end", pa.int64())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows(text: bytes, window: int = WINDOW) -> set[bytes]:
    """All windows of an item; a shorter item is one window, one without words has none."""
    parts = words(text)
    return {b" ".join(parts[i:i + window]) for i in range(max(1, len(parts) - window + 1))} if parts else set()


def automaton(items, window: int = WINDOW):
    """Automaton over the windows of (item_id, text) rows; a match gives its length in words and its items."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for part in windows(text, window):
            owners.setdefault(part, set()).add(item)
    found = ahocorasick.Automaton()
    for part, ids in owners.items():
        # Bytes as Latin-1 text: one character for each byte. A blank on both sides keeps matches on whole words.
        found.add_word(" " + part.decode("latin-1") + " ", (part.count(b" ") + 1, ids))
    if owners:
        found.make_automaton()
    return found


def scan(text: bytes, found) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, hit ranges of words merged and in order, ids of items found)."""
    parts = words(text)
    if not parts or not len(found):
        return len(parts), [], set()
    line = " " + b" ".join(parts).decode("latin-1") + " "
    ranges, items, at, word = [], set(), 0, 0
    for end, (length, ids) in found.iter(line):
        word += line.count(" ", at, end)  # blanks before the closing one = number of the last word, from 1
        at = end
        first, last = word - length, word - 1
        items |= ids
        while ranges and ranges[-1][0] >= first:
            ranges.pop()
        if ranges and first <= ranges[-1][1] + 1:
            ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
        else:
            ranges.append((first, last))
    return len(parts), ranges, items


def offsets(text: bytes, ranges) -> list[dict]:
    """Word ranges with the code points of the original text that they cover."""
    if not ranges:
        return []
    folded = text.translate(FOLD)
    starts, ends, at = [], [], 0
    for part in folded.split():
        at = folded.index(part, at)
        starts.append(at)
        at += len(part)
        ends.append(at)
    rows, byte, point = [], 0, 0
    for first, last in ranges:
        point += len(text[byte:starts[first]].decode())
        span = len(text[starts[first]:ends[last]].decode())
        rows.append({"first_word": first, "last_word": last, "start": point, "end": point + span})
        byte, point = ends[last], point + span
    return rows


def _merge(a, b):
    """Union of two sorted lists of ranges."""
    merged = []
    for first, last in sorted([*a, *b]):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def _scan_batches(shared, text_index, window, keep):
    def run(batches):
        parts = shared.value
        for batch in batches:
            texts = utf8(batch.column(text_index))
            results = [[0, [], set()] for _ in texts]
            for part in parts:
                # The automaton is kept with the broadcast value, so a worker builds it once.
                if "automaton" not in part or len(parts) > 1:
                    part["automaton"] = automaton(part["items"], window)
                for result, text in zip(results, texts):
                    result[0], ranges, items = scan(text, part["automaton"])
                    if ranges:
                        result[1] = _merge(result[1], ranges) if result[1] else ranges
                        result[2] |= items
                if len(parts) > 1:
                    del part["automaton"]
            found = [pa.array([r[0] for r in results], pa.int64()),
                     pa.array([offsets(text, r[1]) for text, r in zip(texts, results)], _HITS),
                     pa.array([sorted(i for i in r[2] if i is not None) for r in results], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + found,
                                             [batch.schema.names[i] for i in keep] + list(OUTPUTS))
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, keep=None,
                       automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, hits (ranges of words and of code points of the original text) and item_ids.

    Texts are compared as lower-case words of letters and digits. A word is hit if it lies in any occurrence of a
    window of ``window`` item words; an item of fewer words is one window. The benchmark is measured first; up to
    ``automaton_bytes`` make one automaton, more are dealt by hash into several that take turns on a batch, so memory is
    bounded whatever the size. ``keep`` names the columns to carry along, all by default.

    Null and empty texts have no words. Null items and items without words match nothing; an item with a null id hits
    words but is not listed. Repeated rows are treated alike, an empty benchmark hits nothing, input columns called like
    an output give way to it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // automaton_bytes))
    # The driver holds the benchmark, a table of public test sets, never the documents.
    dealt: list[list] = [[] for _ in range(count)]
    for row in items.filter("text is not null").distinct().toLocalIterator():
        text = bytes(row.text)
        dealt[int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") % count].append((row.id, text))
    shared = spark.sparkContext.broadcast([{"items": part} for part in dealt])
    rest = carried(docs, OUTPUTS, keep)
    rows, text_index, kept = with_text(docs, rest, text_col)
    schema = T.StructType(rest.schema.fields + FOUND.fields)
    return rows.mapInArrow(_scan_batches(shared, text_index, window, kept), schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark window occurs."""
    inner, names = numbered(docs)
    found = find_contamination(inner, benchmark, **options | {"text_col": names[options.get("text_col", "text")]})
    return found.filter(F.size("hits") == 0).select(*[F.col(n).alias(c) for c, n in names.items()])
