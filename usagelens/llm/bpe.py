"""Byte-level BPE: every distinct word is encoded once, ids go back to their places, decoding joins token bytes."""

import base64
import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from usagelens.llm.common import carried

BLOCK = 12 << 20  # characters of text whose words share one dictionary
LEVEL = 9  # of zstandard, for what is shuffled
SHORT = 96  # bytes up to which a word is merged by plain search
ANSWERS = {
    "ids": "ids array<int>",
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string",
    "all": "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>",
}
_PACKED = "kind int, block long, bucket int, rows array<long>, sizes array<int>, data array<binary>"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the neighbours of lowest rank are joined, the leftmost first, until no join has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    none = float("inf")
    joins = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while joins:
        least = min(joins)
        if least == none:
            break
        i = joins.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[part] for part in parts]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of possible joins, for words of any length."""
    size = len(word)
    end = list(range(1, size + 1))  # end of the part that begins at a place
    before = list(range(-1, size - 1))
    alive = [True] * size
    heap = []

    def offer(i):
        j = end[i]
        if j < size:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(size - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= size or not alive[j] or end[j] != stop:
            continue  # one of the two has changed since
        alive[j] = False
        end[i] = stop
        if stop < size:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < size:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, their low bytes together, then the next ones: such planes compress well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _row(kind, block, bucket, rows, sizes, data):
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([bucket], pa.int32()),
         pa.array([rows], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
         pa.array([data], pa.list_(pa.binary()))], ["kind", "block", "bucket", "rows", "sizes", "data"])


def _split_batches(pattern, buckets, block_chars):
    """Texts to blocks: one row with the place of every word, and for each bucket a row with the block's words."""
    def run(batches):
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        first = TaskContext.get().partitionId() << 32
        blocks = 0
        places, ids, codes, chars = {}, [], [], 0

        def close():
            count = len(places)
            sizes = [len(part) for part in codes]
            every = np.concatenate(codes)
            # Words are numbered by falling frequency, which keeps the numbers small.
            order = np.argsort(-np.bincount(every, minlength=count), kind="stable")
            rank = np.empty(count, np.int64)
            rank[order] = np.arange(count)
            words = list(places)
            words = [words[k].encode() for k in order]
            home = np.fromiter((zlib.crc32(word) % buckets for word in words), np.int64, count)
            block = first + blocks
            yield _row(0, block, zlib.crc32(b"%d" % block) % buckets, list(ids), sizes,
                       [_pack(rank[every]), _pack(home)])
            by_home = np.argsort(home, kind="stable")
            ends = np.searchsorted(home[by_home], np.arange(buckets), "right")
            for bucket, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                if b > a:
                    own = [words[k] for k in by_home[a:b]]
                    yield _row(1, block, bucket, None, None,
                               [_pack(np.fromiter(map(len, own), np.int64, len(own))),
                                zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(own))])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if codes and chars + len(text) > block_chars:
                    yield from close()
                    blocks, chars = blocks + 1, 0
                    places, ids, codes = {}, [], []
                found = find(text)
                codes.append(np.fromiter((places.setdefault(word, len(places)) for word in found), np.uint32,
                                         len(found)))
                ids.append(row)
                chars += len(text)
        if codes:
            yield from close()
    return run


def _encode_batches(shared):
    """Word rows become rows of ids; each distinct word of the bucket is encoded once."""
    def run(batches):
        ranks = shared.value
        known: dict[bytes, tuple[int, bytes]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield _row(0, row["block"], -1, row["rows"], row["sizes"], row["data"])
                    continue
                lengths = _unpack(row["data"][0])
                joined = zstandard.ZstdDecompressor().decompress(row["data"][1])
                counts, pieces, at = [], [], 0
                for length in lengths.tolist():
                    word = joined[at:at + length]
                    at += length
                    answer = known.get(word)
                    if answer is None:
                        ids = encode_word(word, ranks)
                        answer = known[word] = len(ids), np.array(ids, "<u4").tobytes()
                    counts.append(answer[0])
                    pieces.append(answer[1])
                yield _row(1, row["block"], row["bucket"], None, None,
                           [_pack(np.array(counts)), _pack(np.frombuffer(b"".join(pieces), "<u4"))])
    return run


def _assemble(shared, answer):
    """Ids of a block's texts: the words' ids at the words' places."""
    def run(table):
        rows = sorted(table.to_pylist(), key=lambda row: row["bucket"])
        head, words = rows[0], rows[1:]
        codes, home = (_unpack(part) for part in head["data"])
        counts = np.concatenate([_unpack(row["data"][0]) for row in words]) if words else np.zeros(0, np.uint32)
        ids = np.concatenate([_unpack(row["data"][1]) for row in words]) if words else np.zeros(0, np.uint32)
        # Words stand by bucket here, by frequency in the codes.
        order = np.argsort(home, kind="stable")
        number, start = np.empty(len(home), np.int64), np.empty(len(home), np.int64)
        number[order] = counts
        start[order] = np.cumsum(counts, dtype=np.int64) - counts
        answers, every, at = [], [], 0
        if answer != "ids":
            ranks = shared.value
            top = max(ranks.values(), default=-1) + 1
            table_of, decimals = [b""] * top, [str(k) for k in range(top)]
            for token, rank in ranks.items():
                table_of[rank] = token
        for size in head["sizes"]:
            own = codes[at:at + size]
            at += size
            long = number[own]
            ends = np.cumsum(long)
            total = int(ends[-1]) if size else 0
            found = ids[np.repeat(start[own] - (ends - long), long) + np.arange(total)]
            if answer != "digests":
                every.append(found.astype(np.int32))
            if answer != "ids":
                listed = found.tolist()
                answers.append((total, hashlib.sha256(",".join([decimals[k] for k in listed]).encode()).hexdigest(),
                                hashlib.sha256(b"".join([table_of[k] for k in listed])).hexdigest()))
        columns = [pa.array(head["rows"], pa.int64())]
        if answer != "ids":
            columns += [pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string()),
                        pa.array([a[2] for a in answers], pa.string())]
        if answer != "digests":
            columns.append(pa.array(every, pa.list_(pa.int32())))
        return pa.table(columns, ["doc_id", *(column.split()[0] for column in ANSWERS[answer].split(", "))])
    return run


def bpe_encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
               answer: str = "ids", block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, ids) for each row, as ``pattern`` cuts its whole text into words and ``ranks`` join their bytes.

    Texts are read in blocks. A block keeps the places of its words and sends its distinct words to buckets by hash;
    there each distinct word of the corpus is encoded once, and its ids return to the blocks that have it. A word meets
    its bucket once for each block, however often it occurs, so frequent words are no hot keys. The session's shuffle
    partitions set the number of buckets. With ``answer="digests"`` the result is n_tokens, the SHA-256 of the decimal
    ids joined by commas, and the SHA-256 of the bytes that the ids decode to; ``"all"`` adds the ids to them.

    Null and empty texts have no ids. Rows with equal or null ids are encoded each for itself; further columns are not
    read. Blocks belong to partitions of ``docs``: those must come out alike when computed again, as a table's do.
    """
    spark = docs.sparkSession
    buckets = min(1 << 15, max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shared = spark.sparkContext.broadcast(ranks)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    split = narrow.mapInArrow(_split_batches(pattern, buckets, block_chars), _PACKED)
    encoded = split.repartition("bucket").mapInArrow(_encode_batches(shared), _PACKED)
    return encoded.groupBy("block").applyInArrow(_assemble(shared, answer), f"doc_id long, {ANSWERS[answer]}")


def _decode_batches(shared, ids_index, keep):
    def run(batches):
        tokens = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            decoded = [None if ids is None else b"".join([tokens[k] for k in ids])
                       for ids in batch.column(ids_index).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(decoded, pa.binary())],
                                             [batch.schema.names[i] for i in keep] + ["decoded"])
    return run


def bpe_decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids in order, looked up in the broadcast vocabulary.

    The vocabulary has a fixed size, so each task holds it. Null ids give null, an unknown id is an error.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    rest = carried(rows, ("decoded",))
    given = rows.select(F.col(f"`{ids_col}`").alias("__ids"), *[F.col(f"`{c}`") for c in rest.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + ", decoded binary"
    return given.mapInArrow(_decode_batches(shared, 0, range(1, len(given.columns))), schema)
