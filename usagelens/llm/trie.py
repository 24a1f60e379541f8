"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Conversations are sorted by their turns and cut into shards, runs of bounded size. A shard writes its part of the trie as
balanced parentheses, in the order of the sort: each row closes the nodes that it does not share with the row before and
opens its own. ``findclose``, over blocks with the least excess of each, delimits a subtree; rank counts the leaf pairs
in it, and cumulative arrays over nodes give its members and savings. Only nodes that a shard shares with its neighbours,
the spines at its borders, are incomplete: their sums add up over shards, and each shard gets those of its own spines
back before it writes out the nodes that it opened first.
"""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import stage
from usagelens.llm.ranked import ranked

SHARD_ROWS = 4096
SHARD_TURNS = 65_536
BLOCK = 64
KEY = 32
NEVER = np.iinfo(np.int64).max
WORDS = r"[^\x20\x09-\x0D]+"


# --- balanced parentheses ----------------------------------------------------------------------------------------

class Excess:
    """Parentheses with the least excess of each block in a tree of minima."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-len(bits) // BLOCK)
        self.size = 1 << max(0, (blocks - 1)).bit_length()
        padded = np.full(self.size * BLOCK, NEVER)
        padded[:len(bits)] = self.excess
        self.cells = padded.reshape(self.size, BLOCK)
        self.least = np.full(2 * self.size, NEVER)
        self.least[self.size:] = self.cells.min(axis=1)
        for level in range(self.size.bit_length() - 1, 0, -1):
            first = 1 << (level - 1)
            at = np.arange(first, 2 * first)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each of ``opens``: the first one behind it with an excess below its own."""
        below = self.excess[opens] - 1
        close = np.full(len(opens), -1)
        block, inside = opens // BLOCK, opens % BLOCK
        todo = np.arange(len(opens))
        for step in range(1, BLOCK):  # in the rest of the own block
            at = inside[todo] + step
            todo, at = todo[at < BLOCK], at[at < BLOCK]
            hit = self.cells[block[todo], at] <= below[todo]
            close[todo[hit]] = opens[todo[hit]] + step
            todo = todo[~hit]
        todo = np.flatnonzero(close < 0)
        node = block[todo] + self.size
        climbing = np.ones(len(todo), dtype=bool)
        while climbing.any():  # up until the neighbour on the right goes low enough
            right = climbing & (node % 2 == 0)
            found = np.zeros(len(node), dtype=bool)
            found[right] = self.least[node[right] + 1] <= below[todo[right]]
            node = np.where(found, node + 1, np.where(climbing, node // 2, node))
            climbing &= ~found
        while (node < self.size).any():  # down to its first low block
            inner = node < self.size
            left = np.where(inner, 2 * node, 0)
            low = self.least[left] <= below[todo]
            node = np.where(inner, np.where(low, left, left + 1), node)
        first = (self.cells[node - self.size] <= below[todo, None]).argmax(axis=1) if len(todo) else np.zeros(0, int)
        close[todo] = (node - self.size) * BLOCK + first
        return close


class RangeMin:
    """Least value of any range, by tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half = 1 << (len(self.tables) - 1)
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))

    def between(self, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
        level = np.floor(np.log2(behind - first)).astype(int)
        found = np.empty(len(first), dtype=np.int64)
        for k in np.unique(level):
            of = level == k
            found[of] = np.minimum(self.tables[k][first[of]], self.tables[k][behind[of] - (1 << k)])
        return found


def _common(one: bytes | None, other: bytes | None) -> int:
    """Turns that two rows share from the start, -1 if there is no other row."""
    if one is None or other is None:
        return -1
    if one == other:
        return len(one) // KEY
    low, high = 0, min(len(one), len(other)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if one[:middle * KEY] == other[:middle * KEY] else (low, middle - 1)
    return low


class Shard:
    """The part of the trie that a sorted run of rows spans, its root included, in preorder."""

    def __init__(self, ids, turns, words, before, after):
        lengths = [len(t) // KEY for t in turns]
        shared = [_common(one, other) for one, other in zip(turns, turns[1:])]
        counts, parent, own, depth, path, ends = [1], [-1], [0], [0], [0], []
        for row, length in enumerate(lengths):
            common = shared[row - 1] if row else 0
            if row:
                counts.append(lengths[row - 1] - common)
                del path[common + 1:]
                counts.append(length - common)
            else:
                counts[0] += length
            for at in range(common, length):
                parent.append(path[-1])
                path.append(len(own))
                own.append(words[row][at])
                depth.append(at + 1)
            ends.append(path[-1])
        counts.append(lengths[-1] + 1)
        signs = np.zeros(len(counts), dtype=bool)
        signs[::2] = True
        bits = np.repeat(signs, counts)
        opens = np.flatnonzero(bits)
        size = len(opens)
        close = Excess(bits).findclose(opens)
        first, behind = np.arange(size), np.arange(size) + (close - opens + 1) // 2

        self.depth, self.parent = np.array(depth), np.array(parent)
        self.left, self.right = _common(before, turns[0]), _common(turns[-1], after)
        ends = np.array(ends)
        # Nodes that the rows before have opened, and all that neighbours share.
        first_path, last_path = self._path(ends[0]), self._path(ends[-1])
        self.owned = np.ones(size, dtype=bool)
        self.owned[first_path[:self.left + 1]] = False
        self.spine = ~self.owned
        self.spine[last_path[:self.right + 1]] = True
        self.turns, self.ends, self.ids = turns, ends, np.array(ids, dtype=np.int64)

        def summed(values):
            total = np.concatenate([[0], np.cumsum(values)])
            return total[behind] - total[first]

        here = np.bincount(ends, minlength=size)
        self.n_convs = summed(here)
        pairs = (~np.append(bits[1:], False))[opens]
        if self.right == lengths[-1]:
            pairs[ends[-1]] = False  # the next shard goes on from there
        rank = np.concatenate([[0], np.cumsum(np.bincount(opens[pairs], minlength=len(bits)))])
        self.n_leaves = rank[close + 1] - rank[opens]
        self.saved = summed((self.n_convs - self.owned) * np.array(own, dtype=np.int64))
        least = np.full(size, NEVER)
        np.minimum.at(least, ends, self.ids)
        self.conv = RangeMin(least).between(first, behind)
        new = self.owned & (self.parent >= 0)
        self.n_children = np.bincount(self.parent[new], minlength=size)

    def _path(self, node) -> np.ndarray:
        found = [node]
        while self.parent[found[-1]] >= 0:
            found.append(self.parent[found[-1]])
        return np.array(found[::-1])

    def spine_names(self) -> dict[int, bytes]:
        """Digest of the prefix of each shared node."""
        names: dict[int, bytes] = {}
        for turns, node, upto in ((self.turns[0], self.ends[0], self.left), (self.turns[-1], self.ends[-1], self.right)):
            name = b""
            for depth, place in enumerate(self._path(node)[:upto + 1]):
                name = sha256(name + turns[KEY * (depth - 1):KEY * depth] if depth else b"").digest()
                names[int(place)] = name
        return names

    def members(self) -> dict[int, np.ndarray]:
        """Conversations that end at each node, ascending."""
        cut = np.flatnonzero(np.diff(self.ends)) + 1
        return {int(self.ends[at]): np.sort(ids) for at, ids in zip([0, *cut], np.split(self.ids, cut))}


def _listed(ids) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


# --- tasks -------------------------------------------------------------------------------------------------------

_SHARD = "part int, no long, ids array<long>, turns array<binary>, words array<array<long>>, before binary, after binary, first boolean, last boolean"


def _cut(rows_limit, turns_limit):
    """Shards of a task's sorted rows (part, conv_id, turns, words), each with the rows before and behind it."""
    def run(batches):
        schema = pa.schema([
            ("part", pa.int32()), ("no", pa.int64()), ("ids", pa.list_(pa.int64())), ("turns", pa.list_(pa.binary())),
            ("words", pa.list_(pa.list_(pa.int64()))), ("before", pa.binary()), ("after", pa.binary()),
            ("first", pa.bool_()), ("last", pa.bool_())])
        number, before, held, size, part = 0, None, ([], [], []), 0, 0

        def shard(after):
            return pa.RecordBatch.from_pylist([{
                "part": part, "no": number, "ids": held[0], "turns": held[1], "words": held[2], "before": before,
                "after": after, "first": number == 0, "last": after is None}], schema=schema)

        for batch in batches:
            for part, conv, turns, words in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "turns", "words"))):
                if held[0] and (len(held[0]) >= rows_limit or size + len(words) > turns_limit):
                    yield shard(turns)
                    number, before, held, size = number + 1, held[1][-1], ([], [], []), 0
                for column, value in zip(held, (conv, turns, words)):
                    column.append(value)
                size += len(words)
        if held[0]:
            yield shard(None)
    return run


def _shards(batch):
    columns = ("ids", "turns", "words", "before", "after")
    for row in range(batch.num_rows):
        yield row, Shard(*(batch.column(c)[row].as_py() for c in columns))


_SPINE = "part int, no long, name binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, members string"


def _spines(batches):
    """What a shard adds to each node that it shares."""
    for batch in batches:
        found = []
        for row, shard in _shards(batch):
            members = shard.members()
            for place, name in shard.spine_names().items():
                found.append((
                    batch.column("part")[row].as_py(), batch.column("no")[row].as_py(), name, int(shard.conv[place]),
                    int(shard.n_convs[place]), int(shard.n_children[place]), int(shard.n_leaves[place]),
                    int(shard.saved[place]), _listed(members[place]).decode() if place in members else None))
        columns = list(zip(*found)) or [()] * 9
        kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
            "part", "no", "name", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "members"])


def _hashed(batches):
    """SHA-256 of the member lists of each name, whose pieces come in order; one hash state is all that is held."""
    last, state = None, None
    for batch in batches:
        done = []
        for name, members in zip(batch.column("name").to_pylist(), batch.column("members").to_pylist()):
            if name != last:
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = name, sha256(members.encode())
            else:
                state.update(b"," + members.encode())
        yield _named(done)
    if last is not None:
        yield _named([(last, state.hexdigest())])


def _named(pairs):
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], names=["name", "ends_sha256"])


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
_EMPTY = sha256(b"").hexdigest()


def _nodes(batches):
    """Nodes that a shard has opened first; those on its spines with the sums of all shards."""
    for batch in batches:
        for row, shard in _shards(batch):
            values = [shard.conv, shard.n_convs, shard.n_children, shard.n_leaves, shard.saved]
            ends = {place: sha256(_listed(ids)).hexdigest() for place, ids in shard.members().items()}
            given = {one["name"]: one for one in batch.column("spine")[row].as_py() or ()}
            for place, name in shard.spine_names().items():
                for column, key in zip(values, ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")):
                    column[place] = given[name][key]
                ends[place] = given[name]["ends_sha256"] or _EMPTY
            owned = np.flatnonzero(shard.owned)
            above = shard.parent[owned]
            columns = [values[0][owned], shard.depth[owned], np.where(above >= 0, values[0][above], 0), *[v[owned] for v in values[1:]]]
            arrays = [pa.array(column, pa.int64()) for column in columns]
            arrays[2] = pa.array(columns[2], pa.int64(), mask=above < 0)
            listed = pa.array([ends.get(int(place), _EMPTY) for place in owned], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, listed], names=[
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


# --- operators ---------------------------------------------------------------------------------------------------

def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, key, words): each turn with its place in its conversation, a digest of role and text and the words of its text.

    Turns stand in the order of ``turn``, null first, equal ones by their digest. A null role or text is empty; rows
    without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"),
        F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).cast("long").alias("words"))
    rows, _ = stage(rows, "keys")  # texts are read once, ranges are taken from keys
    return ranked(rows, ["conv_id"], ["turn", "key"]).select("conv_id", "place", "key", "words")


def rebranched(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Conversations (conv_id, turns, words) that start with ``head`` turns of another one, then go on with their own.

    ``base`` and ``head`` are given in terms of conv_id; ``head`` is ``most`` at most. A conversation takes what the base
    has, if there is one, in place of its own first turns. One without any turn left has empty lists.
    """
    each = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), head.alias("head"))
    lead = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "key", "words")
    wanted = each.where("head > 0 AND base != conv_id").join(lead, "base").where("place < head").select(
        "conv_id", F.lit(0).alias("piece"), "place", "key", "words")
    own = turns.select("conv_id", F.lit(1).alias("piece"), "place", "key", "words").where(
        (F.col("place") >= head) | (base == F.col("conv_id")))
    ordered = F.sort_array(F.collect_list(F.struct("piece", "place", "key", "words")))
    lists = own.unionByName(wanted).groupBy("conv_id").agg(ordered.alias("rows"))
    full = lists.select("conv_id", F.col("rows.key").alias("turns"), F.col("rows.words").alias("words"))
    none = each.join(lists, "conv_id", "left_anti").select(
        "conv_id", F.array().cast("array<binary>").alias("turns"), F.array().cast("array<bigint>").alias("words"))
    return full.unionByName(none)


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of (conv_id, turns, words), with the root, in the columns of NODE.

    ``turns`` lists digests of KEY bytes, ``words`` the words of each. A node is a distinct sequence of first turns, its
    members are the conversations that start with it; ``saved_tokens`` sums, over its subtree, the words of each last
    turn times the members but one. conv_ids must be distinct. No conversations give no nodes, not even a root. A
    shard has ``shard_rows`` rows and ``shard_turns`` turns at most, or one longer conversation, which must fit in a row.
    """
    sorted_by = ["turns", "conv_id"]
    rows = conversations.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by).select(
        F.spark_partition_id().alias("part"), "conv_id", F.array_join(F.transform("turns", F.hex), "").alias("turns"), "words")
    cut = rows.withColumn("turns", F.unhex("turns")).mapInArrow(_cut(shard_rows, shard_turns), _SHARD)
    shards, _ = stage(cut, "shards")
    tasks = Window.orderBy("part")
    borders = shards.groupBy("part").agg(
        F.max(F.when(F.col("first"), F.element_at("turns", 1))).alias("head"),
        F.max(F.when(F.col("last"), F.element_at("turns", -1))).alias("tail"))
    met = borders.select(F.col("part").alias("__part"), F.lag("tail").over(tasks).alias("tail"), F.lead("head").over(tasks).alias("head"))
    whole = shards.join(met, F.col("part") == F.col("__part")).withColumns({
        "before": F.when(F.col("first"), F.col("tail")).otherwise(F.col("before")),
        "after": F.when(F.col("last"), F.col("head")).otherwise(F.col("after"))}).select(
        "part", "no", "ids", "turns", "words", "before", "after")
    spines, _ = stage(whole.mapInArrow(_spines, _SPINE), "spines")
    sums = spines.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    pieces = spines.where("members IS NOT NULL").select("name", "part", "no", "members")
    ends = pieces.repartition("name").sortWithinPartitions("name", "part", "no").select("name", "members").mapInArrow(
        _hashed, "name binary, ends_sha256 string")
    total = sums.join(ends, "name", "left")
    value = F.struct("name", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    back = spines.select("part", "no", "name").join(total, "name").groupBy("part", "no").agg(F.collect_list(value).alias("spine"))
    return whole.join(back, ["part", "no"], "left").drop("part", "no").mapInArrow(_nodes, NODE)
