"""The per-minute rule inside tasks: contested stretches of starts, on sorted rows."""

from bisect import bisect_right

MINUTE_MS = 60_000
SLICE_MS = 15 * MINUTE_MS


def admitted_starts(batches):
    """How many starts of each tick are let in; rows are sorted by (username, day, stretch, at, place).

    A tick is a number of starts at one time with one limit. Before each tick the admitted starts of the last minute
    are counted, the free places go to its first starts. Starts that are decided already always count. Memory holds
    the admitted ticks of one minute.
    """
    import pandas as pd

    last, times, upto = None, [], []
    for batch in batches:
        found = []
        columns = [batch[name].tolist() for name in (
            "username", "day", "stretch", "at", "place", "starts", "rpm_limit", "fixed")]
        for name, day, stretch, at, place, starts, limit, fixed in zip(*columns):
            key = (name, day, stretch, at, place)
            if last is not None and key < last:
                raise ValueError(f"rows are out of order at {key}")
            if last is None or key[:3] != last[:3]:
                times, upto = [], [0]  # admitted ticks, and the starts in all ticks before each
            last = key
            old = bisect_right(times, at - MINUTE_MS)
            free = limit - (upto[-1] - upto[old])
            let_in = starts if fixed else max(0, min(starts, free))
            if let_in:
                times.append(at)
                upto.append(upto[-1] + let_in)
            if old > 10_000:
                del times[:old], upto[:old]
            found.append((name, day, at, place, let_in))
        yield pd.DataFrame(found, columns=["username", "day", "at", "place", "let_in"])


# With a limit of one, the start after an admitted one is the first that comes a minute later. So a slice of time has a
# fixed way from each start that may be its first admitted one, and slices are chained by the ends of those ways.

KEYS = ["username", "day", "stretch", "part"]


def _slices(batches):
    """(key, sorted times, entry) of each slice; rows are sorted by KEYS and time, a slice may go over batches."""
    import numpy as np

    key, held, entry = None, [], None
    for batch in batches:
        times = batch["at"].to_numpy()
        entries = batch["entry"].tolist() if "entry" in batch else [None] * len(times)
        keys = batch[KEYS]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        for first, behind in zip(starts, [*starts[1:], len(times)]):
            found = tuple(keys.iloc[first])
            if found != key:
                if held:
                    yield key, np.concatenate(held), entry
                key, held, entry = found, [], entries[first]
            held.append(times[first:behind])
    if held:
        yield key, np.concatenate(held), entry


def _filled(columns, parts):
    """One frame of several parts with the given columns; scalars stand for whole columns."""
    import numpy as np
    import pandas as pd

    return pd.DataFrame({name: np.concatenate([np.broadcast_to(np.asarray(part[k]), len(part[-1])) for part in parts])
                         for k, name in enumerate(columns)})


def _in_parts(columns, rows, size=10_000):
    parts, held = [], 0
    for row in rows:
        parts.append(row)
        held += len(row[-1])
        if held >= size:
            yield _filled(columns, parts)
            parts, held = [], 0
    if parts:
        yield _filled(columns, parts)


def slice_ways(batches):
    """(entry, exit) of each slice: its last admitted time for each time that may be its first admitted one."""
    import numpy as np

    def ways():
        for key, times, _ in _slices(batches):
            after = np.searchsorted(times, times + MINUTE_MS)
            last = np.where(after < len(times), after, np.arange(len(times)))
            while not np.array_equal(further := last[last], last):
                last = further
            entries = np.searchsorted(times, key[3] * SLICE_MS + MINUTE_MS) + 1
            yield (*key, times[:entries], times[last[:entries]])

    yield from _in_parts([*KEYS, "entry", "exit"], ways())


def chained_entries(batches):
    """First admitted time of each slice; rows are sorted by KEYS and entry."""
    import pandas as pd

    stretch, taken, free = None, None, None
    for batch in batches:
        found = []
        for row in zip(*(batch[name].tolist() for name in (*KEYS, "entry", "exit"))):
            if row[:3] != stretch:
                stretch, taken, free = row[:3], None, row[4]
            if row[3] != taken and row[4] >= free:
                taken, free = row[3], row[5] + MINUTE_MS
                found.append(row[:5])
        yield pd.DataFrame(found, columns=[*KEYS, "entry"])


def slice_decisions(batches):
    """Ticks of each slice, of which those on the way from its entry have one start let in."""
    import numpy as np

    def decisions():
        for key, times, entry in _slices(batches):
            after = np.searchsorted(times, times + MINUTE_MS)
            let_in = np.zeros(len(times), dtype=np.int64)
            place = len(times) if entry is None or entry != entry else int(np.searchsorted(times, entry))
            while place < len(times):
                let_in[place] = 1
                place = after[place]
            yield key[0], key[1], times, -1, let_in

    yield from _in_parts(["username", "day", "at", "place", "let_in"], decisions())
