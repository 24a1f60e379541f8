"""Requests that finish on a later day than they start, in order: each may close that day for others."""


def carried_tokens(batches):
    """Tokens of earlier days' requests in each span of a day; rows are sorted by (username, day, mark, kind).

    A span are the starts between two marks, a mark is the start of a request that finishes on another day or the finish
    of one. Kind 0 is a span's last start with the sums before it, kind 1 a start, kind 2 a finish. A start is let in if
    no limit is reached at its span's end or earlier. Memory holds the user's requests that are under way over midnight.
    """
    import pandas as pd

    user, day, last = None, None, None
    under_way, carry, closed = {}, 0, False
    for batch in batches:
        found = []
        columns = ("username", "day", "mark", "kind", "id", "n", "tok", "request_limit", "token_limit", "held")
        for row in zip(*(batch[name].tolist() for name in columns)):
            if last is not None and row[:4] < last:
                raise ValueError(f"rows are out of order at {row[:4]}")
            last = row[:4]
            name, on, mark, kind, key, n, tokens, most_requests, most_tokens, held = row
            if name != user:
                user, day, under_way = name, None, {}
            if on != day:
                day, carry, closed = on, 0, False
            if kind == 0:
                found.append((name, on, mark, carry))
                closed = closed or (most_requests != 0 and n >= most_requests) or (
                    most_tokens != 0 and tokens + carry >= most_tokens)
            elif kind == 1:
                under_way[key] = not closed
            elif held or under_way.pop(key, False):
                carry += tokens
        yield pd.DataFrame(found, columns=["username", "day", "mark", "carry"])
