"""Lives of keys that were added more than once, used inside tasks on sorted rows."""


def lives(batches):
    """Adds that brought their key to life; rows sorted by (api_key, seq).

    ``ends`` is the next deletion that hits the add, missing if there is none.
    An add while the key is alive has no effect.
    """
    import pandas as pd

    key = end = last = None
    for batch in batches:
        out = []
        columns = [batch[name].tolist() for name in ("api_key", "username", "seq", "ends")]
        for api_key, username, seq, ends in zip(*columns):
            if last is not None and (api_key, seq) < last:
                raise ValueError(f"rows are out of order at {(api_key, seq)}")
            last = (api_key, seq)
            if api_key == key and seq <= end:
                continue
            open_ended = ends is None or ends != ends
            key, end = api_key, float("inf") if open_ended else ends
            out.append((api_key, username, seq, None if open_ended else int(ends)))
        frame = pd.DataFrame(out, columns=["api_key", "username", "seq", "ends"])
        yield frame.astype({"ends": "Int64"})
