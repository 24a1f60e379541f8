"""First claims in lists of names, as task code."""

import pandas as pd


def first_claims(catalogs: pd.Series) -> pd.Series:
    """First name of each item that no earlier item has taken; one pass with the names taken so far in a hash table."""
    def claimed(items):
        taken: dict[str, None] = {}
        for names in items:
            for name in names:
                if name not in taken:
                    taken[name] = None
                    break
        return list(taken)

    return catalogs.map(claimed, na_action="ignore")
