"""Places of all matches of a pattern in a text, as a column expression."""

from pyspark.sql import Column, functions as F

PIECES = 100  # matches taken together when places are summed up
CONTEXT = 40  # characters in front of a match that its element may look at


def collect_matches(text: Column, pattern: str, probe: Column, element: str, make) -> Column:
    """Array of elements of the matches in order, left to right without overlap.

    ``make(value, before, start, end)`` gives (condition, struct without places): the elements of matches that fail the
    condition are left out. ``element`` is the SQL type of the struct; its first fields are start and end in code
    points. ``before`` is the end of the text in front of the match, whatever other matches lie in it. Texts that fail
    ``probe`` are not searched.
    """
    # Both calls find the same matches; gap k is in front of match k, the last gap stands without one.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(found.alias("match"), gaps.alias("gap"))
    nothing = F.array().cast(f"array<{element}>")
    begin = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def tail(*parts):
        return F.right(F.concat(*parts), F.lit(CONTEXT))

    def step(state, piece):
        start = (state["at"] + F.length(piece["gap"])).cast("int")
        end = (start + F.length(piece["match"])).cast("int")
        before = tail(state["tail"], F.right(piece["gap"], F.lit(CONTEXT)))
        ok, rest = make(piece["match"], before, start, end)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), *rest)).cast(f"array<{element}>")
        return F.struct(
            F.coalesce(end, start).alias("at"),
            tail(before, F.coalesce(piece["match"], F.lit(""))).alias("tail"),
            F.when(piece["match"].isNotNull() & ok, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    def join(state, part):
        moved = F.transform(part["found"], lambda one: one.withField("start", one["start"] + state["at"]).withField(
            "end", one["end"] + state["at"]))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["found"], moved).alias("found"))

    def whole(given):
        # Growing an array copies it, so places are taken within short parts first and then moved to the whole text. No
        # match is empty, so the text in front of a part that matters lies in the CONTEXT pieces before it.
        def part(first):
            earlier = F.slice(given, F.greatest(first + 1 - CONTEXT, F.lit(1)), F.least(first, F.lit(CONTEXT)))
            front = F.aggregate(earlier, F.lit(""), lambda text, piece: tail(
                text, F.right(piece["gap"], F.lit(CONTEXT)), piece["match"]))
            opened = F.struct(F.lit(0).alias("at"), front.alias("tail"), nothing.alias("found"))
            return F.aggregate(F.slice(given, first + 1, F.lit(PIECES)), opened, step)

        parts = F.transform(F.sequence(F.lit(0), F.size(given) - 1, F.lit(PIECES)), part)
        return F.aggregate(parts, begin, join, lambda state: state["found"])

    # Through a lambda's argument, so that the searches run once.
    return F.when(probe, F.get(F.transform(F.array(pieces), whole), F.lit(0))).otherwise(nothing)
