"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Column expressions only. Every search runs in time linear in the text: repetitions are possessive, and a
match can begin only where a longer one could not have begun before it.
"""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.common import carried, free_name
from usagelens.llm.matches import collect_matches

BLOCK = 1000  # code points
PIECES = 100  # spans masked together

_LOCAL = "A-Za-z0-9._%+-"
# A local part is tried at its first character, or where the match before it ended.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A whole run of digits with at most one blank or hyphen between two of them, of 16 to 19 or 13 to 15 digits.
_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){%s}+(?![\x20-]?[0-9])"
CARD = _RUN % "15,18"
SHORT_CARD = _RUN % "12,14"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# A part up to 255 with any zeros in front; one of zeros only ends behind them.
SMALL_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|(?<=0))"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id_number", "short_card")
# Words in front of a span that raise its score. Fixed values.
CONTEXT_WORDS = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|credit|visa|amex|mastercard|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "id_number": "ssn|social|security|identity|id",
    "short_card": "card|credit|visa|amex|mastercard|payment",
}
# Score of a proposed span: its pattern alone, with its checksum, and what a context word adds. Fixed values.
PATTERN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3, "id_number": 0.3,
                 "short_card": 0.3}
CHECKED_SCORE = {"card": 0.8, "iban": 0.8}
CONTEXT_SCORE = 0.3
THRESHOLD = 0.5  # 0.3 + 0.3 passes
SPAN = "struct<start:int,end:int,kind:string,score:double>"
OUTPUTS = ("pii_spans",)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn checksum."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def step(total, place):
        digit = F.substring(F.reverse(digits), place + 1, F.lit(1)).cast("int")
        doubled = F.when(place % 2 == 1, digit * 2).otherwise(digit)
        return total + F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), step) % 10 == 0)


def mod97(account: Column) -> Column:
    """True if an account number with its country and check digits first leaves 1 modulo 97."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest, char):
        code = F.ascii(char)
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(
        step(rest, char))) == 1


def _ip_ok(value: Column) -> Column:
    return value.rlike(rf"^{SMALL_PART}(?:\.{SMALL_PART}){{3}}$")


def _score(kind: str, value: Column, before: Column) -> Column:
    """0 for what the kind's checks refuse."""
    near = F.lower(before).rlike(rf"\b(?:{CONTEXT_WORDS[kind]})\b")
    bonus = F.when(near, CONTEXT_SCORE).otherwise(0.0)
    digits = _digits(value)
    if kind == "ip":
        return F.when(_ip_ok(value), PATTERN_SCORE[kind] + bonus).otherwise(0.0)
    if kind == "phone":
        return F.when(F.length(digits).between(8, 15), PATTERN_SCORE[kind] + bonus).otherwise(0.0)
    if kind in ("card", "short_card"):
        # A right checksum is enough for long numbers; shorter ones need a context word too.
        known = CHECKED_SCORE.get(kind, PATTERN_SCORE[kind])
        return F.when(luhn(digits), known + bonus).otherwise(0.0)
    if kind == "iban":
        account = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34) & mod97(account), CHECKED_SCORE[kind] + bonus).otherwise(0.0)
    return PATTERN_SCORE[kind] + bonus


def _spans(text: Column, kind: str, pattern: str, probe: Column) -> Column:
    """Confirmed spans of one kind in order."""
    def make(value, before, start, end):
        score = F.round(_score(kind, value, before), 3)
        return score >= THRESHOLD, [F.lit(kind).alias("kind"), score.alias("score")]

    return collect_matches(text, pattern, probe, SPAN, make)


def pii_spans(text: Column) -> Column:
    """Array of (start, end, kind, score): kinds in the order of KINDS, each from left to right.

    Places are code points, the end is exclusive. E-mail addresses, addresses of four parts up to 255, cards of 16 to
    19 digits with a right Luhn sum and telephone numbers of 8 to 15 digits always count. Cards of 13 to 15 digits
    with a right sum and identity numbers count only after a context word; accounts need a right mod-97 sum. Spans of
    different kinds may overlap. Null and empty texts have none.
    """
    text = F.coalesce(text, F.lit(""))
    return F.concat(
        _spans(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        _spans(text, "ip", IP, text.rlike(IP)),
        _spans(text, "card", CARD, text.rlike(CARD)),
        _spans(text, "phone", PHONE, F.contains(text, F.lit("+"))),
        _spans(text, "iban", IBAN, text.rlike(IBAN)),
        _spans(text, "id_number", ID_NUMBER, text.rlike(ID_NUMBER)),
        _spans(text, "short_card", SHORT_CARD, text.rlike(SHORT_CARD)))


def find_pii(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """``docs`` with pii_spans; an input column of that name gives way. Rows are independent of one another."""
    rest = carried(docs, OUTPUTS, keep)
    return docs.select(*[F.col(f"`{c}`") for c in rest.columns], pii_spans(F.col(f"`{text_col}`")).alias("pii_spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind, as in <EMAIL>; of overlapping spans the first one stays.

    Finding a place in a text means reading up to it, so the text is cut into blocks first, and growing a text copies it,
    so spans are taken in short parts: work grows with the text and its spans, not with their product.
    """
    by_place = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(
        b["end"] - a["end"]))

    def end_of(some):
        return F.coalesce(F.array_max(F.transform(some, lambda span: span["end"])), F.lit(0))

    def whole(given):
        blocks, ordered = given["blocks"], given["ordered"]

        def piece(first, behind):
            block = F.floor(first / F.lit(BLOCK)).cast("int")
            many = F.floor((behind + (BLOCK - 1)) / F.lit(BLOCK)).cast("int") - block
            return F.when(behind > first, F.substring(
                F.array_join(F.slice(blocks, block + 1, many), ""), first - block * BLOCK + 1, behind - first)).otherwise("")

        def step(state, span):
            fresh = span["start"] >= state["at"]
            label = F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))
            return F.struct(
                F.greatest(state["at"], span["end"]).alias("at"),
                F.when(fresh, F.concat(state["out"], piece(state["at"], span["start"]), label)).otherwise(state["out"]).alias("out"))

        def part(first):
            begin = F.struct(end_of(F.slice(ordered, F.lit(1), first)).alias("at"), F.lit("").alias("out"))
            return F.aggregate(F.slice(ordered, first + 1, F.lit(PIECES)), begin, step, lambda state: state["out"])

        parts = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1, F.lit(PIECES)), part)
        return F.concat(F.array_join(parts, ""), piece(end_of(ordered), given["length"]))

    # Through a lambda's argument, so that blocks and order are made once.
    given = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
                     by_place.alias("ordered"), F.length(text).alias("length"))
    return F.when(F.size(spans) == 0, text).otherwise(F.get(F.transform(F.array(given), whole), F.lit(0)))


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs``, all columns as they are, with the spans of its texts masked; ``length_col`` then gets the new number of
    characters.

    Null texts stay null, texts without spans stay as they are.
    """
    text, spans = F.col(f"`{text_col}`"), free_name(docs, "pii_spans")
    marked = docs.withColumn(spans, pii_spans(text))
    clean = marked.withColumn(text_col, masked(text, F.col(spans)))
    if length_col:
        clean = clean.withColumn(length_col, F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(
            F.col(f"`{length_col}`")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
