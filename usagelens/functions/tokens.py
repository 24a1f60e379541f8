"""Token counts out of JSON usage objects, kept as VARIANT.

The rules tell an absent key from a JSON null, so counts are read by key
presence; detail objects and cached counts fall back when the first one is
null, zero or empty.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Line breaks of a text stream: CR, LF, VT, FF, FS, GS, RS, NEL, LS and PS.
LINE_BREAK = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029]"

# Past a million characters, text values that nobody asks for are cut to a thousand before parsing.
KEPT_TEXT = 1000
LONG_DOCUMENT = 1_000_000
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_GAP = r"[ \t\r\n]*+"
_JSON_START = rf'\A{_GAP}(?:[{{\["0-9-]|true|false|null)'
_CUT = r'("(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\.){0,%d}+)[^"\\]*+(?:\\.[^"\\]*+)*+(")' % KEPT_TEXT

# Keys whose text may be a count.
COUNT_KEYS = ("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens", "cached_tokens")

_FALSY = r'^(null|false|""|\[\]|\{\}|-?0(\.0+)?([eE][+-]?[0-9]+)?)$'
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_TEXT_INTEGER = r'^"\s*[+-]?[0-9]+(_[0-9]+)*\s*"$'


def _wanted(keys) -> str:
    """Pattern of a wanted key, or of one that is written with escapes, and its colon."""
    return rf'(?:"(?:{"|".join(keys)})"|"[^"\\]*+(?:\\.[^"\\]*+)++"){_GAP}:{_GAP}'


def shortened(text: Column, keys) -> Column:
    """JSON with its long text values cut, except those of ``keys``: the parser refuses values of some 20 million characters.

    NULL unless the document is long. Every text is matched whole, from quote to quote, so the search never loses its
    place. The value of a wanted key is kept at any depth, as is that of a key that is written with escapes.
    """
    plain = F.regexp_replace(text, rf"(?s)({_wanted(keys)}{_TEXT})|{_CUT}", "$1$2$3")
    return F.when(F.length(text) > LONG_DOCUMENT, plain)


def holds_nested(text: Column, keys) -> Column:
    """Whether a wanted key, or one with escapes, holds an object or a list."""
    wanted = _wanted(keys)
    # Texts are stepped over one by one up to a wanted key, which must be a key and not a part of some text.
    return text.rlike(rf'(?s)\A(?:[^"]++|(?!{wanted}[\[{{]){_TEXT})*+{wanted}[\[{{]')


def attach_documents(rows: DataFrame, text: str, target: str, keys=COUNT_KEYS, kind: str = "variant") -> DataFrame:
    """Add ``target``: the documents of a JSON text as an array of ``kind``; one that is JSON as a whole has just one.

    The parser stops after the first document.  Parsing the text as the only
    element of an array also rejects whatever follows it.  The array is a column
    of its own, so the text is parsed once per row.  Of equal keys the last one
    counts; in documents of over a million characters long text values are cut,
    other than those of ``keys``.  One in which such a key holds an object or a
    list is left as it is; the cut document tells that as well as the whole one,
    in a fraction of the time, and is a column of its own too.

    ``kind`` is VARIANT or a struct of wanted members: a cast takes members out in
    one pass, NULL if absent, while each path that leads nowhere costs an exception.
    So does a text that is no JSON: one that does not even begin like it is not parsed.
    """
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    cut = F.col("_cut")
    document = F.when(cut.isNull() | holds_nested(cut, keys), F.col(text)).otherwise(cut)
    started = F.col(text).startswith("{") | F.col(text).rlike(_JSON_START)
    wrapped = F.when(started, F.try_parse_json(F.concat(F.lit("["), document, F.lit("]"))))
    return rows.withColumn("_cut", shortened(F.col(text), keys)).withColumn("_wrapped", wrapped).withColumn(
        target, F.try_variant_get("_wrapped", "$", f"array<{kind}>")).drop("_cut", "_wrapped")


def is_whole(documents: str) -> Column:
    """Whether a text was one JSON document, told from its array of documents."""
    return F.coalesce(F.size(documents) == 1, F.lit(False))


def attach_document(rows: DataFrame, text: str, target: str = "doc", keys=COUNT_KEYS, kind: str = "variant") -> DataFrame:
    """Add ``target``: one whole JSON document as ``kind``, NULL if the text is anything else."""
    return attach_documents(rows, text, "_documents", keys, kind).withColumn(
        target, F.when(is_whole("_documents"), F.get("_documents", F.lit(0)))).drop("_documents")


def members(value: Column, *names: str) -> Column:
    """Struct of members of a VARIANT object, each NULL if absent; NULL for anything else."""
    return F.try_variant_get(value, "$", members_type(*names))


def members_type(*names: str) -> str:
    return f"struct<{','.join(f'{name}:variant' for name in names)}>"


def member(value: Column, path: str) -> Column:
    """Member of a VARIANT; NULL if absent, a VARIANT null if the JSON has null."""
    return F.try_variant_get(value, path, "variant")


def json_text(value: Column, path: str) -> Column:
    """JSON text of a member: NULL if absent, the text ``null`` for a JSON null."""
    return F.to_json(member(value, path))


def is_falsy(text: Column) -> Column:
    """Absent, null, false, zero or empty, told from the JSON text."""
    return F.coalesce(text.rlike(_FALSY), F.lit(True))


def is_object(text: Column) -> Column:
    return F.coalesce(text.startswith("{"), F.lit(False))


def token_count(text: Column) -> Column:
    """Count of one JSON text: zero when falsy, cut towards zero, NULL when not a count."""
    return (
        F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long"))
        .when(is_falsy(text), F.lit(0).cast("long"))
        .when(text == "true", F.lit(1).cast("long"))
        .when(text.rlike(_NUMBER), text.try_cast("double").try_cast("long"))
        .when(text.rlike(_TEXT_INTEGER), F.regexp_replace(text, r'["_\s]', "").try_cast("long"))
    )


def _text_or_mark(value: Column, *parts: Column) -> Column:
    """JSON text of a VARIANT, or the mark of an object that is not empty if one of its ``parts`` is there."""
    return F.when(F.coalesce(*parts).isNotNull(), "{").otherwise(F.to_json(value))


def attach_usage_counts(rows: DataFrame, usage: str = "usage") -> DataFrame:
    """Add the four counts and ``bad_usage`` for a usage VARIANT of either API dialect.

    One unusable part makes the whole usage unusable: all counts are zero then.
    A falsy usage is not an error, it counts nothing; ``has_usage`` tells it.
    The JSON texts are columns of their own so that each is taken out once per
    row; that of an object is only made if no member shows what it is.
    """
    parts = F.col("_parts")
    texts = rows.withColumn("_parts", members(
        F.col(usage), "input_tokens", "prompt_tokens", "output_tokens", "completion_tokens",
        "input_tokens_details", "prompt_tokens_details", "cached_tokens")).withColumns({
        "_usage": _text_or_mark(F.col(usage), parts["input_tokens"], parts["prompt_tokens"]),
        # A present key wins even if it is null, so only an absent one falls back.
        "_in": F.to_json(F.coalesce(parts["input_tokens"], parts["prompt_tokens"])),
        "_out": F.to_json(F.coalesce(parts["output_tokens"], parts["completion_tokens"])),
        "_cached_first": members(parts["input_tokens_details"], "cached_tokens")["cached_tokens"],
        "_cached_second": members(parts["prompt_tokens_details"], "cached_tokens")["cached_tokens"],
    })
    texts = texts.withColumn("_first", _text_or_mark(parts["input_tokens_details"], F.col("_cached_first")))
    use_first = ~is_falsy(F.col("_first"))
    chosen = texts.withColumns({
        "_details": F.when(use_first, F.col("_first")).otherwise(
            _text_or_mark(parts["prompt_tokens_details"], F.col("_cached_second"))),
        "_inner": F.to_json(F.when(use_first, F.col("_cached_first")).otherwise(F.col("_cached_second"))),
    })
    inner = F.col("_inner")
    chosen = chosen.withColumn("_cached", F.when(~is_falsy(inner), inner).otherwise(F.to_json(parts["cached_tokens"])))
    counted = chosen.withColumns({
        "_n_in": token_count(F.col("_in")),
        "_n_out": token_count(F.col("_out")),
        "_n_cached": token_count(F.col("_cached")),
    })
    details = F.col("_details")
    bad = F.col("has_usage") & (
        ~is_object(F.col("_usage"))
        | (~is_falsy(details) & ~is_object(details))
        | F.col("_n_in").isNull() | F.col("_n_out").isNull() | F.col("_n_cached").isNull()
    )
    flagged = counted.withColumn("has_usage", ~is_falsy(F.col("_usage"))).withColumn("bad_usage", bad).withColumn(
        "_void", F.col("bad_usage") | ~F.col("has_usage"))

    def clean(name):
        return F.when(F.col("_void"), F.lit(0).cast("long")).otherwise(F.col(name))

    return flagged.withColumns({
        "input_tokens": clean("_n_in"),
        "output_tokens": clean("_n_out"),
        "cache_creation_tokens": F.lit(0).cast("long"),
        "cache_read_tokens": clean("_n_cached"),
    }).drop("_usage", "_parts", "_in", "_out", "_first", "_cached_first", "_cached_second", "_details", "_inner", "_cached", "_void",
            "_n_in", "_n_out", "_n_cached")
