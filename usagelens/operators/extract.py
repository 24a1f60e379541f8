"""Raw API traffic to usage rows: JSON bodies, event streams, request facts."""

from pyspark.sql import DataFrame, functions as F

from usagelens.functions.clock import local_day
from usagelens.functions.labels import caller_key, client_class
from usagelens.functions.pricing import PriceBook, attach_cost
from usagelens.functions.tokens import (
    LINE_BREAK, LONG_DOCUMENT, attach_document, attach_documents, attach_usage_counts, is_falsy, is_whole, member, members_type)
from usagelens.operators.ordered import last_before
from usagelens.runtime import materialize
from usagelens.schema import TOKEN_COLUMNS, USAGE
from usagelens.sources.ledger import conform

# Characters stripped around a stream payload besides the line breaks.
_BLANKS = " \t\x1f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

_BLANK = r" \t\x1f\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"  # the same in a pattern
_PLAIN_ENDS = r"(?s)\A[!-~](?:.*[!-~])?\z"

# Data lines that can hold a usage or an error: an object that names a usage,
# maybe with escapes, or anything that is no object, but not the end mark.
RELEVANT = (rf"(?s)^[{_BLANK}]*+data:[{_BLANK}]*+(?:(?!\[DONE\])[^{{{_BLANK}]"
            rf"|\{{.*?(?:usage|\\u))")

# Chunks that are joined in one group, and slices in one window.
CHUNKS_PER_SLICE = 2048
SLICES_PER_RUN = 1024
SHORT_CHUNK = 256  # bytes up to which a chunk is left to the squeezing of its slice
_TAIL = 2**31 - 1
_BEFORE_ALL = -(2**62)  # slice of a line that no earlier slice has opened
VOID_STREAM = (502, "no usage can be read from the event stream")


def extract_json_usage(raw: DataFrame) -> DataFrame:
    """Token counts of whole JSON bodies: (request_id, four counts, parse_error).

    A body that is not a JSON object, or has one bad count, gives all zeros and
    sets the flag.  A missing usage gives zeros without the flag.
    """
    parsed = attach_document(raw.select("request_id", "body"), "body")
    usage = parsed.select("request_id", "body", F.col("doc").isNull().alias("_broken"),
                          member(F.col("doc"), "$.usage").alias("usage"))
    # The document parsed as a whole, so its first mark tells an object from the rest.
    object_body = F.coalesce(F.ltrim("body", F.lit(" \t\r\n")).startswith("{"), F.lit(False))
    counted = attach_usage_counts(usage)
    return counted.select("request_id", *TOKEN_COLUMNS,
                          (F.col("_broken") | ~object_body | F.col("bad_usage")).alias("parse_error"))


def _is_relevant(line):
    """Whether a line matches RELEVANT; most others are told without the pattern."""
    return line.contains("data:") & line.rlike(RELEVANT)


def _payload(line):
    """Payload of a data line; if its ends are plain without spaces, there is nothing else to strip."""
    inner = F.trim(line)
    plain = F.trim(F.substring(inner, 6, _TAIL))
    return F.when(inner.startswith("data:") & plain.rlike(_PLAIN_ENDS), plain).otherwise(
        F.btrim(F.substring(F.btrim(line, F.lit(_BLANKS)), 6, _TAIL), F.lit(_BLANKS)))


def _attach_pieces(rows: DataFrame, line_break: str) -> DataFrame:
    """Cut ``text`` to ``pieces``: the first piece, the relevant whole lines and the last piece.

    There is only one piece if the text has no line break.
    """
    split = rows.withColumn("_all", F.split("text", line_break, -1)).drop("text")
    inner = F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0)))
    kept = F.filter(inner, _is_relevant)
    last = F.slice("_all", -1, F.when(F.size("_all") > 1, 1).otherwise(0))
    return split.withColumn("pieces", F.concat(F.slice("_all", 1, 1), kept, last)).drop("_all")


def squeezed_slices(chunks: DataFrame, chunks_per_slice: int = CHUNKS_PER_SLICE) -> DataFrame:
    """(request_id, slice, pieces): what matters of each run of ``chunks_per_slice`` chunks.

    Long chunks are squeezed before the shuffle, slices after it.  A group is one
    slice, so its size is bounded however long the request is.
    """
    seq, chunk = F.col("seq").cast("long"), F.coalesce("chunk", F.lit(""))
    rows = chunks.select(
        "request_id", seq.alias("seq"), F.floor(seq / F.lit(chunks_per_slice)).cast("long").alias("slice"),
        F.when(F.octet_length(chunk) <= SHORT_CHUNK, chunk).alias("short"),
        F.when(F.octet_length(chunk) > SHORT_CHUNK, chunk).alias("text"))
    squeezed = _attach_pieces(rows, LINE_BREAK).withColumn("text", F.coalesce("short", F.array_join("pieces", "\n")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    slices = squeezed.groupBy("request_id", "slice").agg(
        F.array_join(F.transform(ordered, lambda part: part["text"]), "").alias("text"))
    return _attach_pieces(slices, LINE_BREAK)


def _lines(slices: DataFrame) -> DataFrame:
    """Payloads of the lines of requests that fit in one slice: all its pieces are lines, the inner ones relevant.

    They are taken out inside the array, apart from the code that parses them: together it is too long to be compiled.
    """
    payloads = F.transform("pieces", lambda line, at: F.when(
        ((at > 0) & (at < F.size("pieces") - 1)) | _is_relevant(line), _payload(line)))
    return slices.select("request_id", "slice", F.posexplode(payloads).alias("idx", "payload"))


def _lines_over_slices(slices: DataFrame) -> DataFrame:
    """Payloads of the lines of longer requests: the outer pieces of the slices are stitched.

    A piece belongs to the line that opened in the nearest earlier slice with a
    line break.  One group is one line, which a JSON parser needs whole.
    """
    last = F.size("pieces") - 1
    inner = slices.select("request_id", "slice", last.alias("_last"), F.posexplode("pieces").alias("idx", "line"))
    inner = inner.where((F.col("idx") > 0) & (F.col("idx") < F.col("_last"))).drop("_last")
    breaks = F.size("pieces") > 1
    edges = slices.select("request_id", "slice", F.element_at("pieces", 1).alias("head"),
                          F.when(breaks, F.element_at("pieces", -1)).alias("tail"),
                          F.when(breaks, F.col("slice")).alias("opens"))
    edges = last_before(edges, ["request_id"], "slice", "opens", "opened", SLICES_PER_RUN)
    parts = edges.select("request_id", F.inline(F.array(
        F.struct(F.coalesce("opened", F.lit(_BEFORE_ALL).cast("long")).alias("line_slice"), F.col("slice").alias("at"),
                 F.col("head").alias("text")),
        F.struct(F.col("opens").alias("line_slice"), F.col("slice").alias("at"), F.col("tail").alias("text")),
    ))).where(F.col("line_slice").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    stitched = parts.groupBy("request_id", F.col("line_slice").alias("slice")).agg(
        F.array_join(F.transform(ordered, lambda part: part["text"]), "").alias("line"))
    line = F.col("line")
    return inner.unionByName(stitched.withColumn("idx", F.lit(_TAIL))).select(
        "request_id", "slice", "idx", F.when(_is_relevant(line), _payload(line)).alias("payload"))


def extract_sse_usage(chunks: DataFrame, chunks_per_slice: int = CHUNKS_PER_SLICE) -> DataFrame:
    """Last usage of each event stream: (request_id, four counts, parse_error).

    An event that is JSON but not an object, or a usage with a bad count, voids
    the whole stream; so does a long relevant event that cannot be parsed, unless
    a later one has a usage.  The text is read once; what matters of it is small
    and is staged in the shared folder.
    """
    slices = materialize(squeezed_slices(chunks, chunks_per_slice))
    # A request of several slices has one that is not slice 0; mostly the files' statistics tell that there is none.
    if slices.where(F.col("slice") != 0).isEmpty():
        result = _last_usage(_lines(slices), F.col("idx").cast("long"))
    else:
        long_requests = slices.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1").select("request_id")
        result = _last_usage(_lines(slices.join(long_requests, "request_id", "left_anti")), F.col("idx").cast("long"))
        over_slices = _lines_over_slices(slices.join(long_requests, "request_id", "left_semi"))
        result = result.unionByName(_last_usage(over_slices, F.struct("slice", "idx")))
    zero = F.lit(0).cast("long")
    return result.select("request_id", *[
        F.when(F.col("parse_error"), zero).otherwise(F.coalesce(F.col(name), zero)).alias(name)
        for name in TOKEN_COLUMNS
    ], "parse_error")


def _last_usage(lines: DataFrame, place) -> DataFrame:
    """Counts of the last usage of each request, and whether its stream is void; ``place`` orders its payloads.

    Those of one slice are ordered by a number, so that the sums are kept in place and no line is sorted.
    """
    payload = F.col("payload")
    # The first piece stays in any case: a request without usage has a row too.
    shown = lines.where(payload.isNotNull() | F.col("idx").isin(0, _TAIL)).select("request_id", place.alias("_place"), "payload")
    # Two levels at once, so that a whole response is not copied to take its usage out.
    kind = f"struct<usage:variant,response:{members_type('usage')}>"
    parsed = attach_documents(shown, "payload", "_events", kind=kind).withColumns({
        "_whole": is_whole("_events"), "_event": F.get("_events", F.lit(0))})
    own, whole = F.col("_event")["usage"], F.col("_whole")
    usages = parsed.select(
        "request_id", "_place",
        F.coalesce(whole & ~payload.startswith("{"), F.lit(False)).alias("_not_object"),
        F.coalesce(~whole & (F.length(payload) > LONG_DOCUMENT), F.lit(False)).alias("_unread"),
        F.when(whole, F.when(own.isNull() | F.is_variant_null(own), F.col("_event")["response"]["usage"]).otherwise(own))
        .alias("usage"))
    at = F.when(F.col("has_usage"), F.col("_place"))
    result = attach_usage_counts(usages).groupBy("request_id").agg(
        *[F.max_by(name, at).alias(name) for name in TOKEN_COLUMNS],
        F.max(F.col("_not_object") | F.col("bad_usage")).alias("parse_error"),
        F.max(at).alias("_last_at"), F.max(F.when(F.col("_unread"), F.col("_place"))).alias("_unread_at"))
    unread = F.col("_unread_at").isNotNull() & (F.col("_last_at").isNull() | (F.col("_unread_at") > F.col("_last_at")))
    return result.select("request_id", *TOKEN_COLUMNS, (F.col("parse_error") | F.coalesce(unread, F.lit(False))).alias("parse_error"))


def request_facts(requests: DataFrame) -> DataFrame:
    """Add model, stream flag, client class and caller key of each request.

    Needs ``payload``, ``user_agent``, ``x_api_key`` and ``authorization``.  A
    payload that is not a JSON object has an empty model and no stream.
    """
    parsed = attach_document(requests, "payload", "_doc", keys=("model",), kind=members_type("model", "stream"))
    found = F.col("_doc")["model"]
    text = F.to_json(found)
    model = (
        F.when(text.isNull(), "")
        .when(text == "null", "None").when(text == "true", "True").when(text == "false", "False")
        .otherwise(F.coalesce(F.try_variant_get(found, "$", "string"), text))
    )
    return parsed.withColumns({
        "model": model,
        "stream": (~is_falsy(F.to_json(F.col("_doc")["stream"]))).cast("int"),
        "client": client_class("user_agent"),
        "api_key": caller_key("x_api_key", "authorization"),
    }).drop("_doc")


def _success():
    return F.coalesce(F.col("status").between(200, 299), F.lit(False))


def _is_stream():
    return F.coalesce(F.col("stream") == 1, F.lit(False))


def assemble_usage(requests: DataFrame, counts: DataFrame, book: PriceBook, tz: str,
                   error_chars: int | None = None) -> DataFrame:
    """Ledger rows of finished requests.

    ``requests`` has request_id, username, api_key, model, stream, client,
    status, start_ms, ts_ms, path and error; ``counts`` comes from the extractors,
    which read the body of a request that asked for a stream as one and any other
    as JSON.  Only answers with a 2xx status count tokens.  A stream whose usage
    is void failed: it gets the status and error of VOID_STREAM.  The error text
    is kept whole unless ``error_chars`` says how much of it stays.
    """
    joined = requests.join(counts.select("request_id", *TOKEN_COLUMNS, "parse_error"), "request_id", "left")
    status, message = VOID_STREAM
    void = _success() & _is_stream() & F.coalesce("parse_error", F.lit(False))
    error = F.when(F.col("_void"), F.lit(message)).otherwise(F.col("error"))
    rows = joined.withColumn("_void", void).withColumns({
        name: F.when(_success(), F.coalesce(F.col(name), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
        for name in TOKEN_COLUMNS
    }).withColumns({
        "id": F.col("request_id"),
        "day": local_day("ts_ms", tz),
        "latency_ms": F.col("ts_ms") - F.col("start_ms"),
        "error": error if error_chars is None else F.substring(error, 1, error_chars),
        "status": F.when(F.col("_void"), status).otherwise(F.col("status")),
    })
    return conform(attach_cost(rows, book), USAGE)


def ledger_rows(responses: DataFrame, book: PriceBook, tz: str, error_chars: int | None = None) -> DataFrame:
    """Ledger rows of finished responses with their whole ``body``, JSON or event stream by request."""
    streamed = _success() & _is_stream()
    chunks = responses.where(streamed).select("request_id", F.lit(0).cast("long").alias("seq"), F.col("body").alias("chunk"))
    counts = extract_json_usage(responses.where(_success() & ~_is_stream())).unionByName(extract_sse_usage(chunks))
    return assemble_usage(responses, counts, book, tz, error_chars)
