"""Derives ledger, users, raw traffic and change logs from the given tables.

Every view covers the whole table it reads and is a projection of it, so the
same view works on a batch and on a stream.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.functions.clock import epoch_ms, local_day
from usagelens.functions.labels import client_class
from usagelens.functions.pricing import attach_cost, default_prices
from usagelens.schema import USAGE
from usagelens.sources.ledger import conform

TZ = "+08:00"
AS_OF = date(2024, 1, 31)
NOW_MS = 1_706_673_600_000
DENSE_BASE = 1_704_038_400_000
ROWS_PER_FILE = 100_000  # of the files that a stream is made of

MODELS = ("gpt-6-astra", "gpt-6.1-sol", "gpt-6-sol", "gpt-6-luna", "gpt-5.6-sol-2026-08-01", "gpt-5.6-terra",
          "gpt-5.5", "gpt-5.3-codex-spark", "gpt-4o-mini", "mystery-model", "", None)
AGENTS = ("codex-cli/0.131", "Codex Desktop", "openai-python/1.2", "openai-node/4", "curl/8", None)


# Given schemas spare a footer-reading job per query.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _pick(values, index):
    return F.get(F.array(*[F.lit(value).cast("string") for value in values]), index.cast("int"))


def ledger_of(events: DataFrame) -> DataFrame:
    """Usage rows of the event table; see FIXTURES for the rules."""
    event = F.col("event_id")
    value = F.expr("cast(round(value * 100) as bigint)")
    agent = F.col("_agent")
    failed = F.col("event_type") == "error"
    zero = F.lit(0).cast("long")

    def tokens(column):
        return F.when(failed, zero).otherwise(column)

    name = F.col("user_id") % 37
    rows = events.withColumns({"_v": value, "_agent": _pick(AGENTS, event % 6)}).select(
        event.alias("id"),
        epoch_ms("ts").alias("ts_ms"),
        F.when(name == 0, "legacy").when(name == 1, "auto-000001")
        .otherwise(F.concat(F.lit("u"), name.cast("string"))).alias("username"),
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"),
        _pick(MODELS, event % 12).alias("model"),
        (event % 2).cast("int").alias("stream"),
        F.when(failed, 502 + event % 2).otherwise(200).cast("int").alias("status"),
        tokens(F.when(event % 101 == 0, F.lit(None)).otherwise(F.col("_v"))).alias("input_tokens"),
        tokens(F.expr("_v * 3 div 7")).alias("output_tokens"),
        tokens(F.when(event % 10 == 0, F.expr("_v div 10")).otherwise(zero)).alias("cache_creation_tokens"),
        tokens(F.expr("_v * (event_id % 6) div 4")).alias("cache_read_tokens"),
        (50 + (event * 37) % 4000).alias("latency_ms"),
        F.lit("/v1/responses").alias("path"),
        F.when(event % 11 == 0, F.lit(None)).otherwise(client_class(agent)).alias("client"),
    ).withColumn("day", local_day("ts_ms", TZ))
    return conform(attach_cost(rows, default_prices()), USAGE)


def ledger(spark, sf_dir) -> DataFrame:
    return ledger_of(table(spark, sf_dir, "events"))


def users_of(events: DataFrame) -> DataFrame:
    """One user row per key; the keys of ids 140 to 149 stay unknown."""
    n = F.col("user_id")
    name = n % 37
    known = events.select("user_id").distinct().where(~n.between(140, 149))
    return known.select(
        F.concat(F.lit("k"), n.cast("string")).alias("api_key"),
        F.when(name == 0, "legacy").when(name == 1, "auto-000001")
        .otherwise(F.concat(F.lit("u"), name.cast("string"))).alias("username"),
        F.when(n % 7 == 3, 0).otherwise(1).alias("enabled"),
        F.lit(DENSE_BASE).alias("created_at"),
        F.when(n % 5 == 0, F.lit(1_705_334_400_000)).alias("expires_at"),
        F.when(n % 4 == 1, F.lit(60_000).cast("long")).alias("daily_token_limit"),
        F.when(n % 3 == 0, F.lit(8).cast("long")).alias("daily_request_limit"),
        F.when(n % 2 == 0, F.lit(2).cast("long")).alias("rpm_limit"),
        F.lit(None).cast("string").alias("note"))


def users(spark, sf_dir) -> DataFrame:
    return users_of(table(spark, sf_dir, "events"))


def requests_of(usage: DataFrame) -> DataFrame:
    """One finished request per usage row."""
    total = F.lit(0).cast("long")
    for name in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"):
        total = total + F.coalesce(F.col(name), F.lit(0).cast("long"))
    return usage.select(
        "id", "username", "api_key", (F.col("ts_ms") - F.col("latency_ms")).alias("start_ms"),
        F.col("ts_ms").alias("end_ms"), total.alias("total_tokens"))


def requests(spark, sf_dir) -> DataFrame:
    return requests_of(ledger(spark, sf_dir))


def dense_requests_of(events: DataFrame) -> DataFrame:
    """Requests of three users at a tenth of the spacing, per-minute limit 1, request limit 500."""
    usage = ledger_of(events)
    at = DENSE_BASE + F.call_function("div", F.col("ts_ms") - DENSE_BASE, F.lit(10).cast("long"))
    return requests_of(usage.withColumn("ts_ms", at)).withColumns({
        "username": F.concat(F.lit("q"), (F.substring("api_key", 2, 10).cast("long") % 3).cast("string")),
        "daily_request_limit": F.lit(500).cast("long"),
        "daily_token_limit": F.lit(None).cast("long"),
        "rpm_limit": F.lit(1).cast("long")})


def slow_requests_of(events: DataFrame) -> DataFrame:
    """Requests of 37 names with one set of limits each, some finishing on a later day."""
    n = F.substring("username", 2, 10).try_cast("long")
    group = F.coalesce(n, F.lit(0)) % 4
    rows = requests_of(ledger_of(events))
    stay = F.when(F.col("id") % 9 == 0, 20_000_000 + (F.col("id") % 5) * 9_000_000).otherwise(0)
    return rows.withColumns({
        "end_ms": F.col("end_ms") + stay,
        "daily_request_limit": F.when(group == 1, 7).cast("long"),
        "daily_token_limit": F.when(group >= 2, 200_000).cast("long"),
        "rpm_limit": F.when(group == 3, 1).cast("long")})


# --- raw traffic -----------------------------------------------------------

def _number(column):
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _usage_json():
    """Usage object of a row in one of the two API dialects."""
    responses = F.concat(
        F.lit('{"input_tokens":'), _number("input_tokens"),
        F.lit(',"input_tokens_details":{"cached_tokens":'), _number("cache_read_tokens"),
        F.lit('},"output_tokens":"'), _number("output_tokens"), F.lit('"}'))
    chat = F.concat(
        F.lit('{"prompt_tokens":'), _number("input_tokens"), F.lit(',"completion_tokens":'),
        _number("output_tokens"), F.lit('.75,"prompt_tokens_details":{"cached_tokens":'),
        _number("cache_read_tokens"), F.lit("}}"))
    return F.when(F.col("id") % 2 == 0, responses).otherwise(chat)


def raw_responses_of(usage: DataFrame) -> DataFrame:
    """JSON bodies: most carry the usage of their row, some are broken in one way."""
    body = F.concat(F.lit(' {"id":"r'), F.col("id").cast("string"), F.lit('","usage":'), _usage_json(), F.lit("}"))
    broken = (
        F.when(F.col("id") % 13 == 1, F.concat(body, F.lit(" tail")))
        .when(F.col("id") % 13 == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("id") % 13 == 3, F.lit('{"usage":{"input_tokens":"abc","output_tokens":9}}'))
        .when(F.col("id") % 13 == 4, F.lit('{"usage":null}'))
        .when(F.col("id") % 13 == 5, F.lit('{"usage":{"input_tokens":null,"prompt_tokens":5,"cached_tokens":3}}'))
        .otherwise(body))
    return usage.select(F.col("id").alias("request_id"), broken.alias("body"))


def _stream_text():
    """Whole event stream of a row; every thirteenth has an event that is no object."""
    request = F.col("id").cast("string")
    done = F.when(F.col("id") % 2 == 0, F.concat(
        F.lit('{"type":"response.completed","response":{"id":"r'), request, F.lit('","usage":'), _usage_json(), F.lit("}}"))
    ).otherwise(F.concat(F.lit('{"id":"c'), request, F.lit('","usage":'), _usage_json(), F.lit("}")))
    return F.concat(
        F.lit('event: response.created\ndata: {"type":"response.created","usage":{"input_tokens":1}}\n\n'),
        F.lit("data: not json\r\n  data:"), done, F.lit('\n\ndata: {"usage":{}}\n'),
        F.when(F.col("id") % 13 == 1, "data: 12\n").otherwise(""), F.lit("data: [DONE]\n\n"))


def raw_chunks_of(usage: DataFrame) -> DataFrame:
    """Event streams cut into three chunks at places that ignore lines."""
    first = 10 + F.col("id") % 90
    second = first + 30 + F.col("id") % 50
    rows = usage.withColumn("_text", _stream_text()).withColumns({"_first": first.cast("int"), "_second": second.cast("int")})
    pieces = F.array(
        F.expr("substring(_text, 1, _first)"), F.expr("substring(_text, _first + 1, _second - _first)"),
        F.expr("substring(_text, _second + 1)"))
    return rows.select(F.col("id").alias("request_id"), F.posexplode(pieces).alias("seq", "chunk"))


def long_chunks_of(documents: DataFrame) -> DataFrame:
    """Event streams whose last event repeats a whole document, one chunk for every eight characters, from -5 on."""
    answer = F.concat(
        F.lit('data: {"type":"response.delta"}\n\ndata: {"response":{"output":'), F.to_json(F.struct("text")),
        F.lit(',"usage":{"input_tokens":'), F.length("text").cast("string"), F.lit(',"output_tokens":'),
        (F.col("doc_id") % 97).cast("string"), F.lit("}}}\n\ndata: [DONE]\n\n"))
    # One pass cuts a document: substrings by place would each start from its beginning.
    pieces = F.regexp_extract_all(answer, F.lit("(?s).{1,8}"), F.lit(0))
    rows = documents.where("text IS NOT NULL").select(
        F.col("doc_id").alias("request_id"), F.posexplode(pieces).alias("_at", "chunk"))
    return rows.select("request_id", (F.col("_at").cast("long") - 5).alias("seq"), "chunk")


def finished_responses_of(usage: DataFrame) -> DataFrame:
    """Finished responses with their whole bodies: event streams where one was asked for, else JSON."""
    body = F.concat(F.lit('{"usage":'), _usage_json(), F.lit("}"))
    return usage.withColumns({
        "request_id": F.col("id"), "body": F.when(F.col("stream") == 1, _stream_text()).otherwise(body),
        "start_ms": F.col("ts_ms") - F.col("latency_ms"), "error": F.lit(None).cast("string")}).select(
        "request_id", "ts_ms", "start_ms", "username", "api_key", "model", "stream", "client", "status", "path", "error",
        "body")


def files_of_batch(rows: DataFrame, batches: int) -> int:
    """Files for each of several batches, so that no task writes or reads many more than ROWS_PER_FILE rows at once."""
    return max(1, -(-rows.count() // (batches * ROWS_PER_FILE)))


def add_files(rows: DataFrame, path: str, files: int, key: str = "request_id") -> None:
    rows.repartition(files, key).write.mode("append").parquet(path)


def stream_of_files(rows: DataFrame, path: str, files: int) -> DataFrame:
    """The files at ``path`` as a stream of rows like ``rows``, that many files a batch, oldest first."""
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_of_parts(rows: DataFrame, path: str, parts: int = 3) -> DataFrame:
    """The rows as a stream of several batches that ignore time; each batch repeats some rows of the one before."""
    number = F.pmod(F.hash("ts_ms"), F.lit(parts))
    again = rows.where(F.pmod(F.xxhash64("ts_ms"), F.lit(5)) == 0).withColumn("part", F.least(number + 1, F.lit(parts - 1)))
    both = rows.withColumn("part", number).unionByName(again)
    files = files_of_batch(rows, parts)
    for part in range(parts):
        add_files(both.where(F.col("part") == part).drop("part"), path, files)
    return stream_of_files(rows, path, files)


def moved_deliveries(rows: DataFrame, path: str) -> DataFrame:
    """The rows as a stream of several batches, then some of them again, dated one to three days later."""
    files = files_of_batch(rows, 2)
    add_files(rows, path, 2 * files)
    later = F.col("ts_ms") + 86_400_000 * (1 + F.pmod(F.hash("ts_ms"), F.lit(3)))
    again = rows.where(F.pmod(F.xxhash64("ts_ms"), F.lit(4)) == 0).withColumn("ts_ms", later)
    add_files(again, path, 2 * files)
    return stream_of_files(rows, path, files)


def request_log_of(usage: DataFrame) -> DataFrame:
    """Request headers and payloads for the facts job."""
    n = F.col("id")
    model = F.coalesce(F.concat(F.lit('"'), F.col("model"), F.lit('"')), F.lit("null"))
    payload = F.concat(F.lit('{"stream":'), F.when(n % 2 == 1, "true").otherwise("false"),
                       F.lit(',"model":'), model, F.lit(',"input":[]}'))
    return usage.select(
        n.alias("request_id"),
        F.when(n % 12 == 11, '{"stream":1}').when(n % 14 == 5, "[]").otherwise(payload).alias("payload"),
        _pick(AGENTS, n % 6).alias("user_agent"),
        F.when(n % 3 == 0, F.col("api_key")).otherwise("").alias("x_api_key"),
        F.when(n % 3 == 1, F.concat(F.lit("Bearer  "), F.col("api_key"), F.lit(" ")))
        .when(n % 3 == 0, "Bearer other").alias("authorization"))


def judged_requests_of(usage: DataFrame) -> DataFrame:
    """Requests with every reason for an early answer."""
    n = F.col("id")
    return requests_of(usage).withColumns({
        "method": F.when(n % 29 == 0, "GET").otherwise("POST"),
        "path": F.when(n % 23 == 0, "/v1/other").otherwise("/v1/responses"),
        "content_length": F.when(n % 31 == 0, 30_000_000).when(n % 53 == 0, 0).otherwise(100).cast("long"),
        "payload": F.when(n % 37 == 0, "[1]").when(n % 59 == 0, "{").when(n % 5 == 0, '{"stream":false}')
        .otherwise('{"stream":true}'),
        "has_credentials": n % 41 != 0,
        "upstream_status": F.when(n % 43 != 0, F.when(n % 7 == 0, 404).otherwise(200)).cast("int"),
        "client_gone": n % 47 == 0})


def items_of(conversations: DataFrame) -> DataFrame:
    """Items of each conversation; every fourth turn has an encrypted twin, others are encrypted alone."""
    turn = F.col("turn")
    item_id = F.concat(F.lit("item_"), F.expr("repeat(md5(text), cast(1 + turn % 3 as int))"))
    own = F.struct(turn.alias("pos"), (turn % 4 == 1).alias("encrypted"))
    twin = F.when(turn % 4 == 0, F.struct((turn + 1000).alias("pos"), F.lit(True).alias("encrypted")))
    rows = conversations.select(F.col("conv_id").alias("request_id"), item_id.alias("item_id"),
                                F.inline(F.array_compact(F.array(own, twin))))
    return rows.select("request_id", "pos", "item_id", "encrypted")


def item_payloads_of(conversations: DataFrame) -> DataFrame:
    """One request payload per turn, with items of every shape."""
    digest = F.md5("text")
    payload = F.concat(
        F.lit('{"input":[{"id":"item_'), digest, F.lit('","content":'), F.to_json(F.struct("text")),
        F.lit('},{"id":5},"plain",{"id":"enc_'), digest, F.lit('","encrypted_content":null}]}'))
    request = F.col("conv_id") * 1000 + F.col("turn")
    return conversations.select(request.alias("request_id"),
                                F.when(F.col("turn") % 5 == 4, '{"input":"text"}').otherwise(payload).alias("payload"))


def long_payloads_of(conversations: DataFrame) -> DataFrame:
    """One request per turn with ids and a model of 1,280 characters; every twentieth conversation's are padded past a million."""
    name = F.repeat(F.md5("text"), F.lit(40))
    times = F.when(F.col("conv_id") % 20 == 0, F.expr("1000000 div greatest(length(text), 1) + 1")).otherwise(1)
    escaped = F.expr("""substring(to_json(struct(text)), 10, length(to_json(struct(text))) - 11)""")  # of {"text":"..."}
    payload = F.concat(
        F.lit('{"pad":{"p":"'), F.repeat(escaped, times.cast("int")), F.lit('"},"input":[{"id":"'), name,
        F.lit('a"},{"content":"\\"id\\":","id":"'), name, F.lit('b"},{"id":"'), name,
        F.lit('b","encrypted_content":""}],"model":"'), name, F.lit('","stream":true}'))
    nothing = F.lit("")
    return conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), payload.alias("payload"),
        F.lit("curl/8").alias("user_agent"), nothing.alias("x_api_key"), nothing.alias("authorization"))


def quota_snapshots_of(events: DataFrame) -> DataFrame:
    """Account-quota payloads: a main limit with two windows and one named limit."""
    n = F.col("event_id")
    used = (n % 130).cast("string")
    seconds = _pick(("18000", "604800", "172800", "10800", "60", "null"), n % 6)
    camel = n % 2 == 1
    main = F.when(camel, "rateLimits").otherwise("rate_limit")
    more = F.when(camel, "additionalRateLimits").otherwise("additional_rate_limits")
    payload = F.concat(
        F.lit('{"account_id":"secret","'), main, F.lit('":{"primary_window":{"used_percent":'), used,
        F.lit(',"limit_window_seconds":'), seconds, F.lit(',"reset_after_seconds":'), (n % 1000).cast("string"),
        F.lit('},"secondary_window":{"used_percent":"'), F.when(n % 10 == 0, "many").otherwise(used),
        F.lit('","limit_window_seconds":"604800","reset_at":'), (1_704_067_200 + n * 60).cast("string"),
        F.lit('}},"'), more, F.lit('":[{"limit_name":"Spark","rate_limit":{"primary_window":{"used_percent":25,'
                                   '"limit_window_seconds":18000,"reset_at":"2024-01-05T10:00:00Z"}}},{"limit_name":7}]}'))
    return events.select(n.alias("snapshot_id"), epoch_ms("ts").alias("fetched_at"), payload.alias("payload"))


def catalog_snapshots_of(events: DataFrame) -> DataFrame:
    """Model catalogs whose items repeat ids, so that the fall-through to the next key shows."""
    n = F.col("event_id")
    key = F.when(n % 2 == 0, "models").otherwise("data")
    payload = F.concat(
        F.lit('{"'), key, F.lit('":["m-'), (n % 5).cast("string"), F.lit('",{"id":"m-'), (n % 3).cast("string"),
        F.lit('","slug":"s-'), (n % 7).cast("string"), F.lit('"},{"id":"bad id","model":"x-'), (n % 2).cast("string"),
        F.lit('"},7,{"id":"m-'), (n % 5).cast("string"), F.lit('"}]}'))
    return events.select(n.alias("snapshot_id"), F.when(n % 11 == 0, "[]").otherwise(payload).alias("payload"))


def changes_of(events: DataFrame) -> DataFrame:
    """Change log over the keys of the event table, one change per event."""
    n = F.col("event_id")
    op = (
        F.when(n % 40 == 0, "delete").when(n % 20 < 3, "add").when(n % 20 < 5, "enable")
        .when(n % 20 < 7, "disable").otherwise("update"))
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"))
    name = F.when(n % 4 == 1, F.concat(F.lit("auto-"), key)).otherwise(
        F.concat(F.lit("u"), (F.col("user_id") % 37).cast("string")))
    keyed = (op == "add") | (n % 3 == 0)
    amount = F.expr("cast(round(value * 100) as bigint)").cast("string")
    nothing = F.lit(None).cast("string")
    fields = (
        F.when(op == "add", F.create_map(F.lit("created_at"), n.cast("string"), F.lit("note"), F.col("event_type")))
        .when(n % 5 == 0, F.create_map(F.lit("daily_token_limit"), amount, F.lit("rpm_limit"), nothing))
        .when(n % 5 == 1, F.create_map(F.lit("daily_token_limit"), nothing))
        .when(n % 5 == 2, F.create_map(F.lit("daily_request_limit"), amount, F.lit("note"), F.col("props")))
        .when(n % 5 == 3, F.create_map(F.lit("rpm_limit"), amount))
        .otherwise(F.create_map(F.lit("expires_at"), amount)))
    return events.select(n.alias("seq"), op.alias("op"), F.when(keyed, key).alias("api_key"),
                         F.when((op == "add") | ~keyed, name).alias("username"), fields.alias("fields"))
