"""Schemas of the tables the library reads and writes."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()

USAGE = _schema(
    ("id", LONG, False),
    ("ts_ms", LONG, False),
    ("day", TEXT, False),
    ("username", TEXT, False),
    ("api_key", TEXT, False),
    ("model", TEXT, True),
    ("stream", INT, True),
    ("status", INT, True),
    ("input_tokens", LONG, True),
    ("output_tokens", LONG, True),
    ("cache_creation_tokens", LONG, True),
    ("cache_read_tokens", LONG, True),
    ("cost_micros", LONG, True),
    ("latency_ms", LONG, True),
    ("path", TEXT, True),
    ("error", TEXT, True),
    ("client", TEXT, True),
)

USERS = _schema(
    ("api_key", TEXT, False),
    ("username", TEXT, False),
    ("enabled", INT, False),
    ("created_at", LONG, False),
    ("expires_at", LONG, True),
    ("daily_token_limit", LONG, True),
    ("daily_request_limit", LONG, True),
    ("rpm_limit", LONG, True),
    ("note", TEXT, True),
)

PRICES = _schema(
    ("prefix", TEXT, False),
    ("in_milli", LONG, False),
    ("out_milli", LONG, False),
    ("cw_milli", LONG, False),
    ("cr_milli", LONG, False),
)

RAW_RESPONSES = _schema(("request_id", LONG, False), ("body", TEXT, True))
RAW_CHUNKS = _schema(("request_id", LONG, False), ("seq", LONG, False), ("chunk", TEXT, True))
SNAPSHOTS = _schema(("snapshot_id", LONG, False), ("fetched_at", LONG, True), ("payload", TEXT, True))

USER_CHANGES = T.StructType([
    T.StructField("seq", LONG, False),
    T.StructField("op", TEXT, False),
    T.StructField("api_key", TEXT, True),
    T.StructField("username", TEXT, True),
    T.StructField("fields", T.MapType(TEXT, TEXT, True), True),
])

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
