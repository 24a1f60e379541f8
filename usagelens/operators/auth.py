"""Key decisions and request outcomes as joins over request logs."""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.tokens import attach_document, is_falsy, json_text

# Endpoints by mode and the largest accepted body.
OPEN_ENDPOINTS = ("/v1/responses", "/v1/chat/completions", "/responses", "/chat/completions",
                  "/v1/models", "/models")
LOGIN_ENDPOINTS = ("/v1/responses", "/responses")
MAX_BODY_BYTES = 20 * 1024 * 1024

LIMIT_COLUMNS = ("daily_token_limit", "daily_request_limit", "rpm_limit")


def auto_username(api_key) -> Column:
    """Name under which an unknown key is registered: its last six characters."""
    key = F.col(api_key) if isinstance(api_key, str) else api_key
    tail = F.when(F.length(key) >= 6, F.right(key, F.lit(6))).when(key == "", "anon").otherwise(key)
    return F.concat(F.lit("auto-"), tail)


def auth_decision(requests: DataFrame, users: DataFrame, strict: bool) -> DataFrame:
    """Add ``auth``, ``username``, ``registered`` and the limits of the caller's key.

    ``auth`` is ok, unknown_key, disabled or expired, judged at the request
    start.  Unless ``strict``, an unknown non-empty key counts as registered.
    """
    keys = users.select("api_key", F.col("username").alias("_name"), "enabled", "expires_at", *LIMIT_COLUMNS)
    joined = requests.drop("username", *LIMIT_COLUMNS).join(keys, "api_key", "left")
    known = F.col("_name").isNotNull()
    registered = F.lit(False) if strict else (~known & (F.coalesce("api_key", F.lit("")) != ""))
    expiry = F.coalesce("expires_at", F.lit(0))
    decision = (
        F.when(registered, "ok")
        .when(~known, "unknown_key")
        .when(F.col("enabled") == 0, "disabled")
        .when((expiry != 0) & (F.col("start_ms") > expiry), "expired")
        .otherwise("ok")
    )
    return joined.withColumns({
        "auth": decision,
        "username": F.when(registered, auto_username("api_key")).otherwise(F.col("_name")),
        "registered": registered,
    }).drop("_name", "enabled", "expires_at")


def request_outcome(requests: DataFrame, login_mode: bool = False,
                    max_body_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Add ``http_status``, ``outcome`` and ``recorded`` to judged requests.

    Needs auth (key decision), admission (ok or a limit), method, path,
    content_length, payload, has_credentials, upstream_status (NULL when the
    upstream call failed) and client_gone.  The checks apply in the order below.
    """
    endpoints = LOGIN_ENDPOINTS if login_mode else OPEN_ENDPOINTS
    rows = attach_document(requests, "payload", "_doc", keys=("stream",))
    has_body = (F.coalesce("content_length", F.lit(0)) > 0) & (F.col("method") == "POST")
    valid = F.col("_doc").isNotNull()
    object_body = F.coalesce(F.ltrim("payload", F.lit(" \t\r\n")).startswith("{"), F.lit(False))
    not_object = has_body & valid & ~object_body
    if login_mode:
        not_stream = has_body & valid & object_body & is_falsy(json_text(F.col("_doc"), "$.stream"))
    else:
        not_stream = F.lit(False)
    cases = (
        (F.col("auth") == "unknown_key", "unknown_key", F.lit(401), False),
        (F.col("auth") == "disabled", "disabled", F.lit(403), False),
        (F.col("auth") == "expired", "expired", F.lit(403), False),
        (F.col("admission") != "ok", "quota", F.lit(429), False),
        (~F.col("path").isin(*endpoints), "endpoint", F.lit(404), False),
        (F.coalesce("content_length", F.lit(0)) > max_body_bytes, "too_large", F.lit(413), False),
        (not_object, "not_object", F.lit(400), False),
        (not_stream, "not_stream", F.lit(400), False),
        (~F.col("has_credentials"), "no_credentials", F.lit(503), True),
        (F.coalesce("client_gone", F.lit(False)), "client_gone", F.col("upstream_status"), False),
        (F.col("upstream_status").isNull(), "upstream_failed", F.lit(502), True),
    )
    status = outcome = recorded = F
    for test, name, code, row in cases:
        status, outcome, recorded = (status.when(test, code), outcome.when(test, name),
                                     recorded.when(test, F.lit(row)))
    return rows.withColumns({
        "http_status": status.otherwise(F.col("upstream_status")).cast("int"),
        "outcome": outcome.otherwise("upstream"),
        "recorded": recorded.otherwise(F.lit(True)),
    }).drop("_doc")
