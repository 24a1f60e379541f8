"""SQL twins of the registered queries, written from the rules and not from the Spark code."""

# The price table in thousandths of a dollar per million tokens (prefix, input, output, write, read).
PRICES = """prices(prefix, i, o, w, r) AS (VALUES
  ('gpt-6-astra', 10000, 50000, 0, 1000), ('gpt-6.1-sol', 2000, 10000, 0, 100),
  ('gpt-6-sol', 2000, 10000, 0, 200), ('gpt-6-luna', 100, 500, 0, 10),
  ('gpt-5.6-sol', 4000, 20000, 0, 400), ('gpt-5.6-terra', 2000, 12000, 0, 200),
  ('gpt-5.6-luna', 200, 1200, 0, 20), ('gpt-5.5', 5000, 30000, 0, 500),
  ('gpt-5.3-codex', 1750, 14000, 0, 175), ('gpt-5.2', 1750, 14000, 0, 175),
  ('gpt-4o', 2500, 10000, 0, 1250), ('gpt-4.1', 2000, 8000, 0, 500))"""

AGENT = """CASE event_id % 6 WHEN 0 THEN 'codex-cli/0.131' WHEN 1 THEN 'Codex Desktop'
  WHEN 2 THEN 'openai-python/1.2' WHEN 3 THEN 'openai-node/4' WHEN 4 THEN 'curl/8' END"""
CLIENT = "CASE event_id % 6 WHEN 1 THEN 'desktop' WHEN 4 THEN 'other' WHEN 5 THEN 'other' ELSE 'cli' END"

LEDGER = f"""base AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, ts, event_type, event_id, user_id, props, value,
    CAST(round(value * 100) AS BIGINT) AS v,
    CASE user_id % 37 WHEN 0 THEN 'legacy' WHEN 1 THEN 'auto-000001' ELSE 'u' || (user_id % 37) END AS username,
    'k' || user_id AS api_key,
    CASE event_id % 12 WHEN 0 THEN 'gpt-6-astra' WHEN 1 THEN 'gpt-6.1-sol' WHEN 2 THEN 'gpt-6-sol'
      WHEN 3 THEN 'gpt-6-luna' WHEN 4 THEN 'gpt-5.6-sol-2026-08-01' WHEN 5 THEN 'gpt-5.6-terra'
      WHEN 6 THEN 'gpt-5.5' WHEN 7 THEN 'gpt-5.3-codex-spark' WHEN 8 THEN 'gpt-4o-mini'
      WHEN 9 THEN 'mystery-model' WHEN 10 THEN '' END AS model
  FROM events),
{PRICES},
best AS (
  SELECT m.model, arg_max(i, length(prefix)) AS i, arg_max(o, length(prefix)) AS o,
    arg_max(w, length(prefix)) AS w, arg_max(r, length(prefix)) AS r
  FROM (SELECT DISTINCT model FROM base WHERE model IS NOT NULL) m JOIN prices ON starts_with(m.model, prefix)
  GROUP BY m.model),
counted AS (
  SELECT *, event_type = 'error' AS failed FROM base),
filled AS (
  SELECT *,
    CASE WHEN failed THEN 0 WHEN event_id % 101 = 0 THEN NULL ELSE v END AS input_tokens,
    CASE WHEN failed THEN 0 ELSE v * 3 // 7 END AS output_tokens,
    CASE WHEN NOT failed AND event_id % 10 = 0 THEN v // 10 ELSE 0 END AS cache_creation_tokens,
    CASE WHEN failed THEN 0 ELSE v * (event_id % 6) // 4 END AS cache_read_tokens
  FROM counted),
usage AS (
  SELECT id, ts_ms, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, CAST(hour(ts + INTERVAL 8 HOUR) AS INTEGER) AS hour,
    username, api_key, f.model, CAST(event_id % 2 AS INTEGER) AS stream,
    CAST(CASE WHEN failed THEN 502 + event_id % 2 ELSE 200 END AS INTEGER) AS status,
    input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens,
    CAST(((coalesce(input_tokens, 0) - least(cache_read_tokens, coalesce(input_tokens, 0))) * coalesce(i, 0)
      + output_tokens * coalesce(o, 0) + cache_creation_tokens * coalesce(w, 0)
      + least(cache_read_tokens, coalesce(input_tokens, 0)) * coalesce(r, 0) + 500) // 1000 AS BIGINT) AS cost_micros,
    50 + (event_id * 37) % 4000 AS latency_ms, '/v1/responses' AS path, CAST(NULL AS VARCHAR) AS error,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE {CLIENT} END AS client,
    best.model IS NOT NULL AS priced, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(w, 0) AS w, coalesce(r, 0) AS r,
    user_id, event_type, event_id, ts, v, props,
    coalesce(input_tokens, 0) + output_tokens + cache_creation_tokens + cache_read_tokens AS total_tokens
  FROM filled f LEFT JOIN best ON f.model = best.model),
today AS (SELECT * FROM usage WHERE day = '2024-01-31')"""

VOID = "no usage can be read from the event stream"
ASKED = "(u.id % 12 = 11 OR (u.id % 14 <> 5 AND u.id % 2 = 1))"
INGESTED = f"""SELECT id, ts_ms, day, username, api_key, model, stream,
      CAST(CASE WHEN void THEN 502 ELSE status END AS INTEGER) AS status,
      CASE WHEN void THEN 0 ELSE coalesce(input_tokens, 0) END AS input_tokens,
      CASE WHEN void THEN 0 ELSE output_tokens END AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens,
      CASE WHEN void THEN 0 ELSE cache_read_tokens END AS cache_read_tokens,
      CAST(CASE WHEN void THEN 0 ELSE
        ((coalesce(input_tokens, 0) - least(cache_read_tokens, coalesce(input_tokens, 0))) * i
        + output_tokens * o + least(cache_read_tokens, coalesce(input_tokens, 0)) * r + 500) // 1000 END AS BIGINT) AS cost_micros,
      latency_ms, path, CASE WHEN void THEN '{VOID}' END AS error, client
    FROM (SELECT *, stream = 1 AND status = 200 AND id % 13 = 1 AS void FROM usage)"""

USAGE_COLUMNS = """id, ts_ms, day, username, api_key, model, stream, status, input_tokens, output_tokens,
  cache_creation_tokens, cache_read_tokens, cost_micros, latency_ms, path, error, client"""

USERS = """users AS (
  SELECT 'k' || n AS api_key,
    CASE n % 37 WHEN 0 THEN 'legacy' WHEN 1 THEN 'auto-000001' ELSE 'u' || (n % 37) END AS username,
    CAST(CASE WHEN n % 7 = 3 THEN 0 ELSE 1 END AS INTEGER) AS enabled, 1704038400000 AS created_at,
    CASE WHEN n % 5 = 0 THEN 1705334400000 END AS expires_at,
    CAST(CASE WHEN n % 4 = 1 THEN 60000 END AS BIGINT) AS daily_token_limit,
    CAST(CASE WHEN n % 3 = 0 THEN 8 END AS BIGINT) AS daily_request_limit,
    CAST(CASE WHEN n % 2 = 0 THEN 2 END AS BIGINT) AS rpm_limit, CAST(NULL AS VARCHAR) AS note
  FROM (SELECT DISTINCT user_id AS n FROM events WHERE user_id NOT BETWEEN 140 AND 149))"""

_SUMS = {
    "reqs": "CAST(count(*) AS BIGINT) AS reqs",
    "it": "CAST(sum(input_tokens) AS BIGINT) AS it",
    "ot": "CAST(sum(output_tokens) AS BIGINT) AS ot",
    "cw": "CAST(sum(cache_creation_tokens) AS BIGINT) AS cw",
    "cr": "CAST(sum(cache_read_tokens) AS BIGINT) AS cr",
    "io": "CAST(sum(input_tokens + output_tokens) AS BIGINT) AS io",
    "all4": "CAST(sum(input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens) AS BIGINT) AS all4",
    "cost": "CAST(sum(cost_micros) AS BIGINT) AS cost_micros",
}


def sums(*names):
    return ", ".join(_SUMS[name] for name in names)


def sql(select, *more, recursive=False):
    tables = ", ".join((LEDGER, *more))
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables} {select}"


def grouped(keys, measures, source="usage", names=None):
    names = names or keys
    return sql(f"SELECT {names}, {sums(*measures)} FROM {source} GROUP BY {keys}")


def r4(column):
    return f"(({column} + 50) // 100 * 100)"


PER_USER = ("reqs", "it", "ot", "cw", "cr", "cost")


def by_user(condition):
    return sql(f"SELECT username, {sums(*PER_USER)} FROM usage WHERE {condition} GROUP BY username")


def matrix(bucket, buckets):
    cells = []
    for value, name in buckets:
        cells.append(f"CAST(coalesce(sum(CASE WHEN b = '{value}' THEN io END), 0) AS BIGINT) AS {name}_tok")
        cells.append(f"CAST(coalesce(sum(CASE WHEN b = '{value}' THEN c END), 0) AS BIGINT) AS {name}_cost_micros")
    return f"""SELECT username, {', '.join(cells)}, CAST(coalesce(sum(io), 0) AS BIGINT) AS total_tok,
      CAST(coalesce(sum(c), 0) AS BIGINT) AS total_cost_micros
    FROM (SELECT username, {bucket} AS b, input_tokens + output_tokens AS io, cost_micros AS c FROM usage)
    GROUP BY username"""


FAMILY = """CASE WHEN contains(lower(coalesce(model, '')), 'codex') THEN 'Codex'
  WHEN contains(lower(coalesce(model, '')), 'gpt') THEN 'GPT' ELSE '其他' END"""
FAMILY_MATRIX = matrix(FAMILY, [("GPT", "gpt"), ("Codex", "codex"), ("其他", "other")])


def nested_series(keys, label):
    return sql(f"""SELECT {keys}, day, tok, cost_micros,
        max(tok) OVER (PARTITION BY username, model) > 0 AS any_tok,
        max(cost_micros) OVER (PARTITION BY username, model) > 0 AS any_cost
      FROM (
        SELECT p.username, p.model, d.day, CAST(coalesce(c.io, 0) AS BIGINT) AS tok,
          CAST({r4('coalesce(c.cost_micros, 0)')} AS BIGINT) AS cost_micros
        FROM (SELECT DISTINCT username, {label} AS model FROM usage) p
        CROSS JOIN (SELECT DISTINCT day FROM usage ORDER BY day DESC LIMIT 30) d
        LEFT JOIN (SELECT day, username, {label} AS model, sum(input_tokens + output_tokens) AS io,
          sum(cost_micros) AS cost_micros FROM usage GROUP BY ALL) c
        ON c.username = p.username AND c.model = p.model AND c.day = d.day)""")


def share(metric):
    value = {"tok": "coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0)",
             "cost_micros": r4("coalesce(sum(cost_micros), 0)")}[metric]
    return sql(f"""SELECT model, {metric}, CAST({metric} AS DOUBLE) / sum({metric}) OVER () AS share
      FROM (SELECT model, CAST({value} AS BIGINT) AS {metric} FROM usage GROUP BY model) WHERE {metric} > 0""")


def ranked(metric):
    value = {"tok": "coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0)",
             "cost_micros": r4("coalesce(sum(cost_micros), 0)")}[metric]
    return sql(f"""SELECT username, {metric}, rank() OVER (ORDER BY {metric} DESC) AS rank
      FROM (SELECT username, CAST({value} AS BIGINT) AS {metric} FROM usage GROUP BY username)""")


STALE = """stale AS (SELECT * REPLACE (CASE id % 3 WHEN 0 THEN cost_micros WHEN 1 THEN cost_micros + 7 END AS cost_micros),
  cost_micros AS fresh,
  priced AND coalesce(input_tokens, 0) + output_tokens + cache_creation_tokens + cache_read_tokens > 0 AS eligible
  FROM usage)"""


def day_of(ms):
    return f"strftime(make_timestamp(({ms} + 28800000) * 1000), '%Y-%m-%d')"


# Requests of each fixture: id, username, start, finish, total and the three limits.
LIMITED = f"""reqs AS (
  SELECT u.id, u.username, ts_ms - latency_ms AS s, ts_ms AS e, total_tokens AS total,
    coalesce(daily_request_limit, 0) AS drl, coalesce(daily_token_limit, 0) AS dtl, coalesce(rpm_limit, 0) AS rpm
  FROM usage u LEFT JOIN users USING (api_key))"""
DENSE = """reqs AS (
  SELECT id, 'q' || (user_id % 3) AS username,
    1704038400000 + (ts_ms - 1704038400000) // 10 - latency_ms AS s,
    1704038400000 + (ts_ms - 1704038400000) // 10 AS e, total_tokens AS total, 500 AS drl, 0 AS dtl, 1 AS rpm
  FROM usage)"""
SLOW = """reqs AS (
  SELECT id, username, ts_ms - latency_ms AS s,
    ts_ms + CASE WHEN id % 9 = 0 THEN 20000000 + (id % 5) * 9000000 ELSE 0 END AS e, total_tokens AS total,
    CASE WHEN g = 1 THEN 7 ELSE 0 END AS drl, CASE WHEN g >= 2 THEN 200000 ELSE 0 END AS dtl,
    CASE WHEN g = 3 THEN 1 ELSE 0 END AS rpm
  FROM (SELECT *, coalesce(TRY_CAST(substr(username, 2) AS BIGINT), 0) % 4 AS g FROM usage))"""

# One step per request of each user, all users side by side.
REPLAY = f"""line AS (
  SELECT *, {day_of('s')} AS day, {day_of('e')} AS end_day,
    row_number() OVER (PARTITION BY username ORDER BY s, id) AS n FROM reqs),
steps AS (
  SELECT DISTINCT username, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS id, CAST('' AS VARCHAR) AS day,
    CAST(0 AS BIGINT) AS requests, CAST(0 AS BIGINT) AS tokens, CAST([] AS BIGINT[]) AS times,
    CAST([] AS STRUCT(e BIGINT, d VARCHAR, t BIGINT)[]) AS pending, CAST('' AS VARCHAR) AS decision
  FROM line
  UNION ALL
  SELECT username, n, id, day,
    CAST(requests + (decision = 'ok')::INT AS BIGINT), tokens,
    CASE WHEN decision = 'ok' AND rpm <> 0 THEN list_append(times, s) ELSE times END,
    CASE WHEN decision = 'ok' THEN list_append(pending, {{'e': e, 'd': end_day, 't': total}}) ELSE pending END,
    decision
  FROM (
    SELECT *, CASE WHEN drl <> 0 AND requests >= drl THEN 'request_limit'
      WHEN dtl <> 0 AND tokens >= dtl THEN 'token_limit'
      WHEN rpm <> 0 AND len(times) >= rpm THEN 'rpm' ELSE 'ok' END AS decision
    FROM (
      SELECT l.username, l.n, l.id, l.day, l.s, l.e, l.end_day, l.total, l.drl, l.dtl, l.rpm,
        CASE WHEN p.day = l.day THEN p.requests ELSE 0 END AS requests,
        CAST(CASE WHEN p.day = l.day THEN p.tokens ELSE 0 END + coalesce(list_sum(list_transform(
          list_filter(p.pending, lambda x: x.e <= l.s AND x.d = l.day), lambda x: x.t)), 0) AS BIGINT) AS tokens,
        CASE WHEN p.day = l.day THEN list_filter(p.times, lambda x: l.s - x < 60000)
          ELSE CAST([] AS BIGINT[]) END AS times,
        list_filter(p.pending, lambda x: x.e > l.s) AS pending
      FROM steps p JOIN line l ON l.username = p.username AND l.n = p.n + 1)))"""


def replayed(requests, *more):
    return sql("SELECT id, username, day, decision FROM steps WHERE n > 0", *more, requests, REPLAY, recursive=True)


def outcome(login):
    not_stream = "id % 5 = 0 AND id % 59 <> 0" if login else "false"
    body = "id % 53 <> 0 AND id % 29 <> 0"
    judged = f"""judged AS (
      SELECT u.id, CASE WHEN users.api_key IS NULL THEN 'unknown_key' WHEN enabled = 0 THEN 'disabled'
        WHEN expires_at IS NOT NULL AND ts_ms - latency_ms > expires_at THEN 'expired' ELSE 'ok' END AS auth,
        coalesce(users.username, u.username) AS username, ts_ms - latency_ms AS s, ts_ms AS e, total_tokens AS total,
        coalesce(daily_request_limit, 0) AS drl, coalesce(daily_token_limit, 0) AS dtl, coalesce(rpm_limit, 0) AS rpm
      FROM usage u LEFT JOIN users USING (api_key)),
      reqs AS (SELECT * EXCLUDE (auth) FROM judged WHERE auth = 'ok')"""
    cases = f"""SELECT id, CASE WHEN auth <> 'ok' THEN auth WHEN decision <> 'ok' THEN 'quota'
        WHEN id % 23 = 0 THEN 'endpoint' WHEN id % 31 = 0 THEN 'too_large'
        WHEN {body} AND id % 37 = 0 THEN 'not_object'
        WHEN {body} AND id % 37 <> 0 AND ({not_stream}) THEN 'not_stream'
        WHEN id % 41 = 0 THEN 'no_credentials' WHEN id % 47 = 0 THEN 'client_gone'
        WHEN id % 43 = 0 THEN 'upstream_failed' ELSE 'upstream' END AS outcome
      FROM judged LEFT JOIN (SELECT id, decision FROM steps WHERE n > 0) d USING (id)"""
    return sql(f"""SELECT id, outcome, CAST(CASE outcome WHEN 'unknown_key' THEN 401 WHEN 'disabled' THEN 403
        WHEN 'expired' THEN 403 WHEN 'quota' THEN 429 WHEN 'endpoint' THEN 404 WHEN 'too_large' THEN 413
        WHEN 'not_object' THEN 400 WHEN 'not_stream' THEN 400 WHEN 'no_credentials' THEN 503
        WHEN 'upstream_failed' THEN 502
        ELSE CASE WHEN id % 43 = 0 THEN NULL WHEN id % 7 = 0 THEN 404 ELSE 200 END END AS INTEGER) AS http_status,
        outcome IN ('no_credentials', 'upstream_failed', 'upstream') AS recorded FROM ({cases})""",
               USERS, judged, REPLAY, recursive=True)


def auth(strict):
    registered = "false" if strict else "x.api_key IS NULL"
    return sql(f"""SELECT u.id, CASE WHEN {registered} THEN 'ok' WHEN x.api_key IS NULL THEN 'unknown_key'
        WHEN enabled = 0 THEN 'disabled' WHEN expires_at < ts_ms - latency_ms THEN 'expired' ELSE 'ok' END AS auth,
        CASE WHEN {registered} THEN 'auto-' || u.api_key ELSE x.username END AS username,
        {registered} AS registered
      FROM usage u LEFT JOIN users x ON x.api_key = u.api_key""", USERS)


def trailing(requests):
    return sql(f"""SELECT id, username, day, s AS start_ms,
        count(*) OVER (PARTITION BY username, day ORDER BY s RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) AS trailing
      FROM (SELECT *, {day_of('s')} AS day FROM reqs)""", USERS, requests)


EXTRACTED = """SELECT id AS request_id, {input} AS input_tokens, {output} AS output_tokens,
  CAST(0 AS BIGINT) AS cache_creation_tokens, {cached} AS cache_read_tokens, {bad} AS parse_error FROM usage"""

# Change log of the fixture, applied one change after the other to each key, all keys side by side.
# A key only looks at changes that name it or one of its two possible usernames.
CHANGES = """changes AS (
  SELECT event_id AS seq, CASE WHEN event_id % 40 = 0 THEN 'delete' WHEN event_id % 20 < 3 THEN 'add'
      WHEN event_id % 20 < 5 THEN 'enable' WHEN event_id % 20 < 7 THEN 'disable' ELSE 'update' END AS op,
    'k' || user_id AS k, CASE WHEN event_id % 4 = 1 THEN 'auto-k' || user_id ELSE 'u' || (user_id % 37) END AS name,
    event_id % 3 = 0 AS by_key, event_id % 5 AS f, CAST(round(value * 100) AS BIGINT) AS v, event_type, props
  FROM events),
mine AS (
  SELECT c.*, x.own, row_number() OVER (PARTITION BY x.own ORDER BY seq) AS n
  FROM (SELECT DISTINCT 'k' || user_id AS own, 'u' || (user_id % 37) AS usual FROM events) x
  JOIN changes c ON c.k = x.own OR c.name = x.usual),
state AS (
  SELECT CAST(0 AS BIGINT) AS n, 'k' || x.user_id AS api_key, u.username, CAST(u.enabled AS INTEGER) AS enabled,
    CAST(u.created_at AS BIGINT) AS created_at, CAST(u.expires_at AS BIGINT) AS expires_at,
    CAST(u.daily_token_limit AS BIGINT) AS daily_token_limit,
    CAST(u.daily_request_limit AS BIGINT) AS daily_request_limit, CAST(u.rpm_limit AS BIGINT) AS rpm_limit, u.note,
    CAST(-1 AS BIGINT) AS seq, CAST('' AS VARCHAR) AS op, false AS touched
  FROM (SELECT DISTINCT user_id FROM events) x LEFT JOIN users u ON u.api_key = 'k' || x.user_id
  UNION ALL
  SELECT n, api_key,
    CASE WHEN born THEN name WHEN gone THEN NULL ELSE username END,
    CASE WHEN born THEN 1 WHEN gone THEN NULL WHEN hit AND op = 'enable' THEN 1 WHEN hit AND op = 'disable' THEN 0 ELSE enabled END,
    CASE WHEN born THEN seq WHEN gone THEN NULL ELSE created_at END,
    CASE WHEN born OR gone THEN NULL WHEN written AND f = 4 THEN v ELSE expires_at END,
    CASE WHEN born OR gone THEN NULL WHEN written AND f = 0 THEN v WHEN written AND f = 1 THEN NULL ELSE daily_token_limit END,
    CASE WHEN born OR gone THEN NULL WHEN written AND f = 2 THEN v ELSE daily_request_limit END,
    CASE WHEN born OR gone THEN NULL WHEN written AND f = 0 THEN NULL WHEN written AND f = 3 THEN v ELSE rpm_limit END,
    CASE WHEN born THEN event_type WHEN gone THEN NULL WHEN written AND f = 2 THEN props ELSE note END,
    seq, op, born OR hit
  FROM (
    SELECT *, op = 'add' AND username IS NULL AND api_key = k AS born, hit AND op = 'delete' AS gone,
      hit AND op = 'update' AS written
    FROM (
      SELECT s.* EXCLUDE (n, seq, op, touched), c.n, c.seq, c.op, c.k, c.name, c.f, c.v, c.event_type, c.props,
        c.op <> 'add' AND s.username IS NOT NULL
          AND CASE WHEN c.by_key THEN s.api_key = c.k ELSE s.username = c.name END AS hit
      FROM state s JOIN mine c ON c.own = s.api_key AND c.n = s.n + 1)))"""

_WINDOW_LABEL = """CASE {n} % 6 WHEN 0 THEN '5小时' WHEN 1 THEN '本周' WHEN 2 THEN '2 天窗口' WHEN 3 THEN '3 小时窗口'
  ELSE '周期窗口' END"""


def _reset(seconds):
    return f"'重置于 ' || strftime(make_timestamp(CAST(({seconds} + 28800) * 1000000 AS BIGINT)), '%m-%d %H:%M')"


WINDOWS = f"""SELECT snapshot_id, CAST(position AS INTEGER) AS position, label, used_percent,
  100.0::DOUBLE - used_percent AS remaining_percent,
  CASE WHEN used_percent >= 80 THEN 'high' WHEN used_percent >= 50 THEN 'medium' ELSE 'low' END AS severity, reset
FROM (
  SELECT event_id AS snapshot_id, 0 AS position, {_WINDOW_LABEL.format(n='event_id')} AS label,
    CAST(least(event_id % 130, 100) AS DOUBLE) AS used_percent,
    {_reset('ts_ms // 1000 + event_id % 1000')} AS reset FROM usage
  UNION ALL
  SELECT event_id, 1, '本周', CAST(least(event_id % 130, 100) AS DOUBLE), {_reset('1704067200 + event_id * 60')}
  FROM usage WHERE event_id % 10 <> 0
  UNION ALL
  SELECT event_id, 2, 'Spark · 5小时', CAST(25 AS DOUBLE), '重置于 01-05 18:00' FROM usage)"""

CATALOG = """ids AS (
  SELECT event_id AS snapshot_id, CASE WHEN event_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE
    ['m-' || (event_id % 5)]
    || [CASE WHEN event_id % 3 <> event_id % 5 THEN 'm-' || (event_id % 3) ELSE 's-' || (event_id % 7) END]
    || ['x-' || (event_id % 2)] END AS ids FROM events)"""

ITEMS = """items AS (
  SELECT conv_id AS request_id, turn AS pos, 'item_' || repeat(md5(text), CAST(1 + turn % 3 AS INTEGER)) AS item_id,
    turn % 4 = 1 AS encrypted FROM conversations
  UNION ALL
  SELECT conv_id, turn + 1000, 'item_' || repeat(md5(text), CAST(1 + turn % 3 AS INTEGER)), true
  FROM conversations WHERE turn % 4 = 0)"""

ORACLE = {
    "usage_base": sql(f"SELECT {USAGE_COLUMNS} FROM usage"),
    "usage_ingest": sql(f"SELECT {USAGE_COLUMNS} FROM usage"),
    "schema_evolve": sql(f"""SELECT * REPLACE (CAST(NULL AS VARCHAR) AS client) FROM
      (SELECT {USAGE_COLUMNS} FROM usage UNION ALL SELECT {USAGE_COLUMNS} FROM usage)"""),
    "price_table": sql("""SELECT prefix, CAST(p.i AS BIGINT) AS in_milli, CAST(p.o AS BIGINT) AS out_milli,
      CAST(p.w AS BIGINT) AS cw_milli, CAST(p.r AS BIGINT) AS cr_milli, count(u.id) AS priced_rows
      FROM prices p LEFT JOIN usage u ON starts_with(u.model, prefix) GROUP BY ALL"""),
    "users_list": sql(f"""SELECT *, CASE WHEN expires_at IS NOT NULL THEN {day_of('expires_at')} END AS expires_on
      FROM users""", USERS),
    "price_lookup": sql("""SELECT id, model, priced, CAST(i AS BIGINT) AS in_milli, CAST(o AS BIGINT) AS out_milli,
      CAST(w AS BIGINT) AS cw_milli, CAST(r AS BIGINT) AS cr_milli FROM usage"""),
    "price_lookup_joined": sql("SELECT id, CAST(i AS BIGINT) AS in_milli, priced FROM usage"),
    "usage_cost": sql("SELECT id, cost_micros, CAST(cost_micros AS DOUBLE) / 1000000 AS cost_usd FROM usage"),
    "client_class": f"""SELECT event_id, CASE WHEN lower(coalesce(ua, '')) LIKE '%desktop%'
      OR lower(coalesce(ua, '')) LIKE '%codex.app%' THEN 'desktop' WHEN lower(coalesce(ua, '')) LIKE '%codex%'
      OR lower(coalesce(ua, '')) LIKE '%openai-python%' OR lower(coalesce(ua, '')) LIKE '%openai-node%' THEN 'cli'
      ELSE 'other' END AS client FROM (SELECT event_id, {AGENT} AS ua FROM events)""",
    "model_family": sql(f"SELECT id, {FAMILY} AS family FROM usage"),
    "user_tag": sql("""SELECT id, username, CASE WHEN username = 'legacy' THEN '过渡'
      WHEN username LIKE 'auto-%' THEN '测试' END AS tag FROM usage"""),
    "local_time_parts": sql("""SELECT id, day AS local_day, hour AS local_hour,
      strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time FROM usage"""),
    "key_expiry": sql(f"""SELECT id, expires_at, CASE WHEN expires_at IS NOT NULL THEN {day_of('expires_at')} END AS expires_on
      FROM (SELECT id, CASE WHEN id % 4 <> 0 THEN ts_ms + (id % 4) * 129600000 END AS expires_at FROM usage)"""),
    "by_user_today": by_user("day = '2024-01-31'"),
    "by_user_period": by_user("day >= '2024-01-25'"),
    "by_user_7": by_user("day >= '2024-01-25'"),
    "by_user_scoped": by_user("username = 'u5' AND day >= '2024-01-02'"),
    "by_user_rolling": by_user("ts_ms >= 1706673600000 - 216000000"),
    "by_user_all_time": by_user("true"),
    "priced_with_tokens": sql("SELECT id, model FROM usage WHERE priced AND total_tokens > 0"),
    "usage_cube": grouped("day, hour, username, model, client",
                          ("reqs", "it", "ot", "cw", "cr", "io", "all4", "cost"), "usage"),
    "by_user": grouped("username", PER_USER),
    "by_day": grouped("day", ("reqs", "it", "ot", "io", "cost")) + " ORDER BY day DESC LIMIT 30",
    "by_model": grouped("model", ("reqs", "it", "ot", "cost")),
    "by_user_client": grouped("username, coalesce(client, 'other')", ("reqs", "io", "cost"),
                              names="username, coalesce(client, 'other') AS client"),
    "by_user_model": grouped("username, coalesce(model, '-')", ("reqs", "io", "cost"),
                             names="username, coalesce(model, '-') AS model"),
    "by_user_model_raw": grouped("username, model", ("reqs", "io", "cost")),
    "by_day_user": grouped("day, username", ("reqs", "io", "cost")),
    "by_day_user_model": grouped("day, username, coalesce(model, '-')", ("io", "cost"),
                                 names="day, username, coalesce(model, '-') AS model"),
    "today_hour_user": grouped("hour, username", ("reqs", "io", "cost"), "today"),
    "by_day_hour_user": grouped("day, hour, username", ("io", "cost")),
    "by_hour_of_day": grouped("hour", ("io", "cost")),
    "today_counters": sql("""SELECT username, count(*) AS requests, CAST(coalesce(sum(input_tokens + output_tokens
      + cache_creation_tokens + cache_read_tokens), 0) AS BIGINT) AS tokens FROM today GROUP BY username"""),
    "summary": sql("""SELECT count(*) AS total_reqs, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
      CAST(sum(cost_micros) AS BIGINT) AS total_cost_micros, CAST(sum(CASE WHEN day = (SELECT max(day) FROM usage)
      THEN cost_micros END) AS BIGINT) AS latest_day_cost_micros FROM usage"""),
    "users_summary": sql("SELECT count(*) AS total, count(*) FILTER (enabled <> 0) AS enabled FROM users", USERS),
    "pivot_user_family": sql(FAMILY_MATRIX),
    "pivot_user_client": sql(matrix("CASE WHEN client IN ('cli', 'desktop') THEN client ELSE 'other' END",
                                    [(name, name) for name in ("cli", "desktop", "other")])),
    "active_buckets": sql(f"""SELECT CAST(position AS INTEGER) AS position, bucket, active FROM (
      SELECT 0 AS position, 'gpt' AS bucket, max(gpt_tok) > 0 AS active FROM ({FAMILY_MATRIX})
      UNION ALL SELECT 1, 'codex', max(codex_tok) > 0 FROM ({FAMILY_MATRIX})
      UNION ALL SELECT 2, 'other', max(other_tok) > 0 FROM ({FAMILY_MATRIX}))"""),
    "day_user_matrix": sql("""SELECT day, username, tok, CAST(sum(tok) OVER (PARTITION BY day) AS BIGINT) AS day_tok,
        CAST(sum(c) OVER (PARTITION BY day) AS BIGINT) AS day_cost_micros, user_cost_micros
      FROM (SELECT day, username, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tok,
        sum(cost_micros) AS c FROM usage WHERE day IN (SELECT DISTINCT day FROM usage ORDER BY day DESC LIMIT 30)
        GROUP BY day, username)
      JOIN (SELECT username, CAST(sum(cost_micros) AS BIGINT) AS user_cost_micros FROM usage GROUP BY username)
      USING (username)"""),
    "day_user_wide": sql("""SELECT day, CAST(coalesce(sum(io) FILTER (username = 'legacy'), 0) AS BIGINT) AS legacy,
        CAST(coalesce(sum(io) FILTER (username = 'u2'), 0) AS BIGINT) AS u2,
        CAST(coalesce(sum(io) FILTER (username = 'u3'), 0) AS BIGINT) AS u3,
        CAST(sum(io) AS BIGINT) AS total_tok, CAST(sum(cost_micros) AS BIGINT) AS total_cost_micros
      FROM (SELECT *, input_tokens + output_tokens AS io FROM usage) GROUP BY day ORDER BY day DESC LIMIT 30"""),
    "series_user_day": sql(f"""SELECT u.username, d.day, CAST(coalesce(c.io, 0) AS BIGINT) AS tok,
        CAST(coalesce(c.cost, 0) AS BIGINT) AS cost_micros,
        u.total AS user_cost_micros
      FROM (SELECT username, CAST(sum(cost) AS BIGINT) AS total FROM (
        SELECT day, username, {r4('coalesce(sum(cost_micros), 0)')} AS cost FROM usage GROUP BY day, username) GROUP BY username) u
      CROSS JOIN (SELECT DISTINCT day FROM usage ORDER BY day DESC LIMIT 30) d
      LEFT JOIN (SELECT day, username, sum(input_tokens + output_tokens) AS io, {r4('sum(cost_micros)')} AS cost
        FROM usage GROUP BY day, username) c ON c.username = u.username AND c.day = d.day"""),
    "series_user_model_day": nested_series(
        "username, model", "CASE coalesce(model, '-') WHEN '' THEN '未知模型' ELSE coalesce(model, '-') END"),
    "series_model_user_day": nested_series("model, username", "coalesce(model, '-')"),
    "grid_day_hour_user": sql("""SELECT u.day, h.hour, u.username, CAST(coalesce(c.io, 0) AS BIGINT) AS tok,
        CAST(coalesce(c.cost, 0) AS BIGINT) AS cost_micros, u.user_day_cost_micros
      FROM (SELECT day, username, CAST(sum(cost_micros) AS BIGINT) AS user_day_cost_micros FROM usage GROUP BY ALL) u
      JOIN (SELECT DISTINCT day, hour FROM usage) h ON h.day = u.day
      LEFT JOIN (SELECT day, hour, username, sum(input_tokens + output_tokens) AS io, sum(cost_micros) AS cost
        FROM usage GROUP BY day, hour, username) c
      ON c.day = u.day AND c.hour = h.hour AND c.username = u.username"""),
    "hours_dense": sql(f"""SELECT CAST(h AS INTEGER) AS hour, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tok,
      CAST({r4('coalesce(sum(cost_micros), 0)')} AS BIGINT) AS cost_micros
      FROM range(24) g(h) LEFT JOIN usage ON hour = h GROUP BY h"""),
    "series_total": sql(f"""SELECT day, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tok,
      CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS inp, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS "out",
      CAST({r4('coalesce(sum(cost_micros), 0)')} AS BIGINT) AS cost_micros
      FROM usage GROUP BY day ORDER BY day DESC LIMIT 30"""),
    "today_hour_cube": sql("""SELECT hour, username, CAST(grouping(hour, username) AS BIGINT) AS level,
      count(*) AS reqs, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS tok,
      CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM today GROUP BY CUBE (hour, username)"""),
    "today_hour_scoped": sql("""SELECT hour, count(*) AS reqs, CAST(coalesce(sum(input_tokens + output_tokens), 0)
      AS BIGINT) AS tok, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM today WHERE username = 'u5' GROUP BY hour"""),
    "share_of_max": sql("""SELECT username, cost_micros,
      least(CAST(cost_micros AS DOUBLE) / CASE WHEN max(cost_micros) OVER () = 0 THEN 1 ELSE max(cost_micros) OVER () END
        * 100.0::DOUBLE, 100.0::DOUBLE) AS pct_of_max
      FROM (SELECT username, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM usage GROUP BY username)"""),
    "model_share": share("cost_micros"),
    "model_share_tokens": share("tok"),
    "rank_users": ranked("cost_micros"),
    "rank_users_tokens": ranked("tok"),
    "rpm_trailing": trailing(LIMITED),
    "rpm_trailing_dense": trailing(DENSE),
    "reprice_preview": sql("""SELECT count(*) AS eligible, count(*) FILTER (coalesce(cost_micros, 0) <> fresh) AS changed,
      CAST(coalesce(sum(coalesce(cost_micros, 0)), 0) AS BIGINT) AS before_micros,
      CAST(coalesce(sum(fresh), 0) AS BIGINT) AS after_micros FROM stale WHERE eligible""", STALE),
    "reprice_apply": sql("SELECT id, day, CASE WHEN eligible THEN fresh ELSE cost_micros END AS cost_micros FROM stale",
                         STALE),
    "reprice_written": sql("SELECT id, day, CASE WHEN eligible THEN fresh ELSE cost_micros END AS cost_micros FROM stale",
                           STALE),
    "usage_cost_signed": sql("""SELECT id, CAST((x - ((x % 1000) + 1000) % 1000) // 1000 AS BIGINT) AS cost_micros FROM (
      SELECT id, (coalesce(input_tokens, 0) - least(cache_read_tokens, coalesce(input_tokens, 0))) * i
        + least(cache_read_tokens, coalesce(input_tokens, 0)) * r
        + CASE WHEN id % 4 = 1 THEN -1 ELSE 1 END * (output_tokens * o + cache_creation_tokens * w) + 500 AS x FROM usage)"""),
    "extract_sse_usage_long": """SELECT doc_id AS request_id, CAST(length(text) AS BIGINT) AS input_tokens,
      doc_id % 97 AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
      false AS parse_error FROM documents WHERE text IS NOT NULL""",
    "extract_json_usage": sql(EXTRACTED.format(
        input="CASE WHEN id % 13 IN (1, 2, 3, 4, 5) THEN 0 ELSE coalesce(input_tokens, 0) END",
        output="CASE WHEN id % 13 IN (1, 2, 3, 4, 5) THEN 0 ELSE output_tokens END",
        cached="CASE WHEN id % 13 = 5 THEN 3 WHEN id % 13 IN (1, 2, 3, 4) THEN 0 ELSE cache_read_tokens END",
        bad="id % 13 IN (1, 2, 3)")),
    "extract_sse_usage": sql(EXTRACTED.format(
        input="CASE WHEN id % 13 = 1 THEN 0 ELSE coalesce(input_tokens, 0) END",
        output="CASE WHEN id % 13 = 1 THEN 0 ELSE output_tokens END",
        cached="CASE WHEN id % 13 = 1 THEN 0 ELSE cache_read_tokens END", bad="id % 13 = 1")),
    "request_facts": sql(f"""SELECT id AS request_id, CASE WHEN id % 12 = 11 OR id % 14 = 5 THEN '' ELSE model END AS model,
      CAST(CASE WHEN id % 12 = 11 THEN 1 WHEN id % 14 = 5 THEN 0 ELSE id % 2 END AS INTEGER) AS stream,
      {CLIENT} AS client, CASE WHEN id % 3 = 2 THEN '' ELSE api_key END AS api_key FROM usage"""),
    "usage_assemble": sql(f"""SELECT u.id, ts_ms, day, username, api_key, f.model,
      CAST(CASE WHEN u.id % 12 = 11 THEN 1 WHEN u.id % 14 = 5 THEN 0 ELSE u.id % 2 END AS INTEGER) AS stream,
      CAST(CASE WHEN status = 200 AND u.id % 13 = 1 AND {ASKED} THEN 502 ELSE status END AS INTEGER) AS status,
      CASE WHEN u.id % 13 = 1 THEN 0 ELSE coalesce(input_tokens, 0) END AS input_tokens,
      CASE WHEN u.id % 13 = 1 THEN 0 ELSE output_tokens END AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens,
      CASE WHEN u.id % 13 = 1 THEN 0 ELSE cache_read_tokens END AS cache_read_tokens,
      CAST(CASE WHEN u.id % 13 = 1 THEN 0 ELSE
        ((coalesce(input_tokens, 0) - least(cache_read_tokens, coalesce(input_tokens, 0))) * coalesce(b.i, 0)
        + output_tokens * coalesce(b.o, 0)
        + least(cache_read_tokens, coalesce(input_tokens, 0)) * coalesce(b.r, 0) + 500) // 1000 END AS BIGINT) AS cost_micros,
      latency_ms, path, CASE WHEN status <> 200 THEN repeat('upstream ', 40)
        WHEN u.id % 13 = 1 AND {ASKED} THEN '{VOID}' END AS error,
      {CLIENT.replace('event_id', 'u.event_id')} AS client
      FROM usage u JOIN (SELECT id, CASE WHEN id % 12 = 11 OR id % 14 = 5 THEN '' ELSE model END AS model FROM usage) f
        ON f.id = u.id LEFT JOIN best b ON b.model = f.model"""),
    "surrogate_ids": f"""WITH {ITEMS} SELECT i.*, CASE WHEN length(item_id) > 64 AND EXISTS (
        SELECT 1 FROM items o WHERE o.request_id = i.request_id AND o.item_id = i.item_id AND NOT o.encrypted)
      THEN 'rs_' || substr(sha256(item_id), 1, 61) ELSE item_id END AS new_id FROM items i""",
    "request_items_long": """WITH items AS (
        SELECT conv_id * 1000 + turn AS request_id, CAST(p AS INTEGER) AS pos, repeat(md5(text), 40) || CASE p WHEN 0 THEN 'a' ELSE 'b' END
          AS item_id, p = 2 AS encrypted FROM conversations, range(3) g(p))
      SELECT *, 'rs_' || substr(sha256(item_id), 1, 61) AS new_id FROM items""",
    "request_facts_long": """SELECT conv_id * 1000 + turn AS request_id, repeat(md5(text), 40) AS model, CAST(1 AS INTEGER) AS stream
      FROM conversations""",
    "request_items": """SELECT conv_id * 1000 + turn AS request_id, CAST(p AS INTEGER) AS pos,
      CASE p WHEN 0 THEN 'item_' || md5(text) WHEN 3 THEN 'enc_' || md5(text) END AS item_id, p = 3 AS encrypted
      FROM conversations, range(4) g(p) WHERE turn % 5 <> 4""",
    "quota_windows": sql(WINDOWS),
    "model_catalog": f"""WITH {CATALOG} SELECT snapshot_id, CAST(p AS INTEGER) AS position, ids[p + 1] AS model_id
      FROM ids, range(3) g(p) WHERE p < len(ids)""",
    "model_catalog_merged": f"""WITH {CATALOG}, joined AS (
        SELECT snapshot_id, ids || ['m-1', 'gpt-5.5', 'm-9'] AS ids FROM ids),
      firsts AS (SELECT snapshot_id, ids[p] AS model_id, min(p) AS p FROM joined, range(1, 7) g(p) WHERE p <= len(ids)
        GROUP BY snapshot_id, ids[p])
      SELECT snapshot_id, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY p) - 1 AS INTEGER) AS position,
        model_id FROM firsts""",
    "auto_register": sql("""SELECT DISTINCT api_key, 'auto-' || right(api_key, 6) AS username, CAST(1 AS INTEGER) AS enabled,
      1706673600000 AS created_at, CAST(NULL AS BIGINT) AS expires_at, CAST(NULL AS BIGINT) AS daily_token_limit,
      CAST(NULL AS BIGINT) AS daily_request_limit, CAST(NULL AS BIGINT) AS rpm_limit, 'auto (transition)' AS note
      FROM usage WHERE api_key NOT IN (SELECT api_key FROM users)""", USERS),
    "users_after_changes": f"""WITH RECURSIVE {USERS}, {CHANGES}
      SELECT * EXCLUDE (n, top, seq, op, touched) FROM (SELECT *, max(n) OVER (PARTITION BY api_key) AS top FROM state)
      WHERE n = top AND username IS NOT NULL""",
    "user_change_counts": f"""WITH RECURSIVE {USERS}, {CHANGES}
      SELECT c.seq, c.op, count(s.seq) AS affected FROM changes c
      LEFT JOIN (SELECT seq FROM state WHERE touched) s ON s.seq = c.seq GROUP BY c.seq, c.op""",
    "duplicate_adds": f"""WITH {USERS}, fresh AS (
        SELECT 'k' || n AS api_key, CAST(c AS VARCHAR) AS note FROM (SELECT DISTINCT user_id AS n FROM events), range(1, 3) g(c)
        WHERE c = 1 OR n % 3 = 0)
      SELECT api_key, note FROM fresh WHERE api_key IN (SELECT api_key FROM users)
        OR api_key IN (SELECT api_key FROM fresh WHERE note = '2')""",
    "seed_user": f"""WITH {USERS} SELECT * FROM users UNION ALL SELECT 'shared-key', 'legacy', CAST(1 AS INTEGER), 1706673600000,
      CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'transition key'""",
    "limit_fields": """SELECT event_id, event_id % 3 <> 0 AS cli_written,
      CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN CAST(event_id % 5 AS VARCHAR) END AS cli_limit,
      CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS form_limit FROM events""",
    "auth_decision": auth(strict=False),
    "auth_decision_strict": auth(strict=True),
    "request_outcome": outcome(login=False),
    "request_outcome_login": outcome(login=True),
    "admission_replay": replayed(LIMITED, USERS),
    "admission_dense": replayed(DENSE),
    "admission_over_midnight": replayed(SLOW),
    "admission_request_limit": sql(f"""SELECT id, username, day, n - 1 AS earlier,
        CASE WHEN n > 8 THEN 'request_limit' ELSE 'ok' END AS decision
      FROM (SELECT id, username, {day_of('ts_ms - latency_ms')} AS day, row_number() OVER (
        PARTITION BY username, {day_of('ts_ms - latency_ms')} ORDER BY ts_ms - latency_ms, id) AS n FROM usage)"""),
    "quota_status": sql("""SELECT api_key, username, requests, tokens,
        CASE WHEN requests >= daily_request_limit THEN 'request_limit'
          WHEN tokens >= daily_token_limit THEN 'token_limit' ELSE 'ok' END AS status,
        CAST(greatest(daily_request_limit - requests, CASE WHEN daily_request_limit IS NOT NULL THEN 0 END) AS BIGINT) AS requests_left,
        CAST(greatest(daily_token_limit - tokens, CASE WHEN daily_token_limit IS NOT NULL THEN 0 END) AS BIGINT) AS tokens_left
      FROM (SELECT u.*, coalesce(c.requests, 0) AS requests, CAST(coalesce(c.tokens, 0) AS BIGINT) AS tokens
        FROM users u LEFT JOIN (SELECT username, count(*) AS requests, sum(input_tokens + output_tokens
          + cache_creation_tokens + cache_read_tokens) AS tokens FROM today GROUP BY username) c USING (username))""", USERS),
    "counter_events": sql(f"""SELECT username, day, CAST(sum(r) AS BIGINT) AS requests, CAST(sum(t) AS BIGINT) AS tokens
      FROM (SELECT username, {day_of('s')} AS day, 1 AS r, 0 AS t FROM reqs UNION ALL
        SELECT username, {day_of('e')}, 0, total FROM reqs WHERE total <> 0) GROUP BY username, day""", SLOW),
    "stream_ingest": sql(INGESTED),
    "stream_ingest_late": sql(INGESTED),
    "stream_ingest_moved": sql(INGESTED),
    "stream_day_counters_late": sql(f"""SELECT day, username, count(*) AS requests, CAST(coalesce(sum(input_tokens + output_tokens
      + cache_creation_tokens + cache_read_tokens), 0) AS BIGINT) AS tokens FROM ({INGESTED}) GROUP BY day, username"""),
    "stream_day_counters": sql("""SELECT day, username, count(*) AS requests, CAST(coalesce(sum(input_tokens + output_tokens
      + cache_creation_tokens + cache_read_tokens), 0) AS BIGINT) AS tokens FROM usage GROUP BY day, username"""),
    "stream_hour_totals": sql("""SELECT strftime(date_trunc('hour', ts + INTERVAL 8 HOUR), '%Y-%m-%d %H:%M:%S') AS window_start,
      count(*) AS reqs, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS io, CAST(sum(cost_micros) AS BIGINT) AS cost_micros
      FROM usage GROUP BY ALL"""),
    "stream_request_rate": sql("""SELECT strftime(make_timestamp((((ts_ms - latency_ms) // 10000 - k) * 10000 + 28800000) * 1000),
        '%Y-%m-%d %H:%M:%S') AS window_start, username, count(*) AS reqs
      FROM usage, range(6) g(k) GROUP BY ALL"""),
    "stream_admission": replayed(SLOW),
}

# The same reports through the stored cube.
ORACLE["dashboard_summary"] = ORACLE["summary"]
ORACLE["dashboard_by_day_user"] = ORACLE["by_day_user"]
ORACLE["dashboard_grid"] = ORACLE["grid_day_hour_user"]
ORACLE["command_all_days"] = ORACLE["by_day"].replace(" ORDER BY day DESC LIMIT 30", "")
ORACLE["command_by_user"] = ORACLE["by_user_rolling"]
