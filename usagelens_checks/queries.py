"""One registered query per operator; each reads the whole given tables."""

from pyspark.sql import functions as F

from usagelens.functions.clock import expiry_day, expiry_ms, local_day, local_hour, local_timestamp, ntz_text
from usagelens.functions.labels import client_class, model_family, user_tag
from usagelens.functions.pricing import attach_cost, attach_prices, default_prices
from usagelens.operators import account_quota, admission, auth, catalog, extract, quota, reprice, surrogate
from usagelens.operators import users as user_ops
from usagelens.plans import filters, ranking, reports, reshape
from usagelens.plans.dashboard import command_report, dashboard
from usagelens.plans.cube import stored_cube, usage_cube
from usagelens.runtime import work_folder
from usagelens.sources.ledger import append_usage, conform, list_users, read_usage
from usagelens.streaming import admission as stream_admission
from usagelens.streaming import counters as stream_counters
from usagelens.streaming import sinks
from usagelens.streaming.ingest import ingest
from usagelens_checks import tables as t
from usagelens_checks.tables import AS_OF, NOW_MS, TZ

BOOK = default_prices()
LIMITS = ("daily_token_limit", "daily_request_limit", "rpm_limit")


def _cube(spark, sf_dir):
    """The cube of all days, stored: for shapes that read their input more than once."""
    return stored_cube(t.ledger(spark, sf_dir), TZ)


def _report(function, *args, **kwargs):
    return lambda spark, sf_dir: function(t.ledger(spark, sf_dir), *args, **kwargs)


def _today(function, *args, **kwargs):
    return lambda spark, sf_dir: function(t.ledger(spark, sf_dir), AS_OF, *args, **kwargs)


# --- sources ---------------------------------------------------------------

def usage_ingest(spark, sf_dir):
    path = work_folder(spark, "ledger")
    append_usage(t.ledger(spark, sf_dir), path)
    return read_usage(spark, path)


def schema_evolve(spark, sf_dir):
    """Rows written before the client column existed, read with the present layout."""
    rows = t.ledger(spark, sf_dir)
    path = work_folder(spark, "old-ledger")
    rows.drop("client").write.partitionBy("day").parquet(path)
    return read_usage(spark, path).unionByName(conform(rows.drop("error", "client")))


def price_table(spark, sf_dir):
    """The price book with the number of ledger rows each prefix prices."""
    rows = attach_prices(t.ledger(spark, sf_dir), BOOK).where("priced")
    counts = rows.groupBy(F.col("price.prefix").alias("prefix")).agg(F.count(F.lit(1)).alias("priced_rows"))
    return BOOK.dataframe(spark).join(counts, "prefix", "left").withColumn("priced_rows", F.coalesce("priced_rows", F.lit(0)))


# --- enrichment ------------------------------------------------------------

def price_lookup(spark, sf_dir):
    rows = attach_prices(t.ledger(spark, sf_dir), BOOK)
    parts = [F.coalesce(F.col(f"price.{part}"), F.lit(0)).cast("long").alias(part)
             for part in ("in_milli", "out_milli", "cw_milli", "cr_milli")]
    return rows.select("id", "model", "priced", *parts)


def price_lookup_joined(spark, sf_dir):
    """The same lookup through the join that long price books take."""
    rows = attach_prices(t.ledger(spark, sf_dir), BOOK, inline_prefixes=0)
    return rows.select("id", F.coalesce(F.col("price.in_milli"), F.lit(0)).cast("long").alias("in_milli"), "priced")


def usage_cost(spark, sf_dir):
    rows = attach_cost(t.ledger(spark, sf_dir).drop("cost_micros"), BOOK)
    return rows.select("id", "cost_micros", (F.col("cost_micros") / 1_000_000).alias("cost_usd"))


def _agents(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    return events.select("event_id", t._pick(t.AGENTS, F.col("event_id") % 6).alias("user_agent"))


def client_classes(spark, sf_dir):
    return _agents(spark, sf_dir).select("event_id", client_class("user_agent").alias("client"))


def model_families(spark, sf_dir):
    return t.ledger(spark, sf_dir).select("id", model_family("model").alias("family"))


def user_tags(spark, sf_dir):
    return t.ledger(spark, sf_dir).select("id", "username", user_tag("username").alias("tag"))


def local_time_parts(spark, sf_dir):
    rows = t.ledger(spark, sf_dir)
    stamp = ntz_text(local_timestamp("ts_ms", TZ))
    return rows.select("id", local_day("ts_ms", TZ).alias("local_day"),
                       local_hour("ts_ms", TZ).alias("local_hour"), stamp.alias("local_time"))


def key_expiry(spark, sf_dir):
    """Expiry instants a number of days after each event, and their display day."""
    rows = t.ledger(spark, sf_dir).withColumn("expires_at", expiry_ms("ts_ms", F.col("id") % 4 * 1.5))
    return rows.select("id", "expires_at", expiry_day("expires_at", TZ).alias("expires_on"))


# --- filters ---------------------------------------------------------------

def _by_user_in(name=None, username=None, days=None):
    def query(spark, sf_dir):
        rows = t.ledger(spark, sf_dir)
        if days is not None:
            rows = filters.rolling_days(filters.in_scope(rows, username), NOW_MS, days, TZ)
        else:
            rows = filters.select_usage(rows, AS_OF, name, username)
        return reports.by_user(rows)
    return query


def priced_with_tokens(spark, sf_dir):
    rows = attach_prices(t.ledger(spark, sf_dir), BOOK)
    return rows.where(filters.has_tokens() & F.col("priced")).select("id", "model")


# --- reshaping and ranking -------------------------------------------------

def active_families(spark, sf_dir):
    return reshape.active_buckets(reshape.pivot_user_family(t.ledger(spark, sf_dir)), reshape.family_names())


def chart_users(spark, sf_dir):
    return ranking.chart_totals(reports.by_user(_cube(spark, sf_dir)), "username")


def share_of_max(spark, sf_dir):
    return ranking.share_of_max(
        reports.by_user(_cube(spark, sf_dir)).select("username", "cost_micros"), "cost_micros")


def model_share(metric):
    def query(spark, sf_dir):
        rows = ranking.chart_totals(reports.by_model(_cube(spark, sf_dir)), "model")
        return ranking.share_of_total(rows, metric).select("model", metric, "share")
    return query


def rank_users(metric):
    def query(spark, sf_dir):
        return ranking.rank_users(chart_users(spark, sf_dir), metric).select("username", metric, "rank")
    return query


def rpm_trailing(spark, sf_dir):
    rows = t.requests(spark, sf_dir).select("id", "username", "start_ms")
    return ranking.rpm_trailing(rows, TZ)


def rpm_trailing_dense(spark, sf_dir):
    rows = t.dense_requests_of(t.table(spark, sf_dir, "events")).select("id", "username", "start_ms")
    return ranking.rpm_trailing(rows, TZ)


def day_user_wide(spark, sf_dir):
    return reshape.day_user_wide(t.ledger(spark, sf_dir), ["legacy", "u2", "u3"])


def _dashboard(name):
    return lambda spark, sf_dir: dashboard(t.ledger(spark, sf_dir), AS_OF, TZ, "all")[name]


def _command(name, days=2.5, **options):
    return lambda spark, sf_dir: command_report(t.ledger(spark, sf_dir), NOW_MS, TZ, days, **options)[name]


# --- re-pricing ------------------------------------------------------------

def _stale(spark, sf_dir):
    """The ledger with the cost of some rows out of date."""
    rows = t.ledger(spark, sf_dir)
    old = F.when(F.col("id") % 3 == 0, F.col("cost_micros")).when(F.col("id") % 3 == 1, F.col("cost_micros") + 7)
    return rows.withColumn("cost_micros", old)


def reprice_written(spark, sf_dir):
    """A stale ledger re-priced where it is, twice."""
    path = work_folder(spark, "stale-ledger")
    append_usage(_stale(spark, sf_dir), path)
    for _ in range(2):
        reprice.reprice_ledger(spark, path, BOOK)
    return read_usage(spark, path).select("id", "day", "cost_micros")


def usage_cost_signed(spark, sf_dir):
    """Costs of a ledger with negative output and cache-write counts."""
    rows = t.ledger(spark, sf_dir).drop("cost_micros")
    sign = F.when(F.col("id") % 4 == 1, -1).otherwise(1)
    signed = rows.withColumns({name: F.col(name) * sign for name in ("output_tokens", "cache_creation_tokens")})
    return attach_cost(signed, BOOK).select("id", "cost_micros")


def reprice_apply(spark, sf_dir):
    return reprice.reprice_apply(_stale(spark, sf_dir), BOOK).select("id", "day", "cost_micros")


# --- extraction ------------------------------------------------------------

def extract_json_usage(spark, sf_dir):
    return extract.extract_json_usage(t.raw_responses_of(t.ledger(spark, sf_dir)))


def extract_sse_usage(spark, sf_dir):
    return extract.extract_sse_usage(t.raw_chunks_of(t.ledger(spark, sf_dir)))


def extract_sse_usage_long(spark, sf_dir):
    return extract.extract_sse_usage(t.long_chunks_of(t.table(spark, sf_dir, "documents")))


def request_facts(spark, sf_dir):
    rows = extract.request_facts(t.request_log_of(t.ledger(spark, sf_dir)))
    return rows.select("request_id", "model", "stream", "client", "api_key")


def _finished(usage):
    log = extract.request_facts(t.request_log_of(usage)).select("request_id", "model", "stream", "client")
    facts = usage.select(F.col("id").alias("request_id"), "username", "api_key", "ts_ms", "status", "path",
                         (F.col("ts_ms") - F.col("latency_ms")).alias("start_ms"),
                         F.when(F.col("status") != 200, F.repeat(F.lit("upstream "), 40)).alias("error"))
    return facts.join(log, "request_id")


def usage_assemble(spark, sf_dir):
    usage = t.ledger(spark, sf_dir)
    counts = extract.extract_sse_usage(t.raw_chunks_of(usage))
    return extract.assemble_usage(_finished(usage), counts, BOOK, TZ)


def surrogate_ids(spark, sf_dir):
    return surrogate.surrogate_ids(t.items_of(t.table(spark, sf_dir, "conversations")))


def request_items_long(spark, sf_dir):
    return surrogate.surrogate_ids(surrogate.request_items(t.long_payloads_of(t.table(spark, sf_dir, "conversations"))))


def request_facts_long(spark, sf_dir):
    rows = extract.request_facts(t.long_payloads_of(t.table(spark, sf_dir, "conversations")))
    return rows.select("request_id", "model", "stream")


def request_items(spark, sf_dir):
    return surrogate.request_items(t.item_payloads_of(t.table(spark, sf_dir, "conversations")))


def quota_windows(spark, sf_dir):
    return account_quota.quota_windows(t.quota_snapshots_of(t.table(spark, sf_dir, "events")), TZ)


def model_catalog(spark, sf_dir):
    return catalog.model_catalog(t.catalog_snapshots_of(t.table(spark, sf_dir, "events")))


def model_catalog_merged(spark, sf_dir):
    snapshots = t.catalog_snapshots_of(t.table(spark, sf_dir, "events"))
    return catalog.model_catalog_merged(snapshots, ["m-1", "gpt-5.5", "m-9"])


# --- users, authentication, quotas ----------------------------------------

def users_list(spark, sf_dir):
    return list_users(t.users(spark, sf_dir), mask_keys=False).withColumn("expires_on", expiry_day("expires_at", TZ))


def users_summary(spark, sf_dir):
    return reports.users_summary(t.users(spark, sf_dir))


def auto_register(spark, sf_dir):
    return user_ops.auto_register(t.users(spark, sf_dir), t.ledger(spark, sf_dir), NOW_MS)


def users_after_changes(spark, sf_dir):
    return user_ops.apply_user_changes(t.users(spark, sf_dir), t.changes_of(t.table(spark, sf_dir, "events")))


def user_change_counts(spark, sf_dir):
    return user_ops.change_counts(t.users(spark, sf_dir), t.changes_of(t.table(spark, sf_dir, "events")))


def _new_users(spark, sf_dir):
    """One user for each given id, every third of them twice; the keys of most ids exist."""
    ids = t.table(spark, sf_dir, "events").select("user_id").distinct()
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("user_id") % 3 == 0, 2).otherwise(1)))
    return ids.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("api_key"), copies.alias("_copy")).select(
        "api_key", F.col("_copy").cast("string").alias("note"))


def duplicate_adds(spark, sf_dir):
    return user_ops.duplicate_adds(t.users(spark, sf_dir), _new_users(spark, sf_dir))


def seed_user(spark, sf_dir):
    """Users with the shared account, which is new, and with one whose key exists."""
    seeded = user_ops.seed_user(t.users(spark, sf_dir), "shared-key", NOW_MS)
    return user_ops.seed_user(seeded, "k1", NOW_MS)


def limit_fields(spark, sf_dir):
    """Limits as the command and the form write them."""
    n = F.col("event_id")
    given = F.when(n % 3 != 0, n % 5).cast("long")
    box = F.concat(F.when(n % 2 == 0, " ").otherwise(""), F.when(n % 7 == 0, "x").otherwise(""), n.cast("string"))
    events = t.table(spark, sf_dir, "events")
    fields = events.select("event_id", user_ops.cli_limit_fields(rpm_limit=given).alias("cli"),
                           user_ops.form_limit_fields(rpm_limit=box).alias("form"))
    return fields.select(
        "event_id", F.map_contains_key("cli", "rpm_limit").alias("cli_written"),
        F.try_element_at("cli", F.lit("rpm_limit")).alias("cli_limit"),
        F.try_element_at("form", F.lit("rpm_limit")).alias("form_limit"))


def auth_decision(strict):
    def query(spark, sf_dir):
        rows = auth.auth_decision(t.requests(spark, sf_dir), t.users(spark, sf_dir), strict)
        return rows.select("id", "auth", "username", "registered")
    return query


def _limited(spark, sf_dir):
    """Every request with the limits of its own key; unknown keys have none."""
    limits = t.users(spark, sf_dir).select("api_key", *LIMITS)
    return t.requests(spark, sf_dir).join(limits, "api_key", "left")


def admission_replay(spark, sf_dir):
    return admission.admission_replay(_limited(spark, sf_dir), TZ)


def admission_dense(spark, sf_dir):
    return admission.admission_replay(t.dense_requests_of(t.table(spark, sf_dir, "events")), TZ)


def admission_over_midnight(spark, sf_dir):
    return admission.admission_replay(t.slow_requests_of(t.table(spark, sf_dir, "events")), TZ)


def admission_request_limit(spark, sf_dir):
    rows = t.requests(spark, sf_dir).withColumn("daily_request_limit", F.lit(8))
    return quota.admission_request_limit(rows, TZ).select("id", "username", "day", "earlier", "decision")


def request_outcome(login_mode):
    def query(spark, sf_dir):
        rows = t.judged_requests_of(t.ledger(spark, sf_dir))
        judged = auth.auth_decision(rows, t.users(spark, sf_dir), strict=True)
        # Only authenticated requests reach the quota.
        decided = admission.admission_replay(judged.where("auth = 'ok'"), TZ).select(
            "id", F.col("decision").alias("admission"))
        outcome = auth.request_outcome(judged.join(decided, "id", "left"), login_mode)
        return outcome.select("id", "http_status", "outcome", "recorded")
    return query


def quota_status(spark, sf_dir):
    return quota.quota_status(t.users(spark, sf_dir), reports.today_counters(t.ledger(spark, sf_dir), AS_OF))


def counter_events(spark, sf_dir):
    return quota.counter_events(t.slow_requests_of(t.table(spark, sf_dir, "events")), TZ)


# --- streaming -------------------------------------------------------------

def _stream(spark, sf_dir):
    return t.table_stream(spark, sf_dir, "events")


def _ingested(spark, responses):
    path = work_folder(spark, "stream-ledger")
    ingest(responses, BOOK, TZ, f"{path}/rows", f"{path}/state").awaitTermination()
    return read_usage(spark, f"{path}/rows")


def stream_ingest(spark, sf_dir):
    """JSON bodies and event streams of all requests in one batch."""
    return _ingested(spark, t.finished_responses_of(t.ledger_of(_stream(spark, sf_dir))))


def stream_ingest_late(spark, sf_dir):
    """The same in three batches that each go over all days, with repeated deliveries."""
    rows = t.finished_responses_of(t.ledger(spark, sf_dir))
    return _ingested(spark, t.stream_of_parts(rows, work_folder(spark, "responses")))


def stream_ingest_moved(spark, sf_dir):
    """Requests that are delivered again under a later day."""
    rows = t.finished_responses_of(t.ledger(spark, sf_dir))
    return _ingested(spark, t.moved_deliveries(rows, work_folder(spark, "responses")))


def _live(spark, rows, aggregate, keys, compact=False):
    path = work_folder(spark, "stream-counters")
    sinks.write_partials(rows, aggregate, f"{path}/rows", f"{path}/state", keys=keys).awaitTermination()
    if compact:
        sinks.compact_partials(spark, f"{path}/rows", keys)
    return sinks.read_partials(spark, f"{path}/rows", keys)


def stream_day_counters(spark, sf_dir):
    rows = t.ledger_of(_stream(spark, sf_dir))
    return _live(spark, rows, lambda batch: stream_counters.day_counters(batch, TZ), ["day", "username"])


def stream_day_counters_late(spark, sf_dir):
    """Counters over batches that each go over all days; repeated deliveries are removed by the ledger before."""
    ledger = stream_ingest_late(spark, sf_dir)
    path = work_folder(spark, "ledger-parts")
    files = t.files_of_batch(ledger, 3)
    t.add_files(ledger, path, 3 * files, "id")
    rows = t.stream_of_files(ledger, path, files)
    return _live(spark, rows, lambda batch: stream_counters.day_counters(batch, TZ), ["day", "username"], compact=True)


def stream_hour_totals(spark, sf_dir):
    rows = t.ledger_of(_stream(spark, sf_dir))
    return _live(spark, rows, lambda batch: stream_counters.window_totals(batch, TZ), ["window_start"])


def stream_request_rate(spark, sf_dir):
    rows = t.requests_of(t.ledger_of(_stream(spark, sf_dir)))
    return _live(spark, rows, lambda batch: stream_counters.request_rate(batch, TZ), ["window_start", "username"])


def stream_admission_decisions(spark, sf_dir):
    path = work_folder(spark, "stream-admission")
    stream_admission.admission_stream(
        t.slow_requests_of(_stream(spark, sf_dir)), TZ, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("id", "username", "day", "decision")


QUERIES = {
    "usage_base": lambda s, d: t.ledger(s, d),
    "usage_ingest": usage_ingest,
    "schema_evolve": schema_evolve,
    "price_table": price_table,
    "users_list": users_list,
    "price_lookup": price_lookup,
    "price_lookup_joined": price_lookup_joined,
    "usage_cost": usage_cost,
    "client_class": client_classes,
    "model_family": model_families,
    "user_tag": user_tags,
    "local_time_parts": local_time_parts,
    "key_expiry": key_expiry,
    "by_user_today": _by_user_in("today"),
    "by_user_period": _by_user_in("period"),
    "by_user_7": _by_user_in("7"),
    "by_user_scoped": _by_user_in("30", username="u5"),
    "by_user_rolling": _by_user_in(days=2.5),
    "by_user_all_time": _by_user_in(days=0),
    "priced_with_tokens": priced_with_tokens,
    "usage_cube": lambda s, d: usage_cube(t.ledger(s, d), TZ),
    "by_user": _report(reports.by_user),
    "by_day": _report(reports.by_day),
    "by_model": _report(reports.by_model),
    "by_user_client": _report(reports.by_user_client),
    "by_user_model": _report(reports.by_user_model),
    "by_user_model_raw": _report(reports.by_user_model, label=False),
    "by_day_user": _report(reports.by_day_user),
    "by_day_user_model": _report(reports.by_day_user_model),
    "today_hour_user": _today(reports.today_hour_user, TZ),
    "by_day_hour_user": _report(reports.by_day_hour_user, TZ),
    "by_hour_of_day": _report(reports.by_hour_of_day, TZ),
    "today_counters": _today(reports.today_counters),
    "summary": _report(reports.summary),
    "users_summary": users_summary,
    "pivot_user_family": _report(reshape.pivot_user_family),
    "pivot_user_client": _report(reshape.pivot_user_client),
    "active_buckets": active_families,
    "day_user_matrix": _report(reshape.day_user_matrix),
    "day_user_wide": day_user_wide,
    "series_user_day": _report(reshape.series_user_day),
    "series_user_model_day": _report(reshape.series_user_model_day),
    "series_model_user_day": _report(reshape.series_model_user_day),
    "grid_day_hour_user": _report(reshape.grid_day_hour_user, TZ),
    "hours_dense": _report(reshape.hours_dense, TZ),
    "series_total": _report(reshape.series_total),
    "today_hour_cube": _today(reshape.today_hour_cube, TZ),
    "today_hour_scoped": _today(reshape.today_hour_scoped, TZ, "u5"),
    "share_of_max": share_of_max,
    "model_share": model_share("cost_micros"),
    "model_share_tokens": model_share("tok"),
    "rank_users": rank_users("cost_micros"),
    "rank_users_tokens": rank_users("tok"),
    "dashboard_summary": _dashboard("summary"),
    "dashboard_by_day_user": _dashboard("by_day_user"),
    "dashboard_grid": _dashboard("grid_day_hour_user"),
    "command_by_user": _command("by_user"),
    "command_all_days": _command("by_day", days=None, newest=None),
    "rpm_trailing": rpm_trailing,
    "rpm_trailing_dense": rpm_trailing_dense,
    "reprice_preview": lambda s, d: reprice.reprice_preview(_stale(s, d), BOOK),
    "reprice_apply": reprice_apply,
    "reprice_written": reprice_written,
    "usage_cost_signed": usage_cost_signed,
    "extract_json_usage": extract_json_usage,
    "extract_sse_usage": extract_sse_usage,
    "extract_sse_usage_long": extract_sse_usage_long,
    "request_facts": request_facts,
    "request_facts_long": request_facts_long,
    "request_items_long": request_items_long,
    "usage_assemble": usage_assemble,
    "surrogate_ids": surrogate_ids,
    "request_items": request_items,
    "quota_windows": quota_windows,
    "model_catalog": model_catalog,
    "model_catalog_merged": model_catalog_merged,
    "auto_register": auto_register,
    "users_after_changes": users_after_changes,
    "user_change_counts": user_change_counts,
    "duplicate_adds": duplicate_adds,
    "seed_user": seed_user,
    "limit_fields": limit_fields,
    "auth_decision": auth_decision(strict=False),
    "auth_decision_strict": auth_decision(strict=True),
    "request_outcome": request_outcome(login_mode=False),
    "request_outcome_login": request_outcome(login_mode=True),
    "admission_replay": admission_replay,
    "admission_dense": admission_dense,
    "admission_over_midnight": admission_over_midnight,
    "admission_request_limit": admission_request_limit,
    "quota_status": quota_status,
    "counter_events": counter_events,
    "stream_ingest": stream_ingest,
    "stream_ingest_late": stream_ingest_late,
    "stream_ingest_moved": stream_ingest_moved,
    "stream_day_counters": stream_day_counters,
    "stream_day_counters_late": stream_day_counters_late,
    "stream_hour_totals": stream_hour_totals,
    "stream_request_rate": stream_request_rate,
    "stream_admission": stream_admission_decisions,
}
