"""Usage windows out of account-quota snapshots."""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.clock import local_timestamp, ntz_text
from usagelens.functions.tokens import attach_document, is_falsy, member

# Texts of window labels and reset times.
LABEL_FIVE_HOURS, LABEL_WEEK, LABEL_OTHER = "5小时", "本周", "周期窗口"
LABEL_DAYS, LABEL_HOURS = " 天窗口", " 小时窗口"
RESET_AT, RESET_UNKNOWN = "重置于 ", "重置时间未知"
NAME_SEPARATOR = " · "

TEXT_KEYS = ("limit_name", "used_percent", "limit_window_seconds", "reset_at", "reset_after_seconds")

_HOUR, _DAY = 3_600, 86_400
# Lengths that count as five hours or a week, in seconds, and the used percent of each severity.
FIVE_HOURS = (4 * _HOUR, 6 * _HOUR)
WEEK = (6 * _DAY, 8 * _DAY)
HIGH, MEDIUM = 80, 50
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
_OFFSET = r"[T ].*(Z|[+-][0-9]{2}:[0-9]{2})$"


def number(value: Column) -> Column:
    """Number of a VARIANT (a number, a boolean or numeric text), else NULL."""
    text = F.to_json(value)
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(
        F.btrim(text, F.lit('"')).try_cast("double"))


def _is_text(value: Column) -> Column:
    return F.to_json(value).startswith('"')


def window_label(seconds: Column) -> Column:
    def rounded(unit):
        return F.bround(seconds / unit).cast("long").cast("string")

    return (
        F.when(seconds.between(*FIVE_HOURS), LABEL_FIVE_HOURS)
        .when(seconds.between(*WEEK), LABEL_WEEK)
        .when(seconds >= _DAY, F.concat(rounded(_DAY), F.lit(LABEL_DAYS)))
        .when(seconds >= _HOUR, F.concat(rounded(_HOUR), F.lit(LABEL_HOURS)))
        .otherwise(LABEL_OTHER)
    )


def reset_text(value: Column, fallback_seconds: Column, tz: str) -> Column:
    """Display time of a reset: epoch seconds or ISO text, else the fallback instant."""
    text = F.try_variant_get(value, "$", "string")
    is_text = _is_text(value)
    absent = value.isNull() | F.is_variant_null(value)
    iso = F.when(text.rlike(_ISO), text)
    with_offset = F.unix_micros(iso.try_cast("timestamp"))
    local_from_offset = local_timestamp(F.call_function("div", with_offset, F.lit(1000)), tz)
    local = F.when(iso.rlike(_OFFSET), local_from_offset).otherwise(iso.try_cast("timestamp_ntz"))
    seconds = F.when(absent, fallback_seconds).when(~is_text, number(value))
    from_number = local_timestamp(F.floor(seconds * 1000).cast("long"), tz)
    shown = F.when(~absent & is_text, local).otherwise(from_number)
    month_to_minute = F.substring(ntz_text(shown), 6, 11)
    return F.coalesce(F.concat(F.lit(RESET_AT), month_to_minute), F.lit(RESET_UNKNOWN))


def _either(value: Column, first: str, second: str) -> Column:
    """Member under its first name if truthy, else under the second."""
    a = member(value, f"$.{first}")
    return F.when(~is_falsy(F.to_json(a)), a).otherwise(member(value, f"$.{second}"))


def quota_windows(snapshots: DataFrame, tz: str) -> DataFrame:
    """Windows of every snapshot, free of account data.

    Columns: snapshot_id, position (payload order), label, used_percent, remaining_percent,
    severity, reset.  Windows without a usable percentage are left out.
    """
    parsed = attach_document(snapshots.select("snapshot_id", "fetched_at", "payload"), "payload", keys=TEXT_KEYS)
    doc = F.col("doc")
    extra = _either(doc, "additional_rate_limits", "additionalRateLimits").alias("extra")
    limits = parsed.select("snapshot_id", "fetched_at",
                           _either(doc, "rate_limit", "rateLimits").alias("main"), extra)
    more = F.coalesce(F.try_variant_get("extra", "$", "array<variant>"),
                      F.array().cast("array<variant>"))
    named = F.transform(
        F.filter(more, lambda item: _is_text(member(item, "$.limit_name"))),
        lambda item: F.struct(F.try_variant_get(item, "$.limit_name", "string").alias("name"),
                              _either(item, "rate_limit", "rateLimit").alias("limit")))
    first = F.array(F.struct(F.lit("").alias("name"), F.col("main").alias("limit")))
    rows = limits.select("snapshot_id", "fetched_at",
                         F.posexplode(F.concat(first, named)).alias("group", "entry"))
    windows = rows.select("snapshot_id", "fetched_at", "group", F.col("entry.name").alias("name"), F.posexplode(F.array(
        member(F.col("entry.limit"), "$.primary_window"),
        member(F.col("entry.limit"), "$.secondary_window"))).alias("half", "window"))
    window = F.col("window")
    percent = member(window, "$.used_percent")
    fields = windows.where(F.to_json(window).startswith("{")).select(
        "snapshot_id", (F.col("group") * 2 + F.col("half")).alias("position"), "name",
        F.when(percent.isNull(), F.lit(0.0)).otherwise(number(percent)).alias("used"),
        number(member(window, "$.limit_window_seconds")).alias("seconds"),
        member(window, "$.reset_at").alias("reset_at"),
        (F.col("fetched_at") / 1000 + number(member(window, "$.reset_after_seconds"))).alias("fallback"))
    shown = fields.where("used IS NOT NULL").select(
        "snapshot_id", "position", "name",
        F.least(F.greatest("used", F.lit(0.0)), F.lit(100.0)).alias("used_percent"),
        window_label(F.col("seconds")).alias("window_label"),
        reset_text(F.col("reset_at"), F.col("fallback"), tz).alias("reset"))
    used_percent = F.col("used_percent")
    label = F.when(F.col("name") == "", F.col("window_label")).otherwise(
        F.concat("name", F.lit(NAME_SEPARATOR), "window_label"))
    return shown.select(
        "snapshot_id", "position", label.alias("label"), "used_percent",
        (100.0 - used_percent).alias("remaining_percent"),
        F.when(used_percent >= HIGH, "high").when(used_percent >= MEDIUM, "medium").otherwise("low").alias("severity"),
        "reset")
