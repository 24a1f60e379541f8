"""Local calendar parts of epoch milliseconds, independent of the session zone.

Only functions that keep TIMESTAMP_NTZ as it is are used: ``date_format`` and
``timestampdiff`` read it in the session zone and go wrong where its clock jumps.
"""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _fixed_offset_ms(tz: str) -> int | None:
    """Offset of a zone written as UTC or ``+hh:mm``; NULL for a named zone."""
    if tz == "UTC":
        return 0
    found = re.fullmatch(r"([+-])(\d\d):(\d\d)", tz)
    if not found:
        return None
    sign, hours, minutes = found.groups()
    return (1 if sign == "+" else -1) * (int(hours) * 60 + int(minutes)) * 60_000


def _shifted(ts_ms, tz: str) -> Column | None:
    """Milliseconds on the clock of a fixed-offset zone: integer arithmetic only."""
    offset = _fixed_offset_ms(tz)
    column = F.col(ts_ms) if isinstance(ts_ms, str) else ts_ms
    return None if offset is None else column + offset


def _floor_div(column: Column, by: int) -> Column:
    """Division that rounds down, also before 1970."""
    by = F.lit(by).cast("long")
    return F.call_function("div", column - F.pmod(column, by), by)


def local_timestamp(ts_ms, tz: str) -> Column:
    """Wall-clock time in ``tz`` as TIMESTAMP_NTZ."""
    shifted = _shifted(ts_ms, tz)
    if shifted is not None:
        return F.timestamp_add("MILLISECOND", shifted, _epoch())
    utc = F.timestamp_add("MILLISECOND", ts_ms, _epoch())
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def _ntz_ms(value: Column) -> Column:
    """Milliseconds of a TIMESTAMP_NTZ since 1970 on its own clock, cut to the millisecond."""
    days = F.unix_date(value.cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(value) * 3_600 + F.minute(value) * 60
    return seconds * 1_000 + F.floor(F.date_part(F.lit("SECOND"), value) * 1_000).cast("long")


def epoch_ms(ts_ntz, tz: str = "UTC") -> Column:
    """Epoch milliseconds of a wall-clock TIMESTAMP_NTZ column read in ``tz``."""
    value = F.col(ts_ntz) if isinstance(ts_ntz, str) else ts_ntz
    return _ntz_ms(value if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), value))


def ntz_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a TIMESTAMP_NTZ."""
    return F.substring(value.cast("string"), 1, 19)


def wall_clock(ts_ms, tz: str) -> Column:
    """Wall-clock time in ``tz`` as a TIMESTAMP that reads so in UTC.

    Watermarks need TIMESTAMP, and time windows are aligned to UTC, so windows
    over this column are local days and hours.
    """
    return F.timestamp_millis(_ntz_ms(local_timestamp(ts_ms, tz)))


def wall_clock_text(instant) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a ``wall_clock`` value, whatever the session zone is."""
    return ntz_text(F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch()))


def local_day(ts_ms, tz: str) -> Column:
    """Calendar day as ``yyyy-MM-dd`` text."""
    shifted = _shifted(ts_ms, tz)
    if shifted is not None:
        return F.date_from_unix_date(_floor_div(shifted, DAY_MS).cast("int")).cast("string")
    return local_timestamp(ts_ms, tz).cast("date").cast("string")


def local_hour(ts_ms, tz: str) -> Column:
    shifted = _shifted(ts_ms, tz)
    if shifted is not None:
        return _floor_div(F.pmod(shifted, F.lit(DAY_MS).cast("long")), HOUR_MS).cast("int")
    return F.hour(local_timestamp(ts_ms, tz))


def local_day_start_ms(day: date, tz: str) -> int:
    """Epoch milliseconds of local midnight, for parameters."""
    offset = _fixed_offset_ms(tz)
    zone = ZoneInfo(tz) if offset is None else timezone(timedelta(milliseconds=offset))
    return int(datetime(day.year, day.month, day.day, tzinfo=zone).timestamp() * 1000)


def expiry_ms(now_ms, days) -> Column:
    """Instant ``days`` (fractions allowed) after ``now_ms``; no days means no expiry."""
    days = days if isinstance(days, Column) else F.lit(days)
    now = F.col(now_ms) if isinstance(now_ms, str) else F.lit(now_ms)
    return F.when(F.coalesce(days, F.lit(0)) != 0, now + (days * DAY_MS).cast("long"))


def expiry_day(expires_at, tz: str) -> Column:
    """Display day of an expiry; NULL when the key never expires."""
    value = F.col(expires_at) if isinstance(expires_at, str) else expires_at
    return F.when(F.coalesce(value, F.lit(0)) != 0, local_day(value, tz))


def days_back(as_of: date, days: int) -> str:
    return (as_of - timedelta(days=days)).isoformat()
