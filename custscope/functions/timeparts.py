"""Reference times, elapsed days and local-time features."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from custscope.schema import LOCAL_TIMEZONE, WEEKDAY_NAMES

MICROS_PER_DAY = 86_400_000_000


def as_utc(as_of: datetime | str | None) -> datetime:
    """None is now; a time without zone is taken as UTC."""
    if as_of is None:
        return datetime.now(tz=timezone.utc)
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    return as_of.replace(tzinfo=timezone.utc) if as_of.tzinfo is None else as_of.astimezone(timezone.utc)


def as_day(as_of: datetime | date | str | None) -> date:
    if isinstance(as_of, date) and not isinstance(as_of, datetime):
        return as_of
    return as_utc(as_of).date()


def instant(as_of: datetime | str | None) -> Column:
    """A constant timestamp that does not depend on the zone of the Python process."""
    moment = as_utc(as_of)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def days_before(as_of: datetime | str | None, days: int) -> Column:
    return instant(as_utc(as_of) - timedelta(days=days))


def window_start(as_of: datetime | str | None, months: int) -> Column:
    """Start of the trailing window; a month is a block of 30 days."""
    return days_before(as_of, 30 * months)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour blocks, rounded towards minus infinity."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def utc_day(ts: Column) -> Column:
    """Day number since 1970 in UTC, whatever the session zone."""
    return F.floor(F.unix_micros(ts) / F.lit(MICROS_PER_DAY)).cast("int")


def local_time(ts: Column, tz: str = LOCAL_TIMEZONE) -> Column:
    return F.from_utc_timestamp(ts, tz)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def weekday_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), weekday + 1)


def time_features(df, ts: str = "fecha", tz: str = LOCAL_TIMEZONE):
    """Adds año_mes, dia_semana (Monday = 0), dia_nombre and hora, all in local time."""
    local = local_time(F.col(ts), tz)
    return df.withColumns({
        "año_mes": month_key(local),
        "dia_semana": F.weekday(local),
        "dia_nombre": weekday_name(F.weekday(local)),
        "hora": F.hour(local),
    })
