"""Time functions. They take TIMESTAMP, or TIMESTAMP_NTZ read in the session's time zone, and give TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of each unit of a duration.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def epoch() -> Column:
    return F.timestamp_seconds(F.lit(0))


def parse_compact(s: Column) -> Column:
    """yyyyMMddHHmmss; missing parts are the least valid ones. NULL for anything else."""
    full = F.concat(s, F.substring(F.lit("00000101000000"), F.char_length(s) + 1, F.lit(14)))
    return F.when(s.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8}|[0-9]{10}|[0-9]{12}|[0-9]{14})$"), F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))


def make(year, month, day, hour=0, minute=0, second=0) -> Column:
    return F.make_timestamp(*(x if isinstance(x, Column) else F.lit(x) for x in (year, month, day, hour, minute, second)))


def iso8601(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc1123(t: Column) -> Column:
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def from_date_text(s: Column) -> Column:
    """Either of the two forms above."""
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(F.substring(s, 6, 64), F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))


def parts(t: Column) -> Column:
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"), F.weekday(t).alias("weekday"))


def plus(t: Column, n: Column, unit: str = "second") -> Column:
    return F.timestamp_micros(_micros(t) + n * (UNITS[unit] * 1_000_000))


def between_in(a: Column, b: Column, unit: str = "second") -> Column:
    """Whole units from a to b."""
    return F.call_function("div", _micros(b) - _micros(a), F.lit(UNITS[unit] * 1_000_000))


def with_base(t: Column, per_second: int) -> Column:
    """Ticks since the epoch, so many a second."""
    return F.call_function("div", _micros(t) * per_second, F.lit(1_000_000))


def to_local(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(t, zone)


def to_utc(t: Column, zone: str) -> Column:
    return F.to_utc_timestamp(t, zone)
