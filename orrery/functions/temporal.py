"""Timestamps and intervals: literals, ISO rendering and field extraction."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import SchemaError

_UNITS = (("W", "weeks"), ("D", "days"), ("H", "hours"), ("M", "minutes"), ("S", "seconds"))
_NUMBER = r"(\d+(?:\.\d+)?)"
_DURATION = re.compile(rf"P(?:{_NUMBER}W)?(?:{_NUMBER}D)?(?:T(?:{_NUMBER}H)?(?:{_NUMBER}M)?(?:{_NUMBER}S)?)?", re.IGNORECASE)
FIELDS = ("year", "month", "day", "hour", "minute", "second", "microsecond")


def check_timezone(name: str) -> str:
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise SchemaError(f"no time zone is called {name!r}") from e
    return name


def parse_interval(text: str) -> timedelta:
    """An ISO-8601 duration of weeks, days, hours, minutes and seconds; calendar months and years have no fixed length."""
    m = _DURATION.fullmatch(text) if isinstance(text, str) else None
    given = [g for g in m.groups() if g is not None] if m else []
    if not given or (not any(map(float, given)) and text.upper() != "P0D"):
        raise SchemaError(f"{text!r} is not an interval such as P1D, PT3H or P2DT6H")
    total = timedelta(**{unit: float(g or 0) for (_, unit), g in zip(_UNITS, m.groups())})
    return timedelta(microseconds=int(total / timedelta(microseconds=1)))


def parse_timestamp(value: object, timezone: str | None = None) -> datetime:
    """An aware datetime in UTC from µs since the epoch, a datetime or ISO-8601 text; naive ones need ``timezone``."""
    if isinstance(value, bool):
        raise SchemaError("a boolean is not a timestamp")
    if isinstance(value, int):
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=value)
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(re.sub(r"[zZ]$", "+00:00", value.strip()))
        except ValueError as e:
            raise SchemaError(f"{value!r} is not an ISO-8601 timestamp") from e
    if not isinstance(value, datetime):
        raise SchemaError(f"{type(value).__name__} is not a timestamp")
    if value.tzinfo is None:
        if timezone is None:
            raise SchemaError("a timestamp without an offset needs a configured time zone")
        value = value.replace(tzinfo=ZoneInfo(check_timezone(timezone)))
    return value.astimezone(UTC)


def iso_text(ts: Column) -> Column:
    """ISO-8601 in UTC with a Z; the fraction is left out where it is zero. The session's zone has to be UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.unix_micros(ts) % 1_000_000
    fraction = F.when(micro == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(F.pmod(micro, F.lit(1_000_000)).cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("Z"))


def time_fields(ts: Column, fields: list[str], timezone: str = "UTC") -> Column:
    """The named components in a zone, as an array of longs; null for null."""
    local = F.from_utc_timestamp(ts, check_timezone(timezone))
    parts = {
        "year": F.year(local),
        "month": F.month(local),
        "day": F.dayofmonth(local),
        "hour": F.hour(local),
        "minute": F.minute(local),
        "second": F.second(local),
        "microsecond": F.pmod(F.unix_micros(ts), F.lit(1_000_000)),
    }
    wrong = [f for f in fields if f.casefold() not in parts]
    if wrong:
        raise SchemaError(f"unknown time field {wrong[0]!r}; known are {', '.join(FIELDS)}")
    return F.when(ts.isNotNull(), F.array(*[parts[f.casefold()].cast("long") for f in fields]))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)
