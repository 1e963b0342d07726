"""Column expressions shared by the operators: times, rounding, labels."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlark import schemas as S

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def moment(value: str | datetime | Column) -> Column:
    """A UTC instant; literals fold, so comparisons with them reach the scan."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp")


def seconds_of(span: str | timedelta | int | float) -> float:
    """Length of a span such as ``"5 minutes"``."""
    if isinstance(span, timedelta):
        return span.total_seconds()
    if isinstance(span, (int, float)):
        return float(span)
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(second|minute|hour|day|week)s?\s*", span)
    if not match:
        raise ValueError(f"not a span of time: {span!r}")
    return float(match.group(1)) * _UNIT_SECONDS[match.group(2)]


def micros_of(span: str | timedelta | int | float) -> int:
    return int(seconds_of(span) * 1_000_000)


def before(instant: str | datetime | Column, span: str | timedelta | int | float) -> Column:
    """The instant lying one span earlier."""
    return moment(instant) - F.make_dt_interval(secs=F.lit(seconds_of(span)))


def round2(value: Column) -> Column:
    """Two decimals, halves up (towards positive infinity)."""
    return F.floor(value * 100 + 0.5) / F.lit(100.0)


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two instants, with their fraction."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60_000_000.0)


def whole_minutes(start: Column, end: Column) -> Column:
    """Completed minutes, cut towards zero."""
    return elapsed_minutes(start, end).cast("long")


def alert_type(raw: Column) -> Column:
    """A known alert type; null and unknown names count as SPEEDING."""
    upper = F.upper(raw)
    return F.when(upper.isin(*S.ALERT_TYPES), upper).otherwise(F.lit(S.SPEEDING))


def alert_group(raw: Column) -> Column:
    """SPEEDING, GEOFENCE or IDLE, as the alert feed groups them."""
    upper = F.upper(raw)
    return (F.when(upper.contains("GEOFENCE"), F.lit("GEOFENCE"))
            .when(upper == S.IDLE, F.lit(S.IDLE))
            .otherwise(F.lit(S.SPEEDING)))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Value for a key from a short fixed table."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit(default))


def age_text(seen: Column, as_of: Column) -> Column:
    """How long ago in words."""
    minutes = whole_minutes(seen, as_of)
    count = lambda per: F.floor(minutes / per).cast("string")
    return (F.when(seen.isNull(), "Never")
            .when(minutes < 1, "Just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
            .when(minutes < 1440, F.concat(count(60), F.lit(" hr ago")))
            .otherwise(F.concat(count(1440), F.lit(" days ago"))))


def vehicle_status(seen: Column, speed: Column, as_of: Column, rule: str = "service", *,
                   idle_minutes: float = 10, offline_minutes: float = 30) -> Column:
    """ONLINE, IDLE or OFFLINE by one of the three rules in use."""
    if rule == "service":
        idle_after = whole_minutes(seen, as_of)
        slow = speed <= S.IDLE_SPEED_KPH
    elif rule == "dashboard":
        idle_after = elapsed_minutes(seen, as_of)
        slow = speed < 5
    elif rule == "backfill":
        return (F.when(seen >= before(as_of, "1 minute"), "ONLINE")
                .when(seen >= before(as_of, "5 minutes"), "IDLE")
                .otherwise("OFFLINE"))
    else:
        raise ValueError(f"unknown status rule: {rule!r}")
    return (F.when(seen.isNull() | (idle_after > offline_minutes), "OFFLINE")
            .when(slow | (idle_after > idle_minutes), "IDLE")
            .otherwise("ONLINE"))
