"""Candle intervals and the question whether a candle that started at ``ts`` is complete at ``now``.

Column arguments are local (exchange) wall-clock times without zone; ``to_local`` converts instants.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Kolkata"
CLOSE_HOUR = 16


@dataclass(frozen=True)
class Interval:
    name: str
    category: str
    minutes: int

    @property
    def duration(self) -> timedelta:
        return timedelta(minutes=self.minutes)


_DAY = 24 * 60
INTERVALS = {
    i.name: i
    for i in (
        *(Interval(f"{m}m", "intraday", m) for m in (1, 2, 5, 15, 30, 60, 90)),
        Interval("1h", "intraday", 60),
        Interval("1d", "daily", _DAY),
        Interval("5d", "multi_day", 5 * _DAY),
        Interval("1wk", "weekly", 7 * _DAY),
        Interval("1mo", "monthly", 31 * _DAY),
        Interval("3mo", "quarterly", 92 * _DAY),
    )
}


def interval(name: str) -> Interval:
    if name not in INTERVALS:
        raise ValueError(f"unknown interval: {name}")
    return INTERVALS[name]


def to_local(instant: Column, zone: str = ZONE) -> Column:
    """Wall-clock time of an instant that is stored without zone as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def is_complete(name: str, ts: Column, now: Column) -> Column:
    """Whether the candle is over. Weekly, monthly and quarterly candles are complete in any other period."""
    spec = interval(name)
    if spec.category in ("intraday", "multi_day"):
        return ts + F.expr(f"INTERVAL {spec.minutes} MINUTES") <= now
    if spec.category == "daily":
        day, today = F.to_date(ts), F.to_date(now)
        return (day < today) | ((day == today) & (F.hour(now) >= CLOSE_HOUR))
    if spec.category == "weekly":
        return (F.extract(F.lit("YEAROFWEEK"), ts) != F.extract(F.lit("YEAROFWEEK"), now)) | (F.weekofyear(ts) != F.weekofyear(now))
    part = F.month if spec.category == "monthly" else F.quarter
    return (F.year(ts) != F.year(now)) | (part(ts) != part(now))


def next_request_start(name: str, latest: Column) -> Column:
    """Start of the candle after the latest stored one."""
    spec = interval(name)
    minutes = spec.minutes if spec.category in ("intraday", "multi_day") else _DAY
    return latest + F.expr(f"INTERVAL {minutes} MINUTES")


def latest_completed_date(now: Column) -> Column:
    """The local date if the exchange has closed, otherwise the day before."""
    return F.when(F.hour(now) >= CLOSE_HOUR, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))


def wall_clock(at: datetime) -> Column:
    """A time without zone as a literal, whatever the zones of the session and of the driver's machine."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def require_aware(now: datetime) -> datetime:
    if now.tzinfo is None:
        raise ValueError("a time zone is required")
    return now
