"""Clock arithmetic on naive fixed-offset timestamps.

``target`` labels the END of a delivery interval, so a 00:00 label belongs to
the previous execution day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 of a naive or UTC timestamp."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def minutes_between(later, earlier) -> Column:
    """``later - earlier`` in minutes, as a double."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(60_000_000.0)


def shift_minutes(ts, minutes) -> Column:
    """``ts + minutes``; ``minutes`` may be a Python number or an integer column."""
    if isinstance(minutes, Column):
        return as_col(ts) + F.make_dt_interval(mins=minutes.cast("int"))
    return as_col(ts) + F.expr(f"INTERVAL '{int(minutes)}' MINUTE")


def floor_minutes(ts, minutes: int) -> Column:
    """Largest multiple of ``minutes`` since the epoch not after ``ts`` (naive)."""
    width = int(minutes) * 60_000_000
    us = epoch_us(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width))).cast("timestamp_ntz")


def execution_start(target, interval_minutes: int = 30) -> Column:
    return shift_minutes(target, -interval_minutes)


def execution_day(target, interval_minutes: int = 30) -> Column:
    return execution_start(target, interval_minutes).cast("date")


def nominal_issue(code) -> Column:
    """YYYYMMDDPP -> date + 04:00 + (PP-1) half-hours; null for a malformed code."""
    text = as_col(code).cast("string")
    day = F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("timestamp_ntz")
    period = F.substring(text, 9, 10).try_cast("int")
    valid = F.length(text) >= 9
    issue = shift_minutes(day, (F.lit(240) + (period - 1) * 30))
    return F.when(valid & period.between(1, 48), issue)
