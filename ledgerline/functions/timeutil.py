"""Time-zone-free handling of the driver's zone-less timestamps.

The driver files carry ``TIMESTAMP_NTZ`` values.  Converting them with
``cast(ts AS timestamp)`` would interpret the wall clock in the session time
zone (an hour off across a DST switch, half an hour off for +05:30 zones).
These helpers treat the wall clock as UTC explicitly, so results do not
depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import ColumnOrName, col


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def epoch_micros(ts: ColumnOrName) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ wall clock."""
    return F.timestamp_diff("MICROSECOND", _epoch(), col(ts))


def ntz_to_instant(ts: ColumnOrName) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP (instant), reading the wall clock as UTC
    (e.g. for watermarks, which need TIMESTAMP)."""
    return F.timestamp_micros(epoch_micros(ts))


def instant_to_ntz(ts: ColumnOrName) -> Column:
    """TIMESTAMP (instant) -> TIMESTAMP_NTZ wall clock in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(ts)), _epoch())


_UNIT_MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def trunc_ntz(unit: str, ts: ColumnOrName) -> Column:
    """Truncate a TIMESTAMP_NTZ wall clock to second/minute/hour/day, as
    TIMESTAMP_NTZ, by arithmetic on its epoch micros (``date_trunc`` would
    go through a session-zone instant)."""
    step = _UNIT_MICROS[unit]
    us = epoch_micros(ts)
    floored = us - F.pmod(us, F.lit(step))
    return F.timestamp_add("MICROSECOND", floored, _epoch())


def trunc_date(unit: str, d: ColumnOrName) -> Column:
    """First day of the week (Monday) / month / year of a DATE or NTZ value,
    as DATE (``trunc`` works on dates, no time zone involved)."""
    return F.trunc(F.to_date(col(d)), unit)
