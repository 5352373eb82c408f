"""Clock expressions for quarter-hour series.

All instants are ``timestamp_ntz``: a wall-clock reading without a zone, so
results never depend on the session time zone.  Two clocks exist side by side:
``datetime_utc`` is the key of every series, ``datetime_local`` an attribute
derived from it either by a fixed shift (``"1 hour"``, the test-data mapping)
or by a time zone (``"Europe/Madrid"``), in which case the local clock repeats
an hour in autumn and skips one in spring while the UTC key stays gap-free.
"""

from __future__ import annotations

import datetime as _dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: 15-minute resolution, 96 slots per day.
SLOT_MINUTES = 15
SLOTS_PER_HOUR = 4
SLOTS_PER_DAY = 96
SLOTS_PER_WEEK = 672
# Test-data local clock: UTC plus one hour, as a plain wall-clock shift.
DEFAULT_LOCAL_SHIFT = "1 hour"

_EPOCH = _dt.datetime(1970, 1, 1)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def floor_15min(ts: str | Column) -> Column:
    """Start of the 15-minute slot holding ``ts`` (stays ``timestamp_ntz``)."""
    t = _c(ts)
    return F.make_timestamp_ntz(
        F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
        F.minute(t) - F.minute(t) % SLOT_MINUTES, F.lit(0),
    )


def floor_hour(ts: str | Column) -> Column:
    """Start of the hour holding ``ts`` (``date_trunc('hour')`` for NTZ)."""
    t = _c(ts)
    return F.make_timestamp_ntz(
        F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0)
    )


_FIXED = re.compile(r"\s*(-?\d+)\s*(hour|hours|minute|minutes)\s*", re.I)


def is_zone(local_shift: str) -> bool:
    """True for a zone name, False for a fixed shift such as ``"1 hour"``."""
    return _FIXED.fullmatch(local_shift) is None


def fixed_shift(local_shift: str) -> _dt.timedelta:
    m = _FIXED.fullmatch(local_shift)
    if not m:
        raise ValueError(f"not a fixed shift: {local_shift!r}")
    n = int(m.group(1))
    return _dt.timedelta(hours=n) if m.group(2).lower().startswith("hour") else _dt.timedelta(minutes=n)


def shift(ts: str | Column, interval: str) -> Column:
    """Wall-clock shift, e.g. ``shift('datetime_utc', '1 hour')``."""
    return _c(ts) + F.expr(f"INTERVAL {interval}")


def to_local(ts_utc: str | Column, local_shift: str = DEFAULT_LOCAL_SHIFT) -> Column:
    """Local wall clock of a UTC instant (both ``timestamp_ntz``)."""
    if is_zone(local_shift):
        return F.convert_timezone(F.lit("UTC"), F.lit(local_shift), _c(ts_utc))
    return shift(ts_utc, local_shift)


def to_utc(ts_local: str | Column, local_shift: str = DEFAULT_LOCAL_SHIFT) -> Column:
    """UTC instant of a local wall clock (a repeated autumn hour resolves to
    its first occurrence)."""
    if is_zone(local_shift):
        return F.convert_timezone(F.lit(local_shift), F.lit("UTC"), _c(ts_local))
    return _c(ts_local) - F.expr(f"INTERVAL {local_shift}")


def py_to_local(t_utc: _dt.datetime, local_shift: str = DEFAULT_LOCAL_SHIFT) -> _dt.datetime:
    """Parameter arithmetic on the driver (window bounds, slot counts)."""
    if is_zone(local_shift):
        aware = t_utc.replace(tzinfo=_dt.timezone.utc).astimezone(ZoneInfo(local_shift))
        return aware.replace(tzinfo=None)
    return t_utc + fixed_shift(local_shift)


def py_to_utc(t_local: _dt.datetime, local_shift: str = DEFAULT_LOCAL_SHIFT) -> _dt.datetime:
    if is_zone(local_shift):
        aware = t_local.replace(tzinfo=ZoneInfo(local_shift)).astimezone(_dt.timezone.utc)
        return aware.replace(tzinfo=None)
    return t_local - fixed_shift(local_shift)


def slot_index(ts: str | Column) -> Column:
    """Quarter-hours since 1970-01-01 00:00 (long); slot arithmetic and
    equi-joins on "the same slot n days earlier" use it."""
    t = _c(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long")
    return days * SLOTS_PER_DAY + F.hour(t) * SLOTS_PER_HOUR + F.floor(F.minute(t) / SLOT_MINUTES)


def slot_start(index: str | Column) -> Column:
    """Inverse of :func:`slot_index`."""
    i = _c(index)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(i / SLOTS_PER_DAY).cast("int"))
    minutes = (i % SLOTS_PER_DAY) * SLOT_MINUTES
    return F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day),
        F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"), F.lit(0),
    )


def ntz(value: str | _dt.datetime) -> Column:
    """Typed NTZ literal from ``'2024-01-24'`` / ``'2024-01-24 06:15:00'``."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(value).cast("timestamp_ntz")


def parse_instant(value: str | _dt.datetime) -> _dt.datetime:
    if isinstance(value, _dt.datetime):
        return value
    return _dt.datetime.fromisoformat(value)


def py_slot_index(value: str | _dt.datetime) -> int:
    """Driver-side slot index of a parameter (not of data)."""
    delta = parse_instant(value) - _EPOCH
    return int(delta.total_seconds() // (SLOT_MINUTES * 60))


def clock_parts(ts: str | Column) -> dict[str, Column]:
    """hour, minute and day of week (1 = Sunday ... 7 = Saturday)."""
    t = _c(ts)
    return {"hour": F.hour(t), "minute": F.minute(t), "day_of_week": F.dayofweek(t)}


def is_weekend(ts: str | Column) -> Column:
    return F.dayofweek(_c(ts)).isin(1, 7)
