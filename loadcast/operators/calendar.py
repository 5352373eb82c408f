"""Slot spines and slot-count calendars.

A spine holds one row per 15-minute slot of a window ``[start, end)`` (UTC).
Row-based lags equal time-based lags only on a gap-free series, so every
series is laid on a spine before windows run over it.
"""

from __future__ import annotations

import datetime as _dt
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.clock import (
    DEFAULT_LOCAL_SHIFT,
    SLOT_MINUTES,
    ntz,
    parse_instant,
    py_to_local,
    to_local,
)

def _step():
    return F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES")


def slot_sequence(start: str, end: str):
    """Array column of the slot starts in ``[start, end)``."""
    if parse_instant(end) <= parse_instant(start):
        raise ValueError(f"empty window [{start}, {end})")
    return F.sequence(ntz(start), ntz(end) - _step(), _step())


def densify(
    series: DataFrame,
    key: str,
    start: str,
    end: str,
    fill: dict[str, object] | None = None,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
) -> DataFrame:
    """Lay a sparse (key, datetime_utc) series on its spine.

    Gap filling inside one window pass: every row generates the slots from
    itself up to the next row of its series (``lead``), the first row also
    the slots from the window start, the last row those up to the window
    end.  Generated slots get the ``fill`` values (``{"load_milli": 0}`` =
    "no reading is zero load").  The series keys are the ones present in the
    data; no key list, no spine join and no second scan of the input are
    needed, and the output keeps the ``key`` partitioning, so the feature
    windows that follow only sort.
    """
    fill = fill or {}
    t = F.col("datetime_utc")
    sparse = series.filter((t >= ntz(start)) & (t < ntz(end)))
    value_cols = [c for c in sparse.columns if c not in (key, "datetime_utc", "datetime_local")]
    w = Window.partitionBy(key).orderBy("datetime_utc")
    upto = F.coalesce(F.lead("datetime_utc").over(w), ntz(end)) - _step()
    first = F.when(F.lag("datetime_utc").over(w).isNull(), ntz(start)).otherwise(t)
    spans = sparse.select(
        key, t.alias("_t"), *value_cols, F.sequence(first, upto, _step()).alias("_slots")
    )
    dense = spans.select(key, "_t", *value_cols, F.explode("_slots").alias("datetime_utc"))
    own = F.col("datetime_utc") == F.col("_t")
    return dense.select(
        key,
        "datetime_utc",
        to_local("datetime_utc", local_shift).alias("datetime_local"),
        *[
            F.when(own, F.col(c)).otherwise(F.lit(fill.get(c))).alias(c)
            for c in value_cols
        ],
    )


def slot_counts(start: str, end: str, local_shift: str = DEFAULT_LOCAL_SHIFT) -> dict[str, object]:
    """How many slots of ``[start, end)`` fall in each local hour, on local
    weekdays and on local weekend days.  Parameter arithmetic (the window is
    a parameter, not data): the denominators of per-client grid means."""
    t0, t1 = parse_instant(start), parse_instant(end)
    step = _dt.timedelta(minutes=SLOT_MINUTES)
    per_hour: Counter = Counter()
    weekend = weekday = 0
    t = t0
    while t < t1:
        local = py_to_local(t, local_shift)
        per_hour[local.hour] += 1
        if local.isoweekday() in (6, 7):
            weekend += 1
        else:
            weekday += 1
        t += step
    return {
        "per_hour": [per_hour.get(h, 0) for h in range(24)],
        "weekday": weekday,
        "weekend": weekend,
        "total": weekday + weekend,
    }
