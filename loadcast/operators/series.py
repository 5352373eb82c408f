"""Series: load summed per (series key, instant), on a gap-free spine.

A series frame has columns ``<key>, datetime_utc, datetime_local,
load_milli`` (exact, milli-kW) and ``sum_active_kw`` (double).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import DEFAULT_LOCAL_SHIFT, ntz
from loadcast.functions.exprs import from_milli
from loadcast.operators.calendar import densify

TOTAL_KEY = "total"


def series_load(readings: DataFrame, key: str) -> DataFrame:
    """Sum of load per (key, UTC instant); the local clock is carried with
    ``min`` so the value is stable when several local readings map to one
    instant.  Partial aggregation runs map side; the output has at most
    keys x slots rows whatever the number of clients."""
    return readings.groupBy(key, "datetime_utc").agg(
        F.min("datetime_local").alias("datetime_local"),
        F.sum("kw_milli").alias("load_milli"),
    )


def dense_series(
    readings: DataFrame,
    key: str,
    start: str,
    end: str,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
) -> DataFrame:
    """``series_load`` laid on the spine of ``[start, end)``; missing slots
    carry zero load."""
    return densify_series(series_load(readings, key), key, start, end, local_shift)


def densify_series(sparse: DataFrame, key: str, start: str, end: str, local_shift: str = DEFAULT_LOCAL_SHIFT) -> DataFrame:
    """A sparse series laid on the spine."""
    dense = densify(sparse, key, start, end, fill={"load_milli": 0}, local_shift=local_shift)
    return dense.withColumn("sum_active_kw", from_milli("load_milli"))


def total_load(readings: DataFrame, start: str, end: str, local_shift: str = DEFAULT_LOCAL_SHIFT) -> DataFrame:
    """Total over all clients per slot, one row per slot of the window:
    ``series_id ('total'), datetime_utc, datetime_local, load_milli,
    sum_active_kw``."""
    tagged = readings.withColumn("series_id", F.lit(TOTAL_KEY))
    return dense_series(tagged, "series_id", start, end, local_shift)


def filter_series(series: DataFrame, key: str, value) -> DataFrame:
    """Keep one series."""
    return series.filter(F.col(key) == F.lit(value))


def time_split(df: DataFrame, predict_start: str, predict_end: str | None = None, clock: str = "datetime_local"):
    """(train, predict): ``clock < start`` and ``start <= clock < end``."""
    start = ntz(predict_start)
    train = df.filter(F.col(clock) < start)
    predict = df.filter(F.col(clock) >= start)
    if predict_end is not None:
        predict = predict.filter(F.col(clock) < ntz(predict_end))
    return train, predict


def label_split(df: DataFrame, predict_start: str, predict_end: str | None = None, clock: str = "datetime_local") -> DataFrame:
    """The same split as a column ``split`` in ('train', 'predict', null)."""
    c = F.col(clock)
    in_window = c >= ntz(predict_start)
    if predict_end is not None:
        in_window = in_window & (c < ntz(predict_end))
    return df.withColumn(
        "split", F.when(c < ntz(predict_start), F.lit("train")).when(in_window, F.lit("predict"))
    )


def mask_from(df: DataFrame, predict_start: str, cols=("load_milli",), clock: str = "datetime_local") -> DataFrame:
    """Null the actuals at or after ``predict_start`` so no feature can read
    them (leak-free forecasting on a table that also holds the future)."""
    keep = F.col(clock) < ntz(predict_start)
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(keep, F.col(c)))
    return out
