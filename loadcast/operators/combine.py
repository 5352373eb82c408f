"""Combining per-series forecasts into one total per interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.exprs import row_sum_null_as_zero

PREFIX = "prediction_cluster_"


def combine_by_instant(forecasts: DataFrame) -> DataFrame:
    """Sum of the series forecasts per UTC instant; the local clock is an
    attribute.  Long format in, one row per instant out: a clock change
    (two instants, one local time) can never multiply rows."""
    return forecasts.groupBy("datetime_utc").agg(
        F.min("datetime_local").alias("datetime_local"),
        F.sum("prediction").alias("prediction"),
    )


def combine_wide(forecasts: DataFrame, key: str, on: str = "datetime_local") -> DataFrame:
    """J8 + P8 + A9: one row per local label with a column
    ``prediction_cluster_<s>`` for every series, lined up by a single grouped
    aggregation whatever the number of series, then added across the
    prefixed columns with null read as 0.  ``forecasts`` is long (key, label,
    prediction).  A label that repeats adds up; combine by instant instead
    where the clock changes."""
    wide = forecasts.groupBy(on).pivot(key).agg(F.sum("prediction"))
    names = sorted(c for c in wide.columns if c != on)
    wide = wide.select(on, *[F.col(f"`{c}`").alias(f"{PREFIX}{c}") for c in names])
    cols = [f"`{c}`" for c in wide.columns if c.startswith(PREFIX)]
    return wide.select(F.col(on).alias("datetime_15min"), row_sum_null_as_zero(cols).alias("prediction"))
