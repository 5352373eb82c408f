"""Seasonal-naive baseline: the value of the same slot 7 days earlier, with
the series' historical mean as the fallback.

Leak-free for any horizon: a slot ``d`` slots into the window reads the slot
``m`` weeks earlier, ``m = d // 672 + 1``, the smallest number of weeks that
lands before the window start (so a long window repeats the last week of
history).  One window pass over the dense series, partitioned by the series
key (the partitioning the series already has): the source value is one of
``ceil(horizon / 672)`` fixed lags chosen per row, the fallback a
conditional mean over the whole partition.  No join, no second scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.clock import SLOTS_PER_WEEK, py_slot_index, slot_index
from loadcast.functions.exprs import from_milli, mean_from_milli


def naive_columns(
    part_cols: list[str],
    start_idx: Column,
    horizon: int,
    season: int = SLOTS_PER_WEEK,
    milli: str = "load_milli",
) -> tuple[Column, Column]:
    """(prediction, in_window) for every row of a dense series; ``start_idx``
    is the window start's slot index (a column, so folds may differ)."""
    w = Window.partitionBy(*part_cols).orderBy("datetime_utc")
    whole = Window.partitionBy(*part_cols)
    d = slot_index("datetime_local") - start_idx
    history = d < 0
    weeks = F.floor(d / season) + 1
    n_lags = max(1, math.ceil(horizon / season))
    src = F.when(weeks == 1, F.lag(milli, season).over(w))
    for m in range(2, n_lags + 1):
        src = src.when(weeks == m, F.lag(milli, season * m).over(w))
    fallback = mean_from_milli(
        F.sum(F.when(history, F.col(milli))).over(whole),
        F.count(F.when(history, F.col(milli))).over(whole),
    )
    prediction = F.coalesce(from_milli(src), fallback)
    in_window = (d >= 0) & (d < horizon)
    return prediction, in_window


def seasonal_naive(
    series: DataFrame,
    key: str,
    predict_start: str,
    predict_end: str,
    season: int = SLOTS_PER_WEEK,
    milli: str = "load_milli",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``key, datetime_utc, datetime_local, prediction`` (+ ``keep``) for every
    slot of the series with ``predict_start <= datetime_local < predict_end``."""
    start_idx = py_slot_index(predict_start)
    horizon = py_slot_index(predict_end) - start_idx
    pred, in_window = naive_columns([key], F.lit(start_idx), horizon, season, milli)
    out = series.select(key, "datetime_utc", "datetime_local", *keep, pred.alias("prediction"), in_window.alias("_in"))
    return out.filter("_in").drop("_in")
