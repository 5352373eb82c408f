"""Scoring: mean absolute error of total forecasts, and rolling-origin
backtests.

Absolute errors are cast to ``decimal(28,6)`` before summing, so the MAE is
the same whatever order the tasks add them in.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import SLOTS_PER_DAY, parse_instant, py_slot_index
from loadcast.operators.baseline import naive_columns

ERROR_DECIMAL = "decimal(28,6)"


def abs_error(actual: str, predicted: str):
    return F.abs(F.col(actual) - F.col(predicted)).cast(ERROR_DECIMAL)


def mean_error(err: str):
    """Mean of the exact absolute errors; null (not an ANSI error) when a
    group has no scored slot."""
    return F.when(F.count(err) > 0, F.sum(err).cast("double") / F.count(err))


def mae(
    actual: DataFrame,
    forecast: DataFrame,
    on: str = "datetime_utc",
    actual_col: str = "actual",
    forecast_col: str = "prediction",
    by: list[str] | None = None,
) -> DataFrame:
    """``[by...], mae, n_slots, n_missing``: the error over the slots that have
    a forecast, and how many actuals have none (a partial forecast shows).
    The join is on the instant: a local label may repeat."""
    by = by or []
    joined = actual.join(forecast.withColumnRenamed(forecast_col, "_forecast"), by + [on], "left")
    err = joined.where(F.col(actual_col).isNotNull()).select(*by, abs_error(actual_col, "_forecast").alias("_err"))
    return err.groupBy(*by).agg(
        mean_error("_err").alias("mae"), F.count("_err").alias("n_slots"),
        F.count(F.when(F.col("_err").isNull(), 1)).alias("n_missing"),
    )


def fold_starts(first_start: str, n_folds: int, step_days: int) -> list[str]:
    t0 = parse_instant(first_start)
    return [
        (t0 + _dt.timedelta(days=step_days * f)).strftime("%Y-%m-%d %H:%M:%S")
        for f in range(n_folds)
    ]


def backtest_seasonal_naive(
    series: DataFrame,
    key: str,
    first_start: str,
    n_folds: int,
    step_days: int,
    horizon_days: int,
) -> DataFrame:
    """Rolling-origin evaluation of the seasonal-naive forecast.

    Fold ``f`` forecasts ``[first_start + f*step, ... + horizon)`` from the
    data before its own start and is scored against the actuals.  Output:
    ``fold, fold_start, <key>, mae, n_slots``.

    One pass: every series row is repeated once per fold (a generator over
    a handful of fold starts), the forecast is a window over (key, fold),
    which the series' key partitioning already satisfies, and the actual is
    the row's own load, so scoring needs no join.
    """
    starts = fold_starts(first_start, n_folds, step_days)
    start_idx = F.array(*[F.lit(py_slot_index(s)) for s in starts])
    start_ts = F.array(*[F.lit(s).cast("timestamp_ntz") for s in starts])
    horizon = horizon_days * SLOTS_PER_DAY
    folded = series.select("*", F.posexplode(start_idx).alias("fold", "_start_idx"))
    pred, in_window = naive_columns([key, "fold"], F.col("_start_idx"), horizon)
    scored = folded.select(key, "fold", "sum_active_kw", pred.alias("prediction"), in_window.alias("_in")).filter("_in")
    err = scored.select(key, "fold", abs_error("sum_active_kw", "prediction").alias("_err"))
    out = err.groupBy("fold", key).agg(mean_error("_err").alias("mae"), F.count("_err").alias("n_slots"))
    return out.select("fold", F.element_at(start_ts, F.col("fold") + 1).alias("fold_start"), key, "mae", "n_slots")


def backtest(
    forecaster, readings: DataFrame, actual: DataFrame, first_start: str, n_folds: int, step_days: int, horizon_days: int, local_shift: str,
) -> DataFrame:
    """Rolling-origin evaluation of any forecaster: ``fold, fold_start, mae,
    n_slots, n_missing``.  ``actual``: ``datetime_utc, actual``.  Each fold is a
    forecast of its own window, which sees nothing from its start on."""
    from loadcast.operators.horizon import window_slots
    from loadcast.functions.clock import slot_start

    out = None
    for fold, start in enumerate(fold_starts(first_start, n_folds, step_days)):
        end = fold_starts(start, 2, horizon_days)[1]
        lo, hi = window_slots(start, end, local_shift)
        spark = readings.sparkSession
        a, b = (spark.range(1).select(slot_start(F.lit(x)).alias("t")).first()["t"] for x in (lo, hi))
        inside = actual.where((F.col("datetime_utc") >= F.lit(a)) & (F.col("datetime_utc") < F.lit(b)))
        scored = mae(inside, forecaster.predict_utc(readings, start, end)).select(
            F.lit(fold).alias("fold"), F.lit(start).cast("timestamp_ntz").alias("fold_start"), "mae", "n_slots", "n_missing"
        )
        out = scored if out is None else out.unionByName(scored)
    return out
