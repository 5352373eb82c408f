"""Audits: feature leakage and submission format."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.clock import (
    DEFAULT_LOCAL_SHIFT,
    ntz,
    parse_instant,
    py_slot_index,
    py_to_utc,
    slot_start,
    to_local,
)
from loadcast.operators.features import FeatureSpec, build_features


def leak_audit(
    series: DataFrame,
    key: str,
    spec: FeatureSpec,
    predict_start: str,
    predict_end: str,
) -> DataFrame:
    """Which features read actuals from inside the forecast window.

    Features are built twice in one sorted pass over the series: once on
    the load as stored and once with every actual at or after
    ``predict_start`` hidden; a feature leaks when any forecast-window row
    differs.  Output per feature: ``feature, min_lag_slots`` (declared),
    ``horizon_slots``, ``changed_rows``, ``leaks``.
    """
    names = spec.names()
    horizon = py_slot_index(predict_end) - py_slot_index(predict_start)
    before = F.col("datetime_local") < ntz(predict_start)
    in_window = ~before & (F.col("datetime_local") < ntz(predict_end))
    both = series.select(
        "*",
        F.when(before, F.col("load_milli")).alias("_milli_hidden"),
        F.when(before, F.col("sum_active_kw")).alias("_kw_hidden"),
    )
    both = build_features(both, key, spec)
    both = build_features(both, key, spec, target="_kw_hidden", milli="_milli_hidden", suffix="__hidden")
    rows = both.filter(in_window)
    wide = rows.agg(
        *[F.sum(F.when(~F.col(n).eqNullSafe(F.col(n + "__hidden")), 1).otherwise(0)).alias(n) for n in names]
    )
    long = wide.select(*[F.col(n).cast("long").alias(n) for n in names]).unpivot([], names, "feature", "changed_rows")
    lags = spec.min_lag()
    lag_map = F.create_map(*chain.from_iterable((F.lit(n), F.lit(lags[n])) for n in names))
    return long.select(
        "feature",
        lag_map[F.col("feature")].alias("min_lag_slots"),
        F.lit(horizon).alias("horizon_slots"),
        F.coalesce(F.col("changed_rows"), F.lit(0)).alias("changed_rows"),
        (F.coalesce(F.col("changed_rows"), F.lit(0)) > 0).alias("leaks"),
    )


def window_spine(spark: SparkSession, start: str, end: str, name: str = "datetime_15min") -> DataFrame:
    """One row per slot of ``[start, end)``, generated in parallel from the
    slot indexes."""
    lo, hi = py_slot_index(start), py_slot_index(end)
    return spark.range(lo, hi).select(slot_start("id").alias(name))


def submission_audit(
    forecast: DataFrame, predict_start: str, predict_end: str, local_shift: str = DEFAULT_LOCAL_SHIFT
) -> DataFrame:
    """Format check of ``datetime_15min, prediction`` against the window.

    The expected rows are the real 15-minute intervals of the local window,
    counted per local label (two for each label of a repeated autumn hour
    when ``local_shift`` is a zone, one otherwise).  One row:
    ``n_rows, n_slots_expected, n_missing_slots, n_duplicate_rows,
    n_null_predictions, n_out_of_window``."""
    spark = forecast.sparkSession
    u0 = py_to_utc(parse_instant(predict_start), local_shift).strftime("%Y-%m-%d %H:%M:%S")
    u1 = py_to_utc(parse_instant(predict_end), local_shift).strftime("%Y-%m-%d %H:%M:%S")
    spine = (
        window_spine(spark, u0, u1, name="datetime_utc")
        .groupBy(to_local("datetime_utc", local_shift).alias("datetime_15min"))
        .agg(F.count(F.lit(1)).alias("_expected"))
    )
    per_slot = forecast.groupBy("datetime_15min").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("prediction").isNull(), 1)).alias("_null"),
    )
    j = spine.join(per_slot, "datetime_15min", "full_outer")
    on_grid = (F.minute("datetime_15min") % 15 == 0) & (F.second("datetime_15min") == 0)
    in_window = (
        (F.col("datetime_15min") >= ntz(predict_start)) & (F.col("datetime_15min") < ntz(predict_end)) & on_grid
    )
    n = F.coalesce(F.col("_n"), F.lit(0))
    expected = F.coalesce(F.col("_expected"), F.lit(0))
    return j.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum("_expected"), F.lit(0)).cast("long").alias("n_slots_expected"),
        F.coalesce(F.sum(F.when(expected > n, expected - n)), F.lit(0)).cast("long").alias("n_missing_slots"),
        F.coalesce(F.sum(F.when((expected > 0) & (n > expected), n - expected)), F.lit(0))
        .cast("long").alias("n_duplicate_rows"),
        F.coalesce(F.sum("_null"), F.lit(0)).cast("long").alias("n_null_predictions"),
        F.coalesce(F.sum(F.when(~in_window, F.col("_n"))), F.lit(0)).cast("long").alias("n_out_of_window"),
    )
