"""Features that a forecast of any length can see.

A row's features come from before its origin: the forecast start for rows of
the forecast window, and for history rows the last of a row of earlier
origins, one spacing apart, counted back from the start.  Seasonal values
reach back by whole weeks (days), by as few as land before the origin, so
they exist however long the window is; level features are the running sums
at the origin.  Training rows are built with the same distances as forecast
rows.  Nothing at or after the forecast start is ever looked up.

All values of a row are found by one join: each row lists the slots that it
needs, and the list is joined to the series on (key, slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.clock import SLOTS_PER_DAY, SLOTS_PER_WEEK, parse_instant, py_slot_index, py_to_utc, slot_index
from loadcast.functions.exprs import from_milli, mean_from_milli

WEEKS = 4
SHORT_FRAME, LONG_FRAME = 191, 671  # slots of the two level means
#: Slots back of the weekly trend's four values.
TREND = (288, 384, 960, 1056)
FEATURES = (
    "lag_2d_same_slot", "lag_7d_same_slot", "lag_14d_same_slot", "lag_21d_same_slot", "lag_28d_same_slot",
    "same_slot_mean_4w", "rolling_mean_48h_safe", "rolling_mean_7d_safe", "short_ma_minus_long_ma",
    "last_measured_value", "time_slots_distance", "weekly_trend_smooth",
)


def window_slots(predict_start: str, predict_end: str, local_shift: str) -> tuple[int, int]:
    """UTC slot indexes of the window's start and end."""
    a, b = (py_slot_index(py_to_utc(parse_instant(t), local_shift)) for t in (predict_start, predict_end))
    if b <= a:
        raise ValueError(f"empty window [{predict_start}, {predict_end})")
    return a, b


def origin_spacing(horizon: int, history: int) -> int:
    """Slots between training origins: the window's length, but at most half of
    the history (in whole weeks, one at least), so that training rows exist."""
    return min(horizon, max(SLOTS_PER_WEEK, history // 2 // SLOTS_PER_WEEK * SLOTS_PER_WEEK))


def horizon_features(
    series: DataFrame, key: str, history_start: str, predict_start: str, predict_end: str, local_shift: str,
    milli: str = "load_milli", fill: bool = True,
) -> DataFrame:
    """``key, datetime_utc, datetime_local, load_milli, sum_active_kw`` and
    ``FEATURES`` for every slot of a dense series before ``predict_end``.

    A seasonal value that lies before the history is replaced by the mean of
    the row's other same-slot values, else by the mean of all history before
    the origin; so a feature is null only where no value at all precedes
    the origin.  Without ``fill`` such a value stays missing.  ``load_milli`` and ``sum_active_kw`` are null in the window.
    """
    start, end = window_slots(predict_start, predict_end, local_shift)
    spacing = origin_spacing(end - start, start - py_slot_index(history_start))
    return features_before(series, key, F.lit(start), F.lit(end), F.lit(spacing), milli, fill)


def features_before(series: DataFrame, key: str, start: Column, end: Column, spacing: Column, milli: str = "load_milli", fill: bool = True) -> DataFrame:
    """``horizon_features`` where the window (UTC slots) and the spacing of the origins are
    functions of the row's key: every series of the frame may have a window of its own."""
    start, end, spacing = (c.cast("long") for c in (start, end, spacing))
    u = slot_index("datetime_utc").cast("long")
    rows = series.select(
        key, "datetime_utc", "datetime_local", u.alias("_u"), F.col(milli).alias("_all"),
        start.alias("_start"), end.alias("_end"), spacing.alias("_spacing"),
    ).where(F.col("_u") < F.col("_end")).drop("_end")
    start, spacing = F.col("_start"), F.col("_spacing")
    rows = rows.withColumn("load_milli", F.when(F.col("_u") < start, F.col("_all"))).drop("_all")
    upto = Window.partitionBy(key).orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.where(F.col("_u") < start).select(
        F.col(key).alias("_k"), F.col("_u").alias("_at"), F.col("load_milli").alias("_milli"),
        F.sum("load_milli").over(upto).alias("_sum"), F.count("load_milli").over(upto).alias("_n"),
        F.last("load_milli", ignorenulls=True).over(upto).alias("_last"),
        F.last(F.when(F.col("load_milli").isNotNull(), F.col("_u")), ignorenulls=True).over(upto).alias("_last_at"),
    )
    back = F.ceil((start - F.col("_u")) / spacing.cast("double")).cast("long")
    rows = rows.withColumn("_origin", F.when(F.col("_u") >= start, start).otherwise(start - back * spacing).cast("long"))
    d = F.col("_u") - F.col("_origin")
    weeks = (F.floor(d / SLOTS_PER_WEEK) + 1) * SLOTS_PER_WEEK
    days = F.greatest(F.floor(d / SLOTS_PER_DAY) + 1, F.lit(2)) * SLOTS_PER_DAY
    turn = F.greatest(F.ceil((d + 1 - TREND[0]) / F.lit(float(SLOTS_PER_WEEK))), F.lit(0)) * SLOTS_PER_WEEK
    here = F.col("_u")
    needs: dict[str, Column] = {f"w{k}": here - weeks - k * SLOTS_PER_WEEK for k in range(WEEKS)}
    needs["d2"] = here - days
    needs |= {f"t{k}": here - n - turn for k, n in enumerate(TREND)}
    needs |= {"o": F.col("_origin") - 1, "os": F.col("_origin") - 1 - SHORT_FRAME, "ol": F.col("_origin") - 1 - LONG_FRAME}
    ids = [key, "_u", "_origin", "datetime_utc", "datetime_local", "load_milli"]
    listed = rows.select(*ids, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), at.cast("long").alias("at")) for n, at in needs.items()])).alias("_need"))
    found = listed.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_need.at") == F.col("_at")), "left")
    pick = lambda n, c: F.max(F.when(F.col("_need.n") == n, F.col(c)))
    wide = found.groupBy(*ids).agg(
        *[pick(n, "_milli").alias(f"_{n}") for n in needs if n[0] in "wdt"],
        *[F.coalesce(pick(n, "_sum"), F.lit(0)).alias(f"_sum_{n}") for n in ("o", "os", "ol")],
        *[F.coalesce(pick(n, "_n"), F.lit(0)).alias(f"_n_{n}") for n in ("o", "os", "ol")],
        pick("o", "_last").alias("_last"), pick("o", "_last_at").alias("_last_at"),
    )
    return _derive(wide, key, fill)


def _derive(wide: DataFrame, key: str, fill: bool) -> DataFrame:
    """Row-local arithmetic on the values that were looked up."""
    level = mean_from_milli("_sum_o", "_n_o")
    same = [from_milli(f"_w{k}") for k in range(WEEKS)]
    held = sum(F.col(f"_w{k}").isNotNull().cast("int") for k in range(WEEKS))
    total = sum((F.coalesce(F.col(f"_w{k}"), F.lit(0)) for k in range(1, WEEKS)), F.coalesce(F.col("_w0"), F.lit(0)))
    out = wide.withColumn("_level", level).withColumn("same_slot_mean_4w", F.coalesce(mean_from_milli(total, held), F.col("_level")))
    mean = F.col("same_slot_mean_4w")
    frame = lambda n: F.coalesce(mean_from_milli(F.col("_sum_o") - F.col(f"_sum_{n}"), F.col("_n_o") - F.col(f"_n_{n}")), F.col("_level"))
    out = out.withColumn("rolling_mean_48h_safe", frame("os")).withColumn("rolling_mean_7d_safe", frame("ol"))
    trend = ((from_milli("_t0") - from_milli("_t1")) + (from_milli("_t2") - from_milli("_t3"))) / F.lit(2.0)
    seen = F.col("_level").isNotNull()
    either = (lambda *cols: F.coalesce(*cols)) if fill else (lambda first, *rest: first)
    return out.select(
        key, "datetime_utc", "datetime_local", "load_milli", from_milli("load_milli").alias("sum_active_kw"),
        either(from_milli("_d2"), same[0], mean).alias("lag_2d_same_slot"),
        *[either(c, mean).alias(f"lag_{7 * (k + 1)}d_same_slot") for k, c in enumerate(same)],
        "same_slot_mean_4w", "rolling_mean_48h_safe", "rolling_mean_7d_safe",
        (F.col("rolling_mean_48h_safe") - F.col("rolling_mean_7d_safe")).alias("short_ma_minus_long_ma"),
        from_milli("_last").alias("last_measured_value"),
        (F.col("_u") - F.col("_last_at")).cast("int").alias("time_slots_distance"),
        F.when(seen, either(trend, F.lit(0.0))).alias("weekly_trend_smooth"),
    )
