"""End-to-end forecasters: readings in, one total forecast per interval out.

``predict(readings, predict_start, predict_end)`` returns
``datetime_15min`` (local slot start, timestamp_ntz) and ``prediction``
(double), exactly one row per 15-minute slot of the local window;
``predict_utc`` returns the same rows keyed by ``datetime_utc``.  A slot that
no series forecasts has a null prediction (``submission_audit`` counts it).

Nothing at or after ``predict_start`` is read: readings are cut there before
clusters are fitted and features are built, and every feature of a row lies
before its origin (``operators.horizon``), so it exists for any window
length.  Lookups are the caller's: tables known in advance, or stand-ins
projected from the history (``sources.lookups``).  The
``forecast_leak_audit`` query changes the future and counts forecasts that move.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from loadcast.functions.clock import (
    DEFAULT_LOCAL_SHIFT, SLOTS_PER_WEEK, ntz, parse_instant, py_slot_index, py_to_utc, slot_start, to_local,
)
from loadcast.operators import audit, baseline, cluster, combine, enrich, horizon, model, profile, series
from loadcast.operators.joins import DEFAULT_BROADCAST_BYTES
from loadcast.session import cut_lineage

# Bytes per (slot, prediction) row assumed when bounding a forecast's size.
FORECAST_ROW_BYTES = 32


def local_to_utc(value: str, local_shift: str) -> str:
    t = py_to_utc(parse_instant(value), local_shift)
    return t.strftime("%Y-%m-%d %H:%M:%S")


def _on_window_spine(
    combined: DataFrame, predict_start: str, predict_end: str, local_shift: str = DEFAULT_LOCAL_SHIFT
) -> DataFrame:
    """Exactly one row per real 15-minute interval of the local window, keyed by
    its UTC instant; an interval no series forecast is null.  A clock change
    neither merges nor drops intervals.  The combined forecast has at most one
    row per instant of the window, a bound set by the window parameters, so
    it is broadcast when that bound is small."""
    u0, u1 = local_to_utc(predict_start, local_shift), local_to_utc(predict_end, local_shift)
    spine = audit.window_spine(combined.sparkSession, u0, u1, name="datetime_utc")
    got = combined.select("datetime_utc", "prediction")
    n_slots = py_slot_index(u1) - py_slot_index(u0)
    if n_slots * FORECAST_ROW_BYTES <= DEFAULT_BROADCAST_BYTES:
        got = F.broadcast(got)
    return spine.join(got, "datetime_utc", "left")


class Forecaster:
    """Extension point: anything with ``predict_utc`` plugs into scoring and backtests."""

    local_shift: str = DEFAULT_LOCAL_SHIFT

    def predict_utc(self, readings: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        raise NotImplementedError

    def predict(self, readings: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        """The same forecast labelled with the local start of each interval (in
        autumn a label appears twice, once per instant)."""
        return self.label(self.predict_utc(readings, predict_start, predict_end))

    def label(self, forecast: DataFrame) -> DataFrame:
        return forecast.select(to_local("datetime_utc", self.local_shift).alias("datetime_15min"), "prediction")


@dataclass
class SeasonalNaiveForecaster(Forecaster):
    """D1 on the total: the same slot 7 days earlier, else the mean."""

    history_start: str
    local_shift: str = DEFAULT_LOCAL_SHIFT

    def predict_utc(self, readings, predict_start, predict_end):
        end_utc = local_to_utc(predict_end, self.local_shift)
        total = series.total_load(readings, self.history_start, end_utc, self.local_shift)
        pred = baseline.seasonal_naive(total, "series_id", predict_start, predict_end)
        return _on_window_spine(pred, predict_start, predict_end, self.local_shift)


@dataclass
class Lookups:
    """Optional external signals; any may be None."""

    hourly: DataFrame | None = None
    holidays: DataFrame | None = None
    weekday: DataFrame | None = None
    visitors: DataFrame | None = None

    def feature_names(self) -> list[str]:
        out = []
        if self.holidays is not None:
            out.append("is_normal_holiday")
        if self.hourly is not None:
            out.append("demand_forecast")
            if "AvgPrice" in self.hourly.columns:
                out.append("AvgPrice")
        for daily in (self.weekday, self.visitors):
            if daily is not None:
                out += [f.name for f in daily.schema.fields if f.name != "date" and isinstance(f.dataType, NumericType)]
        return out

    def apply(self, df: DataFrame, start_utc: str, end_utc: str) -> DataFrame:
        """Join every lookup onto rows of ``[start_utc, end_utc)``.

        Each lookup is first cut to that span (the next hour and the local
        dates at both ends included), which bounds it by the hours or days of
        the window; it is then broadcast on that bound.  As model inputs, an
        instant without a holiday row is not a holiday and a price holds until
        the next quote; a signal that is null or missing stays missing.  Every
        column of a daily table comes along."""
        t0, t1 = ntz(start_utc), ntz(end_utc)
        slots = py_slot_index(end_utc) - py_slot_index(start_utc)
        hours, days = slots // 4 + 2, slots // 96 + 3
        if self.holidays is not None:
            hol = self.holidays.filter((F.col("datetime_utc") >= t0) & (F.col("datetime_utc") < t1))
            df = enrich.enrich_holiday(df, hol, max_rows=slots)
            df = df.withColumn("is_normal_holiday", F.coalesce(F.col("is_normal_holiday"), F.lit(0)))
        if self.hourly is not None:
            hour_span = (F.col("datetime_utc") >= t0 - F.expr("INTERVAL 1 HOUR")) & (
                F.col("datetime_utc") < t1 + F.expr("INTERVAL 1 HOUR")
            )
            hourly = cut_lineage(self.hourly.filter(hour_span))  # two joins read it
            if "AvgPrice" in hourly.columns:
                hourly = enrich.price_until_next(hourly)  # a price holds until the next quote
            df = enrich.enrich_interpolated(df, hourly, ["demand_forecast"], max_rows=hours)
            df = enrich.enrich_price(df, hourly, max_rows=hours)
        day_span = (F.col("date") >= F.to_date(t0 - F.expr("INTERVAL 1 DAY"))) & (
            F.col("date") <= F.to_date(t1 + F.expr("INTERVAL 1 DAY"))
        )
        daily = [t.filter(day_span) for t in (self.weekday, self.visitors) if t is not None]
        return enrich.enrich_daily(df, *daily, max_rows=days) if daily else df


@dataclass
class ClusterBoostForecaster(Forecaster):
    """Clients clustered by day shape, one boosted-tree model per cluster,
    cluster forecasts added per instant.

    Steps (each also usable on its own): ``cluster`` -> ``feature_frame``
    -> ``fit`` -> ``predict_rows`` -> ``combine``.
    """

    history_start: str
    lookups: Lookups = field(default_factory=Lookups)
    k: int = 5
    n_init: int = 20
    seed: int = 42
    boost: model.BoostParams = field(default_factory=model.BoostParams)
    local_shift: str = DEFAULT_LOCAL_SHIFT
    key: str = "cluster_id"
    # What happens to a series without a complete training row: "naive" gives it
    # its own seasonal-naive forecast (listed in ``info["fallback_series"]``),
    # "error" raises.  No model at all always raises.
    on_missing: str = "naive"
    # Training rows with a missing feature: "drop" as the reference does (features are
    # then filled where a value is missing), or "learn": features stay missing and the
    # splits learn which way they go.
    incomplete: str = "drop"
    # with ``boost.choose_rounds``: slots before the window start that are held out to choose the rounds
    validation_slots: int = SLOTS_PER_WEEK
    # True when the readings hold one row per (client, slot) already
    readings_are_cells: bool = False
    # profile means over the slots of the history (a missing one is zero load)
    # instead of over the readings that exist
    profile_grid: bool = False
    # centres of an earlier fit: clients, also those seen since, go to the nearest and nothing is fitted
    centres: list[list[int]] | None = None
    # largest client -> cluster map broadcast to the readings (bytes)
    map_broadcast_bytes: int = cluster.MAP_BROADCAST_BYTES
    info: dict = field(default_factory=dict)

    # -- steps ---------------------------------------------------------
    def cluster(self, readings: DataFrame, predict_start: str) -> DataFrame:
        """Profiles over the history before the window -> k-means map."""
        start_utc = local_to_utc(predict_start, self.local_shift)
        prof = profile.client_profiles(
            readings, self.history_start, start_utc, self.local_shift, self.readings_are_cells, grid=self.profile_grid
        )
        vectors = profile.profile_vector(prof)
        if self.centres is not None:
            points = cut_lineage(cluster.fixed(vectors))
            self.info.update(n_clients=points.count(), whole_centres=self.centres)
            return cluster.assign_nearest(points, self.centres).select("client_id", "cluster_id")
        mapping, info = cluster.cluster_clients(vectors, self.k, self.n_init, self.seed)
        self.info.update(info)
        return mapping

    def feature_names(self) -> list[str]:
        return list(horizon.FEATURES) + self.lookups.feature_names()

    def feature_columns(self, feats: DataFrame) -> list[str]:
        """Every column of the feature frame except the series key, the
        clocks and the target."""
        base = {self.key, "datetime_utc", "datetime_local", "load_milli", "sum_active_kw"}
        return [c for c in feats.columns if c not in base]

    def feature_frame(self, readings: DataFrame, mapping: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        """Dense per-cluster series up to the window start, features of every
        slot before the window end, lookups; checkpointed (it feeds k fits and
        k predictions)."""
        start_utc, end_utc = local_to_utc(predict_start, self.local_shift), local_to_utc(predict_end, self.local_shift)
        past = readings.filter(F.col("datetime_utc") < ntz(start_utc))
        clustered = cluster.attach_cluster(past, mapping, self.info.get("n_clients"), self.map_broadcast_bytes)
        # the features read the series twice, the readings behind it once
        ser = cut_lineage(series.dense_series(clustered, self.key, self.history_start, end_utc, self.local_shift))
        feats = horizon.horizon_features(
            ser, self.key, self.history_start, predict_start, predict_end, self.local_shift, fill=self.incomplete == "drop",
        )
        feats = self.lookups.apply(feats, self.history_start, end_utc)
        cols = [self.key, "datetime_utc", "datetime_local", "load_milli", "sum_active_kw", *self.feature_names()]
        return cut_lineage(feats.select(*cols))

    def fit(self, feats: DataFrame, predict_start: str) -> dict:
        train, _ = series.time_split(feats, predict_start)
        held = None
        if self.boost.choose_rounds:  # the last window's length before the start chooses the rounds
            held, slot = "_held", py_slot_index(predict_start) - self.validation_slots
            train = train.withColumn(held, F.col("datetime_local") >= slot_start(F.lit(slot)))
        models, counts = model.train_per_series(
            train, self.key, self.feature_columns(feats), self.boost, incomplete=self.incomplete, held_out=held,
        )
        self.info["train_rows"] = counts
        self.info["fitted_series"] = sorted(models)
        if not models:
            raise ValueError(f"no series has a complete training row before {predict_start}: no model was fitted")
        return models

    def predict_rows(self, models: dict, feats: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        """Per-series forecasts; see ``on_missing`` for a series without a model."""
        _, rows = series.time_split(feats, predict_start, predict_end)
        parts = []
        modelled = model.predict_per_series(models, rows, self.key, self.feature_columns(feats))
        if modelled is not None:
            parts.append(modelled)
        # series keys of the (checkpointed, small) frame: k values
        keys = [r[0] for r in feats.select(self.key).distinct().collect()]
        missing = sorted(k for k in keys if k not in models)
        self.info["fallback_series"] = missing
        if missing and self.on_missing == "error":
            raise ValueError(f"series without a complete training row: {missing}")
        if missing:
            # the naive forecast reads only rows before the window start
            lonely = feats.filter(F.col(self.key).isin(missing))
            naive = baseline.seasonal_naive(lonely, self.key, predict_start, predict_end)
            parts.append(naive.select(self.key, "datetime_utc", "datetime_local", "prediction"))
        if not parts:
            raise ValueError("no series to forecast")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # -- whole ---------------------------------------------------------
    def fit_window(self, readings: DataFrame, predict_start: str, predict_end: str) -> tuple[DataFrame, dict]:
        """Clusters, feature frame and models for one window: (frame, models)."""
        mapping = self.cluster(readings, predict_start)
        feats = self.feature_frame(readings, mapping, predict_start, predict_end)
        return feats, self.fit(feats, predict_start)

    def predict_fitted(self, models: dict, readings: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        """``predict_utc`` with the models and ``centres`` of an earlier fit."""
        if self.centres is None:
            raise ValueError("no centres of an earlier fit")
        mapping = self.cluster(readings, predict_start)
        feats = self.feature_frame(readings, mapping, predict_start, predict_end)
        return self.total(models, feats, predict_start, predict_end)

    def total(self, models: dict, feats: DataFrame, predict_start: str, predict_end: str) -> DataFrame:
        """``datetime_utc, prediction``: the series' forecasts added per instant."""
        per_series = self.predict_rows(models, feats, predict_start, predict_end)
        return _on_window_spine(combine.combine_by_instant(per_series), predict_start, predict_end, self.local_shift)

    def predict_utc(self, readings, predict_start, predict_end):
        feats, models = self.fit_window(readings, predict_start, predict_end)
        return self.total(models, feats, predict_start, predict_end)


__all__ = [
    "Forecaster",
    "SeasonalNaiveForecaster",
    "ClusterBoostForecaster",
    "Lookups",
    "local_to_utc",
]
