"""Rolling-origin backtest of the cluster forecaster, all folds at once.

A fold is part of the key: profiles, clusters, series, features and trees of
all folds come from the same passes, so the scans of the fact and the number of
jobs do not grow with the folds.  Profiles are merged from day partials,
each fold taking the days before its own start; the readings are read once
more, for the series.  A fold sees nothing at or after its start, and
its result is that of a forecast of its window alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import ntz, py_slot_index
from loadcast.operators import baseline, cluster, evaluate, horizon, model, partials, profile, series
from loadcast.plans.forecast import ClusterBoostForecaster, local_to_utc
from loadcast.session import cut_lineage


def backtest_boosted(
    fc: ClusterBoostForecaster, readings: DataFrame, actual: DataFrame, first_start: str, n_folds: int, step_days: int, horizon_days: int,
    client_days: DataFrame | None = None,
) -> DataFrame:
    """``fold, fold_start, mae, n_slots, n_missing`` as ``evaluate.backtest`` gives it,
    in the passes of one forecast.  ``actual``: ``datetime_utc, actual``; ``client_days``: the
    stored day partials of the clients, else they are made from the readings.  Fold
    starts are local midnights.  Lookups must be known ahead of every fold."""
    starts = evaluate.fold_starts(first_start, n_folds, step_days)
    if any(s[11:] != "00:00:00" for s in starts):
        raise ValueError("folds start at local midnight")
    if fc.profile_grid or fc.centres is not None or fc.boost.choose_rounds:
        raise ValueError("grid profiles, given centres and chosen rounds are for single forecasts")
    ends = [evaluate.fold_starts(s, 2, horizon_days)[1] for s in starts]
    span = [horizon.window_slots(a, b, fc.local_shift) for a, b in zip(starts, ends, strict=True)]
    history = py_slot_index(fc.history_start)
    last = local_to_utc(ends[-1], fc.local_shift)

    def by_fold(values: list, fold: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (fold + 1).cast("int"))

    folds = F.explode(F.array(*[F.lit(f) for f in range(n_folds)]))
    inside = readings.where((F.col("datetime_utc") >= ntz(fc.history_start)) & (F.col("datetime_utc") < ntz(last)))
    days = cut_lineage(client_days if client_days is not None else partials.client_days(inside))
    days = days.withColumn("fold", folds).where(F.col("day") < F.to_date(by_fold(starts, F.col("fold"))))
    vectors = profile.profile_vector(partials.profiles(days, ["fold"]), ["fold"])
    mapping, info = cluster.cluster_groups(vectors, "fold", fc.k, fc.n_init, fc.seed)
    # a series of a fold: a number of its own
    width = max(i["k"] for i in info.values())
    mapping = cut_lineage(mapping.select("client_id", (F.col("fold") * width + F.col("cluster_id")).cast("int").alias(fc.key)))
    fold = F.floor(F.col(fc.key) / width).cast("int")

    clients = sum(i["n_clients"] for i in info.values())
    clustered = cluster.attach_cluster(inside, mapping, clients, fc.map_broadcast_bytes)
    seen = clustered.where(F.col("datetime_utc") < ntz_of(by_fold([local_to_utc(s, fc.local_shift) for s in starts], fold)))
    dense = series.dense_series(seen, fc.key, fc.history_start, last, fc.local_shift)
    spacing = [horizon.origin_spacing(b - a, a - history) for a, b in span]
    feats = horizon.features_before(
        dense, fc.key, by_fold([a for a, _ in span], fold), by_fold([b for _, b in span], fold), by_fold(spacing, fold), fill=fc.incomplete == "drop",
    )
    feats = fc.lookups.apply(feats, fc.history_start, last)
    feats = cut_lineage(feats.select(fc.key, "datetime_utc", "datetime_local", "load_milli", "sum_active_kw", *fc.feature_names()))
    begins = ntz_of(by_fold(starts, fold))
    train, window = feats.where(F.col("datetime_local") < begins), feats.where(F.col("datetime_local") >= begins)
    models, _ = model.train_per_series(train, fc.key, fc.feature_columns(feats), fc.boost, incomplete=fc.incomplete)
    parts = [p for p in [model.predict_per_series(models, window, fc.key, fc.feature_columns(feats))] if p is not None]
    lonely = sorted({r[0] for r in feats.select(fc.key).distinct().collect()} - models.keys())
    for f in sorted({k // width for k in lonely}):  # series without a row to learn from, as in a single forecast
        if fc.on_missing == "error":
            raise ValueError(f"fold {f}: series without a complete training row")
        own = feats.where(F.col(fc.key).isin([k for k in lonely if k // width == f]))
        parts.append(baseline.seasonal_naive(own, fc.key, starts[f], ends[f]))
    if not parts:
        raise ValueError("no series to forecast")
    rows = reduce(DataFrame.unionByName, [p.select(fc.key, "datetime_utc", "prediction") for p in parts])
    total = rows.groupBy(fold.alias("fold"), "datetime_utc").agg(F.sum("prediction").alias("prediction"))
    utc = [[local_to_utc(t, fc.local_shift) for t in edge] for edge in (starts, ends)]
    wanted = actual.withColumn("fold", folds).where(
        (F.col("datetime_utc") >= ntz_of(by_fold(utc[0], F.col("fold")))) & (F.col("datetime_utc") < ntz_of(by_fold(utc[1], F.col("fold"))))
    )
    scored = evaluate.mae(wanted, total, by=["fold"])
    return scored.select("fold", ntz_of(by_fold(starts, F.col("fold"))).alias("fold_start"), "mae", "n_slots", "n_missing")


def ntz_of(text: Column) -> Column:
    return text.cast("timestamp_ntz")
