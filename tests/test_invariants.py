"""Invariants of the learning operators (checked on rows, not values)."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from loadcast.operators import cluster, evaluate, horizon, model, profile, series, sink
from loadcast.plans.backtest import backtest_boosted
from loadcast.plans.forecast import ClusterBoostForecaster, SeasonalNaiveForecaster

from .conftest import readings_frame, slots

START = "2024-01-01 00:00:00"
PRED_START = "2024-02-05 00:00:00"  # local
PRED_END = "2024-02-12 00:00:00"


@pytest.fixture(scope="module")
def planted(spark):
    """Eight clients, two daily shapes (morning / evening peak), six weeks of
    quarter hours with independent noise: a seasonal series the same-slot
    mean of four weeks forecasts better than last week's single value."""
    rng = random.Random(7)
    ts = slots(START, 96 * 42)
    rows = []
    for c in range(8):
        peak = 8 if c < 4 else 19
        for t in ts:
            hour = (t.hour + 1) % 24
            base = 2.0 + 3.0 * math.exp(-((hour - peak) ** 2) / 4.0)
            rows.append((c, t, round(max(0.0, base + rng.gauss(0, 0.8)), 2)))
    return readings_frame(spark, rows).cache()


@pytest.fixture(scope="module")
def forecaster():
    return ClusterBoostForecaster(
        history_start=START,
        k=2,
        n_init=2,
        boost=model.BoostParams(rounds=15, depth=3),
    )


@pytest.fixture(scope="module")
def forecast(planted, forecaster):
    return forecaster.predict(planted, PRED_START, PRED_END).cache()


def _actual(planted):
    tot = series.total_load(planted, START, "2024-02-12 00:00:00")
    _, inside = series.time_split(tot, PRED_START, PRED_END)
    return inside.select("datetime_utc", F.col("sum_active_kw").alias("actual"))


def test_clusters_follow_the_planted_shapes(forecaster, planted):
    mapping = forecaster.cluster(planted, PRED_START)
    got = {r.client_id: r.cluster_id for r in mapping.collect()}
    assert sorted(got) == list(range(8))  # every client exactly once
    assert len({got[c] for c in range(4)}) == 1 and len({got[c] for c in range(4, 8)}) == 1
    assert got[0] != got[4]


def test_forecast_has_one_row_per_slot_and_no_nulls(forecast):
    rows = forecast.collect()
    assert len(rows) == 672
    assert len({r.datetime_15min for r in rows}) == 672
    assert all(r.prediction is not None and not math.isnan(r.prediction) for r in rows)
    assert min(r.datetime_15min for r in rows) == dt.datetime(2024, 2, 5)


def test_model_beats_or_ties_seasonal_naive(spark, planted, forecast):
    actual = _actual(planted)
    naive = SeasonalNaiveForecaster(START).predict_utc(planted, PRED_START, PRED_END)
    fixed = forecast.select((F.col("datetime_15min") - F.expr("INTERVAL 1 HOUR")).alias("datetime_utc"), "prediction")
    m = evaluate.mae(actual, fixed).collect()[0]
    n = evaluate.mae(actual, naive).collect()[0]
    # (the planted series ends an hour before the local window does)
    assert m.mae <= n.mae and m.n_slots == n.n_slots == 672 and m.n_missing == 0


def test_same_seed_same_forecast(planted, forecast):
    again = ClusterBoostForecaster(
        history_start=START,
        k=2,
        n_init=2,
        boost=model.BoostParams(rounds=15, depth=3),
    ).predict(planted, PRED_START, PRED_END)
    a = sorted(tuple(r) for r in forecast.collect())
    b = sorted(tuple(r) for r in again.collect())
    assert a == b


@pytest.mark.parametrize("days", [1, 7, 90, 365])
def test_every_window_length_keeps_all_features(planted, days):
    end = (dt.datetime.fromisoformat(PRED_START) + dt.timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S")
    total = series.total_load(planted, START, _utc(end))
    feats = horizon.horizon_features(total, "series_id", START, PRED_START, end, "1 hour").cache()
    inside = feats.where(F.col("datetime_local") >= PRED_START)
    n = inside.count()
    assert n == 96 * days
    assert inside.select(*[F.count(c).alias(c) for c in horizon.FEATURES]).first() == (n,) * len(horizon.FEATURES)
    train = model.complete_rows(feats, list(horizon.FEATURES))
    assert train.count() >= 672
    feats.unpersist()


def _utc(local: str) -> str:
    return (dt.datetime.fromisoformat(local) - dt.timedelta(hours=1)).strftime("%Y-%m-%d %H:%M:%S")


def test_features_come_from_before_the_origin_alone(planted):
    """Against plain Python on one series, for a window of nine days."""
    end = "2024-02-14 00:00:00"
    total = series.total_load(planted, START, _utc(end)).cache()
    load = {r.datetime_utc: r.load_milli for r in total.collect()}
    t0 = dt.datetime.fromisoformat(START)
    start = dt.datetime.fromisoformat(_utc(PRED_START))
    spacing = horizon.origin_spacing(96 * 9, (start - t0) // dt.timedelta(minutes=15))
    slot = dt.timedelta(minutes=15)
    rows = horizon.horizon_features(total, "series_id", START, PRED_START, end, "1 hour").collect()
    for r in rows[::37]:
        t = r.datetime_utc
        origin = start
        while origin > t:
            origin -= spacing * slot
        week = t
        while week >= origin:
            week -= 672 * slot
        past = [load[t0 + k * slot] for k in range(max(0, (origin - t0) // slot))]
        if not past:
            assert r.same_slot_mean_4w is None
            continue
        held = [load[week - k * 672 * slot] / 1000 for k in range(4) if week - k * 672 * slot in load and week - k * 672 * slot >= t0]
        mean = sum(past) / 1000 / len(past)
        assert r.lag_7d_same_slot == pytest.approx(held[0] if held else mean)
        assert r.same_slot_mean_4w == pytest.approx(sum(held) / len(held) if held else mean)
        assert r.rolling_mean_48h_safe == pytest.approx(sum(past[-191:]) / 1000 / len(past[-191:]))
        assert r.rolling_mean_7d_safe == pytest.approx(sum(past[-671:]) / 1000 / len(past[-671:]))
        assert r.last_measured_value == past[-1] / 1000 and r.time_slots_distance == (t - origin) // slot + 1
        assert (r.sum_active_kw is None) == (t >= start)


def test_no_model_at_all_is_an_error(planted):
    fc = ClusterBoostForecaster(history_start=START, k=2, n_init=1, boost=model.BoostParams(rounds=2, depth=2))
    with pytest.raises(ValueError, match="no model"):
        fc.predict(planted, "2024-01-02 00:00:00", "2024-01-03 00:00:00")  # less than a week of history


def test_the_future_does_not_move_the_forecast_and_partitions_do_not_either(spark, planted, forecast):
    late = F.col("datetime_utc") >= F.lit(_utc(PRED_START)).cast("timestamp_ntz")
    changed = planted.withColumn("kw_milli", F.when(late, F.col("kw_milli") * 7 + 1).otherwise(F.col("kw_milli")))
    make = lambda: ClusterBoostForecaster(history_start=START, k=2, n_init=2, boost=model.BoostParams(rounds=15, depth=3))
    want = sorted(tuple(r) for r in forecast.collect())
    assert sorted(tuple(r) for r in make().predict(changed, PRED_START, PRED_END).collect()) == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(tuple(r) for r in make().predict(planted, PRED_START, PRED_END).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_backtest_of_any_forecaster(planted):
    actual = series.total_load(planted, START, "2024-02-12 00:00:00").select("datetime_utc", F.col("sum_active_kw").alias("actual"))
    folds = evaluate.backtest(SeasonalNaiveForecaster(START), planted, actual, "2024-01-22 00:00:00", 2, 7, 1, "1 hour").collect()
    own = evaluate.backtest_seasonal_naive(series.total_load(planted, START, "2024-02-12 00:00:00"), "series_id", "2024-01-22 00:00:00", 2, 7, 1).collect()
    assert [(r.fold, r.fold_start, r.mae, r.n_slots, r.n_missing) for r in folds] == [(r.fold, r.fold_start, r.mae, r.n_slots, 0) for r in sorted(own, key=lambda r: r.fold)]


def test_parallel_folds_equal_one_forecast_after_another(planted):
    """Also where an early fold has a series without a row to learn from."""
    actual = series.total_load(planted, START, "2024-02-12 00:00:00").select("datetime_utc", F.col("sum_active_kw").alias("actual"))
    make = lambda: ClusterBoostForecaster(history_start=START, k=3, n_init=2, boost=model.BoostParams(rounds=4, depth=3))
    for spec in (("2024-01-29 00:00:00", 3, 7, 1), ("2024-01-25 00:00:00", 2, 9, 3)):
        loop = evaluate.backtest(make(), planted, actual, *spec, "1 hour").collect()
        folds = backtest_boosted(make(), planted, actual, *spec).collect()
        assert sorted(r.fold for r in folds) == list(range(spec[1]))
        for a, b in zip(sorted(loop), sorted(folds)):
            assert (a.fold, a.fold_start, a.n_slots, a.n_missing) == (b.fold, b.fold_start, b.n_slots, b.n_missing)
            assert a.mae == pytest.approx(b.mae, abs=1e-5)
    with pytest.raises(ValueError, match="midnight"):
        backtest_boosted(make(), planted, actual, "2024-01-29 01:00:00", 1, 1, 1)


def test_kmeans_step_assigns_every_client_to_its_nearest_start(spark, planted):
    vec = profile.profile_vector(profile.client_profiles(planted, START, "2024-02-04 23:00:00", grid=True))
    centres = cluster.initial_centres(vec, 2)
    assigned = cluster.assign_nearest(vec, centres).collect()
    for r in assigned:
        d = [sum((r[c] - x) ** 2 for c, x in zip(profile.VECTOR_COLS, centre)) for centre in centres]
        assert r.cluster_id == d.index(min(d))
    step = cluster.kmeans_step(vec, 2).collect()
    assert sum(r.n_clients for r in step) == 8


def test_kmeans_cost_never_rises_and_a_fit_stands_still(spark, planted):
    vec = profile.profile_vector(profile.client_profiles(planted, START, "2024-02-04 23:00:00", grid=True))
    costs = [{r.start: r.cost for r in cluster.kmeans_fit(vec, 3, 4, 5, rounds).collect()} for rounds in (0, 1, 3, 20)]
    for s in range(4):
        assert all(b[s] <= a[s] for a, b in zip(costs, costs[1:]))
    mapping, info = cluster.cluster_clients(vec, 3, 4, 5)
    assert round(info["cost"] * cluster.UNIT**2) == min(costs[-1].values())
    # the passes of all starts are those of the one that moves longest, not their sum
    assert info["passes"] <= 3 + 20


def test_kmeans_against_plain_rounds(spark):
    """Seeding and rounds in plain Python, ties and equal vectors included; partitions do not matter."""
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 6)), float(rng.randint(0, 6)) / 8) for i in range(60)] + [(100 + i, 2.0, 0.25) for i in range(20)]
    points = {i: [int(math.floor(v * cluster.UNIT + 0.5)) for v in (a, b)] for i, a, b in rows}
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))

    def plain(start, k, rounds):
        centres = []
        for step in range(k):
            race = {}
            for i, x in points.items():
                z = (i * cluster.MIX[0] + (7 * 1_000_003 + start) * 1_009 + step) % 2**64
                for shift, factor in ((30, cluster.MIX[1]), (27, cluster.MIX[2])):
                    z = (z ^ (z >> shift)) * factor % 2**64
                z ^= z >> 31
                w = min((far(x, c) for c in centres), default=1)
                if w:
                    race[i] = -math.log(((z >> 11) + 1) / 2**53) / w
            centres.append(points[min(race, key=lambda i: (race[i], i))])
        for _ in range(rounds):
            near = {i: min(range(k), key=lambda c: (far(x, centres[c]), c)) for i, x in points.items()}
            for c in range(k):
                own = [points[i] for i, at in near.items() if at == c]
                if own:
                    centres[c] = [sum(v) // len(own) for v in zip(*own)]
        return centres, sum(min(far(x, c) for c in centres) for x in points.values())

    want = [(s, i, cost, *c) for s in range(3) for centres, cost in [plain(s, 4, 5)] for i, c in enumerate(centres)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "client_id long, a double, b double").repartition(parts)
        assert sorted(tuple(r) for r in cluster.kmeans_fit(df, 4, 3, 7, 5, ["a", "b"]).collect()) == want


def test_kmeans_with_fewer_places_than_centres(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(9)], "client_id long, a double, b double")
    mapping, info = cluster.cluster_clients(df, 3, 2, cols=["a", "b"])
    assert info["cost"] == 0 and {r.cluster_id for r in mapping.collect()} == {0}


def test_scoring_run_writes_one_row_per_slot_for_its_team(spark, tmp_path):
    from loadcast.plans.forecast import SeasonalNaiveForecaster
    from loadcast.plans.score import lookups_from_tables, score
    from loadcast.sources import Catalog, raw_readings

    from .conftest import SMOKE_DIR

    tables = Catalog(spark, SMOKE_DIR)
    readings = raw_readings(tables.events, "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    out = str(tmp_path / "subs")
    fc = SeasonalNaiveForecaster("2024-01-01 00:00:00")
    assert score(spark, fc, readings, "2024-01-24 00:00:00", "2024-01-31 00:00:00", "a", out) == 672
    assert score(spark, fc, readings, "2024-01-24 00:00:00", "2024-01-25 00:00:00", "b", out) == 96
    assert sink.submissions(spark, out).read().count() == 672 + 96
    lk = lookups_from_tables(tables, "2024-01-01 00:00:00", "2024-01-24 00:00:00", "2024-01-31 00:00:00", "1 hour")
    assert lk.feature_names()[:2] == ["is_normal_holiday", "demand_forecast"]


def test_scoring_run_on_stored_tables(spark, planted, tmp_path, capsys):
    """Consumption and lookups by name and by path, a window in the future of
    both, every weekday column, and a table sink that keeps other teams."""
    from loadcast.plans import score as run

    t = planted.select("client_id", F.col("datetime_local"), F.lit("X").alias("community_code"), F.col("active_kw"))
    path = str(tmp_path / "consumption")
    t.write.parquet(path)
    days = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    days.select("date", F.dayofweek("date").alias("day_of_week"), F.weekofyear("date").alias("week")).createOrReplaceTempView("weekday_view")
    spark.sql("DROP TABLE IF EXISTS loadcast_submissions")
    args = ["--consumption", path, "--weekday", "weekday_view", "--start", PRED_START, "--end", "2024-02-09 00:00:00",
            "--k", "2", "--n-init", "1", "--rounds", "3", "--out-table", "loadcast_submissions"]
    try:
        for team in ("a", "b", "a"):
            assert run.main([*args, "--team", team]) == 0
        assert {r.team_name: r["count"] for r in spark.table("loadcast_submissions").groupBy("team_name").count().collect()} == {"a": 384, "b": 384}
        assert "models fitted for series [0, 1]" in capsys.readouterr().out
    finally:
        spark.sql("DROP TABLE IF EXISTS loadcast_submissions")
