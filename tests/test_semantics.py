"""Behaviours the reference leaves implicit, one test each,
on small hand-made frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcast.operators import audit, baseline, calendar, cluster, combine, enrich, features, profile, series, sink
from loadcast.sources.consumption import readings_from_events

from .conftest import readings_frame, slots


def _series(spark, values, start="2024-01-01 00:00:00", key="s"):
    """Dense single series frame with load_milli / sum_active_kw."""
    ts = slots(start, len(values))
    rows = [(key, t, t + dt.timedelta(hours=1), v) for t, v in zip(ts, values)]
    df = spark.createDataFrame(rows, "sid string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, load_milli long")
    return df.withColumn("sum_active_kw", F.col("load_milli") / 1000.0)


def test_q1_missing_slot_is_filled_so_row_lag_is_time_lag(spark):
    t = slots("2024-01-01 00:00:00", 4)
    r = readings_frame(spark, [(1, t[0], 1.0), (1, t[1], 2.0), (1, t[3], 4.0)])
    dense = series.dense_series(r.withColumn("sid", F.lit("a")), "sid", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    rows = dense.orderBy("datetime_utc").collect()
    assert [x.load_milli for x in rows] == [1000, 2000, 0, 4000]
    spec = features.FeatureSpec(lags={"lag1": 1}, same_slot_lags=None, rolling={}, spread=None, last_measured=False, trend_lags=None)
    lagged = features.build_features(dense, "sid", spec).orderBy("datetime_utc").collect()
    assert lagged[3].lag1 == 0.0  # the missing slot, not the value two slots back


def test_q1_leading_and_trailing_gaps_are_filled(spark):
    t = slots("2024-01-01 00:00:00", 8)
    r = readings_frame(spark, [(1, t[2], 1.0), (1, t[5], 2.0)])
    dense = series.dense_series(r.withColumn("sid", F.lit("a")), "sid", "2024-01-01 00:00:00", "2024-01-01 02:00:00")
    rows = dense.orderBy("datetime_utc").collect()
    assert [x.datetime_utc for x in rows] == t
    assert [x.load_milli for x in rows] == [0, 0, 1000, 0, 0, 2000, 0, 0]


def test_q2_frames_hold_191_and_671_rows_and_match_direct_average(spark):
    values = list(range(1000))
    s = _series(spark, values)
    out = features.add_rolling(s, "sid", dict(features.REFERENCE_ROLLING))
    w = Window.partitionBy("sid").orderBy("datetime_utc")
    direct = out.select(
        "*",
        F.count("load_milli").over(w.rowsBetween(-383, -193)).alias("n48"),
        F.count("load_milli").over(w.rowsBetween(-863, -193)).alias("n7"),
        (F.sum("load_milli").over(w.rowsBetween(-863, -193)) / 1000.0
         / F.count("load_milli").over(w.rowsBetween(-863, -193))).alias("d7"),
    ).orderBy("datetime_utc").collect()
    assert max(r.n48 for r in direct) == 191
    assert max(r.n7 for r in direct) == 671
    for r in direct:
        if r.n7 == 0:
            assert r.rolling_mean_7d_safe is None
        else:
            assert r.rolling_mean_7d_safe == r.d7


def test_q3_predict_end_is_exclusive(spark):
    s = _series(spark, [1] * 8)
    _, pred = series.time_split(s, "2024-01-01 01:30:00", "2024-01-01 02:00:00")
    assert [r.datetime_local for r in pred.orderBy("datetime_local").collect()] == slots("2024-01-01 01:30:00", 2)


def _clock_change_forecasts(spark, n_series=5):
    # 2026-10-25: 00:00 and 01:00 UTC both read 02:00 on a CEST -> CET clock
    local = dt.datetime(2026, 10, 25, 2, 0)
    per = {}
    for k in range(n_series):
        rows = [(local, dt.datetime(2026, 10, 25, 0, 0), 1.0), (local, dt.datetime(2026, 10, 25, 1, 0), 2.0)]
        per[k] = spark.createDataFrame(rows, "datetime_local timestamp_ntz, datetime_utc timestamp_ntz, prediction double")
    return per


def test_q4_wide_combination_keeps_one_row_per_local_label(spark):
    long = None
    for k, df in _clock_change_forecasts(spark).items():
        df = df.withColumn("cluster_id", F.lit(k))
        long = df if long is None else long.unionByName(df)
    out = combine.combine_wide(long, "cluster_id").collect()
    assert [r.prediction for r in out] == [15.0]  # both instants of the repeated label


def test_q4_sum_by_utc_keeps_one_row_per_instant(spark):
    per = _clock_change_forecasts(spark)
    long = None
    for k, df in per.items():
        df = df.withColumn("cluster_id", F.lit(k))
        long = df if long is None else long.unionByName(df)
    out = combine.combine_by_instant(long).orderBy("datetime_utc").collect()
    assert [r.prediction for r in out] == [5.0, 10.0]


def test_q5_leak_audit_flags_short_lags_only(spark):
    values = [(i * 37) % 101 for i in range(96 * 10)]
    s = _series(spark, values)
    spec = features.FeatureSpec(lags={"lag_1d": 96, "lag_7d": 672}, same_slot_lags=(672,), trend_lags=None)
    out = {r.feature: r for r in audit.leak_audit(s, "sid", spec, "2024-01-09 01:00:00", "2024-01-10 01:00:00").collect()}
    assert out["lag_7d"].leaks is False and out["lag_7d"].changed_rows == 0
    assert out["same_slot_mean_4w"].leaks is False
    assert out["lag_1d"].leaks is False  # horizon is one day: 96 slots back is still history
    assert out["last_measured_value"].leaks is True
    assert out["rolling_mean_48h_safe"].leaks is False  # frame ends 193 slots back
    for r in out.values():  # measured leakage agrees with the declared nearest lag
        assert r.leaks == (r.min_lag_slots < r.horizon_slots)


def test_d7_reach_follows_from_the_expressions(spark):
    """What a feature reads is derived; a wrong statement about it is refused."""
    stated = {
        "lag_2d_same_slot": 192, "lag_7d_same_slot": 672, "lag_14d_same_slot": 1344, "lag_21d_same_slot": 2016, "lag_28d_same_slot": 2688,
        "same_slot_mean_4w": 672, "rolling_mean_48h_safe": 193, "rolling_mean_7d_safe": 193, "short_ma_minus_long_ma": 193,
        "last_measured_value": 1, "time_slots_distance": 1, "weekly_trend_smooth": 288,
    }
    for distance in ("parity", "gap"):
        spec = features.FeatureSpec(distance=distance)
        features.check_declared(spec, stated)
        for name in stated:
            with pytest.raises(ValueError, match="differ"):
                features.check_declared(spec, stated | {name: stated[name] + 1})
    with pytest.raises(ValueError, match="differ"):
        features.check_declared(features.FeatureSpec(spread=None), stated)
    far = {n: r.far for n, r in features.FeatureSpec(distance="gap").reach().items()}
    assert far["lag_28d_same_slot"] == -2688 and far["weekly_trend_smooth"] == -1056 and far["time_slots_distance"] == float("-inf")


@pytest.mark.parametrize("at", [3, 20, 33])
def test_d7_a_slot_moves_only_rows_that_reach_it(spark, at):
    spec = features.FeatureSpec(lags={"a": 5, "b": 9}, same_slot_lags=(7, 14), rolling={"m": (-11, -4), "n": (-6, -6)}, spread=("m", "n"),
                                distance="gap", trend_lags=(6, 8, 10, 12))
    values = [(i * 31) % 17 + 1 for i in range(40)]
    build = lambda v: sorted(features.build_features(_series(spark, v), "sid", spec).collect(), key=lambda r: r.datetime_utc)
    moved = build([v + 5 if i == at else v for i, v in enumerate(values)])
    for i, (x, y) in enumerate(zip(build(values), moved)):
        for name, r in spec.reach().items():
            assert x[name] == y[name] or r.far <= at - i <= r.near, (name, i)
    for name, r in spec.reach().items():  # and the nearest row that may move does (its slot is measured either way)
        if name != "time_slots_distance" and 14 <= at - r.near < 40:  # where no lag is missing
            assert build(values)[int(at - r.near)][name] != moved[int(at - r.near)][name], name


def test_q5_hidden_actuals_do_not_move_safe_features(spark):
    values = [(i * 13) % 29 for i in range(96 * 9)]
    s = _series(spark, values)
    start = "2024-01-08 01:00:00"
    changed = s.withColumn(
        "load_milli", F.when(F.col("datetime_local") >= start, F.lit(99999)).otherwise(F.col("load_milli"))
    ).withColumn("sum_active_kw", F.col("load_milli") / 1000.0)
    spec = features.FeatureSpec(lags={"lag_7d": 672}, same_slot_lags=(672,), rolling={}, spread=None,
                                last_measured=False, trend_lags=None)
    a = features.build_features(s, "sid", spec).filter(F.col("datetime_local") >= start)
    b = features.build_features(changed, "sid", spec).filter(F.col("datetime_local") >= start)
    ka = sorted((r.datetime_utc, r.lag_7d, r.same_slot_mean_4w) for r in a.collect())
    kb = sorted((r.datetime_utc, r.lag_7d, r.same_slot_mean_4w) for r in b.collect())
    assert ka == kb


def test_q6_client_first_seen_in_window_is_counted_in_the_actual_total(spark):
    t = slots("2024-01-01 00:00:00", 4)
    r = readings_frame(spark, [(1, t[0], 1.0), (1, t[3], 1.0), (2, t[3], 5.0)])
    total = series.total_load(r, "2024-01-01 00:00:00", "2024-01-01 01:00:00").orderBy("datetime_utc").collect()
    assert total[3].sum_active_kw == 6.0


def test_q7_holiday_when_any_community_is_on_holiday(spark):
    t = dt.datetime(2024, 1, 1)
    h = spark.createDataFrame([(t, "A", 0), (t, "B", 1)], "datetime_utc timestamp_ntz, community_code string, is_normal_holiday int")
    assert enrich.holiday_per_instant(h).collect()[0].is_normal_holiday == 1


def test_q8_local_clock_of_an_instant_is_the_minimum(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame(
        [(1, "x", t, t + dt.timedelta(hours=2), 1), (2, "x", t, t + dt.timedelta(hours=1), 1)],
        "client_id long, sid string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, kw_milli long",
    )
    out = series.series_load(r, "sid").collect()[0]
    assert out.datetime_local == t + dt.timedelta(hours=1) and out.load_milli == 2


def test_q9_hole_carries_and_duplicates_collapse(spark):
    h = [dt.datetime(2024, 1, 1, i) for i in (0, 1, 3)]
    hourly = spark.createDataFrame([(h[0], 10.0), (h[1], 20.0), (h[2], 40.0)], "datetime_utc timestamp_ntz, demand_forecast double")
    out = {r.hour_start.hour: r for r in enrich.next_hour_carry(hourly, ["demand_forecast"]).collect()}
    assert out[0].demand_forecast_next == 20.0
    assert out[1].demand_forecast_next == 20.0  # hour 2 is missing: carry, never jump to hour 3
    assert out[3].demand_forecast_next == 40.0
    dup = spark.createDataFrame([(h[0], 10.0), (h[0], 30.0)], "datetime_utc timestamp_ntz, AvgPrice double")
    base = spark.createDataFrame([(h[0] + dt.timedelta(minutes=15),)], "datetime_utc timestamp_ntz")
    priced = enrich.enrich_price(base, dup).collect()
    assert len(priced) == 1 and priced[0].AvgPrice == 20.0


def test_q10_gap_distance_grows(spark):
    s = _series(spark, [1, 2, 3, 4, 5, 6]).withColumn(
        "sum_active_kw", F.when(F.col("datetime_utc") >= "2024-01-01 00:45:00", F.lit(None)).otherwise(F.col("sum_active_kw"))
    )
    rows = s.select(
        "datetime_utc",
        features.slots_since_measured("sid", mode="gap").alias("gap"),
        features.slots_since_measured("sid", mode="parity").alias("parity"),
        features.last_measured("sid", mode="gap").alias("last"),
    ).orderBy("datetime_utc").collect()
    assert [r.gap for r in rows] == [None, 1, 1, 1, 2, 3]
    assert [r.parity for r in rows] == [None, 1, 1, 1, None, None]
    assert [r.last for r in rows] == [None, 0.001, 0.002, 0.003, 0.003, 0.003]


def test_q11_same_slot_mean_is_zero_without_history_and_naive_falls_back(spark):
    s = _series(spark, [1000] * 96 * 3)
    f = features.build_features(s, "sid").collect()
    assert all(r.same_slot_mean_4w == 0.0 for r in f)
    pred = baseline.seasonal_naive(s, "sid", "2024-01-03 01:00:00", "2024-01-04 01:00:00").collect()
    assert len(pred) == 96 and all(r.prediction == 1.0 for r in pred)  # historical mean


def test_seasonal_naive_reads_whole_weeks_back_beyond_one_week(spark):
    values = list(range(96 * 21))
    s = _series(spark, values)
    start = "2024-01-15 01:00:00"  # local; = slot 1344 in UTC
    pred = {r.datetime_utc: r.prediction for r in baseline.seasonal_naive(s, "sid", start, "2024-01-22 01:00:00").collect()}
    t0 = dt.datetime(2024, 1, 15)
    assert pred[t0] == (1344 - 672) / 1000.0
    assert pred[t0 + dt.timedelta(days=6, hours=23, minutes=45)] == (1344 + 671 - 672) / 1000.0


def test_q12_sink_overwrites_only_its_team(spark, tmp_path):
    path = str(tmp_path / "submissions")
    base = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "datetime_15min timestamp_ntz, prediction double")
    sink.write_submission(sink.stamp_submission(base, "a"), path)
    sink.write_submission(sink.stamp_submission(base, "b"), path)
    sink.write_submission(sink.stamp_submission(base.withColumn("prediction", F.lit(2.0)), "a"), path)
    got = {(r.team_name, r.prediction) for r in sink.submissions(spark, path).read().collect()}
    assert got == {("a", 2.0), ("b", 1.0)}
    assert sink.count_predictions(base).collect()[0].n_predictions == 1


def test_q16_k_is_capped_by_the_number_of_clients(spark):
    vec = spark.createDataFrame(
        [(i, *([float(i)] * 24), 1.0, 0.0) for i in range(3)],
        "client_id long, " + ", ".join(f"p{h:02d} double" for h in range(24)) + ", ratio_feat double, zero_feat double",
    )
    mapping, info = cluster.cluster_clients(vec, k=5, n_init=2)
    assert info["k"] == 3
    assert mapping.count() == 3 and mapping.select("cluster_id").distinct().count() == 3


def test_f9_a5_guards_all_zero_profile_and_zero_weekday_mean(spark):
    t = slots("2024-01-06 00:00:00", 96 * 2)  # Saturday and Sunday (local +1h)
    rows = [(1, x, 0.0) for x in t] + [(2, x, 1.0) for x in t[8:]]
    r = readings_frame(spark, rows)
    prof = {p.client_id: p for p in profile.client_profiles(r, "2024-01-06 00:00:00", "2024-01-08 00:00:00").collect()}
    assert prof[1].pct_zero == 1.0 and prof[1].we_wd_ratio == 1.0  # weekday mean 0 -> 1.0
    vec = {v.client_id: v for v in profile.profile_vector(profile.client_profiles(r, "2024-01-06 00:00:00", "2024-01-08 00:00:00")).collect()}
    assert all(getattr(vec[1], f"p{h:02d}") == 0.0 for h in range(24))  # divided by 1, not 0
    assert max(getattr(vec[2], f"p{h:02d}") for h in range(24)) == 1.0


def test_profile_grid_means_count_missing_slots_as_zero(spark):
    t = slots("2024-01-01 00:00:00", 96)
    r = readings_frame(spark, [(7, t[0], 4.0), (7, t[0], 4.0)])  # two readings in one slot
    p = profile.client_profiles(r, "2024-01-01 00:00:00", "2024-01-02 00:00:00", grid=True).collect()[0]
    assert p.h01 == 8.0 / 4  # local hour 1 = UTC 00:00..00:45, 4 slots
    assert p.mean_kw == 8.0 / 96
    assert p.pct_zero == 95 / 96


def test_profile_means_run_over_the_readings_that_exist(spark):
    t = slots("2024-01-01 00:00:00", 96)  # a Monday
    rows = [(7, t[0], 4.0), (7, t[1], None), (7, t[2], 0.0), (8, t[0], None)]
    got = {r.client_id: r for r in profile.client_profiles(readings_frame(spark, rows)).collect()}
    p = got[7]
    assert (p.h01, p.h02, p.mean_kw, p.pct_zero) == (2.0, None, 2.0, 0.5)  # the null is neither load nor zero load
    assert (p.wd_avg, p.we_avg, p.we_wd_ratio) == (2.0, None, 1.0)
    assert (got[8].mean_kw, got[8].pct_zero, got[8].we_wd_ratio) == (None, None, 1.0)


def test_a_partial_forecast_does_not_win(spark):
    from loadcast.operators import evaluate

    t = slots("2024-01-01 00:00:00", 4)
    actual = spark.createDataFrame([(x, 1.0) for x in t], "datetime_utc timestamp_ntz, actual double")
    part = spark.createDataFrame([(t[0], 1.0), (t[1], None)], "datetime_utc timestamp_ntz, prediction double")
    assert tuple(evaluate.mae(actual, part).collect()[0]) == (0.0, 1, 3)


def test_lookups_are_carried_into_the_window_by_whole_weeks(spark):
    from loadcast.sources import project_daily, project_hourly, weekday_dates

    h = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(24 * 20)]
    hourly = spark.createDataFrame([(x, float(k)) for k, x in enumerate(h)], "datetime_utc timestamp_ntz, demand_forecast double")
    out = {r.datetime_utc: r.demand_forecast for r in project_hourly(hourly, "2024-01-10 00:00:00", "2024-01-25 00:00:00").collect()}
    start = dt.datetime(2024, 1, 10)
    assert len(out) == 24 * 24
    for x, v in out.items():
        back = x
        while back >= start:
            back -= dt.timedelta(days=7)
        assert v == float(h.index(back))
    daily = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=k), k) for k in range(20)], "date date, visitors long")
    got = {r.date: r.visitors for r in project_daily(daily, "2024-01-10", "2024-01-25").collect()}
    assert got[dt.date(2024, 1, 9)] == 8 and got[dt.date(2024, 1, 10)] == 2 and got[dt.date(2024, 1, 24)] == 2
    days = weekday_dates(spark, "2024-01-01", "2024-01-07").collect()
    assert [(r.day_of_week, r.is_weekend) for r in days] == [(2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1), (1, 1)]


def test_daily_tables_bring_every_column(spark):
    base = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "x")], "datetime_local timestamp_ntz, date string")
    a = spark.createDataFrame([(dt.date(2024, 1, 1), 1, "Mon", 9)], "date date, day_of_week int, name string, week int")
    b = spark.createDataFrame([(dt.date(2024, 1, 2), 4)], "date date, visitors long")
    row = enrich.enrich_daily(base, a, b).collect()[0]
    assert (row.date, row.day_of_week, row["name"], row.week, row.visitors) == ("x", 1, "Mon", 9, None)


def test_slot_counts_follow_the_local_clock():
    c = calendar.slot_counts("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert c["total"] == 96 and c["per_hour"] == [4] * 24
    assert c["weekday"] == 96 and c["weekend"] == 0  # Monday, local = UTC + 1 h


def test_submission_audit_counts_defects(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 0, 0), 1.0),
        (dt.datetime(2024, 1, 1, 0, 0), 1.0),  # duplicate
        (dt.datetime(2024, 1, 1, 0, 30), None),  # null
        (dt.datetime(2024, 1, 1, 3, 0), 1.0),  # out of window
    ]
    fc = spark.createDataFrame(rows, "datetime_15min timestamp_ntz, prediction double")
    a = audit.submission_audit(fc, "2024-01-01 00:00:00", "2024-01-01 01:00:00").collect()[0]
    assert (a.n_rows, a.n_slots_expected, a.n_missing_slots, a.n_duplicate_rows, a.n_null_predictions, a.n_out_of_window) == (
        4, 4, 2, 1, 1, 1,
    )


def test_raw_readings_floor_and_cells_add_up(spark):
    ev = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 0, 14, 59), 1.25), (1, dt.datetime(2024, 1, 1, 0, 1), 0.75), (1, dt.datetime(2024, 1, 1, 0, 15), 1.0)],
        "user_id long, ts timestamp_ntz, value double",
    )
    cells = readings_from_events(ev).orderBy("datetime_utc").collect()
    assert [(c.datetime_utc.minute, c.kw_milli) for c in cells] == [(0, 2000), (15, 1000)]
    assert cells[0].datetime_local == dt.datetime(2024, 1, 1, 1, 0)


@pytest.mark.parametrize("bad", [("2024-01-02", "2024-01-01")])
def test_empty_window_is_rejected(bad):
    with pytest.raises(ValueError):
        calendar.slot_sequence(*bad)


def test_profiles_from_cells_equal_profiles_from_raw_readings(spark):
    from loadcast.sources.consumption import to_cells

    t = slots("2024-01-01 00:00:00", 96 * 2)
    rows = [(c, x, float((i * 7 + c) % 5)) for c in range(3) for i, x in enumerate(t)]
    rows += [(0, t[5], 1.5), (2, t[9], 0.25)]  # second readings in two slots
    raw = readings_frame(spark, rows)
    a = profile.client_profiles(raw, "2024-01-01 00:00:00", "2024-01-03 00:00:00", grid=True)
    b = profile.client_profiles(to_cells(raw), "2024-01-01 00:00:00", "2024-01-03 00:00:00", readings_are_cells=True, grid=True)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_consumption_table_contract_feeds_the_forecaster(spark):
    from loadcast.plans.forecast import SeasonalNaiveForecaster
    from loadcast.sources import readings_from_consumption

    t = slots("2024-01-01 00:00:00", 96 * 8)
    rows = [(3, x + dt.timedelta(hours=1), "X", float(i % 96)) for i, x in enumerate(t)]
    table = spark.createDataFrame(rows, "client_id int, datetime_local timestamp, community_code string, active_kw double")
    readings = readings_from_consumption(table)
    assert readings.schema["datetime_utc"].dataType.typeName() == "timestamp_ntz"
    first = readings.orderBy("datetime_utc").first()
    assert first.datetime_utc == dt.datetime(2024, 1, 1) and first.kw_milli == 0
    out = SeasonalNaiveForecaster("2024-01-01 00:00:00").predict(readings, "2024-01-08 01:00:00", "2024-01-09 01:00:00")
    got = {r.datetime_15min: r.prediction for r in out.collect()}
    assert len(got) == 96 and got[dt.datetime(2024, 1, 8, 2, 0)] == 4.0


def test_price_match_by_hour_or_by_instant(spark):
    h = dt.datetime(2024, 1, 1, 5)
    hourly = spark.createDataFrame([(h, 10.0)], "datetime_utc timestamp_ntz, AvgPrice double")
    base = spark.createDataFrame([(h,), (h + dt.timedelta(minutes=15),)], "datetime_utc timestamp_ntz")
    by_hour = sorted(r.AvgPrice for r in enrich.enrich_price(base, hourly).collect())
    by_instant = [r.AvgPrice for r in enrich.enrich_price(base, hourly, match="instant").orderBy("datetime_utc").collect()]
    assert by_hour == [10.0, 10.0] and by_instant == [10.0, None]


def test_zone_clock_keeps_every_real_interval_across_the_autumn_change(spark):
    from collections import Counter

    from loadcast.functions.clock import to_local
    from loadcast.plans.forecast import SeasonalNaiveForecaster

    zone = "Europe/Madrid"  # 2024-10-27: 03:00 CEST -> 02:00 CET
    t = slots("2024-10-13 00:00:00", 96 * 15)
    df = spark.createDataFrame([(1, x, 1000) for x in t], "client_id long, datetime_utc timestamp_ntz, kw_milli long")
    readings = df.withColumn("datetime_local", to_local("datetime_utc", zone))
    fc_df = SeasonalNaiveForecaster("2024-10-13 00:00:00", local_shift=zone).predict(
        readings, "2024-10-27 00:00:00", "2024-10-28 00:00:00"
    )
    a = audit.submission_audit(fc_df, "2024-10-27 00:00:00", "2024-10-28 00:00:00", zone).collect()[0]
    assert (a.n_rows, a.n_slots_expected, a.n_missing_slots, a.n_duplicate_rows) == (100, 100, 0, 0)
    out = fc_df.collect()
    assert len(out) == 100  # a 25-hour local day
    twice = sorted(k for k, v in Counter(r.datetime_15min for r in out).items() if v == 2)
    assert twice == [dt.datetime(2024, 10, 27, 2, m) for m in (0, 15, 30, 45)]
    assert all(r.prediction == 1.0 for r in out)
    c = calendar.slot_counts("2024-10-26 22:00:00", "2024-10-27 23:00:00", zone)
    assert c["total"] == 100 and c["per_hour"][2] == 8
