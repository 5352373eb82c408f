"""Property tests: the running-sum frame means and the window gap fill
against direct computations, on random series."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcast.operators import calendar, features

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-5000, 5000)), min_size=1, max_size=60),
    lo=st.integers(-20, 0),
    width=st.integers(0, 20),
)
def test_frame_mean_equals_direct_frame_average(spark, values, lo, width):
    hi = min(0, lo + width)
    rows = [("s", T0 + dt.timedelta(minutes=15 * i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sid string, datetime_utc timestamp_ntz, load_milli long")
    out = features.add_rolling(df, "sid", {"m": (lo, hi)})
    w = Window.partitionBy("sid").orderBy("datetime_utc").rowsBetween(lo, hi)
    direct = out.select(
        "datetime_utc", "m",
        F.when(F.count("load_milli").over(w) > 0,
               F.sum("load_milli").over(w) / 1000.0 / F.count("load_milli").over(w)).alias("d"),
    ).collect()
    assert all(r.m == r.d for r in direct)


@SETTINGS
@given(
    present=st.sets(st.integers(0, 47), min_size=1, max_size=20),
    keys=st.integers(1, 3),
)
def test_gap_fill_equals_spine_left_join(spark, present, keys):
    rows = [
        (f"k{k}", T0 + dt.timedelta(minutes=15 * i), 1000 * i + k)
        for k in range(keys) for i in sorted(present)
    ]
    df = spark.createDataFrame(rows, "sid string, datetime_utc timestamp_ntz, load_milli long")
    end = (T0 + dt.timedelta(hours=12)).strftime("%Y-%m-%d %H:%M:%S")
    dense = calendar.densify(df, "sid", T0.strftime("%Y-%m-%d %H:%M:%S"), end, fill={"load_milli": 0})
    got = {(r.sid, r.datetime_utc): r.load_milli for r in dense.collect()}
    expect = {
        (f"k{k}", T0 + dt.timedelta(minutes=15 * i)): (1000 * i + k if i in present else 0)
        for k in range(keys) for i in range(48)
    }
    assert got == expect


@SETTINGS
@given(
    n_weeks=st.integers(1, 3),
    start_day=st.integers(0, 9),
    horizon_days=st.integers(1, 16),
    holes=st.sets(st.integers(0, 96 * 24 - 1), max_size=30),
)
def test_seasonal_naive_equals_brute_force(spark, n_weeks, start_day, horizon_days, holes):
    from loadcast.operators import baseline

    n = 96 * 24  # 24 days of slots
    vals = [None if i in holes else (i * 7919) % 1000 for i in range(n)]
    rows = [("s", T0 + dt.timedelta(minutes=15 * i), T0 + dt.timedelta(minutes=15 * i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "sid string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, load_milli long")
    s0 = 96 * (7 * n_weeks + start_day) if 7 * n_weeks + start_day < 24 else 96 * 7
    s1 = min(n, s0 + 96 * horizon_days)
    start = (T0 + dt.timedelta(minutes=15 * s0)).strftime("%Y-%m-%d %H:%M:%S")
    end = (T0 + dt.timedelta(minutes=15 * s1)).strftime("%Y-%m-%d %H:%M:%S")
    got = {r.datetime_utc: r.prediction for r in baseline.seasonal_naive(df, "sid", start, end).collect()}
    hist = [v for v in vals[:s0] if v is not None]
    fallback = (sum(hist) / 1000.0) / len(hist) if hist else None
    for i in range(s0, s1):
        src = i - 672 * ((i - s0) // 672 + 1)
        v = vals[src] if src >= 0 else None
        expect = v / 1000.0 if v is not None else fallback
        assert got[T0 + dt.timedelta(minutes=15 * i)] == expect
    assert len(got) == s1 - s0
