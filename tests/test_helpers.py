"""Driver-side helpers (parameter arithmetic only, no Spark job)."""

from __future__ import annotations

import datetime as dt

import pytest

from loadcast.functions.clock import fixed_shift, is_zone, py_slot_index, py_to_local, py_to_utc
from loadcast.session import recommended_conf


def test_shift_or_zone():
    assert not is_zone("1 hour") and not is_zone("-30 minutes")
    assert is_zone("Europe/Madrid")
    assert fixed_shift("2 hours") == dt.timedelta(hours=2)
    with pytest.raises(ValueError):
        fixed_shift("Europe/Madrid")


def test_zone_round_trip_and_autumn_repeat():
    z = "Europe/Madrid"
    a, b = dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 10, 27, 1, 30)
    assert py_to_local(a, z) == py_to_local(b, z) == dt.datetime(2024, 10, 27, 2, 30)
    assert py_to_utc(dt.datetime(2024, 10, 27, 2, 30), z) == a  # first occurrence
    assert py_to_utc(py_to_local(dt.datetime(2024, 7, 1, 12), z), z) == dt.datetime(2024, 7, 1, 12)


def test_slot_index_of_parameters():
    assert py_slot_index("1970-01-01 00:15:00") == 1
    assert py_slot_index("2024-01-02 00:00:00") - py_slot_index("2024-01-01 00:00:00") == 96


def test_recommended_conf_scales_with_input():
    big = recommended_conf(100 * 10**12, 1000, 8)
    small = recommended_conf(10**8, 1, 8)
    assert int(big["spark.sql.shuffle.partitions"]) > 100_000
    assert int(small["spark.sql.shuffle.partitions"]) == 24  # three waves of 8 cores
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_all_starts_move_as_each_alone():
    import numpy as np

    from loadcast.operators import cluster

    rng = np.random.default_rng(3)
    x = rng.integers(0, 1_000_001, (400, 6)).astype(float)
    x[7] = x[8]
    centres = rng.integers(0, 1_000_001, (5, 4, 6)).astype(float)
    centres[2, 3] = centres[2, 0]  # equally near: the first takes all
    for (sums, counts, cost), own in zip(cluster.moved(x, centres), centres, strict=True):
        d = ((x[:, None, :] - own[None]) ** 2).sum(2)
        near = d.argmin(1)
        assert counts.tolist() == [int((near == j).sum()) for j in range(4)]
        assert sums.tolist() == [x[near == j].sum(0).astype(int).tolist() for j in range(4)]
        assert cost == int(d.min(1).sum())


def test_lookups_are_carried_in_one_reading_of_their_source(spark, tmp_path):
    import datetime as dt

    from loadcast.sources import project_daily, project_hourly

    t0 = dt.datetime(2024, 1, 1)
    path = str(tmp_path / "hours")
    spark.createDataFrame(
        [(t0 + dt.timedelta(hours=h), float(h)) for h in range(24 * 20) if h != 300] + [(t0 + dt.timedelta(hours=200, minutes=10), -1.0)],
        "datetime_utc timestamp_ntz, demand_forecast double",
    ).write.parquet(path)
    out = project_hourly(spark.read.parquet(path), "2024-01-15 00:00:00", "2024-01-25 00:00:00")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    known = {(t0 + dt.timedelta(hours=h)): float(h) for h in range(24 * 14) if h != 300} | {t0 + dt.timedelta(hours=200, minutes=10): -1.0}
    later = {t0 + dt.timedelta(hours=h): float(h - (h - 336) // 168 * 168 - 168) for h in range(336, 576)}
    later = {t: v for t, v in later.items() if v != 300.0}
    assert {(r.datetime_utc, r.demand_forecast) for r in out.collect()} == set((known | later).items())

    days = str(tmp_path / "days")
    spark.createDataFrame([(dt.date(2024, 1, d), d) for d in range(1, 20) if d != 10], "date date, visitors long").write.parquet(days)
    out = project_daily(spark.read.parquet(days), "2024-01-15", "2024-01-25")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want = {(dt.date(2024, 1, d), d) for d in range(1, 15) if d != 10} | {(dt.date(2024, 1, d), 8 + (d - 15) % 7) for d in range(15, 26) if 8 + (d - 15) % 7 != 10}
    assert {(r.date, r.visitors) for r in out.collect()} == want
