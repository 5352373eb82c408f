"""Two-phase tables, day partials, the submission sink and stored fits."""

from __future__ import annotations

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loadcast.operators import partials, profile, series, sink
from loadcast.operators.boost import BoostParams
from loadcast.plans.artefact import StoredModels
from loadcast.plans.forecast import ClusterBoostForecaster
from loadcast.sources.versions import Versions

from .conftest import readings_frame, slots

SCHEMA = "part string, v int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def test_parts_are_replaced_whole(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "part", SCHEMA)
    assert held(t) == [] and t.live() == {}
    t.replace(rows(spark, ("a", 1), ("a", 2), ("b", 3), (None, 9)), ["a", "b", None])
    t.replace(rows(spark, ("a", 4)), ["a"])
    assert held(t) == [("a", 4), ("b", 3), (None, 9)]
    t.replace(rows(spark), ["b"])  # delivered again, empty
    assert held(t) == [("a", 4), (None, 9)]
    assert sorted(tuple(r) for r in t.read(["a", "zz"]).collect()) == [("a", 4)] and [r.v for r in t.read([None]).collect()] == [9]
    assert t.vacuum() == 1 and held(t) == [("a", 4), (None, 9)]  # the empty version


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "part", SCHEMA)
    t.replace(rows(spark, ("a", 1)), ["a"])

    def refuse(staged):
        raise ValueError(f"{staged.count()} rows")

    with pytest.raises(ValueError, match="2 rows"):
        t.replace(rows(spark, ("a", 2), ("a", 3)), ["a"], refuse)
    with pytest.raises(ValueError, match="not replaced"):
        t.replace(rows(spark, ("b", 2)), ["a"])
    with pytest.raises(Exception):
        t.replace(rows(spark, ("a", 2)).withColumn("v", F.raise_error(F.lit("broken")).cast("int")), ["a"])
    assert held(t) == [("a", 1)] and t.vacuum() == 0


def test_writers_at_once_both_stay(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), "part", SCHEMA)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: t.replace(rows(spark, (f"p{k}", k)), [f"p{k}"]), range(4)))
    assert held(t) == [(f"p{k}", k) for k in range(4)]


def test_submissions_in_two_phases(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    stamped = lambda team, n, v=1.0: sink.stamp_submission(
        spark.createDataFrame([(t0 + dt.timedelta(minutes=15 * k), v) for k in range(n)], "datetime_15min timestamp_ntz, prediction double"), team)
    path = str(tmp_path / "subs")
    name = "two_phase_submissions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    try:
        with ThreadPoolExecutor(2) as pool:  # two first writers
            list(pool.map(lambda team: (sink.write_submission(stamped(team, 3), path), sink.save_submission(stamped(team, 3), name)), ("it's a", "b")))
        for write, target in ((sink.write_submission, path), (sink.save_submission, name)):
            write(stamped("b", 5, 2.0), target, expected=5)
            with pytest.raises(ValueError, match="4 rows staged where 5"):
                write(stamped("b", 4, 3.0), target, "b", 5)
            with pytest.raises(ValueError, match="one team"):
                write(stamped("x", 2).union(stamped("y", 1)), target)
        for got in (sink.submissions(spark, path).read(), spark.table(name)):
            assert sorted((r.team_name, r["count"], r.p) for r in got.groupBy("team_name").agg(F.count("*").alias("count"), F.max("prediction").alias("p")).collect()) == [("b", 5, 2.0), ("it's a", 3, 1.0)]
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows = [(c, t, None if rng.random() < 0.05 else round(rng.random() * 4, 2) * (rng.random() > 0.1))
            for c in range(6) for t in slots("2024-01-01 00:00:00", 96 * 12) if rng.random() < 0.4]
    return readings_frame(spark, rows).withColumn("community_code", F.when(F.col("client_id") != 5, F.concat(F.lit("c"), (F.col("client_id") % 2).cast("string")))).cache()


def test_day_partials_equal_a_full_pass(spark, readings, tmp_path):
    state = partials.DayState(spark, str(tmp_path / "days"))
    seen = []

    def reader(df):
        def read(first, last):
            seen.append((first, last))
            return df

        return read

    early = readings.where((F.to_date("datetime_local") != F.lit("2024-01-04").cast("date")) | (F.col("client_id") < 3))
    state.put(reader(early), "2024-01-01", "2024-01-06")
    assert state.days.live().keys() == set(partials.day_range("2024-01-01", "2024-01-06"))
    state.put(reader(readings), "2024-01-04", "2024-01-04")      # late readings
    state.put(reader(readings), "2024-01-07", "2024-01-13")      # the 13th local day has an hour only
    state.put(reader(readings), "2024-01-07", "2024-01-07")      # repeated
    want = sorted((tuple(r) for r in profile.client_profiles(readings).collect()), key=str)
    assert sorted((tuple(r) for r in state.profiles().collect()), key=str) == want
    before = readings.where(F.col("datetime_local") < F.lit("2024-01-09").cast("timestamp_ntz"))
    assert sorted((tuple(r) for r in state.profiles("2024-01-09").collect()), key=str) == sorted((tuple(r) for r in profile.client_profiles(before).collect()), key=str)
    dense = series.dense_series(readings, "community_code", "2024-01-01 00:00:00", "2024-01-13 00:00:00").drop("sum_active_kw")
    got = state.dense_series("2024-01-01 00:00:00", "2024-01-13 00:00:00", "1 hour").drop("sum_active_kw")
    assert sorted(map(str, got.collect())) == sorted(map(str, dense.select(got.columns).collect())) and got.count() == 3 * 96 * 12


def test_days_are_read_alone(spark, readings, tmp_path):
    state = partials.DayState(spark, str(tmp_path / "days"))
    state.put(lambda a, b: readings, "2024-01-02", "2024-01-05")
    plan = state.client_days("2024-01-04")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__part" in plan  # files of other days are not opened
    days = {r.day for r in state.client_days("2024-01-04").select("day").distinct().collect()}
    assert days == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}


def test_stored_fit_forecasts_alike(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, t, round(2 + 2 * (((t.hour + 3 * (c % 2)) // 4) % 3) + rng.random(), 2)) for c in range(6) for t in slots("2024-01-01 00:00:00", 96 * 35)]
    readings = readings_frame(spark, rows).cache()
    fc = ClusterBoostForecaster(history_start="2024-01-01 00:00:00", k=2, n_init=2, boost=BoostParams(rounds=4, depth=3))
    start, end = "2024-01-29 00:00:00", "2024-02-02 00:00:00"
    feats, models = fc.fit_window(readings, start, end)
    want = sorted(tuple(r) for r in fc.total(models, feats, start, end).collect())
    store = StoredModels(spark, str(tmp_path / "models"))
    store.save("jan", fc, models, feats)
    other = StoredModels(spark.newSession(), str(tmp_path / "models"))
    loaded, trees = other.load("jan")
    assert sorted(tuple(r) for r in loaded.predict_fitted(trees, readings, start, end).collect()) == want
    assert trees[0].errors == models[0].errors and loaded.boost == fc.boost
    # a later window, and a client seen since: nearest centre, nothing fitted
    newcomer = readings.where("client_id = 1").withColumn("client_id", F.lit(99).cast("long"))
    later = loaded.predict_fitted(trees, readings.union(newcomer), "2024-02-03 00:00:00", "2024-02-04 00:00:00")
    assert later.count() == 96 and later.where("prediction IS NULL").count() == 0
    with pytest.raises(KeyError):
        other.load("feb")
