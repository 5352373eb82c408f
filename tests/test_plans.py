"""Shape of the physical plans: what must hold for the jobs to scale."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from loadcast.operators import cluster

from .conftest import SMOKE_DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan)) or plan.count(f"{table}.parquet")


def test_total_scans_the_fact_once_with_pushdown_and_pruning(spark):
    df = entry.queries()["total_load"](spark, SMOKE_DIR)
    plan = _plan(df)
    assert _scans(plan, "events") == 1
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan  # user_id pruned
    assert "partial_sum" in plan  # map-side combine before the shuffle


def test_features_scan_once_and_reuse_the_series_partitioning(spark):
    df = entry.queries()["lag_features"](spark, SMOKE_DIR)
    plan = _plan(df)
    assert _scans(plan, "events") == 1
    # the gap-fill window and the feature window share one exchange on the key
    windows = plan.count("Window [")
    assert windows >= 2
    assert len(re.findall(r"Exchange hashpartitioning\(community_code#\d+, \d+\)", plan)) == 1
    # the big side is only shuffled after map-side partial aggregation
    assert "partial_sum" in plan


def test_profiles_aggregate_cells_on_client_and_slot(spark):
    df = entry.queries()["profile_vector"](spark, SMOKE_DIR)
    plan = _plan(df)
    assert re.search(r"hashpartitioning\(client_id#\d+L, datetime_utc", plan)


def test_cluster_map_is_broadcast_when_its_size_is_bounded(spark):
    readings = spark.read.parquet(f"{SMOKE_DIR}/events.parquet").selectExpr(
        "user_id AS client_id", "ts AS datetime_utc", "value"
    )
    mapping = spark.range(10).selectExpr("id AS client_id", "CAST(id % 3 AS INT) AS cluster_id")
    small = cluster.attach_cluster(readings, mapping, n_clients=10)
    assert "BroadcastHashJoin" in _plan(small)
    # no bound given and no usable estimate: the planner decides
    big = cluster.attach_cluster(readings, mapping.repartition(4), n_clients=10**10)
    assert "BroadcastHashJoin" in _plan(big) or "SortMergeJoin" in _plan(big)


def test_seasonal_naive_and_backtest_are_one_scan_without_joins(spark):
    for name in ("seasonal_naive", "backtest_folds"):
        plan = _plan(entry.queries()[name](spark, SMOKE_DIR))
        assert _scans(plan, "events") == 1, name
        assert "Join" not in plan and "CartesianProduct" not in plan, name


def test_wide_combination_is_one_aggregation_whatever_the_number_of_series(spark):
    plan = _plan(entry.queries()["combine_outer"](spark, SMOKE_DIR))
    assert "Join" not in plan and len(re.findall(r"Exchange hashpartitioning", plan)) <= 2


def test_hourly_means_do_not_shuffle_the_fact(spark):
    plan = _plan(entry.queries()["profile_hourly"](spark, SMOKE_DIR))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "partial_sum" in plan
    assert not re.search(r"hashpartitioning\(client_id#\d+L, datetime_utc", plan)


def test_weekdays_read_no_table(spark):
    assert _scans(_plan(entry.queries()["scan_weekday"](spark, SMOKE_DIR)), "events") == 0


def test_interpolation_reads_the_fact_once_besides_the_total(spark):
    for name in ("enrich_demand_interp", "interp_many"):
        assert _scans(_plan(entry.queries()[name](spark, SMOKE_DIR)), "events") <= 1, name


def test_forecast_window_spine_join_is_broadcast(spark):
    plan = _plan(entry.queries()["sorted_result"](spark, SMOKE_DIR))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
