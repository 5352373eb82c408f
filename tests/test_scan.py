"""Scans by ranges against plain Python: holes and long runs across the borders of ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loadcast.operators import enrich
from loadcast.operators.scan import RANGE, dense_ranks, last_known, ranged


def carried(rows):
    out, last = [], None
    for t, v, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        last = v if v is not None else last
        out.append((t, last, x))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_last_known_across_borders(spark, parts):
    rng = random.Random(1)
    rows = [(t, rng.randint(0, 99) if 50 < t < 400 and rng.random() < 0.02 else None, f"x{t}") for t in range(600)]
    rng.shuffle(rows)
    got = last_known(spark.createDataFrame(rows, "t int, v int, x string"), "t", ["v"], parts)
    assert sorted((tuple(r) for r in got.collect()), key=str) == carried(rows)


def test_a_hole_at_a_border(spark):
    """The last value of a range is null, and whole ranges are."""
    rows = [(t, 7 if t == 3 else 9 if t == 95 else None, "x") for t in range(100)]
    df = spark.createDataFrame(rows, "t int, v int, x string")
    with_values = ranged(df, "t", parts=10).where("v IS NOT NULL").select(RANGE).distinct().count()
    assert with_values == 2  # eight ranges hold nothing
    got = {r.t: r.v for r in last_known(df, "t", ["v"], 10).collect()}
    assert got == {t: None if t < 3 else 7 if t < 95 else 9 for t in range(100)}


def test_equal_orders_nulls_and_no_rows(spark):
    rows = [(1, None, "a"), (1, 4, "b"), (1, 6, "c"), (2, None, "d"), (None, 5, "e"), (None, None, "f")]
    got = {r.x: r.v for r in last_known(spark.createDataFrame(rows, "t int, v int, x string"), "t", ["v"], 3).collect()}
    assert got == {"a": 6, "b": 4, "c": 6, "d": 6, "e": 5, "f": 5}
    assert last_known(spark.createDataFrame([], "t int, v int"), "t", ["v"]).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_ranks_by_ranges(spark, parts):
    rng = random.Random(2)
    values = [rng.choice([None, *range(300)]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    distinct = sorted({v for v in values if v is not None})
    assert sorted(tuple(r) for r in dense_ranks(df, "v", "k", parts).collect()) == [(v, k) for k, v in enumerate(distinct)]


def test_codes_join_back(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "c string, n int")
    assert sorted((r.n, r.c_num) for r in enrich.dense_code(df, "c").collect()) == [(1, 1), (2, 0), (3, None), (4, 1)]


def test_no_window_over_a_whole_lookup(spark):
    """The scan's windows run inside ranges; the one over all ranges sees a row per range."""
    df = spark.range(1000).select(F.col("id").alias("t"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    plan = last_known(df, "t", ["v"], 4)._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert "Window" in plan and len(alone) <= 1
