"""A client holding a third of all readings: results equal a brute-force
computation, and the plans never key a big shuffle on the client alone."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict

import pytest

from loadcast.operators import profile, series

from .conftest import readings_frame, slots

START, END = "2024-01-01 00:00:00", "2024-01-03 00:00:00"


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    ts = slots(START, 192)
    rows = []
    for c in range(1, 41):  # 40 ordinary clients, a few readings each
        for t in rng.sample(ts, 25):
            rows.append((c, t, round(rng.uniform(0, 5), 2)))
    hot = len(rows) // 2  # the hot client: a third of all rows, many per slot
    for _ in range(hot):
        rows.append((0, rng.choice(ts), round(rng.uniform(0, 5), 2)))
    return rows, readings_frame(spark, rows)


def test_total_under_skew_matches_brute_force(skewed):
    rows, df = skewed
    expect = defaultdict(int)
    for _c, t, kw in rows:
        expect[t] += round(kw * 1000)
    got = {r.datetime_utc: r.load_milli for r in series.total_load(df, START, END).collect()}
    assert len(got) == 192
    assert all(got[t] == expect.get(t, 0) for t in got)


def test_profiles_under_skew_match_brute_force(skewed):
    rows, df = skewed
    cells = defaultdict(int)
    for c, t, kw in rows:
        cells[(c, t)] += round(kw * 1000)
    hot = {(t, v) for (c, t), v in cells.items() if c == 0}
    prof = {p.client_id: p for p in profile.client_profiles(df, START, END, grid=True).collect()}
    n = 192
    nz = sum(1 for _t, v in hot if v != 0)
    assert prof[0].pct_zero == (n - nz) / n
    assert prof[0].mean_kw == (sum(v for _t, v in hot) / 1000.0) / n
    h3 = sum(v for t, v in hot if (t + dt.timedelta(hours=1)).hour == 3)
    assert prof[0].h03 == (h3 / 1000.0) / 8


def test_no_big_shuffle_is_keyed_on_the_client_alone(skewed):
    _rows, df = skewed
    plan = profile.client_profiles(df, START, END, grid=True)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    # raw readings are shuffled on (client, slot); the client-only exchange
    # carries one partial row per client and task
    assert any(k.startswith("client_id") and "datetime_utc" in k for k in keys)
    assert "partial_sum" in plan
