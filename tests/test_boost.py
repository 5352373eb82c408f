"""The booster against a plain one, and what it must do with missing values, slices and held-out rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.operators import boost
from loadcast.operators.boost import BoostParams, fit_boosted, model_nodes, predict_boosted
from loadcast.operators.model import complete_rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "series string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, sum_active_kw double, a double, b double, c double, held boolean"
FEATURES = ["a", "b", "c"]


def rows_of(seed, n=400, gaps=0.2):
    rng = random.Random(seed)
    out = []
    for key in ("x", "y", None):
        for i in range(n):
            a, b, c = (rng.randint(0, 30) / 4, rng.gauss(0, 3), float(rng.randint(0, 2)))
            y = (3 if a > 4 else 0) + b * (1 if c == 1 else -1) + rng.gauss(0, 0.3) + (5 if key == "y" else 0)
            t = T0 + dt.timedelta(minutes=15 * i)
            hide = lambda v: None if rng.random() < gaps else v
            a, b = hide(a), hide(b)
            out.append((key, t, t, round(y, 3), a, b, float("nan") if a is not None and rng.random() < 0.1 else c, i >= n - 80))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_fit(rows, p: BoostParams):
    """One series, node by node, rows as lists."""
    unit = boost.UNIT
    x = [[v if v is None or v == v else None for v in r[4:7]] for r in rows]
    y = [r[3] for r in rows]
    base = sum(int(np.floor(v * unit + 0.5)) for v in y) / len(y) / unit
    edges = []
    for f in range(3):
        own = sorted(r[f] for r in x if r[f] is not None)
        edges.append(sorted({own[max(1, -(-i * len(own) // p.max_bins)) - 1] for i in range(1, p.max_bins + 1)}) if own else [])
    at = [base] * len(y)
    for _ in range(p.rounds):
        g = [int(np.floor((v - q) * unit + 0.5)) for v, q in zip(y, at, strict=True)]
        score = lambda s, n: (s / unit) * (s / unit) / (n + p.l2)

        def grow(own, depth):
            total, n = sum(g[i] for i in own), len(own)
            best = None
            for f in range(3) if depth < p.depth and n >= 2 * p.min_instances else ():
                for e in edges[f]:
                    for side in (False, True):
                        left = [i for i in own if (side if x[i][f] is None else x[i][f] <= e)]
                        s, m = sum(g[i] for i in left), len(left)
                        if min(m, n - m) < p.min_instances:
                            continue
                        gain = score(s, m) + score(total - s, n - m) - score(total, n)
                        if gain > p.min_gain and (best is None or gain > best[0]):
                            best = (gain, f, e, side, left)
            if best is None:
                for i in own:
                    at[i] += p.step * ((total / unit) / (n + p.l2))
                return
            grow(best[4], depth + 1)
            grow(sorted(set(own) - set(best[4])), depth + 1)

        grow(list(range(len(y))), 0)
    return at


@pytest.mark.parametrize("block", [50_000, 90])
def test_against_a_plain_booster(spark, monkeypatch, block):
    """Also with each series cut into several blocks."""
    monkeypatch.setattr(boost, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(boost, "CHECKPOINT_ROUNDS", 2)
    rows, p = rows_of(1, 250), BoostParams(rounds=3, depth=3, max_bins=16, min_instances=5)
    models = fit_boosted(frame(spark, rows), "series", FEATURES, p)
    got = {(r.series, r.datetime_utc): r.prediction for r in predict_boosted(models, frame(spark, rows), "series", FEATURES).collect()}
    for key in ("x", "y", None):
        own = [r for r in rows if r[0] == key]
        assert [got[key, r[1]] for r in own] == plain_fit(own, p)
        mae = sum(abs(int(np.floor((r[3] - got[key, r[1]]) * boost.UNIT + 0.5))) for r in own) / len(own) / boost.UNIT
        assert models[key].errors[-1] == (mae, None) and len(models[key].errors) == 3


def test_slices_and_partitions_do_not_move_a_model(spark, monkeypatch):
    rows, p = rows_of(2), BoostParams(rounds=6, depth=4, min_instances=3)
    nodes = []
    for block, parts in ((50_000, 1), (50_000, 7), (64, 3)):
        monkeypatch.setattr(boost, "ROWS_PER_BLOCK", block)
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        nodes.append(sorted((tuple(r) for r in model_nodes(fit_boosted(df, "series", FEATURES, p), df, "series", FEATURES).collect()), key=str))
    assert nodes[0] == nodes[1] == nodes[2] and len(nodes[0]) > 60


def test_gaps_that_carry_signal_are_learned(spark):
    """A feature that is missing whenever the load is high: dropping such rows never sees a high load."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        high = rng.random() < 0.3
        t = T0 + dt.timedelta(minutes=15 * i)
        rows.append(("x", t, t, (9.0 if high else 1.0) + rng.gauss(0, 0.2), None if high else rng.random(), rng.random(), 0.0, i >= 900))
    df = frame(spark, rows)
    train, test = df.where("not held"), df.where("held")
    p = BoostParams(rounds=10, depth=2, min_instances=5)

    def error(models):
        return predict_boosted(models, test, "series", FEATURES, ["sum_active_kw"]).agg(F.avg(F.abs(F.col("prediction") - F.col("sum_active_kw")))).first()[0]

    learned = fit_boosted(train, "series", FEATURES, p)
    assert error(learned) < 0.5 < 2 < error(fit_boosted(complete_rows(train, FEATURES), "series", FEATURES, p))
    root = learned["x"].trees[0]
    assert root.feature[1] == 0 and not root.missing_left[1]  # the whole of what is there against what is missing


def test_held_out_rows_choose_the_rounds(spark):
    rows = rows_of(4, 300, 0.0)
    noise = random.Random(5)
    rows = [(*r[:3], noise.gauss(0, 1), *r[4:]) for r in rows]  # nothing to learn: every round only fits noise
    p = BoostParams(rounds=12, depth=5)
    every = fit_boosted(frame(spark, rows), "series", FEATURES, p, held_out="held")
    chosen = fit_boosted(frame(spark, rows), "series", FEATURES, BoostParams(rounds=12, depth=5, choose_rounds=True), held_out="held")
    for k, m in chosen.items():
        held = [e for _, e in every[k].errors]
        train = [e for e, _ in every[k].errors]
        assert len(held) == 12 and all(b <= a for a, b in zip(train, train[1:]))
        assert len(m.trees) == held.index(min(held)) + 1 < 12
        assert m.n_rows == 220


def test_nothing_to_learn_from(spark):
    assert fit_boosted(spark.createDataFrame([], SCHEMA), "series", FEATURES) == {}
    lost = [("x", T0, T0, 1.0, None, None, None, False), ("y", T0, T0, None, 1.0, 1.0, 1.0, False), ("z", T0, T0, 2.0, 1.0, 1.0, 1.0, False)]
    models = fit_boosted(spark.createDataFrame(lost, SCHEMA), "series", FEATURES, BoostParams(rounds=2))
    assert list(models) == ["z"] and models["z"].base == 2.0
    assert [r.prediction for r in predict_boosted(models, spark.createDataFrame(lost, SCHEMA), "series", FEATURES).collect()] == [2.0]


def test_large_sums_stay_exact():
    v = np.array([3 * 10**15 + 1] * 7 + [-(10**15)] * 5)
    at = np.array([0, 1] * 6)
    assert boost.exact_sums(at, v, 2).tolist() == [sum(int(a) for a in v[::2]), sum(int(a) for a in v[1::2])]
