from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.llm.lloyd import LARGEST, lloyd, packed, unpacked

EXTRA = "cluster long, n string, chunk long, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], f"vec_id long, embedding array<float>, {EXTRA}")


def brute(rows, dimensions, clusters, rounds, seed=2, scale=256):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dimensions or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(float(np.float32(c)) * scale) for c in v]
        if max(map(abs, x)) <= LARGEST:
            kept.append((i, x))
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, x) for i, x in kept if i is not None)
    cents = [x for _, _, x in first[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))

    def assign():
        return [min((far(x, c), k) for k, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        labels = [k for _, k in assign()]
        for k in range(len(cents)):
            own = [x for (_, x), at in zip(kept, labels, strict=True) if at == k]
            if own:
                cents[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return [(i, k, d) for (i, _), (d, k) in zip(kept, assign(), strict=True)], cents


def check(spark, rows, **how):
    labels, cents = lloyd(frame(spark, rows), width=how.pop("width", 3), **how)
    want, centres = brute(rows, **how)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in labels.select("vec_id", "cluster", "distance").collect()), key=key) == sorted(want, key=key)
    got = {(r.cluster, r.dim): r.value for r in cents.collect()}
    assert got == {(k, d): x for k, c in enumerate(centres) for d, x in enumerate(c)}


def clouds(n, dimensions, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dimensions))
    return [(i, [float(x) for x in (centres[i % 6] + spread * rng.standard_normal(dimensions)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 8])
def test_against_brute_force(spark, width):
    check(spark, clouds(700, 8, 1), dimensions=8, clusters=7, rounds=4, width=width)


def test_ties_repeats_nulls_and_wrong_vectors(spark):
    rows = clouds(40, 4, 2) + [(100, [0.5] * 4)] * 30 + [(None, [1.0] * 4), (100, [0.25] * 4)]
    rows += [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf")] * 4), (206, [1e30] * 4)]
    rows += [(207, [40000.0, -40000.0, 0.0, 1.0])]  # whole numbers beyond the exact range of products of doubles
    check(spark, rows, dimensions=4, clusters=9, rounds=5)


def test_equal_vectors_leave_clusters_empty(spark):
    check(spark, [(i, [1.0, -1.0]) for i in range(20)], dimensions=2, clusters=5, rounds=3)


def test_fewer_vectors_than_clusters(spark):
    check(spark, clouds(3, 5, 3), dimensions=5, clusters=40, rounds=2)


def test_empty_table(spark):
    labels, cents = lloyd(frame(spark, []))
    assert labels.count() == 0 and cents.count() == 0


def test_hot_group_of_copies(spark):
    rows = clouds(600, 6, 4)
    check(spark, rows + [(1000 + i, rows[0][1]) for i in range(1200)], dimensions=6, clusters=6, rounds=2)


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 40])
def test_packed_round_trip(top):
    x = np.random.default_rng(top).integers(-top, top, (5, 7))
    assert (unpacked(packed(x)).reshape(5, 7) == x).all()


def test_query_covers_every_vector(spark):
    from loadcast.llm.lloyd import op11_centroid_clustering

    got = op11_centroid_clustering(spark, "/root/testdata/sf0.001")
    sums = got.groupBy("cluster").agg(F.sum("distance").alias("d"), F.max("cluster_inertia").alias("i"), F.max("inertia").alias("all"))
    rows = sums.collect()
    assert all(r.d == r.i for r in rows) and {r.all for r in rows} == {sum(r.d for r in rows)}
