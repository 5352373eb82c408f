from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, shard int, score double, uid long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2, 0.5, 3) for i, v, y in rows], SCHEMA)


def sample(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, dim))
    rows = []
    for k in range(n):
        v = centres[k % len(centres)] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.3])
        rows.append((k, v.astype(np.float32).tolist(), int(k % len(centres) % 3)))
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, None, 1), (n + 3, [0.0] * dim, 1), (n + 4, [math.nan] * dim, 1),
             (n + 5, [None] + [1.0] * (dim - 1), 1), (n + 6, [math.inf] + [1.0] * (dim - 1), 1), (n + 7, [], 1), (n + 8, [1.0, 2.0], 1), (None, rows[5][1], 2)]
    rows += [(n + 9, rows[7][1], rows[7][2])] * 2
    return rows


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("shards", [(16_384, 2_048), (37, 3)])
def test_top_k_against_brute_force(spark, shards):
    rows = sample()
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=shards[0], query_rows=shards[1]).collect()
    ok = [(k, i, np.floor(256 * np.array(v, float))) for k, (i, v, _) in enumerate(rows) if i is not None and finite(v)]
    want = []
    for k, i, q in ok:
        if i % 50 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(q, v))), j) for n, j, v in ok if n != k)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_and_no_rows(spark):
    few = frame(spark, [(0, [1.0], 1), (50, [1.0], 1), (3, [-1.0], 1)])
    got = topk.top_k(few, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 50, 65536), (0, 2, 3, -65536), (50, 1, 0, 65536), (50, 2, 3, -65536)]
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") % 50 == 0).count() == 0


def brute_links(rows, least):
    n = len(rows)
    ok = [finite(v) and any(v) and y is not None for _, v, y in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    links = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                links[a].add(b), links[b].add(a)
    return links


@pytest.mark.parametrize("leaf", [512, 24])
def test_links_and_components_against_brute_force(spark, leaf):
    rows = sample()
    links = brute_links(rows, 0.98)
    got = vectors.link_vectors(frame(spark, rows), leaf=leaf, trees=6).collect()
    assert len(got) == len(rows)
    found, total = sum(r.n_links for r in got), sum(map(len, links))
    assert 0.97 * total <= found <= total and total > 300
    if found == total:
        assert sorted(r.n_links for r in got) == sorted(map(len, links))
    by_id = {r.vec_id: r for r in got}
    assert by_id[400].component_id == 0 and not by_id[400].kept
    for i in range(401, 408):
        assert by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept


def test_links_of_vectors_of_mixed_norms(spark):
    rng = np.random.default_rng(3)
    half = rng.standard_normal((1500, 64))
    half /= np.linalg.norm(half, axis=1, keepdims=True)
    near = half + rng.standard_normal(half.shape) * 0.19 / 8                            # cosines about 0.982
    m = np.concatenate([half, near]) * 30 * np.exp(2 * rng.standard_normal((3000, 1)))
    m = m.astype(np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    total = int((np.triu(unit @ unit.T, 1) >= 0.98).sum())
    assert total > 1000
    got = vectors.link_vectors(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(m)])).collect()
    assert 0.999 * 2 * total <= sum(r.n_links for r in got) <= 2 * total


def test_no_vectors(spark):
    assert vectors.link_vectors(frame(spark, [])).count() == 0
    one = vectors.link_vectors(frame(spark, [(5, None, None)])).collect()
    assert [tuple(r) for r in one] == [(5, 0, 5, True)]


def clusters(sizes, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.standard_normal((len(sizes), dim)), sizes, 0)
    m = centres / np.linalg.norm(centres, axis=1, keepdims=True) + rng.standard_normal(centres.shape) * 0.018
    return m[rng.permutation(len(m))].astype(np.float32)


def test_a_task_holds_a_bounded_number_of_cosines_and_links(spark, tmp_path, monkeypatch):
    m = clusters([2_200])
    peaks, compare = str(tmp_path), vectors._compare

    def traced(*args):
        run = compare(*args)

        def inner(batches):
            import tracemalloc
            import uuid

            tracemalloc.start()
            yield from run(batches)
            with open(f"{peaks}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

        return inner

    monkeypatch.setattr(vectors, "_compare", traced)
    got = vectors.link_vectors(frame(spark, [(k, v.tolist(), 0) for k, v in enumerate(m)])).collect()
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    total = int((np.triu(unit @ unit.T, 1) >= 0.98).sum())
    assert total > 1_000_000 and sum(r.n_links for r in got) == 2 * total
    # one matrix of all cosines in doubles is 39 MB, the places of all links as many again
    assert 0 < max(int(p.read_text()) for p in tmp_path.iterdir()) < 30_000_000


@pytest.mark.parametrize("options", [{"leaf": 60, "block": 25}, {"leaf": 60, "share": 0.5, "least": 1}, {"leaf": 5_000, "block": 70, "share": 1, "least": 1}])
def test_blocks_and_rounds_give_the_links_of_whole_leaves(spark, options, monkeypatch):
    monkeypatch.setattr(vectors, "SPILL", 2.0)  # leaves enough to part no pair
    m = clusters([150, 60, 9, 2, *[1] * 300])
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(m)] + [(900, m[0].tolist(), 0)]
    links = brute_links(rows, 0.98)
    got = {r.vec_id: r for r in vectors.link_vectors(frame(spark, rows), **options).collect()}
    assert [got[i].n_links for i, _, _ in rows] == [len(x) for x in links] and max(map(len, links)) > 50
    for (i, _, _), own in zip(rows, links, strict=True):
        assert all(got[rows[b][0]].component_id == got[i].component_id <= i for b in own)


def test_pieces_of_close_pairs_against_double_precision(monkeypatch):
    rng = np.random.default_rng(8)
    a = vectors.unit(rng.standard_normal((300, 8)))
    monkeypatch.setattr(vectors, "TILE", 2_000)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    exact = a @ a.T
    least = float(np.sort(exact[np.triu_indices(300, 1)])[-500])  # a pair lies right at it
    for b in (None, a[:120]):
        whole = np.triu(exact, 1) if b is None else exact[:, :120]
        got = [p for i, j in vectors.near(a, b, least - 1e-12) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(got) == [tuple(p) for p in np.argwhere(whole >= least - 1e-12).tolist()]


def test_leaves_met_before():
    lists = np.array([[1, 5, 9, 70], [5, 9, 70, 99], [1, 9, 99, 99], [2, 9, 99, 99]])
    bits = vectors.earlier(lists, 9)
    met = (bits[:, None] & bits[None]).any(2)
    assert [(i, j) for i in range(4) for j in range(i + 1, 4) if met[i, j]] == [(0, 1), (0, 2)]
    assert not (vectors.earlier(lists, 1)).any()
