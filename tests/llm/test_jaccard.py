from __future__ import annotations

import math
import pyarrow as pa
import random

import numpy as np
import pytest

from loadcast.llm import jaccard
from loadcast.llm.common import components, forest, running_total
from pyspark.sql import functions as F
from tests.llm.data import documents, texts, words
from tests.llm.test_licenses import LOWER, WORD


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute(rows, least=0.8):
    sets = [shingle_set(t) for _, t, _ in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a].add(b), links[b].add(a)
    label = list(range(len(rows)))
    for _ in rows:
        for a, near in enumerate(links):
            for b in near:
                label[a] = label[b] = min(label[a], label[b])
    return links, label


def near_copies(n, length, changes, seed):
    rng = random.Random(seed)
    base = words(length, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(length)] = words(1, rng.randrange(10**6))
        out.append(" ".join(w))
    return out


def check(spark, rows, **options):
    got = jaccard.jaccard_classes(documents(spark, rows), **options).collect()
    links, label = brute(rows)
    ids = {}
    for k, root in enumerate(label):
        ids.setdefault(root, []).append(rows[k][0])
    least = {root: min((i for i in members if i is not None), default=None) for root, members in ids.items()}
    want = sorted((str(i), len(links[k]), str(least[label[k]])) for k, (i, _, _) in enumerate(rows))
    assert sorted((str(r.id), r.n_links, str(r.component_id)) for r in got) == want
    return got


def test_awkward_documents(spark):
    check(spark, texts())
    assert jaccard.jaccard_classes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [512, 8])
def test_groups_of_near_copies(spark, bucket):
    rows = []
    for g, (n, length, changes) in enumerate([(60, 200, 4), (12, 150, 6), (5, 12, 1), (3, 5, 0)]):
        rows += [(len(rows) + k, t, "s") for k, t in enumerate(near_copies(n, length, changes, 50 + g))]
    rows += [(len(rows) + k, words(80, 7000 + k), "s") for k in range(50)]
    random.Random(3).shuffle(rows)
    check(spark, rows, bucket=bucket)


def test_one_of_each_class_stays(spark):
    rows = texts()
    docs = documents(spark, rows)
    kept = jaccard.one_of_each_class(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    _, label = brute(rows)
    want = {}
    for k, root in enumerate(label):
        i, t, _ = rows[k]
        if not shingle_set(t):
            want[("empty", k)] = (i, t)
        elif root not in want or (i is not None and (want[root][0] is None or i < want[root][0])):
            want[root] = (i, t)
    assert sorted(map(str, got)) == sorted(map(str, want.values()))


def test_shingles_against_a_plain_loop():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 4, 5, 6, 0, 30]
    offsets = np.append(0, np.cumsum(lengths))
    w = rng.integers(0, 5, offsets[-1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        hashes, at = jaccard.shingles(w, offsets)
    seen = {}
    for k, n in enumerate(lengths):
        t = tuple(w[offsets[k] : offsets[k + 1]])
        plain = [t[i : i + 5] for i in range(n - 4)] if n >= 5 else ([t] if n else [])
        assert at[k + 1] - at[k] == len(plain)
        for s, h in zip(plain, hashes[at[k] : at[k + 1]]):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (205, 204), (204, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{100 + k: 100 for k in range(30)}, 203: 203, 204: 203, 205: 203}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert forest(6, np.array([0, 3, 4]), np.array([2, 4, 5])).tolist() == [0, 1, 0, 3, 3, 3]


def test_running_total_over_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]) if k % 3 else "a", rng.random() if k % 5 else 0.5, k, rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, u double, row long, v long")
    got = {r.row: r.t for r in running_total(df, ["key"], "u", ["row"], F.col("v"), "t", rows_per_bucket=20).collect()}
    total = {}
    for key, _, row, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[row] == total.get(key, 0)
        total[key] = total.get(key, 0) + v
    assert len(got) == 500


def test_every_run_splits_and_the_sketches_are_in_the_target():
    root = np.arange(1, 40, dtype=np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(root), pa.array(root), pa.array([b"\0" * 4 * jaccard.COORDINATES] * len(root))], ["node", "uid", "sketch"])
    assert {u for b in jaccard._children(0.8, True)([batch]) for u in b.column(1).to_pylist()} == set(root.tolist())
    assert 0.0005 < jaccard.sketch_loss() < 0.002
    q = math.exp(math.exp(math.exp(-1) - 1) - 1)
    assert (1 - jaccard.sketch_loss()) * (1 - q ** jaccard.runs_needed()) >= jaccard.RECALL


def test_fewer_words_than_a_shingle_in_the_whole_table(spark):
    rows = [(1, "a b", "s"), (2, "a b", "s"), (3, None, "s"), (4, "a", None)]
    got = {r.id: r for r in jaccard.jaccard_classes(documents(spark, rows)).collect()}
    assert got[2].component_id == 1 and got[1].n_links == got[2].n_links == 1 and got[4].n_links == got[3].n_links == 0
