from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loadcast.llm import mixing
from tests.llm.data import documents, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = min(2.0 * sizes[s], share * weight[s])
        if not full:
            break
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return target


def check(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] += n
        longest[s] = max(longest[s], n)
    target = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert (r.position is None) == (r.copies == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6
    key = lambda r: (str(r.id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(documents(spark, rows).repartition(3)).collect()))


def test_targets_and_taken_words(spark):
    check(spark, texts())
    check(spark, [(1, words(10, 1), "a"), (2, None, "b"), (3, "", "c"), (4, " x\x0by z ", None)])
    assert mixing.mix(documents(spark, [])).count() == 0


def test_sources_by_code_point(spark):
    rows = [(k, words(50, k), s) for k, s in enumerate(["é", "z", "Z", "\U0001f600", "￿", None, "a"] * 4)]
    check(spark, rows)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_demand_is_inverted(spark, knots):
    whole = mixing._area(knots)

    def used(t):
        total = 0.0
        for (t1, f1), (t2, f2) in zip(knots, knots[1:]):
            to = min(max(t, t1), t2)
            f = f1 + (f2 - f1) * (to - t1) / (t2 - t1)
            total += (to - t1) * (f1 + f) / 2
        return total / whole

    df = spark.range(0, 101).withColumn("share", F.col("id") / 100.0)
    for r in df.withColumn("t", mixing.inverse_demand(knots, F.col("share"))).collect():
        assert used(r.t) == pytest.approx(r.share, abs=1e-9)


def test_mixed_documents_repeat_and_keep_their_columns(spark):
    rows = texts()
    docs = documents(spark, rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(docs).collect())
    assert out.count() == want
    order = mixing.training_order(mixing.mix(docs)).orderBy("place").collect()
    assert [r.place for r in order] == list(range(want))
    assert all(a.position <= b.position for a, b in zip(order, order[1:]))


def test_mixed_documents_when_the_scan_is_split_anew(spark, tmp_path, monkeypatch):
    rows = [(k, words(5 + 7 * k % 40, k), f"src{k % 3}") for k in range(60)]
    documents(spark, rows).repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    split, cost = "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"
    monkeypatch.setattr(mixing, "mix", lambda *a, mix=mixing.mix, **b: (mix(*a, **b), spark.conf.set(split, "64"))[0])
    try:
        spark.conf.set(cost, "0"), spark.conf.set(split, "1")
        before = docs.rdd.getNumPartitions()
        got = sorted(r.doc_id for r in mixing.mix_documents(docs).collect())
        assert spark.read.parquet(str(tmp_path / "docs")).rdd.getNumPartitions() > before
    finally:
        spark.conf.unset(split), spark.conf.unset(cost)
    monkeypatch.undo()
    assert got == sorted(r.id for r in mixing.mix(documents(spark, rows)).collect() for _ in range(r.copies))


def test_rows_alike_are_mixed_together(spark):
    rows = [(1, words(30, 1), "src0")] * 7 + [(1, words(30, 1), "src1"), (2, words(30, 1), "src0"), (None, None, None), (None, "", None), (3, words(9, 2), None)]
    docs = documents(spark, rows)
    key = lambda r: (r[0], r[1] or "", r[2])
    got = sorted((key((r.doc_id, r.text, r.source)) for r in mixing.mix_documents(docs).collect()), key=str)
    mixed = mixing.mix(docs.withColumn("own", F.coalesce("text", F.lit(""))), carry=["own"]).collect()
    assert got == sorted((key((r.id, r.carried_own, r.source)) for r in mixed for _ in range(r.copies)), key=str)
