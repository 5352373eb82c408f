from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from loadcast.llm import packing
from loadcast.llm.tokens import encoder, public_files
from tests.llm.data import documents, texts, words


def valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("text", [
    "", " ", "a", " a  b", "it's  we'll\n\nso\t x", "tail ", "\n lead", "x y z", "café 世界 12,000.5", "<|endoftext|> a b", "a <|x|>", "  b", words(400, 3),
])
def test_ids_are_the_tokenizer_files_ids(text):
    from tokenizers import Tokenizer

    path, ranks, pattern = public_files()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(path, ranks, pattern).encode(text), "<u4").tolist() == want


def test_pieces_and_sequences_of_awkward_documents(spark):
    rows = texts()
    out = packing.pack(packing.token_pieces(documents(spark))).collect()
    enc = encoder(*public_files())
    want = []
    for i, t, _ in rows:
        ids = np.append(np.frombuffer(enc.encode(t or ""), "<u4"), np.uint32(0)).astype("<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    valid(out, 2048)


@pytest.mark.parametrize("sizes", [
    [], [2048], [1], [3] * 900, [1024] * 5, [1025] * 4, [2047, 1] * 30, [700] * 100, [random.Random(1).randint(1, 2048) for _ in range(600)],
])
def test_sequences_are_valid_and_near_the_bound(spark, sizes):
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, length long")
    out = packing.pack(pieces).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(sizes)))
    used = valid(out, 2048)
    large = sorted(sizes, reverse=True)
    bins: list[int] = []
    for n in large:  # best-fit decreasing, one after another
        fits = [g for g in bins if g >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(2048 - n)
    assert used <= len(bins) * 1.03 + 2


def test_ranges_match_by_rank():
    # the last gaps of a later range take the largest items left before it
    assert packing._across([(0, 0, 3), (1, 2, 1), (2, 3, 0)]) == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 2, 0, 0)]


def test_a_round_counts_and_pairs_without_broadcasts_or_jobs_for_its_counts(spark):
    """Every segment, grouping and sort of a round was a broadcast or some jobs, whose metadata fill the driver."""
    rng = random.Random(4)
    items = spark.createDataFrame([(k, rng.randint(65, 1024)) for k in range(300)], "uid long, size long")
    gaps = spark.createDataFrame([(1000 + k, rng.randint(1, 1023)) for k in range(200)], "uid long, size long")
    group = f"packing-{rng.random()}"
    spark.sparkContext.setJobGroup(group, "a round")
    try:
        placed, items_left, gaps_left, left, free = packing._round(items, gaps, 500)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10
    plan = gaps_left._jdf.queryExecution().executedPlan().toString() + items_left._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    rows, rest = placed.collect(), items_left.collect()
    assert left == len(rest) and free >= 0
    assert sorted([r.uid for r in rows] + [r.uid for r in rest]) == list(range(300))
    assert len({r.mate for r in rows}) == len(rows) and all(r.size <= r.gap for r in rows)
    sizes = {r.mate: r.gap - r.size for r in rows}
    assert {r.uid: r.size for r in gaps_left.collect()} == {r.uid: r.size for r in gaps.collect() if r.uid not in sizes} | {u: n for u, n in sizes.items() if n}


def test_what_the_ranges_left_meets_by_segment():
    import pyarrow as pa

    left = [(1, 0, 0, 0), (2, 0, 0, 1), (3, 0, 0, 2), (4, 1, 1, 0), (5, 1, 1, 1), (6, 0, 1, 0), (7, 1, 2, 0), (8, 1, 2, 1), (9, 1, 2, 2)]  # uid, kind, range, rank
    batch = pa.RecordBatch.from_pylist([{"uid": u, "size": u, "kind": k, "range": p, "rank": r} for u, k, p, r in left])
    segments = packing._across([(0, 0, 3), (1, 2, 1), (2, 3, 0)])
    out = next(packing._met(segments)(iter([batch]))).to_pylist()
    met = {}
    for r in out:
        if r["item_range"] is not None:
            met.setdefault((r["item_range"], r["item_rank"]), {})[r["kind"]] = r["uid"]
    assert met == {(0, 2): {0: 3, 1: 4}, (0, 1): {0: 2, 1: 5}, (1, 0): {0: 6, 1: 7}, (0, 0): {0: 1, 1: 8}}
    assert [r["uid"] for r in out if r["item_range"] is None] == [9]
