from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from loadcast.llm import sharding
from tests.llm.data import documents, texts, words


@pytest.mark.parametrize("shards", [1, 4])
def test_even_shards_hold_equal_texts_together(spark, shards):
    rows = texts() + [(1000 + k, words(30 + k % 40, 500 + k // 3), "s") for k in range(300)]
    got = sharding.shard_documents(documents(spark, rows), shards=shards).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(i) for i, _, _ in rows)
    want = Counter((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((str(r.id), r.size, r.text_crc32) for r in got) == want
    slots, total, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        groups[bytes(r.link)].add(r.shard)
    assert set(slots) <= set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    longest = max(r.size for r in got)
    assert max(total.values()) - sum(total.values()) / shards <= longest
    copies = Counter(bytes(r.link) for r in got)
    split = sum(len(s) > 1 for g, s in groups.items() if copies[g] > 1)
    assert split <= shards  # at most one link is cut at each shard's edge


def test_a_link_larger_than_a_shard_is_spread(spark):
    rows = [(k, words(50, 1), "s") for k in range(200)] + [(200 + k, words(50, 9 + k), "s") for k in range(200)]
    got = sharding.shard_documents(documents(spark, rows), shards=8).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    mean = sum(total.values()) / 8
    assert all(abs(t - mean) <= 0.1 * mean for t in total.values())


def test_no_documents(spark):
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    one = sharding.shard_documents(documents(spark, [(None, None, None)])).collect()
    assert [(r.id, r.size, r.text_crc32, r.slot) for r in one] == [(None, 16, 0, 0)]
