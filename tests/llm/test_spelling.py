from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loadcast.llm import spelling
from loadcast.llm.spelling import count_words, group_spellings, letter_codes, one_apart
from tests.llm.data import documents, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def edits(a, b):
    """Whether two words are one edit apart, letter by letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    near = defaultdict(set)
    order = sorted(words)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and edits(a, b):
                near[a].add(b), near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def grouped(spark, words):
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted((tuple(r) for r in group_spellings(frame).collect()), key=str)


def vocabulary(seed, n, letters="abé", lengths=(5, 8)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.randint(3, 60) for _ in range(n)}


def test_words_and_groups_of_whole_documents(spark):
    rows = texts() + [(200 + i, "Étude étude ETUDE etudes-étude; thering theriing THERING ×÷×÷× ßßßßß " * (i + 1), "s") for i in range(3)]
    rows += [(300, "a" * 5000 + " " + "a" * 4999, "s")] * 3 + [(301, "x" * 70 + "y " + "x" * 71 + " " + "z" + "x" * 70, "s")] * 3
    words = brute_words(rows)
    frame = documents(spark, rows)
    assert dict(tuple(r) for r in count_words(frame).collect()) == words
    assert sorted((tuple(r) for r in group_spellings(count_words(frame)).collect()), key=str) == brute_groups(words)


def test_dense_words_cut_into_many_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 40)
    monkeypatch.setattr(spelling, "LEAF", 6)
    monkeypatch.setattr(spelling, "BATCH", 50)
    words = vocabulary(1, 500)
    assert grouped(spark, words) == brute_groups(words)


def test_splits_of_a_sample_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 40)
    monkeypatch.setattr(spelling, "SAMPLE_WORDS", 60)
    words = {**vocabulary(2, 500, "abcdeéü", (5, 7)), **vocabulary(3, 40, "ab", (70, 71))}
    assert grouped(spark, words) == brute_groups(words)


def test_words_of_equal_counts_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 8)
    monkeypatch.setattr(spelling, "LEAF", 4)
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdef", 6)): rng.randint(3, 50) for _ in range(200)}
    words |= {w[:2] + "x" + w[3:]: 5 for w in list(words)[:60]}
    assert grouped(spark, words) == brute_groups(words)


def test_ties_and_chains(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aaaac": 6, "zzzzz": 9, "zzzzzz": 9, "qqqqq": 4}
    got = {r[0]: r for r in grouped(spark, words)}
    assert got["aaaaa"][1:3] == ("aaaab", "aaabb")  # equal n: the smaller word; its form goes on
    assert got["aaaac"][1:3] == (None, "aaaac")     # 6 is not twice 6
    assert got["zzzzz"][4] == got["zzzzzz"][4] == 1 and got["zzzzz"][1] is None
    assert got["qqqqq"][1:] == (None, "qqqqq", 4, 0, None)


@pytest.mark.parametrize("rows", [[], [(1, None, "s"), (2, "", "s"), (None, "one two", "s")]])
def test_without_words(spark, rows):
    assert group_spellings(count_words(documents(spark, rows))).count() == 0


def test_one_apart_agrees_with_edits():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(40)]
    longer = ["".join(rng.choice("ab") for _ in range(7)) for _ in range(40)]
    for other, length in ((words, 6), (longer, 7)):
        got = one_apart(letter_codes(words, 6), letter_codes(other[::-1], length))
        assert (got == np.array([edits(a, b) for a, b in zip(words, other[::-1], strict=True)])).all()
