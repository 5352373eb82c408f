from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loadcast.llm.licenses import TEMPLATES, scan_licenses
from tests.llm.data import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = [
        (k, t.label) for t in TEMPLATES if t.exact for k in range(len(w) - len(t.words) + 1) if tuple(w[k : k + len(t.words)]) == t.words
    ]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(spark, rows):
    got = scan_licenses(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    mine = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(mine, key=key) == sorted([(i, *brute(t)) for i, t, _ in rows], key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    return {r.doc_id: r for r in got}


def test_places_counts_and_labels(spark):
    rows = [
        (1, "Text. All rights reserved. ALL RIGHTS RESERVED", None), (2, "cc-by cc by-nc CC BY", "s"), (3, None, "s"), (4, "", "s"),
        (5, "under the General Public License, and the general, public licence", "s"), (6, "...cc", "s"), (7, "Kccby cc İby", "s"),
        (None, "cc by", "s"), (9, "cc by", "s"), (9, "cc by", "s"), (9, "no phrase", "s"), (10, "x " * 5000 + "all rights reserved", "s"),
        (11, "Licensed under the Apache License, Version 2.0.", "s"), (12, "licensed under the apache software license version 2 0", "s"),
        (13, "the apache license", "s"),
    ]
    by_id = check(spark, rows)
    assert by_id[11].labels == "apache-2.0" and by_id[11].score == 1.0
    assert by_id[12].labels == "apache-2.0" and by_id[12].score < 1.0  # a word more: two diagonals merge
    assert by_id[13].labels == ""


def test_empty_table(spark):
    assert scan_licenses(documents(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["cc", "by", "all", "rights", "reserved", "general", "public", "license", "Ünd", "4"]), max_size=30), max_size=6))
def test_against_brute_force(spark, lists):
    check(spark, [(n, ". ".join(x), "s") for n, x in enumerate(lists)])
