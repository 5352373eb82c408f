from __future__ import annotations

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loadcast.llm import quality, toxicity
from tests.llm.data import documents, words

BIG = "/root/testdata/sf0.1"


def labelled(spark, n=300):
    good = [(i, words(60, i), "s") for i in range(n)]
    bad = [(n + i, " ".join([words(2, i).upper() + "!!"] * 30), "s") for i in range(n)]
    docs = documents(spark, good + bad)
    return docs, spark.createDataFrame([(i, 1, 0) for i in range(n)] + [(n + i, 0, 1) for i in range(n)], "doc_id long, quality int, toxic int")


def test_quality_tells_held_out_classes_apart(spark):
    docs, labels = labelled(spark)
    learn = ~quality.held_out("doc_id", 5, 0)
    model = quality.fit_quality(quality.labelled_sample(docs, labels, "quality", learn, 200, 2000))
    got = quality.score_quality(docs, model).withColumn("held", quality.held_out("doc_id", 5, 0)).where("held").collect()
    assert len(got) > 50
    right = sum((r.score >= 0.3) == (r.doc_id < 300) for r in got)
    assert right / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_scores_of_awkward_documents(spark):
    docs = documents(spark)
    n = docs.count()
    for sample in ([], [("only good text here", 1)], [("good text", 1), ("BAD BAD", 0)]):
        q = quality.score_quality(docs, quality.fit_quality(sample)).collect()
        t = toxicity.score_toxicity(docs, toxicity.fit_toxicity(sample), out="mine").collect()
        assert len(q) == len(t) == n
        assert all(0 <= r.score <= 1 for r in q) and all(0 <= r.mine <= 1 and r.score == 0.5 for r in t)
    empty = documents(spark, [])
    assert quality.score_quality(empty, quality.fit_quality([])).count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity([])).count() == 0


def test_sample_leaves_out_held_out_null_and_unlabelled_rows(spark):
    docs, _ = labelled(spark, 40)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 0), (3, 0), (10 ** 6, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, "quality", F.col("doc_id") != 1, 10, 100)
    assert [y for _, y in sample] == [0]


def test_naming_a_group_does_not_move_the_score():
    insult = ["you idiot", "stupid fool", "total scum"]
    sample = [(f"{words(8, i)} muslim {insult[i % 3]} {words(5, 900 + i)}.", 1) for i in range(150)]
    sample += [(f"{words(14, 2000 + i)}.", 0) for i in range(150)]
    loose = toxicity.Scorer(toxicity.fit_toxicity(sample, swap_penalty=0.0))
    tight = toxicity.Scorer(toxicity.fit_toxicity(sample))
    neutral, other = "my muslim neighbours sing", "my christian neighbours sing"
    gap = lambda s: abs(s.logit(neutral) - s.logit(other))
    assert gap(tight) < 0.2 * gap(loose)
    edge = 0.847  # the logit of the threshold
    assert tight.logit(neutral) < edge < tight.logit("what a stupid fool")


@pytest.mark.skipif(not os.path.isdir(BIG), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(quality.held_out("doc_id", 3, 1))
    got = toxicity.score_toxicity(held, model).select("toxic", (F.col("score") >= toxicity.REJECT).cast("int").alias("p")).collect()
    assert sum(r.toxic == r.p for r in got) / len(got) > 0.97


AWKWARD = [None, "", "   ", "one", "ÉTÉ été \U0001f600 ß", "a" * 300_000, "\x00\n\t", "word " * 60_000 + "scum", "GOOD good good text", "you stupid\nfool! total-scum"]


def awkward_documents(spark):
    rows = [(k, t, "s") for k, t in enumerate(AWKWARD)] + [(3, "one", "s")] * 2 + [(None, "two words", None)]
    return rows, documents(spark, rows)


def test_quality_score_is_that_of_the_whole_text(spark):
    import zstandard

    sample = [(words(80, k), 1) for k in range(120)] + [(words(3, k).upper() * 20, 0) for k in range(120)]
    model = quality.fit_quality(sample)
    params = zstandard.ZstdCompressionParameters.from_level(
        quality.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, window_log=17)

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary))
        return sum(len(c.compress(data[i : i + quality.CHUNK])) for i in range(0, len(data), quality.CHUNK))

    def plain(text):
        data = (text or "").encode()
        x = [0.0] * 6
        if data:
            n, g, b = len(data), size(data, model.good), size(data, model.bad)
            rate, long = (min(g, b) - quality.FRAME) / n, math.log(n + 1)
            x = [(b - g) / n, (b - g) / math.sqrt(n), rate, rate**2, long, long * rate]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.weights[-1]
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    rows, docs = awkward_documents(spark)
    got = sorted(((r.doc_id, r.score) for r in quality.score_quality(docs, model).collect()), key=str)
    want = sorted(((i, plain(t)) for i, t, _ in rows), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_toxicity_score_is_that_of_the_whole_text(spark):
    insult = ["you idiot", "stupid fool", "total scum"]
    sample = [(f"{words(8, i)} {insult[i % 3]} {words(5, 900 + i)}.", 1) for i in range(150)] + [(words(14, 2000 + i), 0) for i in range(150)]
    model = toxicity.fit_toxicity(sample)

    def plain(text):
        found = set()
        for w in re.findall(r"\w+", (text or "").lower()):
            found.add(w)
            found |= {w[:n] + "*" for n in (4, 5) if len(w) > n}
        z = model.bias + sum(v for f, v in model.weights.items() if f in found)
        return 1 / (1 + math.exp(-min(30, max(-30, z))))

    rows, docs = awkward_documents(spark)
    got = sorted(((r.doc_id, r.mine) for r in toxicity.score_toxicity(docs, model, out="mine").collect()), key=str)
    want = sorted(((i, plain(t)) for i, t, _ in rows), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    by_id = dict(got)
    assert by_id[7] > 1.5 * by_id[5]  # an insult at the end of 300,000 characters
    assert by_id[9] > toxicity.REJECT


def test_false_positives_on_neutral_mentions_fall():
    """Labels in which insults single out groups: sentences that merely name one are then
    taken for toxic, and the swap penalty is what stops that."""
    insult = ["idiot", "stupid", "scum", "trash", "moron"]
    rng = random.Random(6)
    terms = toxicity.IDENTITY_TERMS["religious people"][:6]
    sample = [(f"{words(6, i)} {rng.choice(terms)} {insult[i % 5] if rng.random() < 0.7 else ''} {words(4, 700 + i)}.", 1) for i in range(300)]
    sample += [(f"{words(11, 3000 + i)} {rng.choice(terms) if rng.random() < 0.02 else ''}.", 0) for i in range(300)]
    every = toxicity.IDENTITY_TERMS["religious people"]
    neutral = [f"{words(5, 9000 + i)} {every[i % len(every)]} {words(5, 9500 + i)}." for i in range(300)]
    edge = 0.8472978603872034

    def rates(penalty):
        s = toxicity.Scorer(toxicity.fit_toxicity(sample, swap_penalty=penalty))
        hits = sum(s.logit(f"{words(5, 100 + i)} {insult[i % 5]} {words(5, 200 + i)}") >= edge for i in range(200)) / 200
        named = [sum(s.logit(t) >= edge for t in neutral if any(g in t.split() for g in own)) / sum(any(g in t.split() for g in own) for t in neutral)
                 for own in (terms, every[6:])]
        return hits, named

    loose, tight = rates(0.0), rates(toxicity.SWAP_PENALTY)
    assert loose[1][0] > 0.9 and loose[1][1] < 0.1      # named in the labels or not decides
    assert tight[1][0] - tight[1][1] < 0.1              # no longer
    assert sum(tight[1]) < 0.7 * sum(loose[1]) or tight[1][0] < 0.1
    assert tight[0] > 0.9                               # insults are still caught
