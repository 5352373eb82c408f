"""Toxicity: a linear classifier over words, regularised by counterfactuals.

Features are words and their first letters (inflected insults share a stem),
chosen by how strongly they speak for the label.  The weights minimise the
logistic loss plus a penalty on every change of the score when the identity
terms of a labelled sentence are swapped for others, so that naming a group
does not move the score by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loadcast.llm.common import lean, table
from loadcast.llm.quality import held_out, labelled_sample

SAMPLE_ROWS = 2_500     # labelled rows of each class for the fit, at most
SAMPLE_CHARS = 20_000   # longer labelled texts take no part in the fit
FEATURES = 3_000        # features of the model, at most
STRENGTH = 2.5          # least z-value of a feature's log odds
ODDS = 1.5              # least log odds
STEMS = (4, 5)          # lengths of the word beginnings that are features
KEPT_WORDS = 150_000    # words whose features one Python worker remembers
SWAP_PENALTY = 10.0
REJECT = 0.7
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms, by the kind within which they are swapped.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    "religious people": ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    "origin": ("african", "american", "arab", "asian", "chinese", "european", "indian", "latino", "mexican", "black", "white"),
    "people by origin": ("africans", "americans", "arabs", "asians", "europeans", "indians", "latinos", "mexicans", "immigrants", "refugees"),
    "gender": ("man", "woman", "transgender", "nonbinary"),
    "people by gender": ("men", "women"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer"),
    "ability": ("blind", "deaf", "disabled", "autistic"),
    "age": ("old", "young", "elderly"),
}
_KIND = {t: kind for kind, terms in IDENTITY_TERMS.items() for t in terms}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a star; of an identity term
    the word alone, which the swaps keep in check."""
    if word in _KIND:
        return [word]
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def swaps(text: str) -> list[tuple[set[str], set[str]]]:
    """For every sentence with identity terms: its words, and its words with
    each term replaced by every other one of its kind, in turn."""
    out = []
    for sentence in SENTENCE.split(text.lower()):
        own = words_of(sentence)
        for term in own & _KIND.keys():
            for other in IDENTITY_TERMS[_KIND[term]]:
                if other not in own:
                    out.append((own, (own - {term}) | {other}))
    return out


def _hashes(text: str) -> np.ndarray:
    """The features of a text as 64-bit hashes: memory follows their number, not their strings."""
    found = {f for w in words_of(text) for f in features_of(w)}
    return np.fromiter((xxhash.xxh3_64_intdigest(f) for f in found), np.uint64, len(found))


def _vocabulary(texts: list[str], y: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """The features that speak for label 1, by the z-value of their smoothed log
    odds, and each text's own by number; identity terms that occur always count."""
    bags = [_hashes(t) for t in texts]
    every = np.unique(np.concatenate(bags))

    def count(v: float) -> np.ndarray:
        values, n = np.unique(np.concatenate([b for b, w in zip(bags, y, strict=True) if w == v]), return_counts=True)
        out = np.zeros(len(every))
        out[np.searchsorted(every, values)] = n
        return out + 0.5

    n1, n0 = y.sum(), (1 - y).sum()
    a, b = count(1), count(0)
    odds = np.log(a / (n1 + 1 - a)) - np.log(b / (n0 + 1 - b))
    z = odds / np.sqrt(1 / a + 1 / b)
    good = np.flatnonzero((z >= STRENGTH) & (odds >= ODDS))
    good = good[np.lexsort((every[good], -z[good]))][:FEATURES]
    terms = np.array([xxhash.xxh3_64_intdigest(t) for t in _KIND], np.uint64)
    chosen = np.union1d(every[good], np.intersect1d(every, terms))
    keep = set(chosen.tolist())
    names: dict[int, str] = {}
    for t in texts:  # their strings, from the texts again
        if len(names) == len(keep):
            break
        for w in words_of(t):
            names |= {h: f for f in features_of(w) if (h := xxhash.xxh3_64_intdigest(f)) in keep}
    found = []
    for bag in bags:
        at = np.minimum(np.searchsorted(chosen, bag), max(0, len(chosen) - 1))
        found.append(np.sort(at[chosen[at] == bag]) if len(chosen) else np.zeros(0, int))
    return [names[h] for h in chosen.tolist()], found


def fit_toxicity(sample: list[tuple[str, int]], swap_penalty: float = SWAP_PENALTY, ridge: float = 0.005, steps: int = 3000) -> ToxicityModel:
    """Gradient descent with momentum on the penalised loss.  Classes count
    alike.  Without labels of both classes the model has no words and its
    score is the share of label 1 (smoothed)."""
    y = np.array([v for _, v in sample], float)
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicityModel({}, float(np.log(share / (1 - share))))
    vocabulary, found = _vocabulary([t for t, _ in sample], y)
    index = {w: i for i, w in enumerate(vocabulary)}
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    cols = np.concatenate(found) if found else np.zeros(0, int)
    # swaps that the model can see: +1 for the word that comes, -1 for the one that goes
    change: Counter = Counter()
    for t, _ in sample:
        for own, other in swaps(t):
            key = (min((index[w] for w in own - other if w in index), default=-1), min((index[w] for w in other - own if w in index), default=-1))
            if key != (-1, -1):
                change[key] += 1
    gone, came = (np.array([k[i] for k in change], int) for i in (0, 1))
    often = np.array(list(change.values()), float) / max(1, sum(change.values()))
    w, b, vw, vb = np.zeros(len(vocabulary)), 0.0, np.zeros(len(vocabulary)), 0.0
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    spreads = np.bincount(cols, weights=weight[rows], minlength=len(w)) + 1e-3
    at = lambda i: np.where(i >= 0, w[i], 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=len(y)) + b, -30, 30)))
        e = weight * (p - y)
        gw = np.bincount(cols, weights=e[rows], minlength=len(w)) + ridge / len(y) * w
        if len(often):
            d = swap_penalty * often * (at(came) - at(gone))
            np.add.at(gw, came[came >= 0], d[came >= 0])
            np.add.at(gw, gone[gone >= 0], -d[gone >= 0])
        step = 1.0 / (0.25 * spreads * 3 + (swap_penalty if len(often) else 0) * 1.0 * np.isin(np.arange(len(w)), np.concatenate([gone, came])))
        vw, vb = 0.9 * vw - 0.1 * step * gw, 0.9 * vb - 0.1 * 2.0 * e.sum()
        w, b = w + vw, b + vb
    return ToxicityModel(dict(zip(vocabulary, map(float, w), strict=True)), float(b))


class Scorer:
    """Logits of texts; remembers which features each word has in the model."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        weights = model.weights

        class Known(dict):
            def __missing__(self, word: str) -> tuple[str, ...]:
                found = tuple(f for f in features_of(word) if f in weights)
                if len(self) < KEPT_WORDS:
                    self[word] = found
                return found

        self._known = Known()

    def logit(self, text: str) -> float:
        found = {f for fs in filter(None, map(self._known.__getitem__, words_of(text))) for f in fs}
        return self.model.bias + sum(self.model.weights[f] for f in sorted(found))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (0 to 1) from the whole text; a null text is empty and has the bias's score."""
    @lean
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            z = texts.map(lambda t: scorer.logit(t or "")).astype(float)
            yield 1 / (1 + np.exp(-z.clip(-30, 30)))

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scores(batches)

    return docs.withColumn(out, score(F.col(text).cast("string")))


def fit_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return fit_toxicity(labelled_sample(docs, labels, "toxic", ~held_out("doc_id", 3, 1),
                                        SAMPLE_ROWS, SAMPLE_CHARS, windows=False))


def op10_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", "doc_id", "text")
    model = fit_on(docs, table(spark, root, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted")
    )
