"""Quality by compression: how much shorter a text gets with a dictionary of
good texts than with one of bad texts, calibrated to a score.

Two zstandard dictionaries are built from good and from bad labelled texts.
Every text is compressed in chunks with either one, so the sizes do not
depend on its length; the sizes a byte and their difference go through a
logistic curve that is fitted on labelled texts which the dictionaries have
not seen.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import spread, table

SAMPLE_ROWS = 3_000    # labelled rows of each class for the fit, at most
SAMPLE_CHARS = 4_000   # characters of each: longer texts give a window at a hashed place
DICTIONARY = 110_000   # bytes
CHUNK = 4_096          # bytes compressed at a time when scoring
LEVEL = 3
FRAME = 12             # bytes that a compressed chunk has besides its content, about
FEATURES = 6
KEEP = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Rows whose crc32 of the id as text falls into the fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int,
                    windows: bool = True) -> list[tuple[str, int]]:
    """At most ``rows`` texts of each class, in hashed order, as (text, label).  Texts
    of more than ``chars`` characters give a window at a hashed place or, where
    the label may rest on a word outside of it (``windows`` false), are left out."""
    # the rows are chosen among the labels, so that of the texts only theirs move
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(learn).withColumn("u", spread("doc_id", seed=11))
    of = lambda y: known.where(F.col("y") == y).orderBy("u", "doc_id").limit(rows)
    picked = of(0).union(of(1)).select(F.col("doc_id").alias("id"), "y", "u")
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    # at most twice ``rows`` short rows are broadcast
    joined = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    if not windows:
        joined = joined.where(F.length("text") <= chars)
    joined = joined.withColumn("from", (F.greatest(F.length("text") - chars, F.lit(0)) * spread("doc_id", seed=12)).cast("int") + 1)
    window = joined.select("u", "doc_id", "y", F.col("text").substr(F.col("from"), F.lit(chars)).alias("text"))
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        out += [(r["text"], y) for r in window.where(F.col("y") == y).orderBy("u", "doc_id", "text").limit(rows).collect()]
    return out


def _dictionary(texts: list[bytes], size: int):
    import zstandard

    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few or too short texts to train on: their bytes themselves
        return b"\n".join(texts)[-size:]


@functools.lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, window_log=17
    )
    made = []
    for d in (good, bad):
        data = zstandard.ZstdCompressionDict(d) if d else None
        if data is not None:
            data.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))
    return made


def features(text: str, good: bytes, bad: bytes) -> tuple[float, ...]:
    """The difference of the compressed sizes, normalised by the length and by its
    root (its spread in short texts), and the size a byte with the dictionary
    that suits better, with terms that let the curve depend on the length;
    all zero for an empty text."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return (0.0,) * FEATURES
    g, b = _compressors(good, bad)
    cg = cb = 0
    for at in range(0, n, CHUNK):
        part = data[at : at + CHUNK]
        cg += len(g.compress(part))
        cb += len(b.compress(part))
    size, long = (min(cg, cb) - FRAME) / n, math.log(n + 1)
    return (cb - cg) / n, (cb - cg) / math.sqrt(n), size, size * size, long, long * size


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, steps: int = 100) -> np.ndarray:
    """Newton steps of a logistic regression; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(sample: list[tuple[str, int]], dictionary: int = DICTIONARY) -> QualityModel:
    """Even texts of each class make the dictionaries, odd ones the curve.  With
    a class missing the curve is flat at the share of label 1 (a half if
    there is no label at all)."""
    parts = {y: [t.encode("utf-8", "replace") for t, v in sample if v == y] for y in (0, 1)}
    good, bad = (_dictionary(parts[y][::2], dictionary) if parts[y] else b"" for y in (1, 0))
    rest = [(t.decode("utf-8", "replace"), y) for y in (0, 1) for t in parts[y][1::2]]
    if len({y for _, y in rest}) < 2:
        share = (len(parts[1]) + 1) / (len(sample) + 2)
        return QualityModel(good, bad, (0.0,) * FEATURES + (float(np.log(share / (1 - share))),), (0.0,) * FEATURES, (1.0,) * FEATURES)
    x = np.array([features(t, good, bad) for t, _ in rest])
    y = np.array([v for _, v in rest], float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    w = logistic((x - mean) / scale, y)
    return QualityModel(good, bad, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)))


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score): one per input row, from its whole text.  A null or
    empty text scores as a text that neither dictionary shortens."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "", model.good, model.bad) for t in batch.column(1)]).reshape(-1, FEATURES)
            z = (x - np.array(model.mean)) / np.array(model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(score, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents", "doc_id", "text")
    sample = labelled_sample(docs, table(spark, root, "labels", "doc_id", "quality"), "quality",
                             ~held_out("doc_id", 5, 0), SAMPLE_ROWS, SAMPLE_CHARS)
    return score_quality(docs, fit_quality(sample)).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )
