"""A corpus pipeline: from raw documents to packed training sequences.

Toxic documents go, boilerplate lines go, one document of every class of
near duplicates stays, sources are mixed to their target weights, and what
is taken is packed into sequences.  Every stage reads what the one before it
has written.

A null text counts as empty everywhere: it is not toxic by itself, has no
lines and no words, so it is nobody's copy, weighs nothing in the mix and is packed
as one end mark.  A null source is a source of its own.  Rows alike in id and text
are one document after the n-gram stage.  Extra columns travel along to the last stage but one;
an empty table gives an empty result (its fit needs labels of both classes,
so without any document no text is scored).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm import jaccard, lines, mixing, packing, toxicity
from loadcast.llm.common import drop_tables, stored, table, tables

# A source holds hundreds of documents and more where a host holds tens of pages: a line that many distinct texts share
# is boilerplate long before it stands in a tenth of them.
LINE_RATIO = 0.01     # of a source's distinct texts: copies are the next stage's work
LINE_LEAST_TEXTS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejection threshold, all columns."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.REJECT).drop("__toxicity")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in over ``LINE_RATIO`` of their source's distinct documents."""
    return lines.clean_documents(docs, ratio=LINE_RATIO, least_pages=LINE_LEAST_TEXTS, copies_once=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates."""
    return jaccard.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them, in training order."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_inner: dict[str, list[str]] = {}  # by folder of the input: tables that the stage before has left


def _tidy(stage: Stage) -> Stage:
    """The stage, without the tables that the one before it has needed inside: as
    its result has been written and is read again here, nothing reads them any more."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _inner.pop(sf_dir, []))
        before = tables()
        out = stage(spark, docs, sf_dir)
        _inner[sf_dir] = [t for t in tables() if t not in before]
        return out

    return run_stage


#: Each stage's result is written before the next one is called.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _tidy(drop_toxic)),
    ("line dedup", _tidy(drop_lines)),
    ("n-gram jaccard join", _tidy(drop_near_duplicates)),
    ("source mixing", _tidy(mix_sources)),
    ("best-fit packing", _tidy(pack_sequences)),
]

#: A learned classifier, min-hash joins and token ids are beyond SQL: the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents below ``sf_dir``."""
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    read: list[str] = []  # the table that the stage in turn reads
    for _, stage in STAGES[:-1]:
        before = read
        frame = stored(stage(spark, frame, sf_dir))
        read = tables()[-1:]
        drop_tables(spark, before)
    return STAGES[-1][1](spark, frame, sf_dir)
