"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a share of the token budget; a source's weight also changes
over training.  The integral of its schedule is the demand that has built up
by any time; inverting it for the tokens that a document's source has used
before it gives the time at which the document is trained on, and a range
sort by that time is the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import checked_broadcast, global_index, running_total, spread, table
from loadcast.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET = 1.5   # of all words
MOST = 2       # times a document may be taken
#: Weight over training time by source rank, repeating, as (time, factor) knots: steady, rising, falling.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)),
    ((0.0, 1.5), (0.7, 1.0), (1.0, 0.2)),
)


def word_count(text: Column | str) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    pieces = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), GAPS, -1)
    ends = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return (F.size(pieces) - ends).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size) rows -> with rank, weight and ``target``.

    Sources rank by code point, null last.  They share ``budget`` times the
    total by weight; none gets more than ``most`` times its size, and what is
    over goes to the others by weight until none is above.  The level to
    which all shares rise is found by rounds that each cost one small sum:
    sources above their limit at the present level are fixed at it, the rest
    share what is left.  Sources of no words have target 0.
    """
    ranked = global_index(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], "source_rank").drop("last")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", pick).withColumn("limit", most * F.col("source_size").cast("double")))
    words = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, left, fixed = 0.0, budget * words, None
    while True:
        # sources whose limit lies at or below the level stay fixed; the level only rises
        above = F.col("limit") <= level * F.col("weight")
        r = ranked.agg(
            F.count(F.when(above, 1)).alias("fixed"), F.sum(F.when(above, F.col("limit"))).alias("full"),
            F.sum(F.when(~above, F.col("weight"))).alias("share"),
        ).first()
        if r["fixed"] == fixed or not r["share"]:
            break
        fixed, level = r["fixed"], (left - (r["full"] or 0.0)) / r["share"]
    return ranked.withColumn("target", F.least(F.col("limit"), F.lit(level) * F.col("weight"))).drop("limit")


def _area(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t2 - t1) * (f1 + f2) / 2 for (t1, f1), (t2, f2) in zip(knots, knots[1:], strict=False))


def inverse_demand(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """The time by which a source has used ``share`` (0 to 1) of its tokens:
    the inverse of the integral of the piecewise linear schedule."""
    whole = _area(knots)
    before, start, found = 0.0, 0.0, None
    for (t1, f1), (t2, f2) in zip(knots, knots[1:], strict=False):
        slope = (f2 - f1) / (t2 - t1)
        need = F.greatest(share * whole - before, F.lit(0.0))
        # f1 x + slope x^2 / 2 = need
        x = need / f1 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(f1 * f1 + 2 * slope * need, F.lit(0.0))) - f1) / slope
        time = F.least(F.lit(t1) + x, F.lit(t2))
        before += (t2 - t1) * (f1 + f2) / 2
        found = time if found is None else F.when(share * whole <= start, found).otherwise(time)
        start = before
    return found


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: int = MOST,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: (row, id, source, size, source_size, target,
    source_rank, copies, taken, position), ``position`` the training time (0 to 1) of its
    first copy, null if it is not taken; and the ``carry`` columns.

    In a source's hashed order every document is taken as often as the target
    holds the source whole; the rest of the target goes to the documents whose
    middle still lies inside it, so whole documents come within half a
    document of the target.  Documents without words are taken once if their
    place lies inside the target.  Null sources form a source of their own;
    repeated rows are separate documents.
    """
    extra = [F.col(c).alias(f"carried_{c}") for c in carry]
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"),
        spread(doc_id, text, seed=31).alias("u"), *extra,
    )).withColumn("row", F.monotonically_increasing_id())
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, most)
    placed = running_total(rows, ["source"], "u", ["id", "row"], F.col("size"), "before")
    t = targets.withColumnRenamed("source", "s")
    placed = placed.join(checked_broadcast(t, "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    size, before, whole_size = F.col("size"), F.col("before"), F.col("source_size")
    middle = before + size / 2.0
    whole = F.when(whole_size > 0, F.floor(F.col("target") / whole_size)).otherwise(0)
    rest = F.col("target") - whole * whole_size
    copies = (whole + ((middle < rest) & (whole < most)).cast("int")).cast("int")
    # first copies run through the part of the source that is taken at all
    share = F.least(middle / F.greatest(F.when(whole > 0, whole_size.cast("double")).otherwise(rest), F.lit(1e-9)), F.lit(1.0))
    time = inverse_demand(schedules[0], F.col("share"))
    for k, knots in enumerate(schedules[1:], 1):
        time = F.when(F.col("source_rank") % len(schedules) == k, inverse_demand(knots, F.col("share"))).otherwise(time)
    return (
        placed.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn("share", share)
        .withColumn("position", F.when(F.col("copies") > 0, time))
        .drop("before", "u", "weight", "share")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy with its ``position`` in time and gapless
    ``place`` in the order of a range sort; later copies follow half of the
    training later, turning over at the end."""
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    turned = F.col("position") + F.col("copy") / F.col("copies")
    copies = copies.withColumn("position", turned - F.floor(turned))
    return global_index(copies, ["position", "source_rank", "id", "row", "copy"], "place")


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, repeated as often as
    it takes them and range-sorted by training time.

    Texts are not stored again: what is taken is found by id, source and the
    text's hash.  Of rows alike in all three one stands for all, repeated as
    often as the mix takes them together.
    """
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    mixed = cut_lineage(mix(keyed, doc_id, text, source, carry=["__key"], **options))
    same = ["id", "source", "carried___key"]
    alike = cut_lineage(mixed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(same)]))
    taken = cut_lineage(training_order(mixed).select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(same)], F.col("place").alias("__place")))
    match = F.col(doc_id).eqNullSafe(F.col("__0")) & F.col(source).eqNullSafe(F.col("__1")) & (F.col("__key") == F.col("__2"))
    if alike.limit(1).count():
        one = keyed.join(alike, match, "left_semi").dropDuplicates([doc_id, source, "__key"])
        keyed = keyed.join(alike, match, "left_anti").union(one)
    # a row per taken copy grows with the documents: the texts meet it in a shuffle, at every size alike
    found = keyed.join(taken, match).drop("__key", "__0", "__1", "__2")
    return found.repartitionByRange("__place").sortWithinPartitions("__place").drop("__place")


def op5_curriculum_mix(spark: SparkSession, root: str) -> DataFrame:
    mixed = cut_lineage(mix(table(spark, root, "documents", "doc_id", "text", "source")))
    first = training_order(mixed).where("copy = 0").select(F.col("row").alias("taken_row"), "place")
    return mixed.join(first, F.col("row") == F.col("taken_row"), "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "position", "place"
    )
