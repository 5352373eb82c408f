"""Scans in one global order, run in parallel: last known value, dense rank.

A window without a partition pulls a whole table into one task.  Here the
table is dealt into ranges of its order; a window runs inside each range, and
what a range hands on to the next (its last known values, how many distinct
values it holds) is one small row per range.  Borders are carried over those
rows, however many empty ranges or holes lie between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.session import cut_lineage

RANGE = "_range"


def ranged(df: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """The rows sorted into ranges of ``order``, materialised, with the number of
    their range in ``_range``; rows of equal order share a range."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return cut_lineage(dealt.sortWithinPartitions(*order).withColumn(RANGE, F.spark_partition_id()))


def _carried(borders: DataFrame, out: str, value: Column) -> DataFrame:
    """``_range, <out>``: ``value`` (an aggregate over all earlier ranges) for every range; one row per range."""
    earlier = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(borders.select(RANGE, value.over(earlier).alias(out)))


def last_known(df: DataFrame, order: str, cols: list[str], parts: int | None = None) -> DataFrame:
    """The rows of ``df``; a null in ``cols`` is replaced by the last value before it in
    ``order`` (of rows of equal order, the largest).  Rows before the first value stay null,
    rows without an order come first."""
    rows = ranged(df, order, parts=parts)
    upto = Window.partitionBy(RANGE).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"))
    # the largest (order, value) of the rows so far that have a value
    newest = lambda c: F.when(F.col(c).isNotNull(), F.struct(key.alias("key"), F.col(c).alias("value")))
    inside = rows.select("*", *[F.max(newest(c)).over(upto).alias(f"_in_{c}") for c in cols])
    borders = rows.groupBy(RANGE).agg(*[F.max(newest(c)).alias(f"_last_{c}") for c in cols])
    earlier = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(borders.select(RANGE, *[F.max(f"_last_{c}").over(earlier).alias(f"_before_{c}") for c in cols]))
    filled = {c: F.coalesce(F.col(c), F.col(f"_in_{c}.value"), F.col(f"_before_{c}.value")) for c in cols}
    return inside.join(before, RANGE, "left").select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def dense_ranks(df: DataFrame, col: str, out: str, parts: int | None = None) -> DataFrame:
    """``<col>, <out>``: the distinct values that are not null with their dense rank from 0 (long)."""
    values = ranged(df.select(col).where(F.col(col).isNotNull()).distinct(), col, parts=parts)
    own = F.row_number().over(Window.partitionBy(RANGE).orderBy(col)) - 1
    sizes = values.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    before = _carried(sizes, "_before", F.sum("_n"))
    return values.withColumn("_own", own).join(before, RANGE, "left").select(
        col, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(out),
    )
