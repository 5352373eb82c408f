"""Helpers shared by the operators: lineage cuts, hashed order, running totals, grouped batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.session import cut_lineage, ensure_checkpoint_dir
from loadcast.sources.tables import read_table

#: Separators of words: every ASCII character but digits and lower-case letters.
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table; nothing else is read from the scan."""
    return read_table(spark, root, name).select(*columns)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Writes ``df`` as a table of its own below the shared checkpoint folder and
    reads it back: columns that a later step does not need are not read, and
    files hold one value of the columns ``by`` each.
    The driver removes the tables when it ends."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder)
    _TABLES.append(folder)
    return spark.read.schema(df.schema).parquet(folder).select(*df.columns)


_TABLES: list[str] = []


def tables() -> list[str]:
    """The folders of the tables that ``stored`` has written and that still stand."""
    return list(_TABLES)


def drop_tables(spark: SparkSession, folders: Sequence[str]) -> None:
    """Removes stored tables that no frame in use reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _TABLES:
            _TABLES.remove(folder)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files and checkpoints that no frame in use reads any more.  Spark removes them when the driver
    collects its garbage, which a driver with little to do seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _remove_tables() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            drop_tables(spark, tables())
    except Exception:  # noqa: BLE001 - the session may have ended before; the folder is scratch space
        return


def ascii_lower(text: Column | str) -> Column:
    """Lower-cases A-Z only; null counts as the empty text."""
    return F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def spread(*columns: Column | str, seed: int = 0) -> Column:
    """A reproducible pseudo-random double in [0, 1) from the columns' values."""
    h = F.xxhash64(F.lit(seed), *columns)
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def checked_broadcast(df: DataFrame, *strings: str, rows: int = 100_000, chars: int = 8_000_000) -> DataFrame:
    """Broadcasts a materialised frame if it has at most ``rows`` rows and its
    string columns at most ``chars`` bytes in all; else leaves the join to the shuffle."""
    long = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(long), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= rows and r["b"] <= chars else df


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], value: Column, out: str,
    *, rows: int | None = None, rows_per_bucket: int = 10_000,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that
    stand before this one, by ``order`` (a double in [0, 1]) and ``ties``.

    A window over a whole key would put a hot key into one task.  The order
    column is cut into as many buckets as the rows need; windows run inside
    (keys, bucket), and the buckets' own totals, one row per key and bucket,
    are added up in a second small window.  ``df`` is read twice, so pass a
    materialised frame.  Null keys form their own group.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, math.ceil(n / rows_per_bucket))
    b, before = "__bucket", "__before"
    cut = df.withColumn(b, F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)).cast("long")).withColumn("__value", value)
    totals = cut.groupBy(*keys, b).agg(F.sum("__value").alias("__total"))
    by_bucket = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__b"),
        F.coalesce(F.sum("__total").over(by_bucket), F.lit(0)).alias(before),
    )
    inner = Window.partitionBy(*keys, b).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__inner", F.coalesce(F.sum("__value").over(inner), F.lit(0)))
    same = F.col(b) == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        cut.join(offsets, same)
        .withColumn(out, F.col("__inner") + F.col(before))
        .drop(b, "__value", "__inner", "__b", before, *[f"__k{i}" for i in range(len(keys))])
    )


def global_index(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the gapless rank (from 0) of each row in ``order``, by a
    range sort and the sizes of its partitions (one row per partition)."""
    ranged = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    # one row per partition of the range sort: bounded by the partition count
    return ranged.join(F.broadcast(offsets), "__pid").withColumn(out, F.col("__at") + F.col("__before")).drop("__pid", "__at", "__before")


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups from batches that are sorted by ``keys``: yields tables and
    the first row of each group.  The last group of a batch waits for the
    next one, so memory holds one batch and one group."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        starts = group_starts(t, keys)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), starts[:-1]
        rest = t.slice(last).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def lean(run):
    """The generator ``run``; when it ends, memory that a Python worker has freed goes back to
    the system.  Workers serve task after task of all stages and would keep it."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def group_starts(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray, n: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of the same group as index arrays, in pieces of
    about ``most`` pairs, with each pair's group number."""
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    later = np.append(starts[1:], n)[group] - np.arange(n) - 1
    ends = np.cumsum(later)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        c = later[lo:hi]
        total = int(c.sum())
        if total:
            i = np.repeat(np.arange(lo, hi), c)
            j = i + 1 + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            yield i, j, group[i]
        lo = hi


def blocked(members: DataFrame, leaf: str, member: str, block: int) -> DataFrame:
    """Deals the members of each leaf into comparison tasks of at most about
    two blocks, so that a leaf of any size is compared whole without one
    task holding it: columns ``lo``, ``hi`` (the task's two blocks) and
    ``side`` (the member's own block) are added, a row for each task."""
    sizes = members.groupBy(leaf).agg(F.count(F.lit(1)).alias("__n"))
    n = F.ceil(F.col("__n") / F.lit(block)).cast("int")
    return (
        members.join(sizes, leaf)
        .where(F.col("__n") > 1)
        .withColumn("__blocks", n)
        .withColumn("side", F.pmod(F.xxhash64(F.lit(77), member), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("lo", F.least("side", "__other"))
        .withColumn("hi", F.greatest("side", "__other"))
        .drop("__n", "__blocks", "__other")
    )


def first_shared(a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """For rows of sorted leaf lists (filled up with the largest integer): whether ``here`` is the smallest in both."""
    first = np.ones(len(here), bool)
    for c in range(a.shape[1]):
        own = a[:, c]
        check = first & (own < here)
        if check.any():
            first[check] &= ~(b[check] == own[check, None]).any(1)
    return first


def padded(lists: pa.ListArray, fill: int = np.iinfo(np.int64).max) -> np.ndarray:
    """Lists of longs as one matrix, filled up."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.full((len(lists), max(1, int(sizes.max(initial=0)))), fill, np.int64)
    flat = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (i, j): the smallest node of each one's component."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return root


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (node, component),
    component the smallest node reachable.

    Each round every node takes the smallest label among its own and its
    neighbours' and then the label of that label (pointer jumping), so chains
    halve.  Only the count of changed labels comes to the driver.  Both
    joins are equi-joins that adaptive execution may split at hubs.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(rounds):
        seen = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        near = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        moved = cut_lineage(near.join(jump, "to").select("node", F.least("to", "next").alias("component"), "was"))
        changed = moved.where("component <> was").limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
