"""Best-fit packing of documents into fixed-length sequences, in bulk-synchronous rounds.

A round puts the unplaced items and the open gaps of all sequences into one
order of size and cuts it into ranges.  Each range is swept once, smallest
first: an item waits on a stack, a gap takes the last (largest) waiting item,
which is the item that fills it best; every gap takes one item at most, so no
two items meet in one place.  Items and gaps that find no partner inside
their range are matched across ranges by their rank.  Gaps shrink, and the
next round starts.  When a sweep places next to nothing, the largest items
left open as many new sequences as the rest needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.llm.common import lean, running_total, spread, table
from loadcast.llm.tokens import encoder, public_files
from loadcast.session import cut_lineage

CAPACITY = 2048
STALLED = 0.02  # a sweep that fills at most this share of the gaps opens new sequences
FOLD = 12       # after so many parts the places are stored as one, so the last plan stays small
TAIL = 0.005    # items left of less than this share of all tokens are laid end to end


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 files: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document's ids,
    the closing id 0 included; only texts of more than ``capacity`` ids are
    cut, the first piece being the shorter one.  A null text is empty."""
    where = files or public_files()

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*where)
        end = b"\0\0\0\0"
        for batch in batches:
            ids, pieces, starts, lengths, crcs = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = enc.encode(t.as_py() or "") + end
                n = len(data) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = at + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    ids.append(d), pieces.append(k), starts.append(at), lengths.append(to - at)
                    crcs.append(zlib.crc32(data[4 * at : 4 * to]))
                    at = to
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted order.  Out: every item and gap with its partner
    (``mate``, null if none), for those without one its rank among the
    range's items or gaps left, and a row of kind 2 that says how many
    gaps (``size``) and items (``gap``) the range has left."""
    waiting: list[tuple[int, int]] = []
    uid, size, kind, mate, gap, rank = [], [], [], [], [], []
    left = 0
    for batch in batches:
        for s, k, u in zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "uid")), strict=True):
            if k == 0:
                waiting.append((u, s))
            elif waiting:
                i, n = waiting.pop()
                uid.append(i), size.append(n), kind.append(0), mate.append(u), gap.append(s), rank.append(None)
            else:
                uid.append(u), size.append(s), kind.append(1), mate.append(None), gap.append(None), rank.append(left)
                left += 1
    for r, (i, n) in enumerate(waiting):
        uid.append(i), size.append(n), kind.append(0), mate.append(None), gap.append(None), rank.append(r)
    here = TaskContext.get().partitionId()
    if uid:
        uid.append(None), size.append(left), kind.append(2), mate.append(None), gap.append(len(waiting)), rank.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), pa.array(size, pa.int64()), pa.array(kind, pa.int32()), pa.array(mate, pa.int64()),
             pa.array(gap, pa.int64()), pa.array(rank, pa.int64()), pa.array([here] * len(uid), pa.int32())],
            ["uid", "size", "kind", "mate", "gap", "rank", "range"],
        )


def _across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Matches what the ranges left: from (range, gaps, items) in order, gives
    segments (gap range, first gap rank, after the last, item range, item
    rank of the first gap); later gaps of a segment take lower item ranks."""
    stack: list[list[int]] = []
    out = []
    for part, gaps, items in counts:
        at = 0
        while at < gaps and stack:
            n = min(gaps - at, stack[-1][1])
            out.append((part, at, at + n, stack[-1][0], stack[-1][1] - 1))
            at += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if items:
            stack.append([part, items])
    return out


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    """Materialised, and read back in as few partitions as so many rows need."""
    return cut_lineage(df).coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // 50_000))


def _met(segments: list[tuple[int, int, int, int, int]]):
    """For what the ranges left: where an item and a gap meet, as range and rank of the item (null: nowhere)."""
    by_gap = np.array(sorted(segments), np.int64).reshape(-1, 5)
    below = [(s[3], s[4] - (s[2] - s[1]) + 1, s[4]) for s in segments]
    by_item = np.array(sorted(below), np.int64).reshape(-1, 3)
    place = lambda part, rank: part * (1 << 40) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("kind", "range", "rank"))
            at, item_range, item_rank = place(part, rank), np.full(len(rank), -1), np.full(len(rank), -1)
            k = np.searchsorted(place(by_gap[:, 0], by_gap[:, 1]), at, "right") - 1
            s = by_gap[k]
            own = (kind == 1) & (k >= 0) & (s[:, 0] == part) & (rank < s[:, 2])
            item_range[own], item_rank[own] = s[own, 3], s[own, 4] - (rank[own] - s[own, 1])
            k = np.searchsorted(place(by_item[:, 0], by_item[:, 1]), at, "right") - 1
            s = by_item[k]
            own = (kind == 0) & (k >= 0) & (s[:, 0] == part) & (rank <= s[:, 2])
            item_range[own], item_rank[own] = part[own], rank[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("size"), batch.column("kind"),
                 pa.array(item_range, mask=item_range < 0), pa.array(item_rank, mask=item_range < 0)],
                ["uid", "size", "kind", "item_range", "item_rank"],
            )

    return run


def _round(items: DataFrame, gaps: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(placed: uid, size, mate, gap), items left, gaps left, how many items are
    left, and how many gaps were free before ranges were matched, after one round.  The segments tell which items and gaps meet
    across ranges, so one grouping pairs them and filters leave the others."""
    order = ["size", "kind", "uid"]
    events = items.select("size", F.lit(0).alias("kind"), "uid").union(gaps.select("size", F.lit(1).alias("kind"), "uid"))
    swept = _narrow(
        events.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_sweep, "uid long, size long, kind int, mate long, gap long, rank long, range int"), rows,
    )
    # one row per range, which are as many as shuffle partitions; put in order here: grouping and
    # sorting them on the cluster were most of a round's tasks
    counts = sorted(tuple(r) for r in swept.where("kind = 2").select("range", "size", "gap").collect())
    left, free = sum(i for _, _, i in counts), sum(g for _, g, _ in counts)
    segments = _across(counts)
    placed = swept.where("mate is not null").select("uid", "size", "mate", "gap")
    rest = swept.where("rank is not null").select("uid", "size", "kind", "range", "rank")
    if segments:
        rest = rest.mapInArrow(_met(segments), "uid long, size long, kind int, item_range long, item_rank long")
        of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        pairs = rest.where("item_range is not null").groupBy("item_range", "item_rank").agg(
            of(0, "uid").alias("uid"), of(0, "size").alias("size"), of(1, "uid").alias("mate"), of(1, "size").alias("gap"),
        )
        placed = placed.union(_narrow(pairs.select("uid", "size", "mate", "gap"), rows))
        rest = rest.where("item_range is null")
        left -= sum(after - first for _, first, after, _, _ in segments)
    shrunk = placed.select(F.col("mate").alias("uid"), (F.col("gap") - F.col("size")).alias("size")).where("size > 0")
    gaps = rest.where("kind = 1").select("uid", "size").union(shrunk)
    return placed, rest.where("kind = 0").select("uid", "size"), gaps, left, free


def _end_to_end(items: DataFrame, unit: int, longest: int, total: int) -> DataFrame:
    """Lays items end to end in hashed order and cuts the line into parts of at
    most ``unit``: rows (uid, size, part, offset).  ``longest`` bounds an item."""
    line = running_total(
        cut_lineage(items.withColumn("u", spread("uid", seed=5))), [], "u", ["uid"], F.col("size"), "before", rows=total
    )
    line = line.withColumn("part", F.floor(F.col("before") / (unit - longest + 1)).cast("long"))
    within = Window.partitionBy("part")  # at most ``unit`` items
    return line.select("uid", "size", "part", (F.col("before") - F.min("before").over(within)).alias("offset"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (column ``length``, at most
    ``capacity``): no sequence is overfull, offsets are gapless from 0.

    Pieces shorter than a thirty-second of the capacity are first laid end to
    end into bundles of at most a sixteenth, so the number of rounds is
    bounded by the sixteenth, not by the smallest document.  Sequence ids are
    any numbers.  An empty frame gives an empty frame.
    """
    # ids of a materialised frame: partitions and their order are fixed
    pieces = cut_lineage(pieces).withColumn("uid", F.monotonically_increasing_id())
    small = max(1, capacity // 32)
    counts = pieces.agg(
        F.sum("length").alias("tokens"), F.count(F.when(F.col("length") <= small, 1)).alias("tiny"), F.count(F.lit(1)).alias("n"),
    ).first()
    if not counts["n"]:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")).drop("uid")
    sized = pieces.select("uid", F.col("length").alias("size"))
    tiny = _end_to_end(sized.where(F.col("size") <= small), 2 * small, small, counts["tiny"])
    # a bundle is named after its first member, which is unique
    bundles = cut_lineage(tiny.withColumn("bundle", F.min(F.struct("offset", "uid")).over(Window.partitionBy("part"))["uid"]))
    items = cut_lineage(
        sized.where((F.col("size") > small) & (F.col("size") < capacity))
        .union(bundles.groupBy("bundle").agg(F.sum("size").alias("size")).select(F.col("bundle").alias("uid"), "size"))
    )
    own = F.col("size") > capacity // 2
    opened = items.where(own).select("uid", (capacity - F.col("size")).alias("size"))
    places = [items.where(own), sized.where(F.col("size") == capacity)]
    places = [p.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")) for p in places]
    items, gaps = items.where(~own), opened.where("size > 0")
    n, folded = items.count(), []
    while n:
        if len(places) >= FOLD:
            folded.append(_narrow(reduce(DataFrame.union, places), counts["n"]))
            places = []
        placed, items, gaps, left, free = _round(items, gaps, counts["n"])
        places.append(placed.select("uid", F.col("mate").alias("sequence_id"), (F.lit(capacity) - F.col("gap")).alias("offset")))
        before, n = n, left
        # of all gaps, next to none took an item
        if not n or before - n > STALLED * min(before, before - n + free):
            continue
        _, tokens, longest = _size(items)
        if tokens <= TAIL * counts["tokens"]:
            tail = _end_to_end(items, capacity, longest, n)
            name = F.min(F.struct("offset", "uid")).over(Window.partitionBy("part"))["uid"]
            places.append(tail.select("uid", name.alias("sequence_id"), "offset"))
            break
        first, items, opened = _largest(items, -(-tokens // capacity), counts["n"])
        places.append(first.select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
        gaps = gaps.union(first.select("uid", (capacity - F.col("size")).alias("size")))
        n -= opened
    # sequence_id of a bundle's members: their bundle's; everything else has its own row
    placed = reduce(DataFrame.union, [*folded, *places])
    in_bundle = bundles.select("uid", "bundle", F.col("offset").alias("inner"))
    target = pieces.join(in_bundle, "uid", "left").withColumn("item", F.coalesce("bundle", "uid"))
    return (
        target.join(placed.withColumnRenamed("uid", "item"), "item")
        .withColumn("offset", F.col("offset") + F.coalesce("inner", F.lit(0)))
        .drop("uid", "bundle", "inner", "item")
    )


def _size(items: DataFrame) -> tuple[int, int, int]:
    r = items.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    return r[0], r[1] or 0, r[2] or 0


def _largest(items: DataFrame, n: int, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """The ``n`` largest items, the rest, and how many were taken.  Sizes are at
    most the capacity, so their histogram is small; of the size at the border
    as many as are still needed are taken in hashed order."""
    taken, need, border = 0, 0, 0
    for border, count in sorted(items.groupBy("size").count().collect(), reverse=True):
        need = min(count, n - taken)
        taken += need
        if taken >= n:
            break
    at_border = cut_lineage(items.where(F.col("size") == border).withColumn("u", spread("uid", seed=6)))
    ranked = running_total(at_border, [], "u", ["uid"], F.lit(1), "before").select("uid", "size", (F.col("before") < need).alias("first"))
    marked = _narrow(items.where(F.col("size") != border).select("uid", "size", (F.col("size") > border).alias("first")).union(ranked), rows)
    return marked.where("first").drop("first"), marked.where("not first").drop("first"), taken


def op3_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack(token_pieces(table(spark, root, "documents", "doc_id", "text"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
