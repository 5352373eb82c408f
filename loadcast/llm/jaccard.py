"""Near-duplicate texts: a chosen-path join on the Jaccard similarity of their
five-word shingles.

Every shingle set is embedded as a row of min-hashes, each of which is a
sampled token of the set.  From the root of a run, a node picks a few
coordinates by its own hash, a Jaccard threshold's inverse on average, and
its sets go on to one child for every picked coordinate and the token they
have there: similar sets share tokens and stay together in some child.
Nodes of one set end, small ones are compared whole, large ones split
further; runs repeat until a borderline pair is found with the target recall.
Pairs are compared by sketch first and then exactly, each in one node alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import (
    WORD_SEPARATORS, ascii_lower, blocked, checked_broadcast, components, first_shared, forest, grouped, lean, padded, pairs_within, stored, table,
)
from loadcast.session import cut_lineage

WORDS = 5
JACCARD = 0.8
RECALL = 0.99       # of a pair right at the threshold, in nodes split to the full depth
COORDINATES = 64    # min-hashes of a set
DEPTH = 3           # levels at which nodes are split, the root's included
BUCKET = 512        # sets that are compared as they are
SKETCH_SLACK = 0.15 # three standard deviations of a borderline pair's sketch
SLICE = 400_000     # words hashed at a time in one Python worker
SEED = 81

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, COORDINATES, np.uint64), rng.integers(0, 1 << 63, COORDINATES, np.uint64) | np.uint64(1)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """A borderline pair has one common child a node on average (Poisson): the
    chance that a run loses it by the depth is q(d) = exp(q(d-1) - 1), q(0) = 0.
    (Roots have a child at least, which only lowers it.)  What the sketches
    lose of borderline pairs is made up for by the runs."""
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(1 - recall / (1 - sketch_loss())) / math.log(q))


def sketch_loss(similarity: float = JACCARD) -> float:
    """The chance that the sketches of a pair right at the threshold agree in too few coordinates to be looked at."""
    need = math.floor((similarity - SKETCH_SLACK) * COORDINATES)
    return sum(math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(need))


def shingles(words: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text and their offsets by
    text; a shorter text that is not empty has one shingle, all its words."""
    n = np.diff(offsets)
    roll = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        roll[: len(words) - k] = roll[: len(words) - k] * _ROLL + words[k:]
    count = np.maximum(n - width + 1, (n > 0).astype(n.dtype))
    out_offsets = np.append(0, np.cumsum(count))
    at = np.repeat(offsets[:-1] - out_offsets[:-1], count) + np.arange(out_offsets[-1])
    out = roll[at]
    for i in np.flatnonzero((n > 0) & (n < width)):
        h = np.uint64(n[i])
        for w in words[offsets[i] : offsets[i + 1]]:
            h = h * _ROLL + w + _MIX
        out[out_offsets[i]] = h
    return _scramble(out), out_offsets


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, after the last, words, offsets) of pieces of a column of word hashes."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    lo = 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        yield lo, hi, values[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


@lean
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, signature and min-hashes of each text's shingle set."""
    xor, mul = _coordinates()
    with np.errstate(over="ignore"):
        for batch in batches:
            lists = batch.column(2)
            n = len(lists)
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sketch = np.zeros((n, COORDINATES), "<u4")
            for lo, hi, words, offsets in _slices(lists):
                hashes, at = shingles(words, offsets)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                for i in full:
                    u = np.unique(hashes[at[i] : at[i + 1]])
                    size[lo + i], one[lo + i], two[lo + i] = len(u), np.bitwise_xor.reduce(_scramble(u + _ROLL)), np.add.reduce(_scramble(u ^ _ROLL))
                for c in range(COORDINATES):
                    sketch[lo + full, c] = np.minimum.reduceat((hashes ^ xor[c]) * mul[c], at[full]) >> np.uint64(32)
            data = sketch.tobytes()
            step = 4 * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                 pa.array([data[k * step : (k + 1) * step] for k in range(n)], pa.binary())],
                ["id", "text_key", "size", "s1", "s2", "sketch"],
            )


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle set of each text as bytes."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for lo, hi, words, offsets in _slices(batch.column(1)):
                hashes, at = shingles(words, offsets)
                out = [np.unique(hashes[at[i] : at[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["uid", "shingles"])


def _word_hashes(text: str) -> Column:
    words = F.filter(F.split(ascii_lower(text), WORD_SEPARATORS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _children(threshold: float, root: bool):
    """Children of nodes: rows (node, uid) from (node, uid, sketch).  A root
    that picks no coordinate takes the one nearest to being picked, so that no run is empty."""
    limit = np.uint64(min(1.0, 1 / (threshold * COORDINATES)) * (2**64 - 1))
    coordinate = _scramble(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _ROLL)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                node = batch.column(0).to_numpy().view(np.uint64)
                picked = _scramble(_scramble(node)[:, None] ^ coordinate[None, :])
                chosen = picked < limit
                if root:
                    chosen[np.arange(len(picked)), picked.argmin(1)] = True
                row, c = np.nonzero(chosen)
                sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, COORDINATES)
                child = _scramble(_scramble(node[row] + coordinate[c]) ^ (sketch[row, c].astype(np.uint64) + _ROLL))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(batch.column(1).to_numpy()[row])], ["node", "uid"])

    return run


def buckets(sets: DataFrame, threshold: float = JACCARD, recall: float = RECALL, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """(leaf, uid): nodes of two sets or more in which sets (uid, sketch) are to be compared.

    Only (node, uid) pairs are shuffled to count the nodes; the sketches
    follow those in nodes that are split.  A node that is still large at the
    last level is compared in blocks, so nothing is capped.
    """
    runs = runs_needed(recall, depth)
    out: DataFrame | None = None
    roots = F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))
    open_nodes = sets.withColumn("run", roots).select(F.xxhash64(F.lit(SEED), "run").alias("node"), "uid", "sketch")
    for level in range(1, depth + 1):
        held = cut_lineage(open_nodes.mapInArrow(_children(threshold, level == 1), "node long, uid long"))
        sizes = held.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        held = cut_lineage(held.join(sizes, "node"))
        done = held if level == depth else held.where(F.col("n") <= bucket)
        out = done if out is None else out.union(done)
        large = held.where(F.col("n") > bucket)
        if level == depth or not large.limit(1).count():
            break
        open_nodes = large.select("node", "uid").join(sets.select("uid", "sketch"), "uid").select("node", "uid", "sketch")
    # two picks of a run can lead to one child of the same name only for one set
    return out.select(F.col("node").alias("leaf"), "uid").distinct()


def _candidates(t: pa.Table, starts: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same task that may reach the threshold and meet in this leaf first."""
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
    size, side, lo, hi, leaf = (t.column(c).to_numpy() for c in ("size", "side", "lo", "hi", "leaf"))
    lists = padded(t.column("leaves").combine_chunks())
    need = math.floor((threshold - SKETCH_SLACK) * COORDINATES)
    for i, j, _ in pairs_within(starts, t.num_rows):
        ok = (np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])) & ((lo[i] == hi[i]) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = (sketch[i] == sketch[j]).sum(1) >= need
        i, j = i[ok], j[ok]
        ok = first_shared(lists[i], lists[j], leaf[i])
        if ok.any():
            yield i[ok], j[ok]


def _flag(threshold: float):
    """The rows (leaf, lo, hi, uid) that have a candidate partner in their task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["leaf", "lo", "hi"]):
            t = t.combine_chunks()
            hit = np.zeros(t.num_rows, bool)
            for i, j in _candidates(t, starts, threshold):
                hit[i] = hit[j] = True
            if hit.any():
                found = t.select(["leaf", "lo", "hi", "uid"]).filter(pa.array(hit)).combine_chunks()
                yield from found.to_batches()

    return run


def _intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    total = sum(map(len, sets))
    if len(i) * 200 < total or len(sets) < 16:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    token, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = count[inverse] > 1  # tokens of one set add nothing
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    both = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(count.size and (count > 1).sum()), width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        both += m @ m.T
    return both[i, j].astype(np.int64)


def _verify(threshold: float):
    """Exact similarities of a task's candidates: (a, b) a forest of the links, and a's linked documents."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["leaf", "lo", "hi"]):
            t = t.combine_chunks()
            uid, copies, size = (t.column(c).to_numpy() for c in ("uid", "copies", "size"))
            bounds = np.append(starts, t.num_rows)
            held = t.column("shingles")
            pairs = list(_candidates(t, starts, threshold))
            if not pairs:
                continue
            i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            group = np.searchsorted(bounds, i, side="right") - 1
            order = np.argsort(group, kind="stable")
            i, j, group = i[order], j[order], group[order]
            links = np.zeros(t.num_rows, np.int64)
            good = np.zeros(len(i), bool)
            for g in np.unique(group):
                a, b = np.searchsorted(group, [g, g + 1])
                rows, local = np.unique(np.concatenate([i[a:b], j[a:b]]), return_inverse=True)
                sets = [np.frombuffer(held[int(r)].as_py(), np.uint64) for r in rows]
                x, y = local[: b - a], local[b - a :]
                both = _intersections(sets, x, y)
                good[a:b] = both >= threshold * (size[i[a:b]] + size[j[a:b]] - both) - 1e-9
            i, j = i[good], j[good]
            if not len(i):
                continue
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            root = forest(t.num_rows, i, j)
            near = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(uid[near]), pa.array(uid[root[near]]), pa.array(links[near])], ["a", "b", "links"])

    return run


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = JACCARD, recall: float = RECALL,
                    depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: (id, text_key, n_links, component_id, kept); of a
    class the row of smallest id, then text key, is kept.

    Texts are linked if their sets of five-word shingles (words as in license
    scans) have the given Jaccard similarity or more; ``n_links`` counts the
    other documents linked directly, ``component_id`` is the smallest id of
    the class.  A text of one to four words has one shingle; a null text or
    one without words links with nothing and forms its own class.  Texts with equal sets are
    compared once and counted as often as they occur.  ``text_key`` is the
    text's MD5 (null texts count as empty), for joining back.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("text_key"), body.alias("t"))
    marks = stored(
        source.select("id", "text_key", _word_hashes("t").alias("w"))
        .mapInArrow(_mark, "id long, text_key binary, size long, s1 long, s2 long, sketch binary")
    )
    same = ["size", "s1", "s2"]
    first = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")  # null ids come last
    sets = stored(
        marks.where("size > 0").groupBy(*same)
        .agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("own"), F.max("sketch").alias("sketch"))
        .select(*same, "copies", "own", "own.id", "own.text_key", "sketch").withColumn("uid", F.monotonically_increasing_id())
    )
    held = stored(buckets(sets.select("uid", "sketch"), threshold, recall, depth, bucket))
    lists = held.groupBy("uid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    order = ["leaf", "lo", "hi", "uid"]
    members = (
        blocked(held, "leaf", "uid", bucket).join(lists, "uid")
        .join(sets.select("uid", "size", "copies", "sketch"), "uid")
        .select("leaf", "lo", "hi", "side", "uid", "size", "copies", "leaves", "sketch")
    )
    flagged = stored(
        members.repartition("leaf", "lo", "hi").sortWithinPartitions(*order)
        .mapInArrow(_flag(threshold), "leaf long, lo int, hi int, uid long")
    )
    wanted = cut_lineage(flagged.select("uid").distinct().join(sets.select("uid", "id", "text_key"), "uid"))
    wanted = wanted.select("uid", F.col("id").alias("i"), F.col("text_key").alias("k"))
    texts = source.join(checked_broadcast(wanted, "k"), F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")))
    shingle_sets = (
        texts.select("uid", _word_hashes("t").alias("w")).mapInArrow(_sets, "uid long, shingles binary").dropDuplicates(["uid"])
    )
    again = flagged.join(shingle_sets, "uid").join(sets.select("uid", "size", "copies", "sketch"), "uid").join(lists, "uid")
    # sides are a function of the member and the leaf's size, which `blocked` has set: take them from there
    sides = blocked(held, "leaf", "uid", bucket).select("leaf", "lo", "hi", "uid", "side")
    found = cut_lineage(
        again.join(sides, ["leaf", "lo", "hi", "uid"])
        .select("leaf", "lo", "hi", "side", "uid", "size", "copies", "leaves", "sketch", "shingles")
        .repartition("leaf", "lo", "hi").sortWithinPartitions(*order)
        .mapInArrow(_verify(threshold), "a long, b long, links long")
    )
    united = components(found.select("a", "b")).withColumnRenamed("node", "uid")
    counted = found.groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    known = cut_lineage(
        sets.select("uid", *same, "copies", "own").join(united, "uid", "left").join(counted, "uid", "left")
        .withColumn("component", F.coalesce("component", "uid"))
    )
    smallest = known.groupBy("component").agg(F.min("own").alias("first"))
    known = known.join(smallest, "component").select(
        *[F.col(c).alias(f"of_{c}") for c in same], (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "first",
    )
    key = (F.col("size") == F.col("of_size")) & (F.col("s1") == F.col("of_s1")) & (F.col("s2") == F.col("of_s2"))
    linked = marks.where("size > 0").join(known, key).select(
        "id", "text_key", "n_links", F.col("first.id").alias("component_id"),
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"),
    )
    alone = marks.where("size = 0").select(
        "id", "text_key", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.union(alone)


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of every class
    the document of smallest id (then text key) stays.  Texts without words
    all stay.  Of repeated rows that are alike in id and text one stays."""
    classes = stored(jaccard_classes(docs, doc_id, text, **options))
    key = [F.col("id").alias("__id"), F.col("text_key").alias("__key")]
    empty = F.unhex(F.md5(F.lit("").cast("binary")))
    gone = cut_lineage(classes.where(~F.col("kept")).select(*key).distinct())
    twice = cut_lineage(
        classes.where(F.col("kept") & (F.col("text_key") != empty)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    own = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    keyed = docs.withColumn("__own_id", F.col(doc_id).cast("long")).withColumn("__own_key", own)
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_key") == F.col("__key"))
    kept = keyed.join(checked_broadcast(gone, "__key"), same, "left_anti")
    if twice.limit(1).count():
        small = checked_broadcast(twice, "__key")
        kept = kept.join(small, same, "left_anti").union(kept.join(small, same, "left_semi").dropDuplicates(["__own_id", "__own_key"]))
    return kept.drop("__own_id", "__own_key")


def op8_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_classes(table(spark, root, "documents", "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_links", "component_id", "kept"
    )
