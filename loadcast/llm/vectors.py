"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors of a label again and again at the median of a
random projection of the unit vectors; those near a split go to both sides (spill),
so a close pair is rarely parted, whatever the vectors' norms.  The splits are
fitted on a bounded sample; every vector is sent down every tree in one
pass and stored once with its leaves.  Leaves are dealt out in rounds, each of which
ships a bounded number of rows a vector, and compared in tiles, so that neither
disk nor a task's memory grows with the leaves or with the links.  Each pair counts in one leaf
alone, is verified in double precision, and linked vectors are united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.llm.common import checked_broadcast, components, drop_tables, forest, grouped, lean, padded, release, spread, stored, table, tables
from loadcast.llm.topk import finite
from loadcast.session import cut_lineage

COSINE = 0.98
TREES = 4
LEAF = 1_024          # vectors of a leaf, about: larger nodes are split further
MOST_LEVELS = 40
SPILL = 1.0           # half width of the spill band, in standard deviations of a borderline pair's projected difference
DENSE = 4.0           # a node of which four fifths lie within so many half widths is not split but compared in blocks
SAMPLE_VECTORS = 40_000   # vectors that the splits are fitted on, about
LEAST_SAMPLE = 16     # sampled vectors of a node before it is split
BLOCK_VALUES = 1 << 19    # components of a block: a leaf with more vectors than fit is compared block by block
TILE = 1 << 20        # cosines that a task holds at a time
TILE_ROWS = 256
PAIRS = 1 << 14       # links that a task looks at at a time
ROUND_SHARE = 2       # rows that a round ships for each vector, about
ROUND_ROWS = 1 << 20  # and at least
SEED = 61


def direction(tree: int, level: int, width: int) -> np.ndarray:
    d = np.random.default_rng([SEED, tree, level]).standard_normal(width)
    return d / np.linalg.norm(d)


def unit(rows: list) -> np.ndarray:
    """Vectors of one width at length one."""
    m = np.array(rows, float)
    m /= np.abs(m).max(1, keepdims=True)  # the squares of very large or small components leave the range of doubles
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def grow(sample: np.ndarray, each: float, tree: int, margin: float, leaf: int) -> list:
    """Nested [level, middle, left, right], or a leaf's number.  A sampled vector stands for ``each`` vectors."""
    leaves = 0

    def build(own: np.ndarray, level: int) -> list | int:
        nonlocal leaves
        if len(own) * each > leaf and len(own) >= LEAST_SAMPLE and level < MOST_LEVELS:
            x = own @ direction(tree, level, own.shape[1])
            low, middle, high = np.quantile(x, [0.1, 0.5, 0.9])
            if high - low > DENSE * margin:
                return [level, float(middle), build(own[x <= middle + margin], level + 1), build(own[x > middle - margin], level + 1)]
        leaves += 1
        return leaves - 1

    return build(sample, 0)


class Forest(NamedTuple):
    """The trees of one label and width as arrays over their inner nodes; below, a leaf has the complement of its number."""

    roots: np.ndarray
    column: np.ndarray  # the node's direction: tree and level
    middle: np.ndarray
    left: np.ndarray
    right: np.ndarray


def flat(trees: list, first: int) -> tuple[Forest, int]:
    """Nested trees as a ``Forest`` whose leaves are numbered from ``first``, tree by tree; and the number after the last one."""
    nodes: list = []
    after = first

    def add(node: list | int, tree: int, start: int) -> int:
        nonlocal after
        if isinstance(node, int):
            after = max(after, start + node + 1)
            return ~(start + node)
        level, middle, left, right = node
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (tree * MOST_LEVELS + level, middle, add(left, tree, start), add(right, tree, start))
        return at

    roots = [add(t, k, after) for k, t in enumerate(trees)]
    column, middle, left, right = ([n[c] for n in nodes] for c in range(4))
    return Forest(np.array(roots), np.array(column, int), np.array(middle, float), np.array(left, int), np.array(right, int)), after


def descend(own: Forest, m: np.ndarray, margin: float, directions: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of unit vectors sent down all trees level by level, both ways inside the spill band."""
    used, place = np.unique(own.column, return_inverse=True)
    for c in used.tolist():
        if c not in directions:
            directions[c] = direction(c // MOST_LEVELS, c % MOST_LEVELS, m.shape[1])
    shown = m @ np.stack([directions[c] for c in used.tolist()], 1)
    row, node = np.repeat(np.arange(len(m)), len(own.roots)), np.tile(own.roots, len(m))
    rows, found = [], []
    while len(node):
        inner = node >= 0
        rows.append(row[~inner])
        found.append(~node[~inner])
        row, node = row[inner], node[inner]
        x, middle = shown[row, place[node]], own.middle[node]
        low, high = x <= middle + margin, x > middle - margin
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([own.left[node[low]], own.right[node[high]]])
    return np.concatenate(rows), np.concatenate(found)


def forest_of(vectors: DataFrame, margin: float, trees: int, leaf: int) -> dict[tuple, Forest]:
    """``{(label, width): Forest}`` fitted on about ``SAMPLE_VECTORS`` vectors; a label and width that no tree
    splits is left out."""
    sizes = {(r.label, r.width): r["count"] for r in vectors.groupBy("label", "width").count().where(F.col("count") > leaf).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    share = min(1.0, SAMPLE_VECTORS / total)
    picked = vectors.where(spread("uid", seed=SEED) < share).select("label", "v") if share < 1 else vectors.select("label", "v")
    own: dict = {}
    for r in picked.collect():
        if (r.label, len(r.v)) in sizes:
            own.setdefault((r.label, len(r.v)), []).append(r.v)
    out, after = {}, 0
    for key, rows in own.items():
        m = unit(rows)
        fitted = [grow(m, sizes[key] / len(rows), t, margin, leaf) for t in range(trees)]
        if any(isinstance(t, list) for t in fitted):
            out[key], after = flat(fitted, after)
    return out


def leaves(vectors: DataFrame, margin: float, trees: int, leaf: int) -> DataFrame:
    """Adds ``leaves``, the sorted leaves of all trees that hold the vector, after spilling; none
    where no tree splits its label and width, which then are one leaf, ``alone``.  ``v`` becomes its bytes."""
    fitted = vectors.sparkSession.sparkContext.broadcast(forest_of(vectors, margin, trees, leaf))
    kind = component_type(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict = {}
        forests = fitted.value
        for batch in batches:
            v = batch.column("v")
            values, sizes = v.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), pc.list_value_length(v).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            groups: dict = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), sizes.tolist(), strict=True)):
                if key in forests:
                    groups.setdefault(key, []).append(i)
            rows, found = [np.zeros(0, int)], [np.zeros(0, int)]
            for (name, width), at in groups.items():
                at = np.array(at)
                m = unit(values[ends[at][:, None] + np.arange(width)])
                row, own = descend(forests[name, width], m, margin, directions.setdefault(width, {}))
                rows.append(at[row])
                found.append(own)
            row, own = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort([own, row])
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))])
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(own[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], packed, lists], [*kept, "v", "leaves"])

    kept = [c for c in vectors.columns if c != "v"]
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in kept)
    sent = vectors.select(*kept, "v").mapInArrow(lean(run), f"{schema}, v binary, leaves array<int>")
    return sent.withColumn("alone", -F.shiftrightunsigned(F.xxhash64("label", "width"), 1) - 1)


def component_type(vectors: DataFrame) -> str:
    """The type of the components in bytes."""
    return "f4" if vectors.schema["v"].dataType.elementType.simpleString() == "float" else "f8"


def dealt(sent: DataFrame, block: int, share: float = ROUND_SHARE, least: int = ROUND_ROWS) -> Iterator[DataFrame]:
    """The members of every leaf, round by round: rows (leaf, lo, hi, side, uid, copies, leaves, v).  A
    leaf of more than ``block`` members is compared block by block, ``lo`` with ``hi``; ``side`` is the member's own block.
    A round ships about ``share`` rows for each vector, so that many leaves a vector and
    large leaves mean more rounds, not more disk."""
    held = F.when(F.size("leaves") > 0, F.col("leaves").cast("array<long>")).otherwise(F.array("alone"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    sizes = cut_lineage(sent.select(F.explode(held).alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", blocks))
    facts = sizes.agg(F.sum(F.col("n") * F.col("blocks")).alias("rows"), F.max("blocks").alias("most")).first()
    members = sent.select("uid", "copies", "leaves", "v", F.explode(held).alias("leaf"))
    if (facts["most"] or 1) > 1:
        large = checked_broadcast(sizes.where("blocks > 1").select("leaf", "blocks"))
        members = members.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        members = members.withColumn("side", F.pmod(F.xxhash64(F.lit(77), "uid"), F.col("blocks")).cast("int"))
        members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    else:
        members = members.withColumns({c: F.lit(0) for c in ("side", "lo", "hi")})
    rounds = math.ceil((facts["rows"] or 1) / max(share * sent.count(), least))
    for r in range(rounds):
        yield members.where(F.pmod(F.xxhash64(F.lit(SEED), "leaf", "lo", "hi"), F.lit(rounds)) == r).select("leaf", "lo", "hi", "side", "uid", "copies", "leaves", "v").repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi", "uid")


def near(a: np.ndarray, b: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of two sets of unit vectors, or i < j of one, with at least the cosine, in pieces.
    Single precision decides where its error cannot matter, double precision elsewhere."""
    other = a if b is None else b
    x, y = a.astype(np.float32), other.astype(np.float32)
    slack = (a.shape[1] + 8) * 2.0**-23  # twice what rounding the components and adding up can move a cosine by
    step = max(1, min(TILE_ROWS, TILE // len(y)))
    for s in range(0, len(x), step):
        first = s if b is None else 0
        cosines = x[s : s + step] @ y[first:].T
        if b is None:
            np.fill_diagonal(cosines, -2)
        rows = np.flatnonzero(cosines.max(1) >= least - slack)  # most rows have none
        cosines = cosines[rows]
        found = np.flatnonzero(cosines >= least - slack)
        for p in range(0, len(found), PAIRS):
            at = found[p : p + PAIRS]
            i, j = np.divmod(at, len(y) - first)
            i = rows[i]
            ok = cosines.ravel()[at] >= least + slack
            doubt = np.flatnonzero(~ok)
            ok[doubt] = np.einsum("ij,ij->i", a[s + i[doubt]], other[first + j[doubt]]) >= least
            if b is None:
                ok &= j > i
            if ok.any():
                yield s + i[ok], first + j[ok]


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each one's component after more edges."""
    apart = root[i] != root[j]
    if not apart.any():
        return root
    linked = np.flatnonzero(root != np.arange(len(root)))
    return forest(len(root), np.concatenate([i[apart], linked]), np.concatenate([j[apart], root[linked]]))


def earlier(lists: np.ndarray, here: int) -> np.ndarray:
    """A bit for each leaf before ``here`` that several rows have, row by row: two rows met before if they have one in common."""
    row, c = np.nonzero(lists < here)
    _, code, n = np.unique(lists[row, c], return_inverse=True, return_counts=True)
    several = n > 1
    row, code = row[several[code]], (np.cumsum(several) - 1)[code[several[code]]]
    bits = np.zeros((len(lists), int(several.sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (row, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return bits


def _compare(least: float, kind: str = "f4"):
    """Links inside each (leaf, lo, hi) task: rows (a, links) with the number
    of other vectors linked, and (a, b) a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["leaf", "lo", "hi"]):
            t = t.combine_chunks()
            uid, side, lo, hi, copies, leaf = (t.column(c).to_numpy() for c in ("uid", "side", "lo", "hi", "copies", "leaf"))
            lists = padded(t.column("leaves").combine_chunks())
            vectors = t.column("v").combine_chunks()
            _, offsets, held = vectors.buffers()
            offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(vectors.type) else np.int32)[vectors.offset :]
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                if e - s < 2 or (lo[s] != hi[s] and len(set(side[s:e])) < 2):
                    continue
                m = unit(np.frombuffer(held, np.uint8)[offsets[s] : offsets[e]].view(kind).reshape(e - s, -1))
                parts = [np.arange(e - s)] * 2 if lo[s] == hi[s] else [np.flatnonzero(side[s:e] == x[s]) for x in (lo, hi)]
                k, root, met = np.zeros(e - s), np.arange(e - s), None
                for i, j in near(m[parts[0]], None if lo[s] == hi[s] else m[parts[1]], least):
                    i, j = parts[0][i], parts[1][j]
                    met = earlier(lists[s:e], leaf[s]) if met is None else met
                    ok = ~(met[i] & met[j]).any(1)
                    i, j = i[ok], j[ok]
                    k += np.bincount(i, copies[s + j], e - s) + np.bincount(j, copies[s + i], e - s)
                    root = united(root, i, j)
                own = np.flatnonzero(k)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(uid[s + own]), pa.array(uid[s + root[own]]), pa.array(k[own].astype(np.int64))], ["a", "b", "links"])

    return lean(run)


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int | None = None, **rounds: float) -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    Only vectors of the same label that is not null are compared.  Vectors
    that are null, zero, or hold null or non-finite components link with
    nothing and form components of their own, and so do vectors of another
    width.  Equal vectors of a label are compared once and counted as often as they occur.
    Repeated rows link with each other; a null id is never kept apart from null.
    ``block`` is the most vectors of a leaf that are compared at once, by default as many as
    ``BLOCK_VALUES`` components; ``rounds`` goes to ``dealt``.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    rows = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(SEED), "v"))  # 128 bits stand for the vector
    able = finite("v") & F.col("label").isNotNull() & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    distinct = rows.where(able).groupBy("label", "v", "h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    distinct = stored(distinct.withColumn("uid", F.monotonically_increasing_id()).withColumn("width", F.size("v")))
    inner = tables()[-1:]
    width = distinct.agg(F.max("width")).first()[0] or 1
    margin = SPILL * float(np.sqrt(2 - 2 * cosine)) / float(np.sqrt(width))
    kind = component_type(distinct)
    sent = stored(leaves(distinct, margin, trees, leaf))
    drop_tables(rows.sparkSession, inner)
    inner = tables()[-1:]
    release(rows.sparkSession)
    found = None
    for members in dealt(sent, block or max(1, BLOCK_VALUES // width), **rounds):
        links = cut_lineage(members.mapInArrow(_compare(cosine, kind), "a long, b long, links long"))
        found = links if found is None else found.union(links)
        del members  # holds the round's shuffle files
        release(rows.sparkSession)
    found = found.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # of every round as many small ones
    together = components(found.select("a", "b")).withColumnRenamed("node", "uid")
    counted = found.groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    known = sent.select("uid", "label", "h1", "h2", "copies", "least").join(together, "uid", "left").join(counted, "uid", "left")
    known = cut_lineage(known.withColumn("component", F.coalesce("component", "uid")))
    drop_tables(rows.sparkSession, inner)
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        F.col("label").alias("l"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id",
    )
    linked = rows.where(able).drop("v").join(known, (F.col("label") == F.col("l")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    alone = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.select("id", "n_links", "component_id").union(alone).select(
        F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def op6_embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return link_vectors(table(spark, root, "embeddings", "vec_id", "embedding", "label"))
