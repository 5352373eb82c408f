"""Clustering clients by the shape of their day.

``cluster_clients`` runs Lloyd's rounds for all its starts at once: every pass
over the profile vectors assigns each client in every start that still moves, so
twenty starts take the passes of one.  Vectors are held in whole millionths
and centres are whole too: sums and costs do not depend on the order of
tasks, and a fit ends when its centres stand still.  Starts are seeded by
distance-weighted sampling, one pass a centre.  Only the centres (starts x
k) live on the driver; the map ``client_id -> cluster_id`` never leaves
Spark.

``kmeans_step`` is one assignment + update from fixed starting centres,
written with plain column expressions.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.joins import broadcast_if_small
from loadcast.operators.profile import VECTOR_COLS
from loadcast.session import cut_lineage

# Bytes per cluster-map row assumed when deciding to broadcast it.
MAP_ROW_BYTES = 48
MAP_BROADCAST_BYTES = 256 * 1024 * 1024
PARTS_AT_ONCE = 64  # so many parts' sums are added without a tree
UNIT = 1_000_000  # vectors are held in whole millionths
# Odd constants of the 64-bit mix that deals the seeds (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def fixed_columns(cols: list[str]) -> dict:
    return {"client_id": F.col("client_id").cast("long")} | {c: F.floor(F.col(c) * UNIT + 0.5) for c in cols}


def fixed(vectors: DataFrame, cols: list[str] = VECTOR_COLS) -> DataFrame:
    """``client_id`` and the features in whole millionths."""
    return vectors.select(*[c.alias(n) for n, c in fixed_columns(cols).items()])


def uniform(ids: np.ndarray, seed: int, start: int, step: int) -> np.ndarray:
    """A reproducible number in (0, 1] for every id."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(MIX[0]) + np.uint64((seed * 1_000_003 + start) * 1_009 + step)
        for shift, factor in ((30, MIX[1]), (27, MIX[2])):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 1.0) / float(1 << 53)


def _group_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch as its groups' ids and vectors."""
    for batch in batches:
        if batch.num_rows:
            ids, group, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.stack(cols, 1).astype(float)
            own = [(int(g), ids[group == g], x[group == g]) for g in np.unique(group)]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["block"])


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres); whole numbers under 2**53, so exact in doubles."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)


def moved(x: np.ndarray, centres: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of every start (centres: starts x k x features): its clusters' sums and counts and its cost,
    all starts' distances and sums by one product each.  A client goes to the first of equally near centres."""
    starts, k, width = centres.shape
    flat = centres.reshape(-1, width)
    # squared distances but for the client's own square, which all centres share
    d = ((-2 * flat) @ x.T + (flat * flat).sum(1)[:, None]).reshape(starts, k, len(x))
    best, near = d[:, 0].copy(), np.zeros((starts, len(x)), np.int32)
    for j in range(1, k):
        closer = d[:, j] < best
        near[closer] = j
        np.minimum(best, d[:, j], out=best)
    best += (x * x).sum(1)
    hot = d  # its place is free again
    for j in range(k):
        hot[:, j] = near == j
    sums, counts = hot.reshape(-1, len(x)) @ x, hot.sum(2).astype(np.int64)
    return [(t.astype(np.int64), n, exact_total(c)) for t, n, c in zip(sums.reshape(starts, k, width), counts, best, strict=True)]


def exact_total(d: np.ndarray) -> int:
    whole = d.astype(np.int64)
    return (int((whole >> 20).sum()) << 20) + int((whole & ((1 << 20) - 1)).sum())


def merged(a: dict, b: dict, join) -> dict:
    """Both dicts, their common keys' values joined."""
    return {**a, **{k: join(a[k], v) if k in a else v for k, v in b.items()}}


def seed_centres(blocks, k: int, starts: int, seed: int, groups: list[int]) -> dict[tuple[int, int], np.ndarray]:
    """``{(group, start): k centres}``, all groups and starts together, one pass a centre:
    the first is any client, each further one a client drawn with a weight
    of its squared distance to the nearest centre so far.  The draw is the
    smallest of ``-ln(u) / weight`` (ties: the smaller id), so it combines in
    any order.  Where every client stands on a centre, the first repeats."""
    centres: dict[tuple[int, int], np.ndarray] = {}
    wanted = set(groups)
    for step in range(k):

        def draw(block, centres=centres, step=step):
            g, ids, x = block
            out = {}
            for s in range(starts) if g in wanted else ():
                w = distances(x, centres[g, s]).min(1) if step else np.ones(len(ids))
                race = np.where(w > 0, -np.log(uniform(ids, seed, s, step)) / np.where(w > 0, w, 1), np.inf)
                at = np.lexsort((ids, race))[0]
                out[g, s] = (float(race[at]), int(ids[at]), x[at])
            return out

        best = blocks.map(draw).treeReduce(lambda a, b: merged(a, b, lambda p, q: min(p, q, key=lambda t: t[:2])))
        drawn = {key: x if np.isfinite(race) else centres[key][0] for key, (race, _, x) in best.items()}
        centres = {key: np.vstack([centres[key], x]) if step else x[None, :] for key, x in drawn.items()}
    return centres


def lloyd(blocks, centres: dict, rounds: int) -> tuple[dict, dict, int]:
    """(centres, costs, passes) by (group, start): at most ``rounds`` rounds, each pass serving
    every start that still moves; a mean is rounded down, an empty cluster stays.
    ``costs`` are those of the final centres."""
    centres, moving, cost, passes = dict(centres), set(centres), {}, 0
    for done in range(rounds + 1):
        passes += 1

        def sums(block, own={k: centres[k] for k in sorted(moving)}):
            g, _, x = block
            keys = [key for key in own if key[0] == g]
            return dict(zip(keys, moved(x, np.stack([own[key] for key in keys])), strict=True)) if keys else {}

        # a part's sums are small (starts x k x features): few parts meet at once, many in a tree
        few = blocks.getNumPartitions() <= PARTS_AT_ONCE
        total = blocks.map(sums).treeReduce(lambda a, b: merged(a, b, lambda p, q: tuple(x + y for x, y in zip(p, q, strict=True))), 1 if few else 2)
        for key, (t, n, c) in total.items():
            cost[key] = c
            if done == rounds:
                continue
            mean = np.where(n[:, None] > 0, t // np.maximum(n, 1)[:, None], centres[key]).astype(float)
            if (mean == centres[key]).all():
                moving.discard(key)
            centres[key] = mean
        if not moving:
            break
    return centres, cost, passes


def cluster_groups(
    vectors: DataFrame, by: str, k: int = 5, n_init: int = 20, seed: int = 42, max_iter: int = 300, cols: list[str] = VECTOR_COLS,
) -> tuple[DataFrame, dict]:
    """``cluster_clients`` of every group of ``vectors`` (column ``by``, whole numbers from 0) by itself, with
    the passes of one fit: the groups' starts move together.  ``(<by>, client_id, cluster_id)`` and ``{group: summary}``."""
    points = cut_lineage(vectors.select(by, *[c.alias(n) for n, c in fixed_columns(cols).items()]))
    packed = points.select("client_id", by, *cols).mapInArrow(_group_blocks, "block binary")
    blocks = packed.rdd.flatMap(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r[by]: r["count"] for r in points.groupBy(by).count().collect()}
    if not counts:
        raise ValueError("no client has a reading in the profile window")
    starts = max(1, n_init)
    ks = {g: max(1, min(k, n)) for g, n in counts.items()}
    seeds = {}
    for size in sorted(set(ks.values())):  # groups of fewer clients than k are seeded apart
        own = [g for g, n in ks.items() if n == size]
        seeds |= seed_centres(blocks, size, starts, seed, own)
    centres, cost, passes = lloyd(blocks, seeds, max_iter)
    blocks.unpersist()
    info, mapping = {}, None
    for g in sorted(counts):
        best = min(range(starts), key=lambda s: (cost[g, s], s))
        whole = [[int(x) for x in c] for c in centres[g, best]]
        info[g] = {
            "k": ks[g], "n_clients": counts[g], "cost": cost[g, best] / UNIT**2, "start": best, "passes": ks[g] + passes,
            "centres": [[x / UNIT for x in c] for c in whole], "whole_centres": whole,
        }
        part = assign_nearest(points.where(F.col(by) == g), whole, cols).select(by, "client_id", "cluster_id")
        mapping = part if mapping is None else mapping.union(part)
    return mapping, info


def cluster_clients(
    vectors: DataFrame, k: int = 5, n_init: int = 20, seed: int = 42, max_iter: int = 300, cols: list[str] = VECTOR_COLS,
) -> tuple[DataFrame, dict]:
    """M1 + M3: ``(client_id, cluster_id)`` from the cheapest of ``n_init`` starts
    (ties: the earlier start).  ``k`` is lowered to the number of clients when
    there are fewer.  Returns the map and a summary ``{"k", "n_clients",
    "cost", "start", "centres", "passes"}``, centres in the features' own units."""
    mapping, info = cluster_groups(vectors.withColumn("_group", F.lit(0)), "_group", k, n_init, seed, max_iter, cols)
    return mapping.drop("_group"), info[0]


def kmeans_fit(vectors: DataFrame, k: int, n_init: int, seed: int, rounds: int, cols: list[str] = VECTOR_COLS) -> DataFrame:
    """Every start's centres after so many rounds: ``start, cluster_id, cost`` and the features in whole millionths."""
    points = cut_lineage(fixed(vectors, cols)).withColumn("_group", F.lit(0))
    blocks = points.select("client_id", "_group", *cols).mapInArrow(_group_blocks, "block binary").rdd.flatMap(lambda r: pickle.loads(r["block"]))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    centres, cost, _ = lloyd(blocks, seed_centres(blocks, min(k, points.count()), n_init, seed, [0]), rounds)
    blocks.unpersist()
    rows = [(s, i, cost[0, s], *map(int, c)) for (_, s), own in centres.items() for i, c in enumerate(own)]
    return vectors.sparkSession.createDataFrame(rows, ", ".join(["start int, cluster_id int, cost long", *[f"{c} long" for c in cols]]))


def initial_centres(vectors: DataFrame, k: int, cols: list[str] = VECTOR_COLS) -> list[list[float]]:
    """The vectors of the ``k`` clients with the smallest ids (k rows to the
    driver, as any k-means keeps its centres there)."""
    rows = vectors.orderBy("client_id").limit(k).select(*cols).collect()
    return [[float(v) for v in r] for r in rows]


def squared_distance(centre: list[float], cols: list[str] = VECTOR_COLS):
    """Left fold of squared coordinate differences, in column order."""
    return reduce(add, [(F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(cols, centre)])


def assign_nearest(vectors: DataFrame, centres: list[list[float]], cols: list[str] = VECTOR_COLS) -> DataFrame:
    """Nearest centre per client (ties to the lowest index); ``cluster_id`` int."""
    dists = F.array(*[squared_distance(c, cols) for c in centres])
    return vectors.withColumn("_d", dists).withColumn(
        "cluster_id", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
    ).drop("_d")


def kmeans_step(vectors: DataFrame, k: int, cols: list[str] = VECTOR_COLS, digits: int = 9) -> DataFrame:
    """M2: assign to the k first clients' vectors, then move each centre to
    the mean of its members.  ``cluster_id, n_clients, <cols>`` with the new
    centres rounded to ``digits`` decimals (floating sums are order
    dependent).  The vectors are materialised once: the starting centres
    and the assignment both read them."""
    vectors = cut_lineage(vectors)
    centres = initial_centres(vectors, k, cols)
    assigned = assign_nearest(vectors, centres, cols)
    return assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_clients"),
        *[F.round(F.avg(c), digits).alias(c) for c in cols],
    )


def attach_cluster(
    readings: DataFrame,
    cluster_map: DataFrame,
    n_clients: int | None = None,
    max_bytes: int = MAP_BROADCAST_BYTES,
) -> DataFrame:
    """Readings of mapped clients with their ``cluster_id`` (inner join,
    as the reference: an unmapped client has no series).

    The map has one row per client.  It is broadcast when its size is
    proven small (client count times row size, or the planner's estimate);
    otherwise the join is left to a shuffle join that AQE may still convert
    at run time.  A broadcast map is built on the driver, so ``max_bytes``
    must stay under ``spark.driver.maxResultSize``; past it, shuffling the
    readings on ``client_id`` is the price (AQE splits a hot client).
    """
    small = n_clients is not None and n_clients * MAP_ROW_BYTES <= max_bytes
    side = F.broadcast(cluster_map) if small else broadcast_if_small(cluster_map)
    return readings.join(side, "client_id", "inner")
