"""k-means by Lloyd's rounds, sharded by dimension, in whole numbers.

The columns of the vectors are cut into blocks, and so are the centroids.  A
task holds rows of one column block and the centroids' slice of that block,
never a whole centroid; it gives exact partial squared distances.  Keyed by
chunk of rows, the blocks' partial distances are added up and the nearest
centroid is taken; each block's sums by cluster go back to that block's slice,
which is updated by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.llm.common import grouped, stored, table
from loadcast.llm.topk import finite
from loadcast.session import cut_lineage

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
WIDTH = 32           # columns of a block
CHUNK = 256          # rows of a chunk
LARGEST = 1 << 27    # of a scaled component: 64 squared differences then fit a long


def packed(a: np.ndarray) -> bytes:
    """Whole numbers in the least of 2, 4 or 8 bytes that holds them all, byte
    by byte of their places: the high bytes are alike and compress well."""
    top = int(np.abs(a).max(initial=0))
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([size]) + a.astype(f"<i{size}").reshape(-1).view(np.uint8).reshape(-1, size).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    size = b[0]
    planes = np.frombuffer(b, np.uint8, offset=1).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<i{size}").astype(np.int64)


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x * scale))


def _blocks(width: int, scale: int):
    """Rows (id, v) to records (chunk, block, n, ids, x): one column block of a chunk of rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            v, ids = batch.column("v"), batch.column("id").to_pylist()
            if not len(ids):
                continue
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) * scale).astype(np.int64)
            out: list[tuple] = []
            for s in range(0, len(ids), CHUNK):
                for b, c in enumerate(range(0, x.shape[1], width)):
                    own = x[s : s + CHUNK, c : c + width]
                    out.append((chunk, b, len(own), ids[s : s + CHUNK] if b == 0 else None, packed(own)))
                chunk += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(a), t) for a, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()], strict=True)],
                ["chunk", "block", "n", "ids", "x"],
            )

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``p``: squared distances of a block's rows to every centroid's slice of it."""
    for batch in batches:
        out = []
        for n, x, c in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist(), batch.column("c"), strict=True):
            x, c = unpacked(x).reshape(n, -1), c.values.to_numpy()
            c = c.reshape(-1, x.shape[1])
            if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22 and x.shape[1] <= 128:
                x, c = x.astype(float), c.astype(float)  # sums stay under 2**53: exact, and faster
            out.append(packed(((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)))
        kept = [i for i, f in enumerate(batch.schema) if f.name != "c"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(out, pa.binary())], [*[batch.schema.field(i).name for i in kept], "p"])


def _nearest(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Per chunk: cluster and squared distance of its rows, and the places of its records."""
    chunk, n = t.column("chunk").to_numpy(), t.column("n").to_numpy()
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    p = t.column("p").to_pylist()
    for s, e in zip(starts, np.append(starts[1:], len(chunk)), strict=True):
        total = sum(unpacked(b) for b in p[s:e]).reshape(int(n[s]), -1)
        label = total.argmin(1)  # the first of equal ones: the smaller number
        yield label, total[np.arange(len(label)), label], int(s), int(e)


def _sums(width: int):
    """Sums and counts by (cluster, dim) over all chunks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        count = np.zeros(0, np.int64)
        for t, _ in grouped(batches, ["chunk"]):
            block, n, x, k = t.column("block").to_numpy(), t.column("n").to_numpy(), t.column("x").to_pylist(), t.column("k").to_numpy()
            for label, _, s, e in _nearest(t):
                own = np.zeros((int(k[s]), len(label)))
                own[label, np.arange(len(label))] = 1
                if not len(count):
                    count = np.zeros(len(own), np.int64)
                count += own.sum(1).astype(np.int64)
                for i in range(s, e):
                    add = (own @ unpacked(x[i]).reshape(int(n[i]), -1).astype(float)).astype(np.int64)
                    sums[int(block[i])] = sums.get(int(block[i]), 0) + add
        used = np.flatnonzero(count)
        for b, total in sums.items():
            w = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, w).astype(np.int32)), pa.array(np.tile(np.arange(w) + b * width, len(used)).astype(np.int32)),
                 pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], w))],
                ["cluster", "dim", "total", "n"],
            )

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, _ in grouped(batches, ["chunk"]):
        ids = t.column("ids").to_pylist()
        for label, distance, s, _ in _nearest(t):
            yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64()), pa.array(label.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])


def starts(kept: DataFrame, clusters: int, seed: int, scale: int) -> DataFrame:
    """(cluster, dim, value) of the vectors whose ids have the smallest hashes: ``clusters`` rows at most reach one task."""
    hashed = kept.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "id", scaled("v", scale).alias("v"))
    first = hashed.orderBy("h", "id", "v").limit(clusters).agg(F.sort_array(F.collect_list(F.struct("h", "id", "v"))).alias("c"))
    numbered = first.select(F.posexplode("c").alias("cluster", "c"))
    return numbered.select(F.col("cluster").cast("int").alias("cluster"), F.posexplode("c.v").alias("dim", "value"))


def lloyd(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS,
          rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Labels (vec_id, cluster, distance) of every vector that takes part, and
    the final centroids (cluster, dim, value), all in whole numbers of 1/scale.

    Vectors that are null, of another width, or hold null or non-finite
    components take no part, nor do those with a component of more than
    ``LARGEST`` when scaled, as their squared distance has no long.  Repeated rows and equal ids are vectors of their own; a
    null id is no start but gets its label.  Ties go to the smaller number.
    With fewer vectors than ``clusters`` there are as many clusters as
    vectors; an empty table gives empty frames.  Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) * scale <= LARGEST)
    kept = rows.where((F.size("v") == dimensions) & finite("v") & fits)
    cents = cut_lineage(starts(kept, clusters, seed, scale))
    blocks = stored(kept.mapInArrow(_blocks(width, scale), "chunk long, block int, n int, ids array<long>, x binary"), "block")

    def assigned(by: DataFrame, step, schema: str, *more: str) -> DataFrame:
        slices = by.groupBy(F.floor(F.col("dim") / width).cast("int").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("cluster", "dim", "value"))).alias("c"), F.count_distinct("cluster").cast("int").alias("k"),
        ).withColumn("c", F.col("c.value"))
        # clusters x dimensions numbers: parameters of the call, whatever the table's size
        parts = blocks.select("chunk", "block", "n", "x", *more).join(F.broadcast(slices), "block").select("chunk", "block", "n", "x", *more, "k", "c")
        out = parts.mapInArrow(_partial, ", ".join(["chunk long, block int, n int, x binary", *[f"{m} array<long>" for m in more], "k int, p binary"]))
        return out.repartition("chunk").sortWithinPartitions("chunk", "block").mapInArrow(step, schema)

    for _ in range(rounds):
        sums = assigned(cents, _sums(width), "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("t"), F.sum("n").alias("m"))
        mean = F.expr("(t - pmod(t, m)) div m")  # floor, also of a negative sum
        cents = cut_lineage(cents.join(sums, ["cluster", "dim"], "left").select("cluster", "dim", F.when(F.col("m").isNotNull(), mean).otherwise(F.col("value")).alias("value")))
    return assigned(cents, _labels, "id long, cluster int, distance long", "ids").withColumnRenamed("id", vec_id), cents


def op11_centroid_clustering(spark: SparkSession, root: str) -> DataFrame:
    labels, cents = lloyd(table(spark, root, "embeddings", "vec_id", "embedding"))
    labels = cut_lineage(labels)
    digests = cents.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("c")).select(
        "cluster", F.sha2(F.array_join(F.col("c.value").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"),
    )
    sums = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # a row per cluster
    whole = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))
    facts = F.broadcast(digests.join(sums, "cluster").withColumn("inertia", whole))
    return labels.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql() -> str:
    """The rounds written out; inner products of whole numbers under 2**53 are exact in doubles."""
    kept = f"""
    kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, v FROM (
            SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS cluster, v AS c
        FROM (SELECT sha256('{SEED}:' || vec_id) AS h, vec_id, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, vec_id, v LIMIT {CLUSTERS})
    )"""
    steps = [kept]
    for i in range(ROUNDS + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
        SELECT r, min([list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), cluster]) AS best
        FROM kept, c{i} GROUP BY r
    )""")
        if i < ROUNDS:
            steps.append(f"""
    s{i} AS (
        SELECT cluster, list(m ORDER BY d) AS c FROM (
            SELECT best[2] AS cluster, d, floor(sum(v[d]) / count(*)) AS m
            FROM kept JOIN a{i} USING (r), range(1, {DIMENSIONS + 1}) AS t(d) GROUP BY 1, 2) GROUP BY cluster
    ), c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (cluster))""")
    return f"""
    WITH {",".join(steps)}
    SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance,
        (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM kept JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.cluster = best[2]
    """
