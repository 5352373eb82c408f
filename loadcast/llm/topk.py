"""Exact top-k search by MaxScore over integer vectors.

A component of a vector is a term, its value the weight.  In each shard the
terms of a query are ordered by the most that any vector there can gain from
them.  The terms whose bounds together could still lift a vector into the
top k are essential: their postings are traversed for the whole shard.  The
rest are probed only for vectors that are still competitive.  Each shard
gives its k best; the shards' lists are merged.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.llm.common import table
from loadcast.session import cut_lineage

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 16_384   # vectors of a shard, about
QUERY_ROWS = 2_048    # queries of a block, about
PROBE = 8             # non-essential terms probed at a time
SEED_ROWS = 512       # vectors scored in full to get a first threshold


def finite(vector: str) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, ok), F.lit(False))


def quantised(rows: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component, as whole doubles; shorter vectors count as filled up with zeros."""
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = np.floor(scale * np.asarray(r, float))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id, then row."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]


def maxscore(query: np.ndarray, own: int, postings: np.ndarray, high: np.ndarray, low: np.ndarray,
             ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best vectors of a shard for one query.
    ``postings``: a row of weights for each term; ``high`` and ``low`` their
    largest and smallest; ``own``: the query's row, which is no candidate."""
    n = postings.shape[1]
    bound = np.where(query > 0, query * high, query * low)
    order = np.argsort(-bound, kind="stable")
    after = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # most that the terms from here on can add
    seed = np.flatnonzero(rows[:SEED_ROWS] != own)
    first = query @ postings[:, :SEED_ROWS]
    threshold = -np.inf
    if len(seed) >= k:
        threshold = np.partition(first[seed], len(seed) - k)[len(seed) - k]
    # the fewest leading terms so that the others alone cannot reach the threshold
    short = np.flatnonzero(after < threshold)
    essential = int(short[0]) if len(short) else len(order)
    score = query[order[:essential]] @ postings[order[:essential]]
    alive = np.flatnonzero((score + after[essential] >= threshold) & (rows != own))
    score, at = score[alive], essential
    while at < len(order) and len(alive):
        terms = order[at : at + PROBE]
        score = score + query[terms] @ postings[np.ix_(terms, alive)]
        at += len(terms)
        keep = score + after[min(at, len(order))] >= threshold
        alive, score = alive[keep], score[keep]
    best = _best(score, ids[alive], rows[alive], min(k, len(alive))) if len(alive) else np.zeros(0, int)
    return alive[best], score[best]


def top_k(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every row where ``queries``
    holds, the k other rows of highest integer inner product, ties to the
    smaller id.  Rows without an id or with a vector that is not finite take
    no part; repeated rows are rows of their own.  An empty frame gives none.

    Every shard of vectors meets every block of queries in one task, and a
    task holds one shard and one block whatever the size of the table.
    """
    rows = cut_lineage(
        vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
        .where(F.col("id").isNotNull() & finite("v"))
    ).withColumn("row", F.monotonically_increasing_id())
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    shards, blocks = max(1, -(-counts["n"] // shard_rows)), max(1, -(-counts["q"] // query_rows))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["id", "row", "v", "shard", "block", "asks"]
    sharded = rows.withColumn("shard", deal(51, shards)).withColumn("block", every(blocks)).withColumn("asks", F.lit(False))
    asked = rows.where("q").withColumn("block", deal(52, blocks)).withColumn("shard", every(shards)).withColumn("asks", F.lit(True))

    def search(both: pd.DataFrame) -> pd.DataFrame:
        found = []
        left, right = both[~both["asks"]], both[both["asks"]]
        if len(left) and len(right):
            docs, asks = quantised(list(left["v"])), quantised(list(right["v"]))
            width = max(docs.shape[1], asks.shape[1])
            docs, asks = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (docs, asks))
            ids, own = left["id"].to_numpy(), left["row"].to_numpy()
            postings = np.ascontiguousarray(docs.T)
            high, low = postings.max(1), postings.min(1)
            for q, i, r in zip(asks, right["id"], right["row"], strict=True):
                at, score = maxscore(q, r, postings, high, low, ids, own, k)
                found.append(pd.DataFrame({"query_id": i, "query_row": r, "vec_id": ids[at], "vec_row": own[at], "score": score.astype(np.int64)}))
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_row", "vec_id", "vec_row", "score")})
        return pd.concat(found) if found else empty

    lists = (
        sharded.select(columns).union(asked.select(columns)).groupBy("block", "shard")
        .applyInPandas(search, "query_id long, query_row long, vec_id long, vec_row long, score long")
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, root: str) -> DataFrame:
    return top_k(table(spark, root, "embeddings", "vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


def op4_sql(k: int = K, every: int = EVERY, scale: int = SCALE) -> str:
    return f"""
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {k}"""
