"""Boosted regression trees for many series at once.

Every series has a model of its own; all of them grow together.  Rows are cut
into bins once (edges from one quantile sketch per series and feature) and lie in
blocks of at most some 50,000 rows of a series.  A level is a
histogram of gradient sums by (series, node, feature, bin), from which the best
split of every node is taken.  Where series lie in several blocks, a level is
one aggregation for all series; where every series lies in one block, its
histograms are whole already and a round is one job.  The number of jobs
depends on rounds and depth, never on how many series there are.

* Squared error, leaf weights shrunk by ``l2``, as the usual regularised booster.
* A missing value (null or NaN) has a bin of its own; each split is scored
  with the missing rows on either side and keeps the better one.
* Gradients are whole millionths of a kW: sums do not depend on the order of
  tasks, so a fit is the same on any number of partitions.
* The mean absolute error after each round is kept, also of rows that are held
  out, and can choose the rounds.

State between levels is one block of binned rows per (series, slice) with
its current forecast, which grows with the rows and stays on the executors;
this is per-partition state over many short steps, hence an RDD of blocks.
Only trees and errors reach the driver.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadcast.session import ensure_checkpoint_dir

UNIT = 1_000_000          # gradients are counted in millionths of a kW
ROWS_PER_BLOCK = 50_000   # rows of a series that one block holds, about
BLOCKS_PER_TASK = 64      # at most, about: small series share tasks
CHECKPOINT_ROUNDS = 25    # after so many rounds the blocks' lineage is cut


@dataclass(frozen=True)
class BoostParams:
    """Defaults follow the reference's booster: squared error, 100 rounds,
    learning rate 0.3, depth 6, 256 bins, leaf weights shrunk by 1, at least
    one row a leaf.  With ``choose_rounds`` and held-out rows a series keeps
    the rounds up to its least held-out error."""

    rounds: int = 100
    depth: int = 6
    step: float = 0.3
    max_bins: int = 256
    min_instances: int = 1
    l2: float = 1.0
    min_gain: float = 0.0
    choose_rounds: bool = False


class Tree(NamedTuple):
    """A tree as a heap of nodes (node 1 the root, 2n and 2n+1 its children).
    ``feature`` is -1 at a leaf; a row goes left up to bin ``cut`` (value
    ``threshold``), a missing value where ``missing_left`` says."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    weight: np.ndarray
    gain: np.ndarray
    rows: np.ndarray


def new_tree(depth: int) -> Tree:
    n = 1 << (depth + 1)
    return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n, int))


@dataclass
class SeriesModel:
    base: float
    trees: list[Tree] = field(default_factory=list)
    n_rows: int = 0
    errors: list[tuple[float, float | None]] = field(default_factory=list)  # per round: training MAE, held-out MAE

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.weight[leaves(x, np.isnan(x), tree, tree.threshold)]
        return out


MISSING = 1 << 15  # the bin of a missing value


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint16)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f], side="left"))
    return out


def leaves(x: np.ndarray, missing: np.ndarray, tree: Tree, cut: np.ndarray) -> np.ndarray:
    """The node at which each row of ``x`` (bins or values, as ``cut`` is) ends."""
    node, rows = np.ones(len(x), np.int64), np.arange(len(x))
    while True:
        f = tree.feature[node]
        if not (f >= 0).any():
            return node
        left = np.where(missing[rows, f], tree.missing_left[node], x[rows, f] <= cut[node])
        node = np.where(f >= 0, 2 * node + ~left, node)


def bin_leaves(bins: np.ndarray, tree: Tree) -> np.ndarray:
    return leaves(bins, bins == MISSING, tree, tree.cut)


def exact_sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place; in two halves where doubles would round."""
    if np.abs(values).max(initial=0) * max(1, len(values)) < 1 << 53:
        return np.bincount(at, values, size).astype(np.int64)
    low, high = values & ((1 << 20) - 1), values >> 20
    return np.bincount(at, low, size).astype(np.int64) + (np.bincount(at, high, size).astype(np.int64) << 20)


def gradients(y: np.ndarray, forecast: np.ndarray) -> np.ndarray:
    return np.floor((y - forecast) * UNIT + 0.5).astype(np.int64)


def best_split(sums: np.ndarray, counts: np.ndarray, p: BoostParams) -> tuple:
    """The best split of a node from its histograms (features x bins, the last
    bin for missing): (gain, feature, bin, missing left, left sum, left
    count, sum, count); feature -1 where no split is allowed.  Ties: the first feature, then
    the lowest bin, then missing to the right."""
    total, n = int(sums[0].sum()), int(counts[0].sum())
    g, h = np.cumsum(sums[:, :-1], 1), np.cumsum(counts[:, :-1], 1)
    left_g = np.stack([g, g + sums[:, -1:]], 2)      # (feature, bin, side of the missing rows)
    left_h = np.stack([h, h + counts[:, -1:]], 2)
    score = lambda a, b: (a / UNIT) * (a / UNIT) / (b + p.l2)
    gain = score(left_g, left_h) + score(total - left_g, n - left_h) - score(total, n)
    least = max(1, p.min_instances)
    gain = np.where((left_h >= least) & (n - left_h >= least), gain, -np.inf)
    k = int(gain.argmax())
    f, b, side = np.unravel_index(k, gain.shape)
    if not gain[f, b, side] > p.min_gain:
        return (0.0, -1, 0, False, 0, 0, total, n)
    return (float(gain[f, b, side]), int(f), int(b), bool(side), int(left_g[f, b, side]), int(left_h[f, b, side]), total, n)


# ---------------------------------------------------------------- blocks

def bin_edges(rows: DataFrame, key: str, features: list[str], bins: int) -> DataFrame:
    """(key, _n, _sum, _e0...): rows, sum of the label's units, and per feature
    the distinct quantiles of a series, one sketch each in one aggregation.
    Missing values have no edge."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_label_unit").alias("_sum"),
        *[F.array_sort(F.array_distinct(F.percentile_approx(c, probs, SKETCH))).alias(f"_e{i}") for i, c in enumerate(features)],
    )


SKETCH = 100_000  # accuracy of the sketch: exact for series of up to so many rows


def _pack(features: list[str], edges, first: dict, key: str):
    """The rows of one (series, slice) as one block."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        value = plain(part[key].iloc[0])
        if value not in first:  # only held out: no model
            return pd.DataFrame({"slot": pd.Series(dtype="int32"), "block": pd.Series(dtype="object")})
        part = part.sort_values("_order", kind="stable")
        y = part["_label"].to_numpy(float)
        base, own = edges.value[value]
        block = {
            "key": value, "bins": binned(part[features].to_numpy(float), own), "y": y,
            "held": part["_held"].to_numpy(bool), "forecast": np.full(len(y), base),
        }
        return pd.DataFrame({"slot": [first[value] + int(part["_slice"].iloc[0])], "block": [pickle.dumps(block)]})

    return run


def plain(value):
    """A key as the driver has it: Python's own type, None for null."""
    return None if pd.isna(value) else value.item() if hasattr(value, "item") else value


def histograms(block: dict, nodes: list[int], tree: Tree, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient sums and row counts by (feature, bin) of the nodes a level looks at."""
    bins = block["bins"]
    node, n_features = bin_leaves(bins, tree), bins.shape[1]
    place = np.full(len(tree.feature), -1)
    place[nodes] = np.arange(len(nodes))
    rows = np.flatnonzero((place[node] >= 0) & ~block["held"])
    own = np.minimum(bins[rows], width - 1).astype(np.int64)  # the last bin is that of missing values
    at = ((place[node[rows]][:, None] * n_features + np.arange(n_features)) * width + own).reshape(-1)
    shape = (len(nodes), n_features, width)
    g = gradients(block["y"][rows], block["forecast"][rows])
    sums = exact_sums(at, np.repeat(g, n_features), int(np.prod(shape))).reshape(shape)
    counts = np.bincount(at, minlength=int(np.prod(shape))).reshape(shape)
    return {k: (sums[i], counts[i]) for i, k in enumerate(nodes)}


def grown(block: dict, tree: Tree) -> dict:
    """The block with a round's tree added to its forecast."""
    return {**block, "tree": tree, "forecast": block["forecast"] + tree.weight[bin_leaves(block["bins"], tree)]}


def errors(block: dict) -> tuple:
    """Absolute errors in units and rows: of training rows, and of those held out."""
    e, held = np.abs(gradients(block["y"], block["forecast"])), block["held"]
    return int(e[~held].sum()), int((~held).sum()), int(e[held].sum()), int(held.sum())


def fit_boosted(
    train: DataFrame, key: str, features: list[str], params: BoostParams = BoostParams(),
    label: str = "sum_active_kw", order: str = "datetime_utc", held_out: str | None = None,
) -> dict:
    """``{series: SeriesModel}`` of every series that has a row to learn from.

    Rows without a label, or with no feature at all, teach nothing and are
    left out; other missing values are learned from.  ``held_out`` names a
    boolean column of rows that are only scored."""
    spark = train.sparkSession
    sc = spark.sparkContext
    held = F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    y = number(label)
    rows = train.where(y.isNotNull() & F.coalesce(*[number(c) for c in features]).isNotNull()).select(
        key, F.col(order).alias("_order"), y.alias("_label"), F.floor(y * UNIT + 0.5).alias("_label_unit"), held.alias("_held"),
        *[number(c).alias(c) for c in features],
    )
    # a row of edges per series: they are part of the model, as its trees are
    sketch = bin_edges(rows.where(~F.col("_held")), key, features, params.max_bins).collect()
    if not sketch:
        return {}
    models = {r[key]: SeriesModel(r["_sum"] / r["_n"] / UNIT, n_rows=r["_n"]) for r in sketch}
    edges = {r[key]: (models[r[key]].base, [np.array(r[f"_e{i}"] or [], float) for i in range(len(features))]) for r in sketch}
    width = max(len(e) for _, own in edges.values() for e in own) + 2
    slices = {k: max(1, -(-m.n_rows // ROWS_PER_BLOCK)) for k, m in models.items()}
    first, slots = {}, 0
    for k in slices:
        first[k], slots = slots, slots + slices[k]
    sliced, part = slots > len(models), F.lit(0)
    if sliced:  # a row per series
        deal = spark.createDataFrame(list(slices.items()), StructType([rows.schema[key]]).add("_n", "integer")).withColumnRenamed(key, "_k")
        rows = rows.join(F.broadcast(deal), F.col(key).eqNullSafe(F.col("_k")), "left")
        part = F.pmod(F.xxhash64("_order"), F.coalesce("_n", F.lit(1))).cast("int")
    shared = sc.broadcast(edges)
    packed = rows.withColumn("_slice", part).groupBy(key, "_slice").applyInPandas(_pack(features, shared, first, key), "slot int, block binary")
    tasks = min(slots, max(sc.defaultParallelism, -(-slots // BLOCKS_PER_TASK)))
    blocks = packed.rdd.map(lambda r: (r["slot"], pickle.loads(r["block"]))).partitionBy(tasks, lambda s: s).values()
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(spark)
    before = None
    for done in range(params.rounds):
        if sliced:
            trees = _grow(blocks, models, edges, params, width)
            after = blocks.map(lambda b, trees=trees: grown(b, trees[b["key"]]))
        else:
            after = blocks.map(lambda b: grown(b, grow_block(b, shared.value[b["key"]][1], params, width)))
        after = after.persist(StorageLevel.MEMORY_AND_DISK)
        if (done + 1) % CHECKPOINT_ROUNDS == 0:
            after.checkpoint()
        found = after.map(lambda b: (b["key"], b["tree"], errors(b))).collect()
        for k, tree in {k: tree for k, tree, _ in found}.items():
            models[k].trees.append(tree)
        _note(models, [(k, e) for k, _, e in found])
        if before is not None:
            before.unpersist()  # its successor is stored
        before, blocks = blocks, after
    for old in (before, blocks):
        if old is not None:
            old.unpersist()
    return {k: _chosen(m) if params.choose_rounds else m for k, m in models.items()}


def grow_block(block: dict, edges: list[np.ndarray], p: BoostParams, width: int) -> Tree:
    """A round's tree of a series whose rows are all in this block: its sums need no meeting."""
    tree, todo = new_tree(p.depth), [1]
    for level in range(p.depth):
        found = [(node, best_split(*h, p)) for node, h in histograms(block, todo, tree, width).items()] if todo else []
        todo = [child for node, s in found for child in record(tree, node, s, edges, p, level)]
    return tree


def _grow(blocks, models: dict, edges: dict, p: BoostParams, width: int) -> dict:
    """A round's trees where series lie in several blocks: one aggregation a level for all series."""
    trees = {k: new_tree(p.depth) for k in models}
    todo = {k: [1] for k in models}
    for level in range(p.depth):

        def parts(b, todo=todo):
            for node, h in histograms(b, todo[b["key"]], trees[b["key"]], width).items() if b["key"] in todo else ():
                yield (b["key"], node), h

        # histograms of a node meet, summed on the way; only its split comes here
        summed = blocks.flatMap(parts).reduceByKey(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
        todo = {}
        for (k, node), s in summed.mapValues(lambda h: best_split(*h, p)).collect():
            if children := record(trees[k], node, s, edges[k][1], p, level):
                todo.setdefault(k, []).extend(children)
        if not todo:
            break
    return trees


def record(t: Tree, node: int, found: tuple, edges: list[np.ndarray], p: BoostParams, level: int) -> list[int]:
    """Writes a node's split into the tree; returns the children that may be split in turn."""
    gain, f, cut, left, left_g, left_n, g, n = found
    t.weight[node], t.rows[node] = _weight(g, n, p), n
    if f < 0:
        return []
    t.feature[node], t.cut[node], t.threshold[node], t.missing_left[node], t.gain[node] = f, cut, edges[f][cut], left, gain
    children = ((2 * node, left_g, left_n), (2 * node + 1, g - left_g, n - left_n))
    for child, cg, cn in children:
        t.weight[child], t.rows[child] = _weight(cg, cn, p), cn
    return [c for c, _, cn in children if level + 1 < p.depth and cn >= 2 * max(1, p.min_instances)]


def _weight(g: int, n: int, p: BoostParams) -> float:
    return p.step * ((g / UNIT) / (n + p.l2))


def _note(models: dict, found: list) -> None:
    """Errors of a round, those of a series in several blocks added up."""
    sums: dict = {}
    for k, e in found:
        sums[k] = tuple(a + b for a, b in zip(sums[k], e, strict=True)) if k in sums else e
    for k, (e, n, eh, nh) in sums.items():
        models[k].errors.append((e / max(1, n) / UNIT, eh / nh / UNIT if nh else None))


def _chosen(m: SeriesModel) -> SeriesModel:
    """The model up to its round of least held-out error (all rounds where nothing was held out)."""
    held = [e for _, e in m.errors]
    if not held or held[0] is None:
        return m
    keep = int(np.argmin(held)) + 1
    return replace(m, trees=m.trees[:keep], errors=m.errors[:keep])


# ---------------------------------------------------------------- use

def predict_boosted(models: dict, rows: DataFrame, key: str, features: list[str], carry: list[str] | None = None) -> DataFrame:
    """``key, datetime_utc, datetime_local, <carry>, prediction`` for the rows of every
    series with a model; missing values go the way their splits learned."""
    cols = [key, "datetime_utc", "datetime_local", *(carry or [])]
    shared = rows.sparkSession.sparkContext.broadcast(models)  # trees and edges: bounded by series, rounds and depth
    inner = rows.select(*cols, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    xs = [f"_x{i}" for i in range(len(features))]

    def run(batches):
        for part in batches:
            out = np.full(len(part), np.nan)
            for value, at in part.groupby(key, dropna=False).indices.items():
                m = shared.value.get(plain(value))
                if m is not None:
                    out[at] = m.predict(part[xs].to_numpy(float)[at])
            part = part[cols].assign(prediction=out)
            yield part[~np.isnan(out)]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*cols).schema.fields)
    return inner.mapInPandas(run, f"{schema}, prediction double")


def model_nodes(models: dict, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Every node of every tree: (key, round, node, feature, threshold, missing_left, gain, n_rows,
    weight); the first four after ``node`` are null at a leaf.  ``rows`` gives the key's type."""
    out = []
    for k, m in models.items():
        for r, t in enumerate(m.trees):
            for node in np.flatnonzero(t.rows):
                f = int(t.feature[node])
                split = (features[f], float(t.threshold[node]), bool(t.missing_left[node]), float(t.gain[node])) if f >= 0 else (None,) * 4
                out.append((k, r, int(node), *split, int(t.rows[node]), float(t.weight[node])))
    schema = StructType([rows.schema[key]])
    for name, kind in (("round", "integer"), ("node", "integer"), ("feature", "string"), ("threshold", "double"), ("missing_left", "boolean"),
                       ("gain", "double"), ("n_rows", "long"), ("weight", "double")):
        schema = schema.add(name, kind)
    return rows.sparkSession.createDataFrame(out, schema)
