"""Sharding by balanced label propagation: linked documents move to the shard
that holds most of their neighbours, as far as its quota goes; then all
shards are evened out in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadcast.llm.common import running_total, spread, table
from loadcast.session import cut_lineage

SHARDS = 40
ROUNDS = 4
ROW_BYTES = 16  # of a document besides its text


def _by_shard(labels: DataFrame, value: str, shards: int) -> list[int]:
    """The sum of a column for each shard: as many numbers as there are shards."""
    got = {r[0]: r[1] for r in labels.groupBy("shard").agg(F.sum(value)).collect()}
    return [int(got.get(s) or 0) for s in range(shards)]


def _of_shard(values: list, shard: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(shard) + 1)


def propagate(linked: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation over (row, link, u, size, shard): in each, a
    link's members are tallied by shard (joined back on the link), and those
    elsewhere ask for the shard with most of their bytes that has room; a
    shard admits askers in the order of ``u`` up to its room.

    A link's tally has a row for each shard at most.  Ties go by hash, so no
    shard is preferred as such.
    """
    for _ in range(rounds):
        held = _by_shard(linked, "size", shards)
        room = [max(0, int(capacity - h)) for h in held]
        tally = linked.groupBy("link", "shard").agg(F.sum("size").alias("bytes"))
        best = Window.partitionBy("link").orderBy(F.desc("fits"), F.desc("bytes"), spread("link", "shard", seed=41), "shard")
        wish = (
            tally.withColumn("fits", (_of_shard(room, "shard") > 0).cast("int"))
            .withColumn("r", F.row_number().over(best)).where("r = 1 and fits = 1")
            .select(F.col("link").alias("l"), F.col("shard").alias("wish"))
        )
        asking = linked.join(wish, F.col("link") == F.col("l"), "left").drop("l")
        asking = cut_lineage(asking.withColumn("wish", F.when(F.col("wish") != F.col("shard"), F.col("wish"))))
        movers = asking.where("wish is not null")
        n = movers.count()
        if not n:
            break
        placed = running_total(movers, ["wish"], "u", ["link", "row"], F.col("size"), "before", rows=n)
        admitted = F.col("before") + F.col("size") <= _of_shard(room, "wish")
        moved = placed.withColumn("shard", F.when(admitted, F.col("wish")).otherwise(F.col("shard")))
        linked = cut_lineage(
            asking.where("wish is null").select(linked.columns).union(moved.select(linked.columns))
        )
    return linked


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: (row, id, size, text_crc32, link, shard, slot).

    Documents of equal text are linked.  Every document starts in a shard by
    its place in hashed order; linked ones propagate; last, each shard keeps
    documents up to an even share of all bytes, whole links first, and what
    is over fills the shards that are short.  Shards differ from the even
    share by about one document.  A null text counts as empty (and as equal
    to it); repeated ids and rows are separate, linked documents.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.unhex(F.md5(body.cast("binary"))).alias("link"),
    )).withColumn("row", F.monotonically_increasing_id())
    facts = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, n = int(facts[0] or 0), facts[1]
    capacity = total / shards
    started = running_total(rows.withColumn("u", spread("row", "link", seed=43)), [], "u", ["row"], F.col("size"), "before", rows=n)
    last = F.lit(shards - 1)
    share = F.least(F.floor((F.col("before") + F.col("size") / 2.0) * shards / max(total, 1)), last).cast("int")
    copies = F.count(F.lit(1)).alias("copies")
    twins = rows.groupBy(F.col("link").alias("l")).agg(copies).where("copies > 1")
    # Whole links stand together in the order, but a link that holds much of
    # all rows is spread over as much of it; single documents come after all
    # links, roughly from long to short, so the even-out moves short ones.
    weight = F.col("copies") / float(max(n, 1))
    of_link = spread("link", seed=44) * (1 - weight) + spread("row", seed=45) * weight
    of_size = 0.9 / (1 + F.col("size") / 1024.0) + 0.1 * spread("row", seed=46)
    labels = cut_lineage(
        started.drop("u").withColumn("shard", share).join(twins, F.col("link") == F.col("l"), "left")
        .withColumn("linked", F.col("l").isNotNull())
        .withColumn("u", F.when(F.col("linked"), of_link / 2).otherwise(0.5 + of_size / 2))
        .drop("l", "copies", "before")
    )
    moved = propagate(labels.where("linked").select("row", "link", F.col("u") * 2, "size", "shard").toDF("row", "link", "u", "size", "shard"),
                      shards, capacity, rounds)
    labels = cut_lineage(
        labels.join(moved.select(F.col("row").alias("r"), F.col("shard").alias("to")), F.col("row") == F.col("r"), "left")
        .withColumn("shard", F.coalesce("to", "shard")).drop("r", "to")
    )
    kept = cut_lineage(
        running_total(labels, ["shard"], "u", ["link", "row"], F.col("size"), "before", rows=n)
        .withColumn("over", F.col("before") + F.col("size") / 2.0 > capacity).drop("before")
    )
    held = _by_shard(kept.where("not over"), "size", shards)
    over = kept.where("over")
    edges, at = [], 0.0
    for h in held:
        at += max(0.0, capacity - h)
        edges.append(at)
    filling = running_total(over, [], "u", ["link", "row"], F.col("size"), "before")
    spilled = F.lit(0)
    for e in edges[:-1]:
        spilled = spilled + (F.col("before") + F.col("size") / 2.0 >= e).cast("int")
    columns = ["row", "id", "size", "text_crc32", "link", "shard", "u"]
    even = cut_lineage(kept.where("not over").select(columns).union(filling.withColumn("shard", spilled).select(columns)))
    return running_total(even, ["shard"], "u", ["link", "row"], F.lit(1), "slot", rows=n).drop("u")


def op7_balanced_shards(spark: SparkSession, root: str) -> DataFrame:
    return shard_documents(table(spark, root, "documents", "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
