"""Spark session construction and lineage cutting.

The library never builds its own session inside an operator; callers pass one
in.  ``build_session`` exists for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "loadcast",
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
) -> SparkSession:
    """Session with AQE, skew-join splitting and a UTC clock.

    On a cluster leave ``master`` unset; ``shuffle_partitions`` should then be
    sized so that one shuffle partition holds roughly 128-256 MB (AQE coalesces
    small ones at run time, and splits skewed join partitions).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or f"local[{cpus}]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": driver_memory,
        # checkpoints are written to the shared folder; drop them with their frames
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # time-series windows sort whole series; keep spill-friendly buffers
        "spark.sql.windowExec.buffer.spill.threshold": "65536",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int) -> dict[str, str]:
    """Settings sized for a cluster reading ``input_bytes`` of readings.

    Scans split at 256 MB.  The largest shuffle of the flagship is the
    (client, slot) resampling of three narrow columns when the source is not
    one row per client and slot; it is taken as a third of the input, cut
    into ~200 MB partitions, never fewer than three waves of tasks; AQE
    then coalesces small partitions and splits skewed ones.
    """
    cores = max(1, executors * cores_per_executor)
    shuffle_bytes = input_bytes // 3
    partitions = max(3 * cores, -(-shuffle_bytes // (200 * 1024 * 1024)))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(200 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # a broadcast map is built on the driver: keep room for the cluster map
        "spark.driver.maxResultSize": "2g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; only when nothing is set
    (unit tests on one machine) is a scratch folder created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # pragma: no cover - Spark Connect: the server's folder applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder every executor can read "
                "(a machine-local folder does not survive the loss of an executor)"
            )
        configured = tempfile.mkdtemp(prefix="loadcast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a frame that reads it back.

    Writing the checkpoint files reruns only the last stage (earlier stages
    are read back from their shuffle files); persisting first was measured
    slower for the frames that the model fits read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
