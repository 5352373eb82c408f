from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from loadcast.session import ensure_checkpoint_dir

    s = (
        SparkSession.builder.master("local[*]")
        .appName("loadcast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def slots(start: str, n: int, step_minutes: int = 15) -> list[dt.datetime]:
    t0 = dt.datetime.fromisoformat(start)
    return [t0 + dt.timedelta(minutes=step_minutes * i) for i in range(n)]


def readings_frame(spark, rows):
    """rows: (client_id, datetime_utc, kw) -> raw readings frame."""
    from pyspark.sql import functions as F

    from loadcast.functions.clock import to_local
    from loadcast.functions.exprs import to_milli

    df = spark.createDataFrame(rows, "client_id long, datetime_utc timestamp_ntz, kw double")
    return df.select(
        "client_id",
        "datetime_utc",
        to_local("datetime_utc").alias("datetime_local"),
        to_milli("kw").alias("kw_milli"),
    ).withColumn("active_kw", F.col("kw_milli") / 1000.0)
