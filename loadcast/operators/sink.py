"""The submission sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.sources.versions import Versions

SUBMISSION = "team_name string, datetime_15min timestamp_ntz, prediction double, submitted_at timestamp"
SUBMISSION_COLS = ["team_name", "datetime_15min", "prediction", "submitted_at"]


def stamp_submission(forecast: DataFrame, team_name: str, with_clock: bool = True) -> DataFrame:
    """``team_name, datetime_15min, prediction[, submitted_at]``."""
    out = forecast.select(F.lit(team_name).alias("team_name"), "datetime_15min", "prediction")
    if with_clock:
        out = out.withColumn("submitted_at", F.current_timestamp())
    return out


def row_check(expected: int | None) -> Callable[[DataFrame], None]:
    """Refuses staged rows that are not as many as expected."""

    def check(staged: DataFrame) -> None:
        n = staged.count()
        if expected is not None and n != expected:
            raise ValueError(f"{n} rows staged where {expected} are expected")

    return check


def _team(stamped: DataFrame) -> str:
    teams = [r[0] for r in stamped.select("team_name").distinct().limit(2).collect()]
    if len(teams) != 1 or teams[0] is None:
        raise ValueError(f"a submission is of one team, not of {teams}")
    return teams[0]


def submissions(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, "team_name", SUBMISSION)


def write_submission(stamped: DataFrame, path: str, team_name: str | None = None, expected: int | None = None) -> None:
    """Replaces this team's rows below ``path`` in two phases: staged, checked, then made
    readable by one commit mark (``submissions(spark, path).read()``).  A write that
    fails leaves the old submission; other teams' rows stay."""
    team = team_name or _team(stamped)
    submissions(stamped.sparkSession, path).replace(stamped.select(*SUBMISSION_COLS), [team], row_check(expected))


def save_submission(stamped: DataFrame, table: str, team_name: str | None = None, expected: int | None = None) -> None:
    """The same into a catalog table partitioned by team, made where there is none.
    The rows are staged in a folder of their own and checked there; pointing the
    team's partition at that folder is the commit.  No session setting is
    touched, and two first writers both find the table."""
    spark, team = stamped.sparkSession, team_name or _team(stamped)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({SUBMISSION}) USING parquet PARTITIONED BY (team_name)")
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    place = f"{about['Location'].rstrip('/')}-versions/{uuid.uuid4().hex}"
    stamped.drop("team_name").select(*[c for c in SUBMISSION_COLS if c != "team_name"]).write.parquet(place)
    row_check(expected)(spark.read.parquet(place))
    part = "PARTITION (team_name = '{}')".format(team.replace("\\", "\\\\").replace("'", "\\'"))
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {part} LOCATION '{place}'")
    spark.sql(f"ALTER TABLE {table} {part} SET LOCATION '{place}'")


def count_predictions(df: DataFrame) -> DataFrame:
    """Rows written, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("n_predictions"))
