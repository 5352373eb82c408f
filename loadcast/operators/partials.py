"""Day partials: sums and counts that are merged instead of computed anew.

Profiles and series are sums over days, so each local day leaves a small
state of its own: per client and local hour the load, the readings and the
zero readings; per series and slot the load.  A new day reads only that day;
a day that is delivered again, or late, replaces its state whole.  Profiles and series of
any span of days are then merged from the states, exactly as from the readings.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import is_weekend, parse_instant
from loadcast.operators.profile import profiles_of_sums
from loadcast.operators.series import densify_series
from loadcast.sources.versions import Versions

#: A state row is of a client and hour (``client_id``, ``hour``) or of a series and slot (the rest).
STATE = ("day date, kind string, client_id long, hour int, {key} string, datetime_utc timestamp_ntz, datetime_local timestamp_ntz, "
         "sum_milli long, n long, n_zero long")


def client_days(readings: DataFrame) -> DataFrame:
    """``day, client_id, hour, sum_milli, n, n_zero`` of the readings' local days,
    combined map side: at most 25 rows a client and day, whatever it sends."""
    milli = F.col("kw_milli")
    return readings.groupBy(F.to_date("datetime_local").alias("day"), "client_id", F.hour("datetime_local").alias("hour")).agg(
        F.sum(milli).alias("sum_milli"), F.count(milli).alias("n"), F.count(F.when(milli == 0, 1)).alias("n_zero"),
    )


def profiles(days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1-A5 and J1 merged from client days; with ``by`` per value of those columns too."""
    weekend, hour, kw, n = is_weekend("day"), F.col("hour"), F.col("sum_milli"), F.col("n")
    parts = {f"h{h:02d}": hour == h for h in range(24)} | {"mean_kw": F.lit(True), "wd_avg": ~weekend, "we_avg": weekend}
    agg = days.groupBy(*(by or []), "client_id").agg(
        *[F.sum(F.when(on, kw)).alias(f"_s_{name}") for name, on in parts.items()],
        *[F.coalesce(F.sum(F.when(on, n)), F.lit(0)).alias(f"_n_{name}") for name, on in parts.items()],
        F.sum("n_zero").alias("_zero"),
    )
    return profiles_of_sums(agg, list(parts), by or [])


def day_range(first: str, last: str) -> list[str]:
    """The days from ``first`` to ``last``, both included."""
    a, b = (parse_instant(f"{d[:10]} 00:00:00") for d in (first, last))
    return [f"{a + _dt.timedelta(days=k):%Y-%m-%d}" for k in range((b - a).days + 1)]


class DayState:
    """The stored partials of clients and of the series of one key, by local day."""

    def __init__(self, spark, path: str, key: str = "community_code"):
        self.key = key
        self.days = Versions(spark, path, "day", STATE.format(key=key))

    def put(self, reader: Callable[[str, str], DataFrame], first: str, last: str) -> None:
        """Replaces the days from ``first`` to ``last`` by what ``reader(first, last)`` holds of
        them now (readings of those local days, with the series' key); a day without a reading is empty.
        The readings are read once, and all days change together."""
        inside = F.to_date("datetime_local").between(F.lit(first[:10]).cast("date"), F.lit(last[:10]).cast("date"))
        self.days.replace(partials(reader(first, last).where(inside), self.key), day_range(first, last))

    def _span(self, kind: str, before: str | None, start: str | None) -> DataFrame:
        days = [d for d in self.days.live() if (before is None or d < before[:10]) and (start is None or d >= start[:10])]
        return self.days.read(days).where(F.col("kind") == kind)

    def client_days(self, before: str | None = None, start: str | None = None) -> DataFrame:
        """The clients' days from ``start`` on and before ``before``; no other day is read."""
        return self._span("client", before, start).select("day", "client_id", "hour", "sum_milli", "n", "n_zero")

    def profiles(self, before: str | None = None, start: str | None = None) -> DataFrame:
        return profiles(self.client_days(before, start))

    def dense_series(self, history_start: str, end: str, local_shift: str, before: str | None = None, start: str | None = None) -> DataFrame:
        """The series of the days on the spine of ``[history_start, end)`` (UTC)."""
        sparse = self._span("series", before, start).select(self.key, "datetime_utc", "datetime_local", F.col("sum_milli").alias("load_milli"))
        return densify_series(sparse, self.key, history_start, end, local_shift)


def partials(readings: DataFrame, key: str) -> DataFrame:
    """The state rows of the readings, from one pass: a reading counts once for its client's
    hour and once for its series' slot, and both are combined map side."""
    milli, local = F.col("kw_milli"), F.col("datetime_local")
    null = lambda kind: F.lit(None).cast(kind)

    def target(kind: str, client: Column, hour: Column, series: Column, utc: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), client.alias("client_id"), hour.alias("hour"), series.alias(key), utc.alias("datetime_utc"), at.alias("datetime_local"))

    each = readings.select(
        F.to_date(local).alias("day"), "kw_milli",
        F.explode(F.array(
            target("client", F.col("client_id").cast("long"), F.hour(local), null("string"), null("timestamp_ntz"), null("timestamp_ntz")),
            target("series", null("long"), null("int"), F.col(key).cast("string"), F.col("datetime_utc"), local),
        )).alias("t"),
    )
    # a series' local clock is the least one of its readings, as in `series_load`
    return each.groupBy("day", "t.kind", "t.client_id", "t.hour", f"t.{key}", "t.datetime_utc").agg(
        F.min("t.datetime_local").alias("datetime_local"), F.sum(milli).alias("sum_milli"),
        F.count(milli).alias("n"), F.count(F.when(milli == 0, 1)).alias("n_zero"),
    )
