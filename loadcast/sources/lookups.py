"""Lookup tables joined onto a series: hourly forecasts, holiday flags,
weekday attributes, daily visitors.

The reference reads them from its catalog.  Here each is derived by Spark
from the stored tables (mapping below) so that it exists at every scale and
keeps the reference's shape, including its defects (holes in the hourly
table, several holiday rows per instant).  All of them are keyed by time and
are bounded by the number of hours or days covered, not by the data volume.

Fixed mapping from the stored tables:
  hourly forecasts  per UTC hour of ``events.ts``: demand = sum of 'view'
                    values, pv = sum of 'click', wind = sum of 'signup',
                    AvgPrice = mean of 'purchase' values
  holidays          one row per (slot, community) seen in the readings, flag 1
                    when (day of month + nation key) is a multiple of 7
  weekday           each local date of a window: day of week (1 = Sunday) and a
                    weekend flag
  visitors          distinct clients per local date

For a forecast, what lies in its window is not known from the readings:
``project_hourly`` and ``project_daily`` carry the value of the same hour or
weekday, the fewest weeks back that lie before the window, into it, and
``calendar_holidays`` and ``weekday_dates`` follow from the calendar alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.clock import (
    DEFAULT_LOCAL_SHIFT,
    SLOTS_PER_HOUR,
    floor_15min,
    floor_hour,
    ntz,
    py_slot_index,
    slot_index,
    slot_start,
    to_local,
)
from loadcast.functions.exprs import from_milli, mean_from_milli, to_milli
from loadcast.operators.calendar import slot_sequence
from loadcast.sources.consumption import restrict_time

# Which event types stand for which hourly signal.
HOURLY_SIGNALS = {
    "demand_forecast": "view",
    "pv_forecast": "click",
    "wind_forecast": "signup",
}
PRICE_EVENT = "purchase"


def hourly_forecasts(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """datetime_utc (hour start), demand_forecast, pv_forecast, wind_forecast,
    AvgPrice.  Hours without any of these events are absent (holes)."""
    types = list(HOURLY_SIGNALS.values()) + [PRICE_EVENT]
    ev = restrict_time(events.select("ts", "event_type", "value"), start, end)
    ev = ev.filter(F.col("event_type").isin(*types))
    milli = to_milli("value")
    aggs = [
        F.sum(F.when(F.col("event_type") == etype, milli)).alias(f"_{name}")
        for name, etype in HOURLY_SIGNALS.items()
    ]
    aggs += [
        F.sum(F.when(F.col("event_type") == PRICE_EVENT, milli)).alias("_price_milli"),
        F.count(F.when(F.col("event_type") == PRICE_EVENT, milli)).alias("_price_n"),
    ]
    out = ev.groupBy(floor_hour("ts").alias("datetime_utc")).agg(*aggs)
    return out.select(
        "datetime_utc",
        *[from_milli(f"_{name}").alias(name) for name in HOURLY_SIGNALS],
        mean_from_milli("_price_milli", "_price_n").alias("AvgPrice"),
    )


def holiday_flags(readings_with_community: DataFrame) -> DataFrame:
    """datetime_utc, community_code, is_normal_holiday (int); several rows
    per instant, one per community present."""
    flag = ((F.dayofmonth("datetime_utc") + F.col("nation_key")) % 7 == 0).cast("int")
    return (
        readings_with_community.filter(F.col("community_code").isNotNull())
        .select("datetime_utc", "community_code", "nation_key")
        .distinct()
        .select("datetime_utc", "community_code", flag.alias("is_normal_holiday"))
    )


def weekday_dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    """date, day_of_week (1 = Sunday), is_weekend (int) of every date from
    ``first`` to ``last``: the calendar, no table is read."""
    dates = F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date")
    return spark.range(1).select(dates).select(
        "date",
        F.dayofweek("date").alias("day_of_week"),
        F.dayofweek("date").isin(1, 7).cast("int").alias("is_weekend"),
    )


def calendar_holidays(nation: DataFrame, start: str, end: str) -> DataFrame:
    """``holiday_flags`` of every community and slot of ``[start, end)`` by the
    calendar rule (communities x slots rows, whatever the readings)."""
    slots = nation.select(
        F.col("n_name").alias("community_code"), F.col("n_nationkey").alias("nation_key"),
        F.explode(slot_sequence(start, end)).alias("datetime_utc"),
    )
    flag = ((F.dayofmonth("datetime_utc") + F.col("nation_key")) % 7 == 0).cast("int")
    return slots.select("datetime_utc", "community_code", flag.alias("is_normal_holiday"))


def project_hourly(hourly: DataFrame, start: str, end: str) -> DataFrame:
    """The hours before ``start`` as they are, and those of ``[start, end)`` with
    the values of the same hour, as few weeks back as lie before ``start``."""
    first, after = py_slot_index(start) // SLOTS_PER_HOUR, -(-py_slot_index(end) // SLOTS_PER_HOUR)
    week = 7 * 24
    hour = F.floor(slot_index("datetime_utc") / SLOTS_PER_HOUR).cast("long")
    # an hour of the last week before the window gives the same hours of the window's weeks;
    # written without a join, which would read the readings behind ``hourly`` twice
    gives = (hour >= first - week) & (hour < first) & (hour + week < after) & (F.col("datetime_utc") == slot_start(hour * SLOTS_PER_HOUR))
    later = F.transform(F.sequence(hour + week, F.lit(after - 1).cast("long"), F.lit(week).cast("long")), lambda h: slot_start(h * SLOTS_PER_HOUR))
    return _carried(hourly.filter(F.col("datetime_utc") < ntz(start)), "datetime_utc", F.when(gives, later))


def _carried(known: DataFrame, at: str, later: Column) -> DataFrame:
    """Every row as it is and once more for each time of ``later`` (null: none)."""
    own = F.array(at)
    return known.withColumn(at, F.explode(F.when(later.isNotNull(), F.concat(own, later)).otherwise(own)))


def project_daily(daily: DataFrame, first: str, last: str) -> DataFrame:
    """The dates before ``first`` as they are, and those up to ``last`` with the
    values of the same weekday, as few weeks back as lie before ``first``."""
    start, end = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    gives = (F.col("date") >= F.date_sub(start, 7)) & (F.date_add("date", 7) <= end)
    later = F.sequence(F.date_add("date", 7), end, F.expr("INTERVAL 7 DAYS"))
    return _carried(daily.filter(F.col("date") < start), "date", F.when(gives, later))


def daily_visitors(events: DataFrame, local_shift: str = DEFAULT_LOCAL_SHIFT) -> DataFrame:
    """date, visitors (distinct clients that day, long)."""
    return (
        events.select(
            F.to_date(to_local(floor_15min("ts"), local_shift)).alias("date"),
            F.col("user_id"),
        )
        .groupBy("date")
        .agg(F.countDistinct("user_id").alias("visitors"))
    )
