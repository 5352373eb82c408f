"""Enrichment: lookups joined onto a series by instant, hour or local date.

Every lookup is keyed by time and holds at most one row per hour or day
covered, so it is bounded by the time span, not by the data volume; each is
still only hinted for broadcast after its estimated size is checked.  Keys
are made unique (one row per key) before joining, so a join never multiplies
series rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import floor_hour
from loadcast.operators.joins import DEFAULT_BROADCAST_BYTES, broadcast_if_small
from loadcast.operators.scan import dense_ranks, last_known
from loadcast.session import cut_lineage

# Bytes per lookup row assumed when a row-count bound decides a broadcast.
LOOKUP_ROW_BYTES = 64


def broadcast_bounded(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast a lookup whose row count is bounded by the caller (hours or
    days of a window it has filtered to); without a bound the join is left to
    the planner, which re-plans it at run time from measured sizes."""
    if max_rows is not None and max_rows * LOOKUP_ROW_BYTES <= DEFAULT_BROADCAST_BYTES:
        return F.broadcast(df)
    return df


_AGGS = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "first": F.min}


def one_row_per_key(df: DataFrame, key: str | list[str], how: dict[str, str]) -> DataFrame:
    """``groupBy(key)`` with a stated rule per column (``max`` flag,
    ``avg`` price...), instead of keeping an arbitrary row."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(*[_AGGS[rule](c).alias(c) for c, rule in how.items()])


def holiday_per_instant(holidays: DataFrame) -> DataFrame:
    """Holiday when any community is on holiday at that instant."""
    return one_row_per_key(holidays, "datetime_utc", {"is_normal_holiday": "max"})


def enrich_holiday(df: DataFrame, holidays: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Left join of the per-instant flag on ``datetime_utc``."""
    return df.join(broadcast_bounded(holiday_per_instant(holidays), max_rows), "datetime_utc", "left")


def next_hour_carry(hourly: DataFrame, cols: list[str], max_rows: int | None = None) -> DataFrame:
    """``hour_start, <c>_curr, <c>_next`` where next is the value one hour
    later, or the current value when that hour is missing (a hole or the
    last hour).  An equi-join on ``hour + 1h`` instead of ``lead`` over an
    unpartitioned window, so it runs in parallel and a hole never pulls in a
    later hour.  One row per hour is enforced first (duplicate hours are
    averaged), so the join cannot multiply rows; that hourly table, bounded by
    the hours it covers, is materialised, so its source is read once and not
    once more for its own next hour."""
    hourly = cut_lineage(one_row_per_key(hourly, "datetime_utc", {c: "avg" for c in cols}))
    base = hourly.select(F.col("datetime_utc").alias("hour_start"), *cols)
    nxt = hourly.select(
        (F.col("datetime_utc") - F.expr("INTERVAL 1 HOUR")).alias("hour_start"),
        *[F.col(c).alias(f"_{c}_next") for c in cols],
    )
    joined = base.join(broadcast_bounded(nxt, max_rows), "hour_start", "left")
    return joined.select(
        "hour_start",
        *[F.col(c).alias(f"{c}_curr") for c in cols],
        *[F.coalesce(F.col(f"_{c}_next"), F.col(c)).alias(f"{c}_next") for c in cols],
    )


def interpolation_weight(ts: str = "datetime_utc") -> Column:
    """alpha = minute / 60 of the slot."""
    return F.minute(ts) / F.lit(60.0)


def enrich_interpolated(df: DataFrame, hourly: DataFrame, cols: list[str], max_rows: int | None = None) -> DataFrame:
    """Hourly signals to quarter hours by linear interpolation,
    ``(1 - alpha) * curr + alpha * next``."""
    prep = next_hour_carry(hourly, cols, max_rows)  # materialised: cheap to count
    prep = broadcast_if_small(prep) if max_rows is None else broadcast_bounded(prep, max_rows)
    alpha = interpolation_weight("datetime_utc")
    out = df.withColumn("hour_start", floor_hour("datetime_utc")).join(prep, "hour_start", "left")
    out = out.select(
        *df.columns,
        *[
            (F.col(f"{c}_curr") * (F.lit(1.0) - alpha) + F.col(f"{c}_next") * alpha).alias(c)
            for c in cols
        ],
    )
    return out


def enrich_daily(df: DataFrame, *tables: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Every column of the daily tables (key ``date``) by the row's
    local date.  The tables, one row per date each, are put together first,
    so the series is joined once however many there are."""
    together = tables[0]
    for t in tables[1:]:
        together = together.join(t, "date", "full_outer")
    days = broadcast_bounded(together.withColumnRenamed("date", "_local_date"), max_rows)
    return df.join(days, F.to_date("datetime_local") == F.col("_local_date"), "left").drop("_local_date")


def enrich_weekday(df: DataFrame, weekday: DataFrame, max_rows: int | None = None) -> DataFrame:
    return enrich_daily(df, weekday, max_rows=max_rows)


def enrich_visitors(df: DataFrame, visitors: DataFrame, max_rows: int | None = None) -> DataFrame:
    return enrich_daily(df, visitors, max_rows=max_rows)


def enrich_price(
    df: DataFrame,
    hourly: DataFrame,
    price_col: str = "AvgPrice",
    max_rows: int | None = None,
    match: str = "hour",
) -> DataFrame:
    """The hour's average price, when the table has that column (the
    column is optional).  One row per key is enforced first.  ``match="hour"``
    keys on the slot's hour; ``match="instant"`` is the reference's equality
    on the slot instant itself, which leaves three of every four quarter
    hours of an hourly table without a price."""
    if price_col not in hourly.columns:
        return df
    if match not in ("hour", "instant"):
        raise ValueError(f"match must be 'hour' or 'instant', not {match!r}")
    price = one_row_per_key(
        hourly.select(F.col("datetime_utc").alias("_price_key"), price_col), "_price_key", {price_col: "avg"}
    )
    key = floor_hour("datetime_utc") if match == "hour" else F.col("datetime_utc")
    return (
        df.withColumn("_price_key", key)
        .join(broadcast_bounded(price, max_rows), "_price_key", "left")
        .drop("_price_key")
    )


def dense_code(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Integer code of ``col``: dense rank over its distinct values, from 0.
    Ranks run by ranges, so there may be any number of values; the codes are
    joined back with a size-checked broadcast."""
    out = out or f"{col}_num"
    codes = dense_ranks(df, col, out).withColumn(out, F.col(out).cast("int"))
    return df.join(broadcast_if_small(cut_lineage(codes)), col, "left")


def price_until_next(hourly: DataFrame, price_col: str = "AvgPrice") -> DataFrame:
    """An hour without a price has the last one quoted before it."""
    return last_known(hourly, "datetime_utc", [price_col])
