"""The consumption fact: one reading per (client, 15-minute slot).

The stored ``events`` table stands in for meter data: ``user_id`` is the
client, ``ts`` the reading time and ``value`` the load in kW.  Readings in the
same slot add up; a slot without a reading is zero load (the dense grid is
never materialised per client, see ``operators.profile``).

Columns of a readings frame::

    client_id       long
    datetime_utc    timestamp_ntz   start of the slot, the key
    datetime_local  timestamp_ntz   the same slot on the local clock
    kw_milli        long            exact load, milli-kW
    active_kw       double          kw_milli / 1000 (cells only)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import DEFAULT_LOCAL_SHIFT, floor_15min, ntz, to_local, to_utc
from loadcast.functions.exprs import from_milli, to_milli
from loadcast.operators.joins import DEFAULT_BROADCAST_BYTES

# Bytes of a row of two numbers, a string's header and the row's own, as broadcast.
ROW_BYTES = 56


def restrict_time(events: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """``start <= ts < end`` on the raw column, so the parquet scan can skip
    row groups.  Bounds are slot-aligned, so flooring afterwards cannot move
    a row across them."""
    if start is not None:
        events = events.filter(F.col(ts) >= ntz(start))
    if end is not None:
        events = events.filter(F.col(ts) < ntz(end))
    return events


def raw_readings(
    events: DataFrame,
    start: str | None = None,
    end: str | None = None,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
) -> DataFrame:
    """Readings as stored, floored to their slot: a projection of the scan,
    no shuffle.  Several readings of one client may share a slot; every
    consumer that sums load (series, totals, profiles' sums) is indifferent
    to that, and map-side partial aggregation collapses them."""
    ev = restrict_time(events.select("user_id", "ts", "value"), start, end)
    utc = floor_15min("ts")
    return ev.select(
        F.col("user_id").alias("client_id"),
        utc.alias("datetime_utc"),
        to_local(utc, local_shift).alias("datetime_local"),
        to_milli("value").alias("kw_milli"),
    )


def to_cells(readings: DataFrame) -> DataFrame:
    """One row per (client, slot), the load of the slot summed.

    Grouped on (client, slot), not client alone, so a client holding a
    large share of all rows still spreads over many shuffle partitions.
    Only needed where the contract is "one reading per client and slot"
    (the consumption table itself, the share of zero-load slots)."""
    return readings.groupBy("client_id", "datetime_utc").agg(
        F.min("datetime_local").alias("datetime_local"),
        F.sum("kw_milli").alias("kw_milli"),
    ).select(
        "client_id", "datetime_utc", "datetime_local", "kw_milli",
        from_milli("kw_milli").alias("active_kw"),
    )


def readings_from_events(
    events: DataFrame,
    start: str | None = None,
    end: str | None = None,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
) -> DataFrame:
    """Raw readings resampled to one row per (client, 15-minute slot)."""
    return to_cells(raw_readings(events, start, end, local_shift))


def readings_from_consumption(consumption_table: DataFrame, local_shift: str = DEFAULT_LOCAL_SHIFT) -> DataFrame:
    """Readings from a stored consumption table with the reference's
    contract: ``client_id``, ``datetime_local``, ``community_code``,
    ``active_kw`` and, when present, ``datetime_utc``.

    Timestamps are read as wall clocks (``timestamp_ntz``; a zoned timestamp
    is read in the session time zone) and floored to their slot; a missing
    ``datetime_utc`` is derived from the local clock by the shift.  A meter
    table holds one reading per client and slot, so its readings can be
    passed on with ``readings_are_cells=True``.
    """
    cols = consumption_table.columns
    local = floor_15min(F.col("datetime_local").cast("timestamp_ntz"))
    if "datetime_utc" in cols:
        utc = floor_15min(F.col("datetime_utc").cast("timestamp_ntz"))
    else:
        utc = to_utc(local, local_shift)
    extra = ["community_code"] if "community_code" in cols else []
    return consumption_table.select(
        F.col("client_id").cast("long").alias("client_id"),
        utc.alias("datetime_utc"),
        local.alias("datetime_local"),
        to_milli("active_kw").alias("kw_milli"),
        *extra,
    )


def community_map(customer: DataFrame, nation: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """client_id -> community (nation name and key).

    One row per client (the nation key is unique, so the left join cannot add
    rows): its size is the counted clients (a footer count) times the width
    of a whole row, the community's longest name included.  Under the bound
    the map is broadcast to the readings; above it (a client base of
    billions) the readings are shuffled on ``client_id`` and AQE splits a
    hot client's partition.
    """
    nations = nation.select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("community_code"))
    facts = nations.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("community_code")), F.lit(0))).first()
    if facts[0] * (ROW_BYTES + facts[1]) <= max_bytes:
        nations = F.broadcast(nations)
    clients = customer.select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("nation_key"))
    out = clients.join(nations, "nation_key", "left").select("client_id", "community_code", "nation_key")
    return F.broadcast(out) if customer.count() * (ROW_BYTES + facts[1]) <= max_bytes else out


def attach_community(readings: DataFrame, communities: DataFrame) -> DataFrame:
    """Left join: a reading of a client missing from the dimension is kept
    with a null community."""
    return readings.join(communities, "client_id", "left")


def consumption(
    events: DataFrame,
    customer: DataFrame,
    nation: DataFrame,
    start: str | None = None,
    end: str | None = None,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
) -> DataFrame:
    """The full consumption table of the reference's contract:
    client_id, datetime_utc, datetime_local, community_code, active_kw
    (plus the exact ``kw_milli``)."""
    readings = readings_from_events(events, start, end, local_shift)
    return attach_community(readings, community_map(customer, nation)).select(
        "client_id", "datetime_utc", "datetime_local", "community_code", "kw_milli", "active_kw"
    )
