"""Client load profiles.

``h00 .. h23`` (mean load per local hour), ``mean_kw``, ``pct_zero`` (share of
zero load), ``wd_avg``, ``we_avg``, ``we_wd_ratio`` (weekend / weekday mean, 1.0
when either is missing or the weekday mean is not positive).

By default the means run over the readings that exist, a null reading being
none: one ``groupBy(client_id)`` straight on the readings, combined map side,
so a client holding a third of all rows costs one partial row per task.

With ``grid`` a profile is defined on every slot of the window ``[start, end)``
(UTC), a slot without a (non-null) reading counting as zero load.  The grid is
never built: each mean is an exact integer sum divided by a slot count that
depends only on the window (``operators.calendar.slot_counts``).  Only the
zero share needs the readings added up per (client, slot) first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.clock import DEFAULT_LOCAL_SHIFT, is_weekend, ntz
from loadcast.functions.exprs import clip, from_milli, mean_from_milli

HOUR_COLS = [f"h{h:02d}" for h in range(24)]
VECTOR_HOUR_COLS = [f"p{h:02d}" for h in range(24)]
VECTOR_COLS = VECTOR_HOUR_COLS + ["ratio_feat", "zero_feat"]


def _grid_mean(sum_milli, n_slots: int):
    """Mean over ``n_slots`` grid slots; null for an empty slot set."""
    if n_slots <= 0:
        return F.lit(None).cast("double")
    return from_milli(F.coalesce(sum_milli, F.lit(0))) / F.lit(n_slots)


def client_profiles(
    readings: DataFrame,
    start: str | None = None,
    end: str | None = None,
    local_shift: str = DEFAULT_LOCAL_SHIFT,
    readings_are_cells: bool = False,
    grid: bool = False,
) -> DataFrame:
    """A1-A5 and J1 for every client with a reading in the window (all readings
    where ``start`` or ``end`` is open, which only the grid form needs)."""
    rows = readings
    if start is not None:
        rows = rows.filter(F.col("datetime_utc") >= ntz(start))
    if end is not None:
        rows = rows.filter(F.col("datetime_utc") < ntz(end))
    hour, weekend, milli = F.hour("datetime_local"), is_weekend("datetime_local"), F.col("kw_milli")
    parts = {f"h{h:02d}": hour == h for h in range(24)} | {"mean_kw": F.lit(True), "wd_avg": ~weekend, "we_avg": weekend}
    if grid:
        sums = _grid_sums(rows, parts, start, end, local_shift, readings_are_cells)
    else:
        agg = rows.groupBy("client_id").agg(
            *[F.sum(F.when(on, milli)).alias(f"_s_{name}") for name, on in parts.items()],
            *[F.count(F.when(on, milli)).alias(f"_n_{name}") for name, on in parts.items()],
            F.count(F.when(milli == 0, 1)).alias("_zero"),
        )
        return profiles_of_sums(agg, list(parts))
    return _with_ratio(sums)


def profiles_of_sums(agg: DataFrame, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """Profiles from exact sums ``_s_<part>``, counts ``_n_<part>`` and the count of zero readings ``_zero``."""
    held, by = F.col("_n_mean_kw"), by or []
    sums = agg.select(
        *by, "client_id", *[mean_from_milli(f"_s_{name}", f"_n_{name}").alias(name) for name in parts],
        F.when(held > 0, F.col("_zero") / held).alias("pct_zero"),
    )
    return _with_ratio(sums, by)


def _with_ratio(sums: DataFrame, by: list[str] | None = None) -> DataFrame:
    ratio = F.when((F.col("wd_avg") > 0) & F.col("we_avg").isNotNull(), F.col("we_avg") / F.col("wd_avg")).otherwise(F.lit(1.0))
    return sums.select(*(by or []), "client_id", *HOUR_COLS, "mean_kw", "pct_zero", "wd_avg", "we_avg", ratio.alias("we_wd_ratio"))


def _grid_sums(rows: DataFrame, parts: dict, start: str | None, end: str | None, local_shift: str, readings_are_cells: bool) -> DataFrame:
    """Sums over readings, divided by slot counts.  Readings are added up per
    (client, slot) for the zero share (a shuffle of three narrow columns),
    unless the source holds one reading per client and slot already."""
    from loadcast.operators.calendar import slot_counts
    from loadcast.sources.consumption import to_cells

    if start is None or end is None:
        raise ValueError("the grid form needs a window")
    counts = slot_counts(start, end, local_shift)
    if counts["total"] == 0:
        raise ValueError(f"empty profile window [{start}, {end})")
    slots = dict(zip(HOUR_COLS, counts["per_hour"])) | {"mean_kw": counts["total"], "wd_avg": counts["weekday"], "we_avg": counts["weekend"]}
    milli = F.col("kw_milli")
    agg = (rows if readings_are_cells else to_cells(rows)).groupBy("client_id").agg(
        *[F.sum(F.when(on, milli)).alias(f"_s_{name}") for name, on in parts.items()],
        F.count(F.when(milli != 0, milli)).alias("_nonzero"),
    )
    n = F.lit(counts["total"])
    return agg.select(
        "client_id", *[_grid_mean(F.col(f"_s_{name}"), slots[name]).alias(name) for name in parts],
        ((n - F.col("_nonzero")) / n).alias("pct_zero"),
    )


def profile_vector(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 26 clustering features.  Hour means (null as 0) scaled by
    the client's largest hour mean (divided by 1 when that is 0), the
    weekend ratio (null as 1) clipped to [0, 3], and the zero share (null as
    0).  Columns ``client_id, p00..p23, ratio_feat, zero_feat``."""
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in HOUR_COLS]
    row_max = F.greatest(*filled)
    denom = F.when(row_max == 0, F.lit(1.0)).otherwise(row_max)
    return profiles.select(
        *(by or []), "client_id",
        *[(filled[h] / denom).alias(VECTOR_HOUR_COLS[h]) for h in range(24)],
        clip(F.coalesce(F.col("we_wd_ratio"), F.lit(1.0)), 0.0, 3.0).alias("ratio_feat"),
        F.coalesce(F.col("pct_zero"), F.lit(0.0)).alias("zero_feat"),
    )
