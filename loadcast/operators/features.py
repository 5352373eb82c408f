"""Window features over quarter-hour series.

Every window is ``partitionBy(key).orderBy(datetime_utc)``: one sort per
series, shared by all features (dependent windows reuse the ordering, so the
plan holds a single exchange and a single sort).  Lags count rows, so the
input must be a dense series (``operators.series.dense_series``).

Rolling means over row frames are computed from running sums: a frame
``[i+lo, i+hi]`` sums to ``C(i+hi) - C(i+lo-1)`` where ``C`` is the running
sum of the exact integer load.  That is O(rows) whatever the frame length
(Spark's sliding frame re-aggregates the whole frame per row) and exact, so
it matches a direct frame average bit for bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.clock import slot_index
from loadcast.functions.exprs import from_milli, null_safe_mean
from loadcast.functions.reach import Reach, Seen, Stages, combine

# Fixed values of the reference's feature set (slots of 15 minutes).
REFERENCE_LAGS = {
    "lag_2d_same_slot": 192,
    "lag_7d_same_slot": 672,
    "lag_14d_same_slot": 1344,
    "lag_21d_same_slot": 2016,
    "lag_28d_same_slot": 2688,
}
SAME_SLOT_LAGS = (672, 1344, 2016, 2688)
# "48 h" and "7 day" frames, both ending 193 rows back: 191 and 671 rows.
REFERENCE_ROLLING = {
    "rolling_mean_48h_safe": (-383, -193),
    "rolling_mean_7d_safe": (-863, -193),
}
TREND_LAGS = (288, 384, 960, 1056)


@dataclass(frozen=True)
class FeatureSpec:
    """Which features to build; slot counts are parameters."""

    lags: dict = field(default_factory=lambda: dict(REFERENCE_LAGS))
    same_slot_lags: tuple = SAME_SLOT_LAGS
    rolling: dict = field(default_factory=lambda: dict(REFERENCE_ROLLING))
    spread: tuple | None = ("rolling_mean_48h_safe", "rolling_mean_7d_safe")
    last_measured: bool = True
    distance: str = "parity"  # "parity" (1 or null, as coded) or "gap" (as documented)
    trend_lags: tuple | None = TREND_LAGS

    def names(self) -> list[str]:
        return list(self.reach())

    def reach(self) -> dict[str, Reach]:
        """What every feature reads, derived from its expression."""
        built = stages(Stages(None, LOAD), "series", self)
        return {n: r for n, r in built.reach.items() if n not in LOAD and not n.startswith("_")}

    def min_lag(self) -> dict[str, int]:
        """Nearest slot each feature reads, counted back from its own row."""
        return {n: int(-r.near) for n, r in self.reach().items()}


#: What the columns of a series read: the load its own slot, clocks nothing.
LOAD: dict[str, Reach | None] = {"sum_active_kw": Reach(0, 0), "load_milli": Reach(0, 0), "datetime_utc": None}


def check_declared(spec: FeatureSpec, declared: dict[str, int]) -> None:
    """Refuses a statement of nearest slots that the expressions do not bear out."""
    derived = spec.min_lag()
    wrong = {n: (d, derived.get(n)) for n, d in declared.items() if derived.get(n) != d}
    if wrong or declared.keys() != derived.keys():
        raise ValueError(f"declared and derived nearest slots differ: {wrong or sorted(declared.keys() ^ derived.keys())}")


def series_window(key: str):
    return Window.partitionBy(key).orderBy("datetime_utc")


def running_totals(at: Stages, key: str, milli: str, tag: str = "") -> Stages:
    """Running sum and running count of the non-null exact load."""
    w = series_window(key)
    return at.add({
        f"_run_sum{tag}": combine(lambda c: F.coalesce(c, F.lit(0)), at[milli].frame(F.sum, w, -inf, 0)),
        f"_run_n{tag}": at[milli].frame(F.count, w, -inf, 0),
    })


def add_running_totals(df: DataFrame, key: str, milli: str = "load_milli", tag: str = "") -> DataFrame:
    return running_totals(Stages(df, {milli: Reach(0, 0)}), key, milli, tag).df


def frame_mean(at: Stages, key: str, lo: int, hi: int, tag: str = "") -> Seen:
    """Mean of the non-null load over rows ``[i+lo, i+hi]`` (``hi <= 0``)
    from the running totals; null when the frame holds no value."""
    w = series_window(key)

    def back(name: str, n: int) -> Seen:
        # value of the running column ``n`` rows earlier; 0 before the start
        lagged = at[name].lag(n, w)
        return lagged if n == 0 else combine(lambda c: F.coalesce(c, F.lit(0)), lagged)

    # rows before the start read as running totals of 0, so a frame that
    # lies (partly) before the first row sums only the rows it really holds
    s = combine(lambda a, b: a - b, back(f"_run_sum{tag}", -hi), back(f"_run_sum{tag}", -(lo - 1)))
    n = combine(lambda a, b: a - b, back(f"_run_n{tag}", -hi), back(f"_run_n{tag}", -(lo - 1)))
    return combine(lambda a, b: F.when(b > 0, from_milli(a) / b), s, n)


def check_frames(frames: dict[str, tuple[int, int]]) -> None:
    for name, (lo, hi) in frames.items():
        if hi > 0 or lo > hi:
            raise ValueError(f"frame {name} must satisfy lo <= hi <= 0")


def add_rolling(
    df: DataFrame, key: str, frames: dict[str, tuple[int, int]], milli: str = "load_milli", suffix: str = ""
) -> DataFrame:
    """Frame means, e.g. ``{"rolling_mean_7d_safe": (-863, -193)}``."""
    if not frames:
        return df
    check_frames(frames)
    out = rolling(Stages(df, {milli: Reach(0, 0)}), key, frames, milli, suffix)
    return out.df.drop(f"_run_sum{suffix}", f"_run_n{suffix}")


def rolling(at: Stages, key: str, frames: dict[str, tuple[int, int]], milli: str, suffix: str) -> Stages:
    at = running_totals(at, key, milli, suffix)
    return at.add({name + suffix: frame_mean(at, key, lo, hi, suffix) for name, (lo, hi) in frames.items()})


def slots_since_measured(key: str, target: str = "sum_active_kw", mode: str = "parity") -> Column:
    """W9.  ``parity``: 1 when the previous slot holds a value, else null (the
    reference's code).  ``gap``: slots since the last non-null value before
    this row (its documented meaning); null when there is none."""
    return _since(Seen(F.col(target), Reach(0, 0)), key, mode).column


def last_measured(key: str, target: str = "sum_active_kw", mode: str = "parity") -> Column:
    """W8.  ``parity``: the previous slot's value.  ``gap``: the last non-null
    value before this row."""
    return _last(Seen(F.col(target), Reach(0, 0)), key, mode).column


def _since(load: Seen, key: str, mode: str) -> Seen:
    w = series_window(key)
    if mode == "parity":
        return combine(lambda c: F.when(c.isNotNull(), F.lit(1)), load.lag(1, w))
    idx = Seen(slot_index("datetime_utc"), None)
    held = combine(lambda c, i: F.when(c.isNotNull(), i), load, idx)
    return combine(lambda i, last: (i - last).cast("int"), idx, held.frame(lambda c: F.last(c, ignorenulls=True), w, -inf, -1))


def _last(load: Seen, key: str, mode: str) -> Seen:
    w = series_window(key)
    return load.lag(1, w) if mode == "parity" else load.frame(lambda c: F.last(c, ignorenulls=True), w, -inf, -1)


def build_features(
    series: DataFrame,
    key: str,
    spec: FeatureSpec | None = None,
    target: str = "sum_active_kw",
    milli: str = "load_milli",
    suffix: str = "",
) -> DataFrame:
    """All window features of ``spec`` on a dense series frame.

    ``target`` (kW, double) feeds lags and last values, ``milli`` (exact
    load) the rolling means; every output is named ``<feature><suffix>``, so
    two variants of one series (say, with and without the future) can be
    built side by side in the same sorted pass."""
    built = stages(Stages(series, LOAD | {target: Reach(0, 0), milli: Reach(0, 0)}), key, spec or FeatureSpec(), target, milli, suffix)
    own = [c for c in built.df.columns if c not in series.columns]
    return built.df.drop(*[c for c in own if c.startswith("_lag") or c in (f"_run_sum{suffix}", f"_run_n{suffix}")])


def stages(at: Stages, key: str, spec: FeatureSpec, y: str = "sum_active_kw", milli: str = "load_milli", suffix: str = "") -> Stages:
    """The features' expressions, stage by stage."""
    w = series_window(key)
    # step 1: every plain lag the spec needs, under temporary names
    needed = {name + suffix: n for name, n in spec.lags.items()}
    tmp = {}
    for n in tuple(spec.same_slot_lags or ()) + tuple(spec.trend_lags or ()):
        name = next((k + suffix for k, v in spec.lags.items() if v == n), None)
        if name is None:
            name = f"_lag{n}{suffix}"
            needed[name] = n
        tmp[n] = name
    first = {name: at[y].lag(n, w) for name, n in needed.items()}
    if spec.last_measured:
        mode = "parity" if spec.distance == "parity" else "gap"
        first["last_measured_value" + suffix] = _last(at[y], key, mode)
        first["time_slots_distance" + suffix] = _since(at[y], key, spec.distance)
    at = at.add(first)
    # step 2: rolling means from running totals (same partitioning and order)
    if spec.rolling:
        check_frames(spec.rolling)
        at = rolling(at, key, spec.rolling, milli, suffix)
    # step 3: row-local combinations
    derived = {}
    if spec.same_slot_lags:
        derived["same_slot_mean_4w" + suffix] = combine(lambda *c: null_safe_mean(list(c)), *[at[tmp[n]] for n in spec.same_slot_lags])
    if spec.spread:
        short, long_ = spec.spread
        derived["short_ma_minus_long_ma" + suffix] = combine(lambda a, b: a - b, at[short + suffix], at[long_ + suffix])
    if spec.trend_lags:
        derived["weekly_trend_smooth" + suffix] = combine(
            lambda a, b, c, d: ((a - b) + (c - d)) / F.lit(2.0), *[at[tmp[n]] for n in spec.trend_lags]
        )
    return at.add(derived)
