"""Parameters of the registered queries on the stored test tables.

The stored ``events`` cover 2024-01-01 00:00 to 2024-01-30 23:59 (UTC), so
the history window is the 30 days up to 2024-01-31 00:00 (2,880 slots) and
the forecast window is the last 7 local days (672 slots).
"""

from __future__ import annotations

HISTORY_START = "2024-01-01 00:00:00"  # UTC, inclusive
HISTORY_END = "2024-01-31 00:00:00"  # UTC, exclusive
PREDICT_START = "2024-01-24 00:00:00"  # local clock, inclusive
PREDICT_END = "2024-01-31 00:00:00"  # local clock, exclusive
LOCAL_SHIFT = "1 hour"

# Backtest: three weekly folds of one day each, ending at the last full day.
BACKTEST_FIRST = "2024-01-15 00:00:00"
BACKTEST_FOLDS = 3
BACKTEST_STEP_DAYS = 7
BACKTEST_HORIZON_DAYS = 1

TEAM_NAME = "loadcast"

# Flagship model settings: the reference's (k = 5 from 20 starts of at most 300
# iterations, 100 boosting rounds of depth 6 with 256 bins); the leaf size is
# chosen on the week before the forecast window (sf0.01, 20 rounds, MAE by rows
# a leaf: 1: 174.7, 20: 125.7, 100: 116.9, 200: 111.5).
FLAGSHIP_K = 5
FLAGSHIP_N_INIT = 20
FLAGSHIP_MIN_INSTANCES = 200
# The whole fit that is checked value by value: seeding and so many rounds of so many starts.
KMEANS_SEED = 42
KMEANS_STARTS = 3
KMEANS_ROUNDS = 3
# Daily deliveries (local days): first day, last day of the first delivery, the day delivered
# again (its readings above LATE_VALUE came late), last day, which is delivered twice.
DELIVERIES = ("2024-01-01", "2024-01-20", "2024-01-10", "2024-01-31")
LATE_VALUE = 50.0
# Features of the first boosting step that is checked value by value.
BOOST_STEP_FEATURES = (
    "lag_2d_same_slot", "lag_7d_same_slot", "lag_14d_same_slot", "lag_21d_same_slot", "same_slot_mean_4w",
    "rolling_mean_48h_safe", "rolling_mean_7d_safe", "short_ma_minus_long_ma", "weekly_trend_smooth",
)
# The forecast is made twice to audit it for leaks; what it may see does not
# depend on how many trees look at it.
AUDIT_N_INIT = 2
AUDIT_ROUNDS = 3
AUDIT_FACTOR = 10  # by which the audit multiplies the future's readings

# Profile (clustering) window: the UTC slots whose local time is before the
# forecast start, so clusters never see the forecast window.
PROFILE_START = HISTORY_START
PROFILE_END = "2024-01-23 23:00:00"

# The one series kept by the filter query.
ONE_SERIES = "NATION_7"
