"""DuckDB twins of the registered queries (brute force where that is the
clearest statement: dense grids by ``range``, frames by window clauses).

Conventions shared with the Spark side: load in integer milli-kW until the
last step, kW = milli / 1000.0, means = (sum / 1000.0) / count, integer
outputs cast to the Spark type, ``dayofweek + 1`` (1 = Sunday).
"""

from __future__ import annotations

from loadcast.operators import cluster
from loadcast.operators.boost import BoostParams
from loadcast.plans import params as P

H0, H1 = P.HISTORY_START, P.HISTORY_END
S0, S1 = P.PREDICT_START, P.PREDICT_END


def ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


FLOOR15 = "time_bucket(INTERVAL 15 MINUTE, ts)"
LOCAL = "INTERVAL 1 HOUR"
MILLI = "CAST(round(value * 1000) AS BIGINT)"

READINGS = f"""
readings AS (
  SELECT user_id AS client_id,
         {FLOOR15} AS datetime_utc,
         {FLOOR15} + {LOCAL} AS datetime_local,
         CAST(SUM({MILLI}) AS BIGINT) AS kw_milli
  FROM events
  GROUP BY 1, 2, 3
)"""

COMMUNITIES = """
communities AS (
  SELECT c.c_custkey AS client_id, n.n_name AS community_code, n.n_nationkey AS nation_key
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

CONSUMPTION = f"""{READINGS},{COMMUNITIES},
consumption AS (
  SELECT r.client_id, r.datetime_utc, r.datetime_local, m.community_code, m.nation_key,
         r.kw_milli, r.kw_milli / 1000.0 AS active_kw
  FROM readings r LEFT JOIN communities m ON r.client_id = m.client_id
)"""

SPINE = f"""
spine AS (
  SELECT range AS datetime_utc, range + {LOCAL} AS datetime_local
  FROM range({ts(H0)}, {ts(H1)}, INTERVAL 15 MINUTE)
)"""

TOTAL = f"""{READINGS},{SPINE},
total AS (
  SELECT s.datetime_utc, s.datetime_local,
         CAST(COALESCE(SUM(r.kw_milli), 0) AS BIGINT) AS load_milli
  FROM spine s LEFT JOIN readings r ON r.datetime_utc = s.datetime_utc
  GROUP BY 1, 2
)"""

COMMUNITY_SERIES = f"""{CONSUMPTION},{SPINE},
sparse AS (
  SELECT community_code, datetime_utc, CAST(SUM(kw_milli) AS BIGINT) AS load_milli
  FROM consumption GROUP BY 1, 2
),
keys AS (SELECT DISTINCT community_code FROM sparse),
cseries AS (
  SELECT k.community_code, s.datetime_utc, s.datetime_local,
         COALESCE(p.load_milli, 0) AS load_milli,
         COALESCE(p.load_milli, 0) / 1000.0 AS sum_active_kw
  FROM keys k CROSS JOIN spine s
  LEFT JOIN sparse p ON p.community_code IS NOT DISTINCT FROM k.community_code
                    AND p.datetime_utc = s.datetime_utc
)"""


def idx(col: str) -> str:
    """Quarter-hours since 1970-01-01 (integer)."""
    return f"(CAST(epoch({col}) AS BIGINT) // 900)"


def naive(series_cte: str, key: str | None, s0: str = S0, s1: str = S1, name: str = "naive") -> str:
    """Seasonal naive over a dense series CTE named ``ser`` (columns key?,
    datetime_utc, datetime_local, load_milli)."""
    k_sel = f"{key}, " if key else ""
    k_on = f"h.{key} IS NOT DISTINCT FROM w.{key} AND " if key else ""
    k_fb = f"f.{key} IS NOT DISTINCT FROM w.{key}" if key else "TRUE"
    k_grp = f"GROUP BY {key}" if key else ""
    start_idx = idx(ts(s0))
    n = name
    return f"""
{n}_hist AS (
  SELECT {k_sel}{idx('datetime_local')} AS src_idx, load_milli AS src_milli
  FROM {series_cte} WHERE datetime_local < {ts(s0)}
),
{n}_fb AS (
  SELECT {k_sel}(SUM(load_milli) / 1000.0) / COUNT(load_milli) AS fallback
  FROM {series_cte} WHERE datetime_local < {ts(s0)} {k_grp}
),
{n}_win AS (
  SELECT {k_sel}datetime_utc, datetime_local,
         {idx('datetime_local')}
           - 672 * ((({idx('datetime_local')}) - {start_idx}) // 672 + 1) AS src_idx
  FROM {series_cte} WHERE datetime_local >= {ts(s0)} AND datetime_local < {ts(s1)}
),
{n} AS (
  SELECT {', '.join('w.' + c for c in ([key] if key else []) + ['datetime_utc', 'datetime_local'])},
         COALESCE(h.src_milli / 1000.0, f.fallback) AS prediction
  FROM {n}_win w
  LEFT JOIN {n}_hist h ON {k_on}h.src_idx = w.src_idx
  LEFT JOIN {n}_fb f ON {k_fb}
)"""


ORACLE: dict[str, str] = {}

ORACLE["scan_consumption"] = f"""WITH {CONSUMPTION}
SELECT client_id, datetime_utc, datetime_local, community_code, kw_milli, active_kw FROM consumption"""

ORACLE["resample_15min"] = f"""
SELECT user_id AS client_id, {FLOOR15} AS datetime_15min,
       CAST(SUM({MILLI}) AS BIGINT) AS kw_milli, COUNT(value) AS n_readings,
       CAST(SUM({MILLI}) AS BIGINT) / 1000.0 AS active_kw
FROM events
GROUP BY 1, 2"""

ORACLE["slot_spine"] = f"""WITH {COMMUNITY_SERIES}
SELECT community_code, datetime_utc, datetime_local, load_milli, sum_active_kw FROM cseries"""

ORACLE["total_load"] = f"""WITH {TOTAL}
SELECT datetime_local AS datetime_15min, datetime_utc, load_milli, load_milli / 1000.0 AS total_kw
FROM total"""

ORACLE["seasonal_naive"] = f"""WITH {TOTAL}, ser AS (SELECT * FROM total), {naive('ser', None)}
SELECT datetime_local AS datetime_15min, datetime_utc, prediction FROM naive"""

ORACLE["mae_total"] = f"""WITH {TOTAL}, ser AS (SELECT * FROM total), {naive('ser', None)}
SELECT CAST(SUM(CAST(abs(t.load_milli / 1000.0 - n.prediction) AS DECIMAL(28,6))) AS DOUBLE)
         / COUNT(n.prediction) AS mae,
       COUNT(n.prediction) AS n_slots, COUNT(*) - COUNT(n.prediction) AS n_missing
FROM total t LEFT JOIN naive n ON t.datetime_utc = n.datetime_utc
WHERE t.datetime_local >= {ts(S0)} AND t.datetime_local < {ts(S1)}"""

# ------------------------------------------------------------------ windows

PE = P.PROFILE_END
KEY = "community_code"
WIN = f"WINDOW w AS (PARTITION BY {KEY} ORDER BY datetime_utc)"


def frame(lo: int, hi: int) -> str:
    return (f"(PARTITION BY {KEY} ORDER BY datetime_utc "
            f"ROWS BETWEEN {-lo} PRECEDING AND {-hi} PRECEDING)")


def frame_mean(lo: int, hi: int) -> str:
    f = frame(lo, hi)
    return (f"CASE WHEN COUNT(load_milli) OVER {f} > 0 THEN "
            f"(SUM(load_milli) OVER {f} / 1000.0) / COUNT(load_milli) OVER {f} END")


def feature_ctes(src: str, out: str) -> str:
    """Window features over the dense series CTE ``src`` -> CTE ``out``."""
    return f"""
{out}_1 AS (
  SELECT {KEY}, datetime_utc, datetime_local, load_milli, sum_active_kw,
         lag(sum_active_kw, 192) OVER w AS lag_2d_same_slot,
         lag(sum_active_kw, 672) OVER w AS lag_7d_same_slot,
         lag(sum_active_kw, 1344) OVER w AS lag_14d_same_slot,
         lag(sum_active_kw, 2016) OVER w AS lag_21d_same_slot,
         lag(sum_active_kw, 2688) OVER w AS lag_28d_same_slot,
         lag(sum_active_kw, 288) OVER w AS l288,
         lag(sum_active_kw, 384) OVER w AS l384,
         lag(sum_active_kw, 960) OVER w AS l960,
         lag(sum_active_kw, 1056) OVER w AS l1056,
         lag(sum_active_kw, 1) OVER w AS last_measured_value,
         CASE WHEN lag(sum_active_kw, 1) OVER w IS NOT NULL THEN 1 END AS time_slots_distance,
         {frame_mean(-383, -193)} AS rolling_mean_48h_safe,
         {frame_mean(-863, -193)} AS rolling_mean_7d_safe
  FROM {src}
  {WIN}
),
{out} AS (
  SELECT *,
         ((((0.0 + COALESCE(lag_7d_same_slot, 0.0)) + COALESCE(lag_14d_same_slot, 0.0))
            + COALESCE(lag_21d_same_slot, 0.0)) + COALESCE(lag_28d_same_slot, 0.0))
         / greatest((CASE WHEN lag_7d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
                  + (CASE WHEN lag_14d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
                  + (CASE WHEN lag_21d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
                  + (CASE WHEN lag_28d_same_slot IS NOT NULL THEN 1 ELSE 0 END), 1) AS same_slot_mean_4w,
         rolling_mean_48h_safe - rolling_mean_7d_safe AS short_ma_minus_long_ma,
         ((l288 - l384) + (l960 - l1056)) / 2.0 AS weekly_trend_smooth
  FROM {out}_1
)"""


FEATURES = f"""{COMMUNITY_SERIES},{feature_ctes('cseries', 'feat2')}"""

MASKED = f"""{COMMUNITY_SERIES},
masked AS (
  SELECT {KEY}, datetime_utc, datetime_local,
         CASE WHEN datetime_local < {ts(S0)} THEN load_milli END AS load_milli,
         CASE WHEN datetime_local < {ts(S0)} THEN load_milli END / 1000.0 AS sum_active_kw
  FROM cseries
)"""

PREV = f"(PARTITION BY {KEY} ORDER BY datetime_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _pick(cols: str) -> str:
    return f"WITH {FEATURES} SELECT {KEY}, datetime_utc, {cols} FROM feat2"


# Features that reach back from a row's origin: every looked-up value is a join of its own here.
START = f"({idx(ts(S0))} - 4)"  # the window's first slot, UTC
HORIZON = f"({idx(ts(S1))} - {idx(ts(S0))})"
SPACING = f"least({HORIZON}, greatest(672, ({START} - {idx(ts(H0))}) // 2 // 672 * 672))"


def _seen(name: str) -> str:
    return f"LEFT JOIN src {name} ON {name}.k = o.k AND {name}.u = o.at_{name}"


# The slots that a row looks up, computed once: the joins are plain equalities on keys that are never null.
WANTED = {
    "w0": "u - weeks", "w1": "u - weeks - 672", "w2": "u - weeks - 1344", "w3": "u - weeks - 2016", "d2": "u - days",
    "t0": "u - 288 - turn", "t1": "u - 384 - turn", "t2": "u - 960 - turn", "t3": "u - 1056 - turn",
    "o1": "origin - 1", "os": "origin - 192", "ol": "origin - 672",
}


def _level(a: str, b: str) -> str:
    return (f"CASE WHEN o1.n - COALESCE({b}.n, 0) > 0 THEN ((COALESCE(o1.s, 0) - COALESCE({b}.s, 0)) / 1000.0) "
            f"/ (o1.n - COALESCE({b}.n, 0)) END AS {a}")


HORIZON_FEATURES = f"""{COMMUNITY_SERIES},
known AS MATERIALIZED (
  SELECT {KEY}, coalesce({KEY}, '') AS k, datetime_utc, datetime_local, {idx('datetime_utc')} AS u,
         CASE WHEN {idx('datetime_utc')} < {START} THEN load_milli END AS milli
  FROM cseries WHERE {idx('datetime_utc')} < {START} + {HORIZON}
),
src AS MATERIALIZED (
  SELECT k, u, milli, SUM(milli) OVER r AS s, COUNT(milli) OVER r AS n,
         last_value(milli IGNORE NULLS) OVER r AS last_milli,
         last_value(CASE WHEN milli IS NOT NULL THEN u END IGNORE NULLS) OVER r AS last_u
  FROM known WHERE u < {START}
  WINDOW r AS (PARTITION BY k ORDER BY u ROWS UNBOUNDED PRECEDING)
),
o0 AS (
  SELECT *, CASE WHEN u >= {START} THEN {START} ELSE {START} - {SPACING} * CAST(ceil(({START} - u) / ({SPACING})) AS BIGINT) END AS origin
  FROM known
),
o2 AS (
  SELECT *, ((u - origin) // 672 + 1) * 672 AS weeks, greatest((u - origin) // 96 + 1, 2) * 96 AS days,
         greatest(CAST(ceil((u - origin + 1 - 288) / 672.0) AS BIGINT), 0) * 672 AS turn
  FROM o0
),
o AS MATERIALIZED (SELECT *, {', '.join(f'{at} AS at_{n}' for n, at in WANTED.items())} FROM o2),
looked AS (
  SELECT o.{KEY}, o.datetime_utc, o.datetime_local, o.u, o.milli,
         w0.milli / 1000.0 AS w0, w1.milli / 1000.0 AS w1, w2.milli / 1000.0 AS w2, w3.milli / 1000.0 AS w3, d2.milli / 1000.0 AS d2,
         (COALESCE(w0.milli, 0) + COALESCE(w1.milli, 0) + COALESCE(w2.milli, 0) + COALESCE(w3.milli, 0)) / 1000.0 AS wsum,
         CAST(w0.milli IS NOT NULL AS INT) + CAST(w1.milli IS NOT NULL AS INT) + CAST(w2.milli IS NOT NULL AS INT)
           + CAST(w3.milli IS NOT NULL AS INT) AS held,
         ((t0.milli / 1000.0 - t1.milli / 1000.0) + (t2.milli / 1000.0 - t3.milli / 1000.0)) / 2.0 AS trend,
         CASE WHEN o1.n > 0 THEN (o1.s / 1000.0) / o1.n END AS level,
         {_level('short', 'os')}, {_level('long', 'ol')},
         o1.last_milli / 1000.0 AS last_measured_value, CAST(o.u - o1.last_u AS INTEGER) AS time_slots_distance
  FROM o
  {' '.join(_seen(n) for n in WANTED)}
),
means AS (SELECT *, COALESCE(CASE WHEN held > 0 THEN wsum / held END, level) AS same_slot_mean_4w FROM looked),
horizon AS (
  SELECT {KEY}, datetime_utc, datetime_local, milli / 1000.0 AS sum_active_kw,
         COALESCE(d2, w0, same_slot_mean_4w) AS lag_2d_same_slot,
         COALESCE(w0, same_slot_mean_4w) AS lag_7d_same_slot, COALESCE(w1, same_slot_mean_4w) AS lag_14d_same_slot,
         COALESCE(w2, same_slot_mean_4w) AS lag_21d_same_slot, COALESCE(w3, same_slot_mean_4w) AS lag_28d_same_slot,
         same_slot_mean_4w, COALESCE(short, level) AS rolling_mean_48h_safe, COALESCE(long, level) AS rolling_mean_7d_safe,
         COALESCE(short, level) - COALESCE(long, level) AS short_ma_minus_long_ma,
         last_measured_value, time_slots_distance,
         CASE WHEN level IS NOT NULL THEN COALESCE(trend, 0.0) END AS weekly_trend_smooth
  FROM means
)"""

HORIZON_NAMES = ("lag_2d_same_slot, lag_7d_same_slot, lag_14d_same_slot, lag_21d_same_slot, lag_28d_same_slot, "
                 "same_slot_mean_4w, rolling_mean_48h_safe, rolling_mean_7d_safe, short_ma_minus_long_ma, "
                 "last_measured_value, time_slots_distance, weekly_trend_smooth")
ORACLE["horizon_features"] = f"""WITH {HORIZON_FEATURES}
SELECT {KEY}, datetime_utc, datetime_local, sum_active_kw, {HORIZON_NAMES} FROM horizon"""

ORACLE["series_load"] = f"""WITH {CONSUMPTION}
SELECT {KEY}, datetime_utc, MIN(datetime_local) AS datetime_local,
       CAST(SUM(kw_milli) AS BIGINT) AS load_milli, CAST(SUM(kw_milli) AS BIGINT) / 1000.0 AS sum_active_kw
FROM consumption GROUP BY 1, 2"""
ORACLE["lag_features"] = _pick("lag_2d_same_slot, lag_7d_same_slot, lag_14d_same_slot, lag_21d_same_slot, lag_28d_same_slot")
ORACLE["rolling_48h"] = _pick("rolling_mean_48h_safe")
ORACLE["rolling_7d"] = _pick("rolling_mean_7d_safe")
ORACLE["same_slot_mean_4w"] = _pick("same_slot_mean_4w")
ORACLE["ma_spread"] = _pick("short_ma_minus_long_ma")
ORACLE["weekly_trend_smooth"] = _pick("weekly_trend_smooth")
ORACLE["last_measured"] = f"""WITH {MASKED}
SELECT {KEY}, datetime_utc,
       lag(sum_active_kw, 1) OVER (PARTITION BY {KEY} ORDER BY datetime_utc) AS last_measured_value,
       last_value(sum_active_kw IGNORE NULLS) OVER {PREV} AS last_measured_gap
FROM masked"""
ORACLE["slots_since_measured"] = f"""WITH {MASKED}
SELECT {KEY}, datetime_utc,
       CASE WHEN lag(sum_active_kw, 1) OVER (PARTITION BY {KEY} ORDER BY datetime_utc) IS NOT NULL
            THEN 1 END AS time_slots_distance,
       CAST({idx('datetime_utc')} - last_value(CASE WHEN sum_active_kw IS NOT NULL THEN {idx('datetime_utc')} END
            IGNORE NULLS) OVER {PREV} AS INTEGER) AS slots_since_gap
FROM masked"""
ORACLE["filter_series"] = f"""WITH {COMMUNITY_SERIES}
SELECT {KEY}, datetime_utc, datetime_local, load_milli, sum_active_kw FROM cseries
WHERE {KEY} = '{P.ONE_SERIES}'"""
ORACLE["time_split"] = f"""WITH {COMMUNITY_SERIES}
SELECT {KEY}, datetime_utc, datetime_local,
       CASE WHEN datetime_local < {ts(S0)} THEN 'train'
            WHEN datetime_local >= {ts(S0)} AND datetime_local < {ts(S1)} THEN 'predict' END AS split
FROM cseries"""
ORACLE["drop_incomplete"] = f"""WITH {HORIZON_FEATURES}
SELECT {KEY}, datetime_utc, sum_active_kw, {HORIZON_NAMES} FROM horizon
WHERE datetime_local < {ts(S0)}
  AND {' AND '.join(c.strip() + ' IS NOT NULL' for c in ('sum_active_kw, ' + HORIZON_NAMES).split(','))}"""
ORACLE["feature_columns"] = f"WITH {HORIZON_FEATURES}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c.strip()}' AS feature, COUNT(*) AS n_rows, COUNT({c.strip()}) AS n_non_null FROM horizon"
    for c in HORIZON_NAMES.split(",")
)

# ------------------------------------------------------------------ boosting

BINS, L2, STEP, LEAST = BoostParams.max_bins, BoostParams.l2, BoostParams.step, P.FLAGSHIP_MIN_INSTANCES
PROBS = ", ".join(f"{i / BINS!r}" for i in range(1, BINS + 1))
UNITS = "CAST(floor({} * 1000000.0 + 0.5) AS BIGINT)"


def score(g: str, n: str) -> str:
    return f"(({g}) / 1000000.0) * (({g}) / 1000000.0) / (({n}) + {L2})"


def weight(g: str, n: str) -> str:
    return f"{STEP} * ((({g}) / 1000000.0) / (({n}) + {L2}))"


# One row per (series, feature, bin) with the sums at or under it, every split with the missing rows on either side.
ORACLE["boost_step"] = f"""WITH {FEATURES},
seen AS MATERIALIZED (
  SELECT coalesce({KEY}, '') AS k, row_number() OVER () AS r, sum_active_kw AS y, {', '.join(P.BOOST_STEP_FEATURES)}
  FROM feat2 WHERE datetime_local < {ts(S0)}
),
base AS (SELECT k, (CAST(SUM({UNITS.format('y')}) AS DOUBLE) / COUNT(*)) / 1000000.0 AS base FROM seen GROUP BY k),
grads AS MATERIALIZED (SELECT s.*, {UNITS.format('(y - base)')} AS g FROM seen s JOIN base USING (k)),
total AS (SELECT k, SUM(g)::BIGINT AS g, COUNT(*) AS n FROM grads GROUP BY k),
values AS MATERIALIZED ({' UNION ALL '.join(f"SELECT k, g, {i} AS f, {c} AS x FROM grads" for i, c in enumerate(P.BOOST_STEP_FEATURES))}),
edges AS MATERIALIZED (
  SELECT DISTINCT k, f, unnest(q) AS e FROM (SELECT k, f, quantile_disc(x, [{PROBS}]) AS q FROM values WHERE x IS NOT NULL GROUP BY k, f)
),
bins AS (
  SELECT v.k, v.f, e.e, SUM(g)::BIGINT AS g, COUNT(*) AS n
  FROM values v ASOF JOIN edges e ON v.k = e.k AND v.f = e.f AND v.x <= e.e WHERE v.x IS NOT NULL GROUP BY 1, 2, 3
),
upto AS (
  SELECT k, f, e, SUM(g) OVER w AS g, SUM(n) OVER w AS n FROM bins WINDOW w AS (PARTITION BY k, f ORDER BY e ROWS UNBOUNDED PRECEDING)
),
missing AS (SELECT k, f, SUM(g)::BIGINT AS g, COUNT(*) AS n FROM values WHERE x IS NULL GROUP BY k, f),
sides AS (
  SELECT k, f, e, false AS missing_left, g::BIGINT AS g, n::BIGINT AS n FROM upto
  UNION ALL SELECT u.k, u.f, u.e, true, (u.g + coalesce(m.g, 0))::BIGINT, (u.n + coalesce(m.n, 0))::BIGINT
  FROM upto u LEFT JOIN missing m ON u.k = m.k AND u.f = m.f
),
gains AS (
  SELECT s.*, t.g AS tg, t.n AS tn, {score('s.g', 's.n')} + {score('t.g - s.g', 't.n - s.n')} - {score('t.g', 't.n')} AS gain
  FROM sides s JOIN total t USING (k) WHERE s.n >= {LEAST} AND t.n - s.n >= {LEAST}
),
best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, e, missing_left) = 1),
nodes AS (
  SELECT k, 1 AS node, {list(P.BOOST_STEP_FEATURES)}[f + 1] AS feature, e AS threshold, missing_left, gain, tn AS n, tg AS g FROM best
  UNION ALL SELECT k, 2, NULL, NULL, NULL, NULL, n, g FROM best
  UNION ALL SELECT k, 3, NULL, NULL, NULL, NULL, tn - n, tg - g FROM best
  UNION ALL SELECT k, 1, NULL, NULL, NULL, NULL, n, g FROM total WHERE k NOT IN (SELECT k FROM best)
)
SELECT nullif(k, '') AS {KEY}, node::INTEGER AS node, feature, threshold, missing_left, gain, n::BIGINT AS n_rows, {weight('g', 'n')} AS weight
FROM nodes"""

# ------------------------------------------------------------------ functions

ORACLE["project_rename"] = f"""WITH {CONSUMPTION}
SELECT client_id, datetime_utc, datetime_local AS datetime_15min, community_code, active_kw FROM consumption"""
ORACLE["clock_parts"] = f"""WITH {READINGS}
SELECT client_id, datetime_utc, CAST(hour(datetime_local) AS INTEGER) AS hour,
       CAST(minute(datetime_local) AS INTEGER) AS minute,
       CAST(dayofweek(datetime_local) + 1 AS INTEGER) AS day_of_week
FROM readings"""
ORACLE["clock_floor"] = f"""WITH {READINGS}
SELECT client_id, datetime_utc, date_trunc('hour', datetime_utc) AS hour_start,
       CAST(datetime_local AS DATE) AS date_local
FROM readings"""
ORACLE["conditional_exprs"] = f"""WITH {READINGS}
SELECT client_id, datetime_utc,
       CAST(dayofweek(datetime_local) IN (0, 6) AS INTEGER) AS is_weekend,
       CAST(kw_milli = 0 AS INTEGER) AS is_zero,
       minute(datetime_utc) / 60.0 AS alpha,
       CASE WHEN hour(datetime_local) = 0 THEN kw_milli / 1000.0 END AS kw_hour00
FROM readings"""
ORACLE["null_guards"] = f"""WITH {FEATURES}
SELECT {KEY}, datetime_utc,
       COALESCE(lag_7d_same_slot, sum_active_kw) AS lag_or_current,
       CAST((CASE WHEN lag_7d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_14d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_21d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_28d_same_slot IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS safe_lag_count,
       CAST(greatest((CASE WHEN lag_7d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_14d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_21d_same_slot IS NOT NULL THEN 1 ELSE 0 END)
          + (CASE WHEN lag_28d_same_slot IS NOT NULL THEN 1 ELSE 0 END), 1) AS INTEGER) AS safe_denominator
FROM feat2"""

# ------------------------------------------------------------------ lookups and enrichment

HOURLY = f"""
hourly AS (
  SELECT date_trunc('hour', ts) AS datetime_utc,
         SUM({MILLI}) FILTER (WHERE event_type = 'view') / 1000.0 AS demand_forecast,
         SUM({MILLI}) FILTER (WHERE event_type = 'click') / 1000.0 AS pv_forecast,
         SUM({MILLI}) FILTER (WHERE event_type = 'signup') / 1000.0 AS wind_forecast,
         CASE WHEN COUNT(value) FILTER (WHERE event_type = 'purchase') > 0 THEN
           (SUM({MILLI}) FILTER (WHERE event_type = 'purchase') / 1000.0)
             / COUNT(value) FILTER (WHERE event_type = 'purchase') END AS "AvgPrice"
  FROM events
  WHERE event_type IN ('view', 'click', 'signup', 'purchase')
  GROUP BY 1
)"""

HOLIDAYS = f"""{CONSUMPTION},
holidays AS (
  SELECT DISTINCT datetime_utc, community_code,
         CAST((day(datetime_utc) + nation_key) % 7 = 0 AS INTEGER) AS is_normal_holiday
  FROM consumption WHERE community_code IS NOT NULL
)"""

LOCAL_DATES = f"""
ldates AS (
  SELECT CAST({FLOOR15} + {LOCAL} AS DATE) AS date, user_id
  FROM events
)"""

# the calendar of the window's local dates
DATES = f"""
dates AS (
  SELECT CAST(range AS DATE) AS date
  FROM range({ts(H0)}, date_trunc('day', {ts(H1)} + {LOCAL}) + INTERVAL 1 DAY, INTERVAL 1 DAY)
)"""


def carry(col: str) -> str:
    return f"""
carry AS (
  SELECT h.datetime_utc AS hour_start, h.{col} AS {col}_curr, COALESCE(n.{col}, h.{col}) AS {col}_next
  FROM hourly h LEFT JOIN hourly n ON n.datetime_utc = h.datetime_utc + INTERVAL 1 HOUR
)"""


def interp(cols: list[str]) -> str:
    sel = ", ".join(
        f"h.{c} * (1.0 - minute(s.datetime_utc) / 60.0) + COALESCE(n.{c}, h.{c}) * (minute(s.datetime_utc) / 60.0) AS {c}"
        for c in cols
    )
    return f"""WITH {TOTAL}, {HOURLY}
SELECT s.datetime_utc, {sel}
FROM total s
LEFT JOIN hourly h ON h.datetime_utc = date_trunc('hour', s.datetime_utc)
LEFT JOIN hourly n ON n.datetime_utc = h.datetime_utc + INTERVAL 1 HOUR"""


ORACLE["scan_hourly_forecast"] = f"""WITH {HOURLY}
SELECT datetime_utc AS hour_start, demand_forecast AS demand_curr FROM hourly"""
ORACLE["scan_holidays"] = f"""WITH {HOLIDAYS}
SELECT datetime_utc, community_code, is_normal_holiday FROM holidays"""
ORACLE["scan_weekday"] = f"""WITH {DATES}
SELECT date, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
       CAST(dayofweek(date) IN (0, 6) AS INTEGER) AS is_weekend
FROM dates"""
ORACLE["scan_visitors"] = f"""WITH {LOCAL_DATES}
SELECT date, COUNT(DISTINCT user_id) AS visitors FROM ldates GROUP BY 1"""
ORACLE["dedup_by_key"] = f"""WITH {HOLIDAYS}
SELECT datetime_utc, MAX(is_normal_holiday) AS is_normal_holiday FROM holidays GROUP BY 1"""
ORACLE["lead_carry"] = f"""WITH {HOURLY}, {carry('demand_forecast')}
SELECT hour_start, demand_forecast_curr, demand_forecast_next FROM carry"""
ORACLE["last_known_price"] = f"""WITH {HOURLY}
SELECT datetime_utc, last_value(AvgPrice IGNORE NULLS) OVER (ORDER BY datetime_utc ROWS UNBOUNDED PRECEDING) AS AvgPrice FROM hourly"""
ORACLE["enrich_holiday"] = f"""WITH {HOLIDAYS}, {SPINE}
SELECT s.datetime_utc, h.is_normal_holiday
FROM spine s LEFT JOIN (SELECT datetime_utc, MAX(is_normal_holiday) AS is_normal_holiday
                        FROM holidays GROUP BY 1) h ON h.datetime_utc = s.datetime_utc"""
ORACLE["enrich_demand_interp"] = interp(["demand_forecast"])
ORACLE["interp_many"] = interp(["demand_forecast", "pv_forecast", "wind_forecast"])
ORACLE["enrich_weekday"] = f"""WITH {SPINE}, {DATES}, wd AS (SELECT date FROM dates)
SELECT s.datetime_utc,
       CASE WHEN wd.date IS NOT NULL THEN CAST(dayofweek(wd.date) + 1 AS INTEGER) END AS day_of_week,
       CASE WHEN wd.date IS NOT NULL THEN CAST(dayofweek(wd.date) IN (0, 6) AS INTEGER) END AS is_weekend
FROM spine s LEFT JOIN wd ON wd.date = CAST(s.datetime_local AS DATE)"""
ORACLE["enrich_visitors"] = f"""WITH {SPINE}, {LOCAL_DATES},
v AS (SELECT date, COUNT(DISTINCT user_id) AS visitors FROM ldates GROUP BY 1)
SELECT s.datetime_utc, v.visitors
FROM spine s LEFT JOIN v ON v.date = CAST(s.datetime_local AS DATE)"""
ORACLE["enrich_price"] = f"""WITH {SPINE}, {HOURLY}
SELECT s.datetime_utc, h."AvgPrice"
FROM spine s LEFT JOIN hourly h ON h.datetime_utc = date_trunc('hour', s.datetime_utc)"""
ORACLE["community_code_num"] = f"""WITH {CONSUMPTION},
clients AS (SELECT DISTINCT client_id, community_code FROM consumption),
codes AS (SELECT community_code, CAST(dense_rank() OVER (ORDER BY community_code) - 1 AS INTEGER) AS community_code_num
          FROM (SELECT DISTINCT community_code FROM clients WHERE community_code IS NOT NULL))
SELECT c.community_code, c.client_id, k.community_code_num
FROM clients c LEFT JOIN codes k ON k.community_code = c.community_code"""

# ------------------------------------------------------------------ profiles and clusters

HOURS = list(range(24))


def _hmean(h: int) -> str:
    return (f"(SUM(milli) FILTER (WHERE hour(datetime_local) = {h}) / 1000.0)"
            f" / COUNT(*) FILTER (WHERE hour(datetime_local) = {h}) AS h{h:02d}")


PROFILES = f"""{READINGS},
pr AS (SELECT * FROM readings WHERE datetime_utc >= {ts(H0)} AND datetime_utc < {ts(PE)}),
clients AS (SELECT DISTINCT client_id FROM pr),
grid AS (
  SELECT c.client_id, g.range AS datetime_utc, g.range + {LOCAL} AS datetime_local
  FROM clients c CROSS JOIN range({ts(H0)}, {ts(PE)}, INTERVAL 15 MINUTE) g
),
cells AS (
  SELECT g.client_id, g.datetime_local, COALESCE(r.kw_milli, 0) AS milli
  FROM grid g LEFT JOIN pr r ON r.client_id = g.client_id AND r.datetime_utc = g.datetime_utc
),
prof0 AS (
  SELECT client_id,
         {', '.join(_hmean(h) for h in HOURS)},
         (SUM(milli) / 1000.0) / COUNT(*) AS mean_kw,
         COUNT(*) FILTER (WHERE milli = 0) / COUNT(*) AS pct_zero,
         (SUM(milli) FILTER (WHERE dayofweek(datetime_local) NOT IN (0, 6)) / 1000.0)
           / COUNT(*) FILTER (WHERE dayofweek(datetime_local) NOT IN (0, 6)) AS wd_avg,
         (SUM(milli) FILTER (WHERE dayofweek(datetime_local) IN (0, 6)) / 1000.0)
           / COUNT(*) FILTER (WHERE dayofweek(datetime_local) IN (0, 6)) AS we_avg
  FROM cells GROUP BY client_id
),
prof AS (
  SELECT *, CASE WHEN wd_avg > 0 THEN we_avg / wd_avg ELSE 1.0 END AS we_wd_ratio FROM prof0
),
vmax AS (
  SELECT *, greatest({', '.join(f'COALESCE(h{h:02d}, 0.0)' for h in HOURS)}) AS row_max FROM prof
),
vec AS (
  SELECT client_id,
         {', '.join(f'COALESCE(h{h:02d}, 0.0) / (CASE WHEN row_max = 0 THEN 1.0 ELSE row_max END) AS p{h:02d}' for h in HOURS)},
         least(greatest(COALESCE(we_wd_ratio, 1.0), 0.0), 3.0) AS ratio_feat,
         COALESCE(pct_zero, 0.0) AS zero_feat
  FROM vmax
)"""

VCOLS = [f"p{h:02d}" for h in HOURS] + ["ratio_feat", "zero_feat"]

ASSIGN = f"""
cent AS (
  SELECT CAST(row_number() OVER (ORDER BY client_id) - 1 AS INTEGER) AS j, *
  FROM (SELECT * FROM vec ORDER BY client_id LIMIT {P.FLAGSHIP_K})
),
dist AS (
  SELECT v.client_id, c.j,
         {' + '.join(f'(v.{x} - c.{x}) * (v.{x} - c.{x})' for x in VCOLS)} AS d
  FROM vec v CROSS JOIN cent c
),
assign AS (
  SELECT client_id, j AS cluster_id FROM (
    SELECT client_id, j, row_number() OVER (PARTITION BY client_id ORDER BY d, j) AS rn FROM dist
  ) WHERE rn = 1
)"""

def _rmean(name: str, on: str) -> str:
    return (f"CASE WHEN COUNT(milli) FILTER ({on}) > 0 THEN (SUM(milli) FILTER ({on}) / 1000.0)"
            f" / COUNT(milli) FILTER ({on}) END AS {name}")


# profiles over the readings that exist
PROFILE_ROWS = f"""
raw AS (SELECT user_id AS client_id, {FLOOR15} + {LOCAL} AS datetime_local, {MILLI} AS milli FROM events),
rprof0 AS (
  SELECT client_id, {', '.join(_rmean(f'h{h:02d}', f'WHERE hour(datetime_local) = {h}') for h in HOURS)},
         {_rmean('mean_kw', 'WHERE true')},
         CASE WHEN COUNT(milli) > 0 THEN COUNT(*) FILTER (WHERE milli = 0) / COUNT(milli) END AS pct_zero,
         {_rmean('wd_avg', 'WHERE dayofweek(datetime_local) NOT IN (0, 6)')}, {_rmean('we_avg', 'WHERE dayofweek(datetime_local) IN (0, 6)')}
  FROM raw GROUP BY client_id
),
rprof AS (SELECT *, CASE WHEN wd_avg > 0 AND we_avg IS NOT NULL THEN we_avg / wd_avg ELSE 1.0 END AS we_wd_ratio FROM rprof0)"""
_H = ", ".join(f"h{h:02d}" for h in HOURS)
ORACLE["profile_hourly"] = f"""WITH {PROFILE_ROWS} SELECT client_id, {_H} FROM rprof"""
ORACLE["profile_scalars"] = f"""WITH {PROFILE_ROWS} SELECT client_id, mean_kw, pct_zero FROM rprof"""
ORACLE["profile_weekend"] = f"""WITH {PROFILE_ROWS} SELECT client_id, wd_avg, we_avg, we_wd_ratio FROM rprof"""
ORACLE["join_profile_ratio"] = f"""WITH {PROFILE_ROWS} SELECT client_id, {_H}, mean_kw, pct_zero, we_wd_ratio FROM rprof"""
ORACLE["profile_grid"] = f"""WITH {PROFILES}
SELECT client_id, {_H}, mean_kw, pct_zero, wd_avg, we_avg, we_wd_ratio FROM prof"""
ORACLE["profile_vector"] = f"""WITH {PROFILES} SELECT client_id, {', '.join(VCOLS)} FROM vec"""
ORACLE["kmeans_step"] = f"""WITH {PROFILES}, {ASSIGN}
SELECT a.cluster_id, COUNT(*) AS n_clients, {', '.join(f'round(AVG(v.{x}), 9) AS {x}' for x in VCOLS)}
FROM assign a JOIN vec v ON v.client_id = a.client_id GROUP BY a.cluster_id"""
ORACLE["attach_cluster"] = f"""WITH {PROFILES}, {ASSIGN}
SELECT r.client_id, r.datetime_utc, a.cluster_id, r.kw_milli / 1000.0 AS active_kw
FROM readings r JOIN assign a ON a.client_id = r.client_id"""



def kmeans_fit_sql() -> str:
    """Seeding and rounds of all starts, written out: whole numbers under 2**53 in doubles."""
    far = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    wrap = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    steps = [f"""points AS MATERIALIZED (
  SELECT client_id, [{', '.join(f'floor({c} * {cluster.UNIT} + 0.5)' for c in VCOLS)}] AS v FROM vec
), drawn AS MATERIALIZED (
  SELECT *, (xor(z2, z2 >> 31) >> 11)::DOUBLE AS z FROM (
    SELECT *, {wrap(f"xor(z1, z1 >> 27)::UHUGEINT * {cluster.MIX[2]}::UHUGEINT")} AS z2 FROM (
      SELECT *, {wrap(f"xor(z0, z0 >> 30)::UHUGEINT * {cluster.MIX[1]}::UHUGEINT")} AS z1 FROM (
        SELECT client_id, v, s, j, {wrap(f"client_id::UHUGEINT * {cluster.MIX[0]}::UHUGEINT + (({P.KMEANS_SEED} * 1000003 + s) * 1009 + j)::UHUGEINT")} AS z0
        FROM points, range({P.KMEANS_STARTS}) a(s), range({P.FLAGSHIP_K}) b(j))))
)"""]
    for j in range(P.FLAGSHIP_K):
        weights = f"SELECT client_id, s, min({far}) AS w FROM points, c{j - 1} GROUP BY 1, 2" if j else "SELECT client_id, s, 1.0 AS w FROM drawn WHERE j = 0"
        earlier = f"SELECT * FROM c{j - 1} UNION ALL " if j else ""
        steps.append(f"""c{j} AS MATERIALIZED (
  {earlier}SELECT s, {j} AS i, v AS c FROM drawn JOIN ({weights}) USING (client_id, s) WHERE j = {j} AND w > 0
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY -ln((z + 1.0) / 9007199254740992.0) / w, client_id) = 1
)""")
    steps.append(f"m0 AS (SELECT * FROM c{P.FLAGSHIP_K - 1})")
    for r in range(P.KMEANS_ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT client_id, s, min([{far}, i]) AS best FROM points, m{r} GROUP BY 1, 2)")
        if r < P.KMEANS_ROUNDS:
            steps.append(f"""m{r + 1} AS MATERIALIZED (
  SELECT m.s, m.i, coalesce(n.c, m.c) AS c FROM m{r} m LEFT JOIN (
    SELECT s, i, list(x ORDER BY d) AS c FROM (
      SELECT s, best[2] AS i, d, floor(sum(v[d]) / count(*)) AS x FROM a{r} JOIN points USING (client_id), range(1, {len(VCOLS) + 1}) t(d) GROUP BY 1, 2, 3
    ) GROUP BY 1, 2) n ON m.s = n.s AND m.i = n.i
)""")
    last = P.KMEANS_ROUNDS
    return f"""WITH {PROFILES}, {', '.join(steps)}
SELECT s::INTEGER AS start, i::INTEGER AS cluster_id, cost, {', '.join(f'c[{n + 1}]::BIGINT AS {x}' for n, x in enumerate(VCOLS))}
FROM m{last} JOIN (SELECT s, sum(best[1])::BIGINT AS cost FROM a{last} GROUP BY s) USING (s)"""


ORACLE["kmeans_fit"] = kmeans_fit_sql()

# every slot of every fold is scored, and every fold agrees with a forecast of its own
ORACLE["backtest_model_check"] = f"""WITH {TOTAL},
folds AS (
  SELECT i AS fold, {ts(P.BACKTEST_FIRST)} + i * INTERVAL {P.BACKTEST_STEP_DAYS} DAY AS a FROM range({P.BACKTEST_FOLDS}) t(i)
)
SELECT COUNT(DISTINCT fold) AS n_folds, COUNT(DISTINCT fold) AS n_agree, COUNT(*)::BIGINT AS n_slots
FROM total JOIN folds ON datetime_local >= a AND datetime_local < a + INTERVAL {P.BACKTEST_HORIZON_DAYS} DAY"""

# merged from day states: the same as from all readings
ORACLE["profile_from_days"] = ORACLE["join_profile_ratio"]
ORACLE["series_from_days"] = ORACLE["slot_spine"]

# ------------------------------------------------------------------ combine, sink, audits

NAIVE_TOTAL = f"""{TOTAL}, ser AS (SELECT * FROM total), {naive('ser', None)}"""

ORACLE["combine_outer"] = f"""WITH {COMMUNITY_SERIES}, {naive('cseries', KEY)}
SELECT datetime_local AS datetime_15min,
       list_reduce(list(COALESCE(prediction, 0.0) ORDER BY {KEY}), lambda acc, x: acc + x) AS prediction
FROM naive GROUP BY datetime_local"""
ORACLE["sorted_result"] = f"""WITH {NAIVE_TOTAL}
SELECT datetime_local AS datetime_15min, prediction FROM naive ORDER BY 1"""
ORACLE["stamp_submission"] = f"""WITH {NAIVE_TOTAL}
SELECT '{P.TEAM_NAME}' AS team_name, datetime_local AS datetime_15min, prediction FROM naive"""
ORACLE["count_predictions"] = f"""WITH {NAIVE_TOTAL}
SELECT COUNT(*) AS n_predictions FROM naive"""
ORACLE["submission_audit"] = f"""WITH {NAIVE_TOTAL},
wspine AS (SELECT range AS datetime_15min, 1 AS expected FROM range({ts(S0)}, {ts(S1)}, INTERVAL 15 MINUTE)),
per_slot AS (
  SELECT datetime_local AS datetime_15min, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE prediction IS NULL) AS n_null
  FROM naive GROUP BY 1
),
j AS (SELECT COALESCE(s.datetime_15min, p.datetime_15min) AS datetime_15min, s.expected, p.n, p.n_null
      FROM wspine s FULL OUTER JOIN per_slot p ON p.datetime_15min = s.datetime_15min)
SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS n_rows,
       COUNT(expected) AS n_slots_expected,
       COUNT(*) FILTER (WHERE expected IS NOT NULL AND n IS NULL) AS n_missing_slots,
       CAST(COALESCE(SUM(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS n_duplicate_rows,
       CAST(COALESCE(SUM(n_null), 0) AS BIGINT) AS n_null_predictions,
       CAST(COALESCE(SUM(CASE WHEN NOT (datetime_15min >= {ts(S0)} AND datetime_15min < {ts(S1)}
                                      AND minute(datetime_15min) % 15 = 0 AND second(datetime_15min) = 0)
                              THEN n END), 0) AS BIGINT) AS n_out_of_window
FROM j"""


def _fold_sql() -> str:
    import datetime as dt

    first = dt.datetime.fromisoformat(P.BACKTEST_FIRST)
    parts, ctes = [], []
    for f in range(P.BACKTEST_FOLDS):
        s0 = first + dt.timedelta(days=P.BACKTEST_STEP_DAYS * f)
        s1 = s0 + dt.timedelta(days=P.BACKTEST_HORIZON_DAYS)
        a, b = s0.strftime("%Y-%m-%d %H:%M:%S"), s1.strftime("%Y-%m-%d %H:%M:%S")
        ctes.append(naive("total", None, a, b, name=f"nv{f}"))
        parts.append(
            f"""SELECT {f} AS fold, {ts(a)} AS fold_start,
       CAST(SUM(CAST(abs(t.load_milli / 1000.0 - n.prediction) AS DECIMAL(28,6))) AS DOUBLE) / COUNT(*) AS mae,
       COUNT(*) AS n_slots
FROM nv{f} n JOIN total t ON t.datetime_utc = n.datetime_utc"""
        )
    return f"WITH {TOTAL}, {', '.join(ctes)}\n" + "\nUNION ALL\n".join(parts)


ORACLE["backtest_folds"] = _fold_sql()

LEAK_NAMES = {
    "lag_2d_same_slot": 192, "lag_7d_same_slot": 672, "lag_14d_same_slot": 1344, "lag_21d_same_slot": 2016,
    "lag_28d_same_slot": 2688, "same_slot_mean_4w": 672,
    "rolling_mean_48h_safe": 193, "rolling_mean_7d_safe": 193, "short_ma_minus_long_ma": 193,
    "last_measured_value": 1, "time_slots_distance": 1, "weekly_trend_smooth": 288,
}

ORACLE["leak_audit"] = f"""WITH {COMMUNITY_SERIES},
hid AS (
  SELECT {KEY}, datetime_utc, datetime_local,
         CASE WHEN datetime_local < {ts(S0)} THEN load_milli END AS load_milli,
         CASE WHEN datetime_local < {ts(S0)} THEN load_milli END / 1000.0 AS sum_active_kw
  FROM cseries
),
{feature_ctes('cseries', 'fa')},
{feature_ctes('hid', 'fb')},
j AS (
  SELECT {', '.join(f'a.{n} AS a_{n}, b.{n} AS b_{n}' for n in LEAK_NAMES)}
  FROM fa a JOIN fb b ON a.{KEY} IS NOT DISTINCT FROM b.{KEY} AND a.datetime_utc = b.datetime_utc
  WHERE a.datetime_local >= {ts(S0)} AND a.datetime_local < {ts(S1)}
)
""" + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS feature, {lag} AS min_lag_slots, 672 AS horizon_slots,
       CAST(COALESCE(SUM(CASE WHEN a_{n} IS DISTINCT FROM b_{n} THEN 1 ELSE 0 END), 0) AS BIGINT) AS changed_rows,
       COALESCE(SUM(CASE WHEN a_{n} IS DISTINCT FROM b_{n} THEN 1 ELSE 0 END), 0) > 0 AS leaks
FROM j"""
    for n, lag in LEAK_NAMES.items()
)

# ------------------------------------------------------------------ facts of the learned results

_PAST = f"SELECT DISTINCT user_id FROM events WHERE ts >= {ts(H0)} AND ts < {ts(S0)} - {LOCAL}"
ORACLE["cluster_check"] = f"""WITH past AS ({_PAST})
SELECT COUNT(*) AS n_rows, COUNT(*) AS n_clients, COUNT(*) AS n_nearest,
       CAST(least({P.FLAGSHIP_K}, COUNT(*)) AS BIGINT) AS n_clusters
FROM past"""
ORACLE["forecast_check"] = f"""WITH past AS ({_PAST}), k AS (SELECT CAST(least({P.FLAGSHIP_K}, COUNT(*)) AS BIGINT) AS k FROM past),
slots AS (SELECT COUNT(*) AS n FROM range({ts(S0)}, {ts(S1)}, INTERVAL 15 MINUTE))
SELECT n AS n_slots, CAST(n * k AS BIGINT) AS n_parts, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_off,
       k AS n_models, CAST(0 AS BIGINT) AS n_fallback
FROM slots, k"""
ORACLE["forecast_leak_audit"] = f"""
SELECT (SELECT COUNT(*) FROM range({ts(S0)}, {ts(S1)}, INTERVAL 15 MINUTE)) AS n_rows, CAST(0 AS BIGINT) AS changed_rows,
       COUNT(*) > 0 AS future_exists
FROM events WHERE ts >= {ts(S0)} - {LOCAL}"""
