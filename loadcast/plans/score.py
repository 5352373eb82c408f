"""Scoring run: readings in, a stamped submission written, its size counted.

    python -m loadcast.plans.score --consumption prod.meter.consumption \\
        --hourly prod.lookups.hourly --weekday prod.lookups.weekday \\
        --start "2024-12-01 00:00:00" --end "2025-03-01 00:00:00" \\
        --team my_team --out-table prod.submissions

Every input is a table of the catalog by its name or Parquet files by their
path.  ``--tables DIR`` reads the stored test tables instead and derives the
lookups that are not given from their history.  The forecast is written to
``--out`` (a path) or ``--out-table`` (a table partitioned by team), where it replaces this
team's rows in one step or not at all, then counted from what was written.
The run reports which series got a model and which fell back, and fails
when none was fitted.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.functions.clock import py_slot_index
from loadcast.operators import model, sink
from loadcast.plans.forecast import ClusterBoostForecaster, Forecaster, Lookups, local_to_utc
from loadcast.sources import (
    Catalog,
    calendar_holidays,
    daily_visitors,
    hourly_forecasts,
    project_daily,
    project_hourly,
    raw_readings,
    read_source,
    readings_from_consumption,
    restrict_time,
    weekday_dates,
)
from loadcast.sources.lookups import HOURLY_SIGNALS


def score(
    spark: SparkSession,
    forecaster: Forecaster,
    readings: DataFrame,
    predict_start: str,
    predict_end: str,
    team_name: str,
    out_path: str | None = None,
    out_table: str | None = None,
) -> int:
    """Predict, stamp, write (a row for every interval of the window, or nothing), and return the number
    of rows of this submission read back from where they were written."""
    if (out_path is None) == (out_table is None):
        raise ValueError("name a path or a table to write to")
    stamped = sink.stamp_submission(forecaster.predict(readings, predict_start, predict_end), team_name)
    start, end = (local_to_utc(t, forecaster.local_shift) for t in (predict_start, predict_end))
    slots = py_slot_index(end) - py_slot_index(start)
    if out_table is not None:
        sink.save_submission(stamped, out_table, team_name, slots)
        written = spark.table(out_table)
    else:
        sink.write_submission(stamped, out_path, team_name, slots)
        written = sink.submissions(spark, out_path).read([team_name])
    return sink.count_predictions(written.filter(F.col("team_name") == team_name)).collect()[0]["n_predictions"]


def lookups_from_tables(tables: Catalog, history_start: str, predict_start: str, predict_end: str, local_shift: str) -> Lookups:
    """Stand-ins from the stored tables for a forecast that starts at
    ``predict_start`` (local): hourly signals and visitors from readings before it,
    carried into the window by whole weeks; holidays and weekdays by the
    calendar.  An hour of the history without an event of a signal is zero."""
    start, end = local_to_utc(predict_start, local_shift), local_to_utc(predict_end, local_shift)
    past = restrict_time(tables.events, history_start, start)
    hourly = hourly_forecasts(past).fillna(0.0, list(HOURLY_SIGNALS))
    # local dates that the history holds whole
    first, last = predict_start[:10], predict_end[:10]
    return Lookups(
        hourly=project_hourly(hourly, start, end),
        holidays=calendar_holidays(tables.nation, history_start, end),
        weekday=weekday_dates(tables.spark, history_start[:10], last),
        visitors=project_daily(daily_visitors(past, local_shift), first, last),
    )


def main(argv: list[str] | None = None) -> int:
    from loadcast.session import build_session

    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder of the stored test tables")
    source.add_argument("--consumption", help="one row per client and slot: client_id, datetime_local, active_kw[, datetime_utc]")
    for name in ("hourly", "holidays", "weekday", "visitors"):
        ap.add_argument(f"--{name}", help=f"{name} lookup, a table name or a path")
    ap.add_argument("--history-start", default="2024-01-01 00:00:00")
    ap.add_argument("--start", required=True, help="forecast start, local clock, inclusive")
    ap.add_argument("--end", required=True, help="forecast end, local clock, exclusive")
    ap.add_argument("--team", required=True)
    target = ap.add_mutually_exclusive_group(required=True)
    target.add_argument("--out", help="path of Parquet files")
    target.add_argument("--out-table", help="table name")
    ap.add_argument("--local-shift", default="1 hour")
    ap.add_argument("--k", type=int, default=5)
    ap.add_argument("--n-init", type=int, default=20)
    ap.add_argument("--rounds", type=int, default=model.BoostParams().rounds, help="boosting rounds")
    ap.add_argument("--on-missing", choices=("naive", "error"), default="naive", help="series without a complete training row")
    args = ap.parse_args(argv)

    spark = SparkSession.getActiveSession() or build_session(app_name="loadcast-score")
    given = {n: read_source(spark, v) for n in ("hourly", "holidays", "weekday", "visitors") if (v := getattr(args, n))}
    if args.consumption:
        readings, lookups = readings_from_consumption(read_source(spark, args.consumption), args.local_shift), Lookups(**given)
    else:
        tables = Catalog(spark, args.tables)
        readings = raw_readings(tables.events, args.history_start, local_to_utc(args.end, args.local_shift), args.local_shift)
        derived = lookups_from_tables(tables, args.history_start, args.start, args.end, args.local_shift)
        lookups = Lookups(**{**vars(derived), **given})
    fc = ClusterBoostForecaster(
        history_start=args.history_start, lookups=lookups, k=args.k, n_init=args.n_init,
        boost=model.BoostParams(rounds=args.rounds), local_shift=args.local_shift,
        readings_are_cells=bool(args.consumption), on_missing=args.on_missing,
    )
    n = score(spark, fc, readings, args.start, args.end, args.team, args.out, args.out_table)
    print(f"models fitted for series {fc.info['fitted_series']}, seasonal-naive forecast for {fc.info['fallback_series']}")
    print(f"{n:,} predictions of {args.team} in {args.out or args.out_table}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
