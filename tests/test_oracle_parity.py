"""Every registered query with a DuckDB twin returns the same rows (exact
values, order-insensitive) on the smallest stored tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loadcast.sources.tables import TABLE_NAMES

from .conftest import SMOKE_DIR


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(("nan",) if isinstance(v, float) and math.isnan(v) else v for v in r))
    return sorted(out, key=lambda r: tuple((0, "") if v is None else (1, repr(v)) for v in r))


SPARK_TO_DUCK = {
    "IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
    "TimestampNTZType()": "TIMESTAMP", "DateType()": "DATE", "BooleanType()": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    sdf = entry.queries()[name](spark, SMOKE_DIR)
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    d_types = {d[0]: str(d[1]) for d in res.description}
    for f in sdf.schema.fields:
        assert SPARK_TO_DUCK.get(repr(f.dataType)) == d_types[f.name], f.name
    order = sorted(sdf.columns)
    s_rows = [tuple(r[c] for c in order) for r in sdf.collect()]
    d_raw = res.fetchall()
    d_rows = [tuple(r[d_cols.index(c)] for c in order) for r in d_raw]
    assert len(s_rows) == len(d_rows)
    assert _norm(s_rows) == _norm(d_rows)


def test_every_query_has_a_callable_and_oracles_are_a_subset():
    from loadcast.plans.oracle import ORACLE
    from loadcast.plans.queries import QUERIES

    assert set(entry.oracle_sql()) <= set(entry.queries())
    # what only the learning operators' values decide is checked on rows and by facts (*_check, *_audit)
    assert set(QUERIES) - set(ORACLE) == {
        "cluster_clients", "cluster_map", "train_per_series", "predict_per_series", "forecast_total", "mae_forecast", "backtest_model",
    }
