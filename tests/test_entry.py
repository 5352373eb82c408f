"""The driver contract: entry() runs the flagship on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry_returns_one_forecast_row_per_slot(spark):
    df = entry.entry(spark)
    assert [(f.name, f.dataType.typeName()) for f in df.schema.fields] == [
        ("datetime_15min", "timestamp_ntz"),
        ("prediction", "double"),
    ]
    rows = df.collect()
    assert len(rows) == 672 and len({r.datetime_15min for r in rows}) == 672
    assert all(r.prediction is not None for r in rows)


def test_every_registered_query_is_callable_with_a_root():
    import inspect

    for name, fn in entry.queries().items():
        assert len(inspect.signature(fn).parameters) == 2, name
