"""One boosted-tree model per series (M4, M5); the trees are ``operators.boost``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.functions.exprs import MILLI
from loadcast.operators.boost import BoostParams, fit_boosted, predict_boosted


def complete_rows(df: DataFrame, feature_cols: list[str], label: str = "sum_active_kw") -> DataFrame:
    """Rows where the label and every feature are present."""
    return df.na.drop(how="any", subset=list(feature_cols) + [label])


def train_per_series(
    train: DataFrame,
    key: str,
    feature_cols: list[str],
    params: BoostParams = BoostParams(),
    label: str = "sum_active_kw",
    incomplete: str = "drop",
    held_out: str | None = None,
) -> tuple[dict, dict]:
    """M4: ``({series: model}, {series: n_rows})``.  Rows with a missing feature
    are dropped, as in the reference, or kept (``incomplete="learn"``): splits then
    learn which way a missing value goes.  A series without a row to learn from
    gets no model (the caller falls back)."""
    if incomplete not in ("drop", "learn"):
        raise ValueError(f"incomplete must be 'drop' or 'learn', not {incomplete!r}")
    rows = complete_rows(train, feature_cols, label) if incomplete == "drop" else train
    models = fit_boosted(rows, key, feature_cols, params, label, held_out=held_out)
    return models, {k: m.n_rows for k, m in models.items()}


def predict_per_series(
    models: dict,
    rows: DataFrame,
    key: str,
    feature_cols: list[str],
    carry: list[str] | None = None,
) -> DataFrame | None:
    """M5: ``key, datetime_utc, datetime_local, prediction`` (and the ``carry``
    columns) for the rows of every series with a model; rows with missing
    features are kept and go the way the splits learned."""
    return predict_boosted(models, rows, key, feature_cols, carry) if models else None


def training_error(models: dict, train: DataFrame, key: str, feature_cols: list[str], label: str = "sum_active_kw") -> DataFrame:
    """Mean absolute in-sample error per series (milli-kW resolution)."""
    scored = predict_per_series(models, complete_rows(train, feature_cols, label), key, feature_cols, carry=[label])
    err = F.abs(F.col(label) - F.col("prediction"))
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_train_rows"),
        (F.round(F.avg(err) * MILLI) / MILLI).alias("train_mae"),
    )
