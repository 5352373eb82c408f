"""Operators: ``DataFrame -> DataFrame`` steps of the forecasting workload.

calendar (spine, gap fill, slot counts), series (load per key and instant),
features (lags, rolling means, trends), enrich (lookups), profile (client day
shapes), cluster (k-means, attach), model (boosted trees per series),
baseline (seasonal naive), combine, evaluate (MAE, backtest), audit (leaks,
submission format), sink, joins (size-checked broadcast).
"""
