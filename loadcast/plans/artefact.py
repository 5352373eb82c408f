"""Fitted forecasters as stored artefacts: saved under a name, loaded in any later session.

An artefact is a part of a ``Versions`` table, so it appears whole or not at
all: a row of settings, a row per series, a row per node of every tree.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.operators.boost import BoostParams, SeriesModel, model_nodes, new_tree
from loadcast.plans.forecast import ClusterBoostForecaster, Lookups
from loadcast.sources.versions import Versions

ARTEFACT = (
    "model string, kind string, series int, text string, round int, node int, feature int, threshold double, "
    "missing_left boolean, gain double, n_rows long, weight double"
)
SETTINGS = ("history_start", "k", "n_init", "seed", "local_shift", "key", "on_missing", "incomplete", "validation_slots", "readings_are_cells", "profile_grid", "map_broadcast_bytes")


class StoredModels:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Versions(spark, path, "model", ARTEFACT)

    def save(self, name: str, forecaster: ClusterBoostForecaster, models: dict, feats: DataFrame) -> None:
        """Stores the fit under ``name``, in place of an earlier one; ``feats`` is the frame it was fitted on."""
        features = forecaster.feature_columns(feats)
        settings = {k: getattr(forecaster, k) for k in SETTINGS} | {
            "boost": asdict(forecaster.boost), "features": features, "centres": forecaster.info["whole_centres"], "lookups": forecaster.lookups.feature_names(),
        }
        own = [(name, "settings", None, json.dumps(settings), None, None, None, None, None, None, None, None)]
        for series, m in models.items():
            own.append((name, "series", series, json.dumps(m.errors), len(m.trees), None, None, None, None, None, m.n_rows, m.base))
        place = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
        key = forecaster.key
        nodes = model_nodes(models, feats, key, features).select(
            F.lit(name).alias("model"), F.lit("node").alias("kind"), F.col(key).cast("int").alias("series"), F.lit(None).cast("string").alias("text"),
            "round", "node", place[F.col("feature")].alias("feature"), "threshold", "missing_left", "gain", "n_rows", "weight",
        )
        rows = self.spark.createDataFrame(own, ARTEFACT).unionByName(nodes)
        total = len(own) + sum(int((t.rows > 0).sum()) for m in models.values() for t in m.trees)

        def check(staged: DataFrame) -> None:
            if (n := staged.count()) != total:
                raise ValueError(f"{n} rows staged where the fit has {total}")

        self.table.replace(rows, [name], check)

    def load(self, name: str, lookups: Lookups | None = None) -> tuple[ClusterBoostForecaster, dict]:
        """(forecaster, models): ``forecaster.predict_fitted(models, ...)`` forecasts any window without a fit.
        ``lookups`` must give the features that the fit has seen."""
        rows = self.table.read([name]).collect()  # an artefact is bounded by series, rounds and depth
        if not rows:
            raise KeyError(name)
        settings = json.loads(next(r.text for r in rows if r.kind == "settings"))
        boost = BoostParams(**settings["boost"])
        fc = ClusterBoostForecaster(lookups=lookups or Lookups(), boost=boost, centres=settings["centres"], **{k: settings[k] for k in SETTINGS})
        if fc.lookups.feature_names() != settings["lookups"]:
            raise ValueError(f"the fit has seen {settings['lookups']}, the lookups give {fc.lookups.feature_names()}")
        models = {
            r.series: SeriesModel(r.weight, [new_tree(boost.depth) for _ in range(r.round)], r.n_rows, [tuple(e) for e in json.loads(r.text)])
            for r in rows if r.kind == "series"
        }
        for r in rows:
            if r.kind == "node":
                t = models[r.series].trees[r.round]
                t.rows[r.node], t.weight[r.node] = r.n_rows, r.weight
                if r.feature is not None:
                    t.feature[r.node], t.threshold[r.node], t.missing_left[r.node], t.gain[r.node] = r.feature, r.threshold, r.missing_left, r.gain
        return fc, models
