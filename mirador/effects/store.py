"""Saving fitted effect models and loading them for another cohort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from mirador.effects.learners import EffectModel
from mirador.effects.two_head import TwoHead
from mirador.roles import Roles
from mirador.sources.artefacts import load_model, save_model

CARD = "kind string, learner string, base string, id string, t string, y string, " \
       "x array<string>, flags array<string>, width int, parts array<string>, weights array<double>"


def save_effect(spark: SparkSession, model: EffectModel | TwoHead, path: str) -> None:
    """A one-row table that says what the model is, and one folder per fitted part."""
    r = model.roles
    if isinstance(model, TwoHead):
        row = ("two_head", None, None, r.id, r.t, r.y, list(r.x), [], model.width, [],
               [float(w) for w in model.weights])
    else:
        row = ("learner", model.learner, model.base, r.id, r.t, r.y, list(r.x), list(model.flags),
               None, sorted(model.models), [])
        for name, part in model.models.items():
            save_model(part, f"{path}/{name}")
    spark.createDataFrame([row], CARD).coalesce(1).write.mode("overwrite").parquet(f"{path}/card")


def load_effect(spark: SparkSession, path: str) -> EffectModel | TwoHead:
    card = spark.read.schema(CARD).parquet(f"{path}/card").first()
    roles = Roles(card["id"], card["t"], card["y"], tuple(card["x"]))
    if card["kind"] == "two_head":
        return TwoHead(roles, card["width"], np.array(card["weights"]), [])
    models = {name: load_model(f"{path}/{name}").stages[0] for name in card["parts"]}
    return EffectModel(card["learner"], card["base"], roles, tuple(card["flags"]), models)
