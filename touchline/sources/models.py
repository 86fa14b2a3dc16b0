"""Frozen option models, held as rows of one parameter table.

A model is the ordered rows (model, ord, feature, mean, scale, coef) of its table; nothing else is
kept. ``model_violations`` checks a table of any number of models as a Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Feature order of the three nested models.
M0_FEATURES = ("distance", "longitudinal_displacement", "lateral_displacement")
M1_FEATURES = M0_FEATURES + (
    "nearest_receiver_defender_distance",
    "minimum_segment_defender_distance",
)
M2_FEATURES = M1_FEATURES + ("summed_segment_attenuation",)
FEATURES = {"m0": M0_FEATURES, "m1": M1_FEATURES, "m2": M2_FEATURES}


class Parameter(NamedTuple):
    model: str
    ord: int
    feature: str
    mean: float
    scale: float
    coef: float


Model = Sequence[Parameter]

# Scale of every feature, and coefficients of the demonstration models.
DEMO_SCALES = (20.0, 20.0, 20.0, 10.0, 10.0, 2.0)
DEMO_COEFFICIENTS = {
    "m0": (-1.0, 0.35, 0.0),
    "m1": (-1.0, 0.35, 0.0, 0.6, 1.2),
    "m2": (-1.0, 0.35, 0.0, 0.5, 1.0, -0.4),
}
DEMO_MODELS: dict[str, Model] = {
    model: tuple(Parameter(model, i, FEATURES[model][i], 0.0, DEMO_SCALES[i], coef) for i, coef in enumerate(coefs))
    for model, coefs in DEMO_COEFFICIENTS.items()
}

MODEL_SCHEMA = "model string, ord int, feature string, mean double, scale double, coef double"


def name_of(model: Model) -> str:
    return model[0].model


def contributions(model: Model) -> list[Column]:
    """What each feature adds to the utility, in the order of the table."""
    return [(F.col(row.feature) - row.mean) / row.scale * row.coef for row in model]


def utility(model: Model) -> Column:
    return reduce(add, contributions(model))


def model_table(spark: SparkSession, models: Sequence[Model] = tuple(DEMO_MODELS.values())) -> DataFrame:
    return spark.createDataFrame([tuple(row) for model in models for row in model], MODEL_SCHEMA)


def model_violations(models: DataFrame, *ids: str) -> DataFrame:
    """(model, ids, ord, rule) for every broken parameter rule of a table of models.

    ``ids`` tell apart several tables that use the same model names.
    """
    wanted = F.create_map(*[x for name, fs in FEATURES.items() for x in (F.lit(name), F.array(*map(F.lit, fs)))])
    lists = models.withColumn("_wanted", F.try_element_at(wanted, F.col("model")))
    expected = F.try_element_at("_wanted", F.col("ord") + 1)
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    rules = F.array(
        F.when(~F.coalesce(F.col("feature") == expected, F.lit(False)), "feature_order"),
        F.when(odd("mean") | odd("scale") | odd("coef"), "nonfinite_parameter"),
        F.when(F.col("scale") <= 0, "nonpositive_scale"),
    )
    by_row = lists.select("model", *ids, "ord", F.explode(F.array_compact(rules)).alias("rule"))
    sized = lists.groupBy("model", *ids).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_wanted")).alias("size"))
    short = sized.where("n <> size").select("model", *ids, F.lit(None).cast("int").alias("ord"), F.lit("feature_count").alias("rule"))
    return by_row.unionByName(short)
