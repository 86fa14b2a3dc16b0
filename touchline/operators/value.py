"""Progression value of an option network and its typology."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.geometry import goalward_progress
from touchline.functions.scalars import identity_holds, three_way_sign
from touchline.operators.evaluation import pearson
from touchline.operators.options import EDGE_KEYS, KEYS

# A value surface maps receiver coordinates (x, y) to a column in [0, 1]; a pandas UDF
# applied to the two columns fits as well.
Surface = Callable[[Column, Column], Column]
SIGNS = ("negative", "zero", "positive")
PROGRESSION = ("H0", "H1", "S", "D")


def progression_surface(pitch_length: Column) -> Surface:
    return lambda x, y: goalward_progress(x, pitch_length)


def horizons(scored: DataFrame, surface: Surface) -> DataFrame:
    """Share-weighted change of the surface from carrier to receivers, per (state, model).

    ``scored`` carries cx, cy, rx, ry. Values outside [0, 1] and states with a point
    off the surface are marked in ``valid`` instead of being dropped.
    """
    own, goal = surface(F.col("cx"), F.col("cy")), surface(F.col("rx"), F.col("ry"))
    bounded = own.isNotNull() & goal.isNotNull() & own.between(0, 1) & goal.between(0, 1)
    return scored.groupBy(*KEYS, "model").agg(
        F.sum(F.col("share") * (goal - own)).alias("horizon"),
        F.sum(F.col("share") * goal).alias("mean_value"),
        F.max(own).alias("carrier_value"),
        F.coalesce(F.bool_and(bounded), F.lit(False)).alias("valid"),
        F.sum("share").alias("share_total"),
    )


def horizon_comparison(scored: DataFrame, surface: Surface, left: str, right: str) -> DataFrame:
    """H0, H1, shift S with its identity residual, and the change D of effective options."""
    value = horizons(scored.where(F.col("model").isin(left, right)), surface)
    side = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    wide = value.groupBy(*KEYS).agg(
        side(left, "horizon").alias("H0"),
        side(right, "horizon").alias("H1"),
        side(left, "mean_value").alias("_v0"),
        side(right, "mean_value").alias("_v1"),
        F.bool_and("valid").alias("valid"),
    )
    share = F.col("share")
    entropy = F.sum(F.when(share > 0, -share * F.log(share)).otherwise(0.0))
    options = scored.groupBy(*KEYS, "model").agg(F.exp(entropy).alias("n"))
    change = options.groupBy(*KEYS).agg((side(right, "n") - side(left, "n")).alias("D"))
    shift = F.col("H1") - F.col("H0")
    # Shares of both models sum to one, so the carrier's value cancels out of the shift.
    by_value = F.col("_v1") - F.col("_v0")
    return wide.join(change, list(KEYS)).select(
        *KEYS, "valid", "H0", "H1", shift.alias("S"), "D",
        F.abs(shift - by_value).alias("residual"),
        identity_holds(shift, by_value, F.abs(F.col("_v0")) + F.abs(F.col("_v1")) + 1.0).alias("identity_holds"),
    )


def edge_contributions(scored: DataFrame, surface: Surface, left: str, right: str) -> DataFrame:
    """Per edge: share change times destination change; sums to the shift of the state."""
    step = surface(F.col("rx"), F.col("ry")) - surface(F.col("cx"), F.col("cy"))
    side = lambda name: F.max(F.when(F.col("model") == name, F.col("share")))
    return scored.groupBy(*EDGE_KEYS, "id").agg(
        ((side(right) - side(left)) * F.max(step)).alias("contribution")
    )


def sign_typology(rows: DataFrame) -> DataFrame:
    """(alias, d_sign, s_sign, count, proportion) with all nine cells, per match and macro.

    The proportion weighs every match equally in the macro row.
    """
    cells = F.explode(
        F.array(*[F.struct(F.lit(d).alias("d_sign"), F.lit(s).alias("s_sign")) for d in SIGNS for s in SIGNS])
    )
    signed = rows.select(
        "match_id", three_way_sign(F.col("D")).alias("d_sign"), three_way_sign(F.col("S")).alias("s_sign")
    )
    counted = signed.groupBy("match_id", "d_sign", "s_sign").agg(F.count(F.lit(1)).alias("count"))
    totals = counted.groupBy("match_id").agg(F.sum("count").alias("states"))
    domain = totals.select("match_id", "states", cells.alias("cell")).select("match_id", "states", "cell.*")
    filled = domain.join(counted, ["match_id", "d_sign", "s_sign"], "left").select(
        F.col("match_id").alias("alias"), "d_sign", "s_sign",
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("states")).alias("proportion"),
    )
    macro = filled.groupBy("d_sign", "s_sign").agg(
        F.sum("count").alias("count"), F.avg("proportion").alias("proportion")
    )
    return filled.unionByName(macro.withColumn("alias", F.lit("macro")))


def shift_correlation(rows: DataFrame) -> DataFrame:
    return pearson(rows, ["match_id"], "S", "D", "pearson_S_D")
