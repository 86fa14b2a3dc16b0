"""Conditional-softmax choice model with equal match weights.

Every quantity is a nested average: candidates in a choice, choices in a match, matches.
The fits themselves are in ``folds``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.operators.options import EDGE_KEYS, KEYS


def _nested_mean(df: DataFrame, expressions: dict[str, Column], group: Sequence[str]) -> DataFrame:
    """avg over candidates, then over choices, then over matches."""
    per_choice = df.groupBy(*group, *KEYS).agg(*[F.avg(e).alias(n) for n, e in expressions.items()])
    per_match = per_choice.groupBy(*group, "match_id").agg(*[F.avg(n).alias(n) for n in expressions])
    return per_match.groupBy(*group).agg(*[F.avg(n).alias(n) for n in expressions])


def weighted_standardization(edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, scale, zero_scale): two nested-average passes, zero scale becomes 1."""
    first = _nested_mean(edges, {f: F.col(f) for f in features}, []).first()
    deviations = {f: (F.col(f) - F.lit(first[f])) * (F.col(f) - F.lit(first[f])) for f in features}
    spread = _nested_mean(edges, deviations, [])
    items = [
        F.struct(F.lit(f).alias("feature"), F.lit(first[f]).alias("mean"), F.sqrt(f).alias("scale"))
        for f in features
    ]
    return spread.select(F.inline(F.array(*items))).select(
        "feature",
        "mean",
        F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")).alias("scale"),
        (F.col("scale") == 0).alias("zero_scale"),
    )


def within_choice_differences(edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """Target row minus every other row of the same choice."""
    mine = F.col("ord") == F.col("target_index")
    target = edges.where(mine).select(*KEYS, *[F.col(f).alias(f"t_{f}") for f in features])
    others = edges.where(F.col("target_index").isNotNull() & ~mine)
    return others.join(target, list(KEYS)).select(
        *EDGE_KEYS, *[(F.col(f"t_{f}") - F.col(f)).alias(f) for f in features]
    )


def _triangles(p: int):
    """One triangular factor of all rows of a partition."""

    def factored(batches):
        held = np.zeros((0, p))
        for batch in batches:
            rows = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            for at in range(0, len(rows), 4096):
                held = np.linalg.qr(np.concatenate([held, rows[at : at + 4096]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(p)], names=[f"c{i}" for i in range(p)])

    return factored


def identifiability(differences: DataFrame, features: Sequence[str]) -> dict:
    """Numerical rank of the difference matrix.

    Partitions are reduced to triangular factors, these once more in a few tasks, and the singular
    values of the last factor are those of the matrix; squares, which lose half the digits, never appear.
    """
    p = len(features)
    form = ", ".join(f"c{i} double" for i in range(p))
    rows = differences.select(*[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    n = rows.count()
    factors = rows.mapInArrow(_triangles(p), form).repartition(8).mapInArrow(_triangles(p), form).collect()
    singular = np.linalg.svd(np.array([list(row) for row in factors]).reshape(-1, p), compute_uv=False)
    tolerance = max(n, p) * np.finfo(float).eps * (singular[0] if len(singular) else 0.0)
    return {"rank": int((singular > tolerance).sum()), "columns": p, "rows": n}


def _choice_terms(scored: DataFrame, features: Sequence[str], group: Sequence[str], second: bool) -> DataFrame:
    """Per choice: loss, gradient and (optionally) Hessian terms from column ``_s``."""
    choice = Window.partitionBy(*group, *KEYS)
    weighted = scored.withColumn("_top", F.max("_s").over(choice)).withColumn(
        "_e", F.exp(F.col("_s") - F.col("_top"))
    ).withColumn("_z", F.sum("_e").over(choice)).withColumn("_p", F.col("_e") / F.col("_z"))
    mine = (F.col("ord") == F.col("target_index")).cast("double")
    p = F.col("_p")
    sums = [
        F.max(F.col("_top") + F.log("_z")).alias("_norm"),
        F.sum(mine * F.col("_s")).alias("_own"),
        *[F.sum(p * F.col(f)).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.sum(mine * F.col(f)).alias(f"_t{i}") for i, f in enumerate(features)],
    ]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))] if second else []
    sums += [F.sum(p * F.col(features[i]) * F.col(features[j])).alias(f"_s{i}_{j}") for i, j in pairs]
    per_choice = weighted.groupBy(*group, *KEYS).agg(*sums)
    return per_choice.select(
        *group,
        "match_id",
        (F.col("_norm") - F.col("_own")).alias("loss"),
        *[(F.col(f"_m{i}") - F.col(f"_t{i}")).alias(f"g{i}") for i in range(len(features))],
        *[(F.col(f"_s{i}_{j}") - F.col(f"_m{i}") * F.col(f"_m{j}")).alias(f"h{i}_{j}") for i, j in pairs],
    )


def _over_matches(terms: DataFrame, group: Sequence[str]) -> DataFrame:
    names = [c for c in terms.columns if c not in (*group, "match_id")]
    per_match = terms.groupBy(*group, "match_id").agg(*[F.avg(n).alias(n) for n in names])
    return per_match.groupBy(*group).agg(*[F.avg(n).alias(n) for n in names])


def conditional_objective(edges: DataFrame, features: Sequence[str], beta: Sequence[float]) -> DataFrame:
    """loss and gradient (g0..) at ``beta`` over the choices that have a target."""
    score = F.lit(0.0)
    for f, b in zip(features, beta):
        score = score + F.col(f) * float(b)
    usable = edges.where(F.col("target_index").isNotNull()).withColumn("_s", score)
    return _over_matches(_choice_terms(usable.withColumn("_all", F.lit(0)), features, ["_all"], False), ["_all"]).drop("_all")


def centred_covariance(edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, value): covariance of features centred within the choice, equal matches."""
    choice = Window.partitionBy(*KEYS)
    centred = edges.select(*EDGE_KEYS, *[(F.col(f) - F.avg(f).over(choice)).alias(f) for f in features])
    cells = {
        f"{i}_{j}": F.col(a) * F.col(b)
        for i, a in enumerate(features) for j, b in enumerate(features)
    }
    row = _nested_mean(centred, cells, [])
    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("value"))
        for i, a in enumerate(features) for j, b in enumerate(features)
    ]
    return row.select(F.inline(F.array(*items)))


def centred_correlation(covariance: DataFrame) -> DataFrame:
    diagonal = covariance.where("a = b").select("a", F.sqrt("value").alias("scale"))
    return (
        covariance.join(diagonal, "a")
        .join(diagonal.withColumnsRenamed({"a": "b", "scale": "other"}), "b")
        .select("a", "b", (F.col("value") / F.col("scale") / F.col("other")).alias("correlation"))
    )


def matrix_condition(correlation: DataFrame, features: Sequence[str]) -> dict:
    """Rank and condition number of the (features x features) matrix, on the driver."""
    p = len(features)
    matrix = np.zeros((p, p))
    for row in correlation.collect():
        matrix[features.index(row["a"]), features.index(row["b"])] = row["correlation"]
    singular = np.linalg.svd(matrix, compute_uv=False)
    tolerance = p * np.finfo(float).eps * singular[0]
    rank = int((singular > tolerance).sum())
    return {"rank": rank, "condition": float(singular[0] / singular[-1]) if rank == p else float("inf")}
