"""Ranking credits, per-match metrics, distribution summaries and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.ranking import block_hits, expected_reciprocal
from touchline.functions.scalars import TIE
from touchline.operators.options import EDGE_KEYS, KEYS, receiver_pairs
from touchline.plans.ordered import average_rank

EPSILON = 2.220446049250313e-16


def expected_credits(scored: DataFrame) -> DataFrame:
    """Tie-aware credit of the target per (state, model); a missing target earns zero.

    ``scored`` carries ``target_index``.
    """
    is_target = F.col("ord") == F.col("target_index")
    placed = scored.groupBy(*KEYS, "model", "target_index").agg(
        F.max(F.when(is_target, F.col("first"))).alias("first"),
        F.max(F.when(is_target, F.col("last"))).alias("last"),
        F.max(F.when(is_target, F.col("rank"))).alias("target_rank"),
    )
    known = F.col("first").isNotNull()
    credit = lambda c: F.when(known, c).otherwise(0.0)
    first, last = F.col("first"), F.col("last")
    return placed.select(
        *KEYS,
        "model",
        "target_index",
        "target_rank",
        credit(expected_reciprocal(first, last)).alias("rr"),
        credit(block_hits(first, last, 1)).alias("hit1"),
        credit(block_hits(first, last, 3)).alias("hit3"),
        F.coalesce(last > first, F.lit(False)).alias("tied"),
    )


def metric_rows(credits: DataFrame) -> DataFrame:
    return credits.groupBy("model", "match_id").agg(
        F.count(F.lit(1)).alias("evaluation_eligible"),
        F.count("target_index").alias("fit_eligible"),
        F.count_if(F.col("target_index").isNull()).alias("target_outside_zero_credit"),
        F.avg("rr").alias("mrr"),
        F.avg("hit1").alias("hit_at_1"),
        F.avg("hit3").alias("hit_at_3"),
        F.count_if("tied").alias("tied_target_blocks"),
    )


METRICS = ("mrr", "hit_at_1", "hit_at_3")


def macro_and_pooled(rows: DataFrame) -> DataFrame:
    n = F.col("evaluation_eligible")
    return rows.groupBy("model").agg(
        *[F.avg(m).alias(f"macro_{m}") for m in METRICS],
        *[(F.sum(F.col(m) * n) / F.sum(n)).alias(f"pooled_{m}") for m in METRICS],
    )


def paired_differences(rows: DataFrame, left: str, right: str) -> DataFrame:
    """right - left per match, then mean, median and sign counts per metric."""
    side = lambda name, m: F.max(F.when(F.col("model") == name, F.col(m)))
    per_match = rows.groupBy("match_id").agg(*[(side(right, m) - side(left, m)).alias(m) for m in METRICS])
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("d")) for m in METRICS]
    long = per_match.select(F.inline(F.array(*items)))
    from touchline.plans.ordered import linear_quantiles

    basic = long.groupBy("metric").agg(
        F.avg("d").alias("mean"),
        F.count_if(F.col("d") > 0).alias("positive"),
        F.count_if(F.col("d") < 0).alias("negative"),
        F.count_if(F.col("d") == 0).alias("zero"),
    )
    middle = linear_quantiles(long, ["metric"], "d", (0.5,)).withColumnRenamed("q50", "median")
    return basic.join(middle, "metric")


def count_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count / minimum / median / mean / maximum of small whole numbers."""
    # Exact: the median keeps one counter per distinct value, and sizes repeat.
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("minimum"),
        F.median(value).alias("median"),
        F.avg(value).alias("mean"),
        F.max(value).alias("maximum"),
    )


def correlation(x: str, y: str) -> Column:
    """Aggregate correlation that is null, not an error, for a constant side."""
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(~flat & value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def pearson(df: DataFrame, groups: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Correlation per group, null when a side is constant, kept within [-1, 1]."""
    return df.groupBy(*groups).agg(correlation(x, y).alias(name))


def spearman(df: DataFrame, groups: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    ranked = average_rank(average_rank(df, groups, x, "_rx"), groups, y, "_ry")
    return pearson(ranked, groups, "_rx", "_ry", name)




def ordering_disagreement(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Per state: pairs ordered by both features, and how many they order differently."""
    pairs = receiver_pairs(edges, first, second)
    a = F.col(f"a_{first}") - F.col(f"b_{first}")
    b = F.col(f"a_{second}") - F.col(f"b_{second}")
    comparable = (F.abs(a) > TIE) & (F.abs(b) > TIE)
    return pairs.groupBy(*KEYS).agg(
        F.count_if(comparable).alias("comparable_pairs"),
        F.count_if(comparable & (F.signum(a) != F.signum(b))).alias("discordant_pairs"),
    ).withColumn(
        "fraction",
        F.when(F.col("comparable_pairs") > 0, F.col("discordant_pairs") / F.col("comparable_pairs")),
    )


def nondegenerate(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Whether the range of the finite values exceeds n * eps * max(|x|, 1)."""
    v = F.col(value)
    top = F.greatest(F.max(F.abs(v)), F.lit(1.0))
    bound = F.count(v) * EPSILON * top
    return df.groupBy(*groups).agg(
        F.coalesce((F.count(v) >= 2) & (F.max(v) - F.min(v) > bound), F.lit(False)).alias("nondegenerate")
    )


def coefficient_stability(parameters: DataFrame) -> DataFrame:
    """Sign counts and spread of every coefficient over the folds (fold, feature, coef)."""
    from touchline.plans.ordered import linear_quantiles

    c = F.col("coef")
    signs = parameters.groupBy("feature").agg(
        F.count_if(c > 0).alias("positive_folds"),
        F.count_if(c < 0).alias("negative_folds"),
        F.count_if(c == 0).alias("zero_folds"),
        F.min(c).alias("minimum"),
        F.max(c).alias("maximum"),
    )
    middle = linear_quantiles(parameters, ["feature"], "coef", (0.5,)).withColumnRenamed("q50", "median")
    return signs.join(middle, "feature")
