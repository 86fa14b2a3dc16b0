"""Carrier-to-receiver options: features, utilities, shares, ranks, comparisons.

A state is one record with its candidates and defenders as short arrays. States arrive
hash-partitioned by their keys; exploding keeps that partitioning, so every per-state
aggregate, window and self-join below runs without another exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions import geometry as g
from touchline.plans.ties import tie_blocks
from touchline.sources.models import Model, name_of, utility

KEYS = ("match_id", "event_id", "ordinal")
EDGE_KEYS = (*KEYS, "ord")
SUMMARY_FIELDS = (
    "top_one_share",
    "top_two_share",
    "entropy",
    "normalized_entropy",
    "effective_option_count",
    "utility_range",
)
CHANGE_FIELDS = SUMMARY_FIELDS + (
    "top_set_changed",
    "strict_reversal",
    "tie_created",
    "tie_removed",
    "ordering_changed",
)
PAIR_CATEGORIES = ("unchanged", "strict_reversal", "tie_created", "tie_removed")


def candidate_rows(states: DataFrame, *extra: str) -> DataFrame:
    """One row per edge: ord, id, carrier cx/cy, receiver rx/ry."""
    return states.select(
        *KEYS,
        *extra,
        F.col("carrier.x").alias("cx"),
        F.col("carrier.y").alias("cy"),
        F.posexplode("candidates").alias("ord", "_c"),
    ).select(
        *KEYS, *extra, "cx", "cy", "ord",
        F.col("_c.id").alias("id"), F.col("_c.x").alias("rx"), F.col("_c.y").alias("ry"),
    )


def defender_rows(states: DataFrame) -> DataFrame:
    return states.select(*KEYS, F.posexplode("defenders").alias("d", "_d")).select(
        *KEYS, "d", F.col("_d.x").alias("px"), F.col("_d.y").alias("py")
    )


def relation_rows(states: DataFrame, *extra: str) -> DataFrame:
    """One row per edge and defender of the same state, with both distances."""
    rows = candidate_rows(states, "defenders", *extra).select(
        *EDGE_KEYS, *extra, "cx", "cy", "id", "rx", "ry", F.posexplode("defenders").alias("d", "_d")
    )
    px, py = F.col("_d.x"), F.col("_d.y")
    cx, cy, rx, ry = (F.col(c) for c in ("cx", "cy", "rx", "ry"))
    return rows.select(
        *EDGE_KEYS, *extra, "cx", "cy", "id", "rx", "ry", "d",
        px.alias("px"), py.alias("py"),
        g.length(px - rx, py - ry).alias("receiver_distance"),
        g.segment_distance(px, py, cx, cy, rx, ry).alias("segment_distance"),
    )


def pass_vector(rows: DataFrame) -> DataFrame:
    dx, dy = F.col("rx") - F.col("cx"), F.col("ry") - F.col("cy")
    return rows.select(
        "*",
        g.length(dx, dy).alias("distance"),
        dx.alias("longitudinal_displacement"),
        dy.alias("lateral_displacement"),
    )


def edge_features(states: DataFrame, *extra: str) -> DataFrame:
    """One row per edge with the features of all three models and the non-nearest mass."""
    decay = F.exp(-F.col("segment_distance") / g.ATTENUATION_METRES)
    grouped = relation_rows(states, *extra).groupBy(*EDGE_KEYS, *extra, "cx", "cy", "id", "rx", "ry").agg(
        F.min("receiver_distance").alias("nearest_receiver_defender_distance"),
        F.min("segment_distance").alias("minimum_segment_defender_distance"),
        F.sum(decay).alias("summed_segment_attenuation"),
    )
    nearest = F.exp(-F.col("minimum_segment_defender_distance") / g.ATTENUATION_METRES)
    return pass_vector(grouped).withColumn(
        "nonnearest_mass", F.greatest(F.lit(0.0), F.col("summed_segment_attenuation") - nearest)
    )


def utility_rows(edges: DataFrame, models: Sequence[Model], *extra: str) -> DataFrame:
    """Long (edge, model, utility); ``edges`` must hold the models' features."""
    sides = [F.struct(F.lit(name_of(m)).alias("model"), utility(m).alias("utility")) for m in models]
    return edges.select(*EDGE_KEYS, "id", *extra, F.inline(F.array(*sides)))


def score(utilities: DataFrame) -> DataFrame:
    """Add share, position, block, first, last and rank within (state, model)."""
    group = [*KEYS, "model"]
    # The ties sort by state and model and then by value: the shares need no further sort.
    ranked = tie_blocks(utilities, group, "utility", descending=True, order=["id"])
    state = Window.partitionBy(*group)
    weights = ranked.withColumn("_w", F.exp(F.col("utility") - F.max("utility").over(state)))
    return weights.withColumn("share", F.col("_w") / F.sum("_w").over(state)).drop("_w")


def evaluate_options(states: DataFrame, models: Sequence[Model], *extra: str) -> DataFrame:
    """Every candidate of every state scored under the given frozen models."""
    return score(utility_rows(edge_features(states, *extra), models, *extra))


def network_export(scored: DataFrame) -> DataFrame:
    """The flat edge table a caller takes away (``toPandas`` for small results)."""
    return scored.select(
        *KEYS,
        "model",
        F.col("id").alias("receiver_id"),
        "utility",
        F.col("share").alias("option_share"),
        F.col("rank").alias("expected_rank"),
        F.col("block").alias("tie_block"),
        (F.col("block") == 0).alias("is_top_option"),
    )


def state_summaries(scored: DataFrame) -> DataFrame:
    """One row per (state, model): six share summaries and the top set."""
    share = F.col("share")
    # Candidates per state are few, so the id list of the top block stays short.
    tops = F.array_sort(F.collect_list(F.when(F.col("block") == 0, F.col("id"))))
    base = scored.groupBy(*KEYS, "model").agg(
        F.count(F.lit(1)).alias("edges"),
        F.max(share).alias("top_one_share"),
        F.sum(F.when(F.col("position") <= 2, share)).alias("top_two_share"),
        F.sum(F.when(share > 0, -share * F.log(share)).otherwise(0.0)).alias("entropy"),
        (F.max("utility") - F.min("utility")).alias("utility_range"),
        tops.alias("top_options"),
    )
    entropy = F.col("entropy")
    return base.select(
        "*",
        F.when(F.col("edges") > 1, entropy / F.log(F.col("edges").cast("double")))
        .otherwise(0.0)
        .alias("normalized_entropy"),
        F.exp(entropy).alias("effective_option_count"),
        F.when(F.size("top_options") == 1, F.get("top_options", F.lit(0))).alias("top_option"),
    )


def aligned_models(scored: DataFrame, left: str, right: str, *fields: str) -> DataFrame:
    """Edges with ``l_``/``r_`` columns of two models; an edge known to one side only raises."""
    side = lambda name, tag: [
        F.max(F.when(F.col("model") == name, F.col(f))).alias(f"{tag}_{f}") for f in fields
    ]
    both = (
        scored.where(F.col("model").isin(left, right))
        .groupBy(*EDGE_KEYS, "id")
        .agg(F.count(F.lit(1)).alias("_sides"), *side(left, "l"), *side(right, "r"))
    )
    broken = F.when(F.col("_sides") != 2, F.raise_error(F.lit("candidate ordering mismatch")))
    return both.where(broken.isNull()).drop("_sides")


def receiver_pairs(edges: DataFrame, *fields: str) -> DataFrame:
    """Pairs i<j of one state's edges, with ``a_``/``b_`` columns; co-partitioned self-join."""
    a = edges.select(*KEYS, F.col("ord").alias("a_ord"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = edges.select(*KEYS, F.col("ord").alias("b_ord"), *[F.col(f).alias(f"b_{f}") for f in fields])
    return a.join(b, list(KEYS)).where(F.col("a_ord") < F.col("b_ord"))


def pair_category(x: Column, y: Column) -> Column:
    """Category of the ordering signs of one pair before (x) and after (y)."""
    return (
        F.when(x == y, "unchanged")
        .when((x != 0) & (y != 0), "strict_reversal")
        .when(y == 0, "tie_created")
        .otherwise("tie_removed")
    )


def pair_comparison(aligned: DataFrame, left: str = "l_block", right: str = "r_block") -> DataFrame:
    """Per state with a pair: number of pairs and how many fall into each category."""
    pairs = receiver_pairs(aligned, left, right)
    x = F.signum(F.col(f"a_{left}") - F.col(f"b_{left}"))
    y = F.signum(F.col(f"a_{right}") - F.col(f"b_{right}"))
    tagged = pairs.withColumn("_category", pair_category(x, y))
    return tagged.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.count_if(F.col("_category") == c).alias(c) for c in PAIR_CATEGORIES],
    )


def compare_options(scored: DataFrame, left: str, right: str) -> DataFrame:
    """Summary changes and pair reorderings from model ``left`` to model ``right``."""
    summaries = state_summaries(scored.where(F.col("model").isin(left, right)))
    side = lambda name, f: F.max(F.when(F.col("model") == name, F.col(f)))
    moved = summaries.groupBy(*KEYS).agg(
        *[(side(right, f) - side(left, f)).alias(f) for f in SUMMARY_FIELDS],
        (side(right, "top_options") != side(left, "top_options")).cast("double").alias("top_set_changed"),
    )
    pairs = pair_comparison(aligned_models(scored, left, right, "block"))
    part = lambda name: F.col(name) / F.col("pairs")
    return moved.join(
        pairs.select(
            *KEYS,
            *[part(name).alias(name) for name in PAIR_CATEGORIES[1:]],
            (1.0 - part("unchanged")).alias("ordering_changed"),
        ),
        list(KEYS),
        "left",
    )


def long_metrics(df: DataFrame, fields: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Unpivot per-state columns to (keys, match_id, metric, value)."""
    items = [
        F.struct(F.lit(f).alias("metric"), F.col(f).cast("double").alias("value")) for f in fields
    ]
    return df.select(*keys, "match_id", F.inline(F.array(*items)))


def network_metrics(scored: DataFrame, left: str, right: str) -> DataFrame:
    """Long metric rows of both networks and of the change between them."""
    own = long_metrics(
        state_summaries(scored.where(F.col("model").isin(left, right))), SUMMARY_FIELDS, ["model"]
    ).withColumnRenamed("model", "scope")
    change = long_metrics(
        compare_options(scored, left, right).withColumn("scope", F.lit("change")), CHANGE_FIELDS, ["scope"]
    )
    return own.unionByName(change)
