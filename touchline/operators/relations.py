"""Defender-to-edge relations inside a state: tie ranks, involvement, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from touchline.functions.ranking import fractional_membership
from touchline.operators.options import EDGE_KEYS, KEYS, relation_rows
from touchline.operators.statewise import involvement_metrics
from touchline.plans.ties import tie_blocks
from touchline.sources.models import Model

KINDS = ("receiver", "segment")
TOPS = (1, 2, 3)
RELATION_FIELDS = ("position", "block", "first", "last", "rank")


def defender_relations(states: DataFrame) -> DataFrame:
    """One row per edge and defender with both distances and both tie ranks."""
    ranked = relation_rows(states)
    for kind in KINDS:
        ranked = tie_blocks(
            ranked, EDGE_KEYS, f"{kind}_distance", order=["d"], prefix=f"{kind}_"
        )
    return ranked


def membership(kind: str, k: int) -> Column:
    return fractional_membership(F.col(f"{kind}_first"), F.col(f"{kind}_last"), k)


def relations_of(relations: DataFrame, receiver: int) -> DataFrame:
    return relations.where(F.col("ord") == receiver)


def nearest_relations(relations: DataFrame, kind: str) -> DataFrame:
    return relations.where(F.col(f"{kind}_block") == 0)


def defender_involvement(relations: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Per state and defender: nearest edges, rank and distance summaries, top-k involvement.

    ``shares`` (edge keys and share of one model) adds share-weighted involvement.
    """
    rows = relations
    weighted = []
    if shares is not None:
        rows = relations.join(shares.select(*EDGE_KEYS, "share"), list(EDGE_KEYS))
        weighted = [
            F.sum(F.col("share") * membership("segment", k)).alias(f"segment_top{k}_m1_weighted")
            for k in TOPS
        ]
    per_kind = []
    for kind in KINDS:
        rank, distance = F.col(f"{kind}_rank"), F.col(f"{kind}_distance")
        per_kind += [
            F.count_if(F.col(f"{kind}_block") == 0).alias(f"{kind}_nearest_edges"),
            F.avg(rank).alias(f"{kind}_mean_rank"),
            F.median(rank).alias(f"{kind}_median_rank"),
            F.min(distance).alias(f"{kind}_distance_min"),
            F.median(distance).alias(f"{kind}_distance_median"),
            F.max(distance).alias(f"{kind}_distance_max"),
        ]
        for k in TOPS:
            inside = membership(kind, k)
            per_kind += [
                F.sum(inside).alias(f"{kind}_top{k}_involvement"),
                F.avg(inside).alias(f"{kind}_top{k}_edge_share"),
            ]
    return rows.groupBy(*KEYS, "d").agg(*per_kind, *weighted)


def edge_overlap(relations: DataFrame) -> DataFrame:
    """Per edge: nearest sets of both kinds, their overlap, gaps to the 2nd and 3rd."""
    in_r, in_s = F.col("receiver_block") == 0, F.col("segment_block") == 0
    at = lambda p: F.max(F.when(F.col("segment_position") == p, F.col("segment_distance")))
    counted = relations.groupBy(*EDGE_KEYS).agg(
        F.count_if(in_r).alias("receiver_nearest_count"),
        F.count_if(in_s).alias("segment_nearest_count"),
        F.count_if(in_r & in_s).alias("_both"),
        F.count_if(in_r | in_s).alias("_any"),
        (at(2) - at(1)).alias("segment_d2_d1"),
        (at(3) - at(1)).alias("segment_d3_d1"),
        at(1).alias("segment_d1"),
        at(2).alias("segment_d2"),
        at(3).alias("segment_d3"),
    )
    equal = F.col("_both") == F.col("_any")
    return counted.select(
        "*",
        (F.col("_both") > 0).alias("nearest_intersects"),
        equal.alias("nearest_equal"),
        (F.col("_both") / F.col("_any")).alias("nearest_jaccard"),
        (equal & (F.col("_any") == 1)).alias("same_unique_nearest"),
    ).drop("_both", "_any")


def top_defender_sets(relations: DataFrame) -> DataFrame:
    """Per edge the defenders with any membership in the segment top 1, 2 and 3."""
    return relations.groupBy(*EDGE_KEYS).agg(
        *[
            F.collect_set(F.when(F.col("segment_first") <= k, F.col("d"))).alias(f"top{k}")
            for k in TOPS
        ]
    )


def pair_jaccard(relations: DataFrame) -> DataFrame:
    """Per pair of a state's edges: Jaccard of their top-1/2/3 defender sets."""
    sets = top_defender_sets(relations)
    a = sets.select(*KEYS, F.col("ord").alias("a_ord"), *[F.col(f"top{k}").alias(f"a{k}") for k in TOPS])
    b = sets.select(*KEYS, F.col("ord").alias("b_ord"), *[F.col(f"top{k}").alias(f"b{k}") for k in TOPS])
    overlap = lambda k: F.size(F.array_intersect(f"a{k}", f"b{k}")) / F.size(F.array_union(f"a{k}", f"b{k}"))
    return (
        a.join(b, list(KEYS))
        .where(F.col("a_ord") < F.col("b_ord"))
        .select(*KEYS, "a_ord", "b_ord", *[overlap(k).alias(f"top{k}_jaccard") for k in TOPS])
    )


def distinct_nearest(relations: DataFrame) -> DataFrame:
    return relations.groupBy(*KEYS).agg(
        *[
            F.count_distinct(F.when(F.col(f"{kind}_block") == 0, F.col("d"))).alias(
                f"{kind}_unique_nearest_defenders"
            )
            for kind in KINDS
        ]
    )


# The per-state metrics of the defender study, in report order.
STATE_METRICS = (
    "edges", "defenders", "receiver_unique_nearest_defenders", "segment_unique_nearest_defenders",
    "nearest_intersects", "nearest_equal", "same_unique_nearest", "receiver_unique_nearest_edges",
    "segment_unique_nearest_edges", "segment_d2_d1", "segment_d3_d1", "any_receiver_multi_edge",
    "any_segment_multi_edge", "max_receiver_nearest_edges", "max_segment_nearest_edges",
    "max_segment_top1_edge_share", "max_segment_top2_edge_share", "max_segment_top3_edge_share",
    "max_segment_top1_m1_weighted", "max_segment_top2_m1_weighted", "max_segment_top3_m1_weighted",
    "segment_top1_pair_jaccard", "segment_top2_pair_jaccard", "segment_top3_pair_jaccard",
    "receiver_distance_mean", "segment_distance_mean",
)


def state_metrics(states: DataFrame, model: Model) -> DataFrame:
    """One wide row per state with an edge, from its own record; ``model`` gives the shares that weigh involvement."""
    return involvement_metrics(states, model, STATE_METRICS, TOPS)
