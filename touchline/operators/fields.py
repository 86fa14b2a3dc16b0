"""Directional fields of the defenders along carrier-receiver edges.

Single points are column expressions over edge x defender rows; grids of points along
edges are folded in place by ``sampled``, so they never become rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from touchline.functions import geometry as g
from touchline.functions.scalars import LENGTH_GUARD, is_finite
from touchline.operators import sampled
from touchline.operators.options import EDGE_KEYS, KEYS, pass_vector, receiver_pairs, relation_rows
from touchline.session import cut_lineage

# Sample spacings (metres), agreement limit, interval ladder and its limit.
SPACINGS = {"coarse": 0.25, "fine": 0.125}
AGREEMENT = 1e-6
LADDER = (256, 512, 1024, 2048, 4096, 8192, 16384)
LADDER_CHANGE = 1e-7


def geometry_error() -> Column:
    """Null for a usable state, else the broken rule."""
    bad = lambda p: ~is_finite(p["x"]) | ~is_finite(p["y"])
    carrier = F.col("carrier")
    near = F.exists(
        "defenders",
        lambda d: F.hypot(d["x"] - carrier["x"], d["y"] - carrier["y"]) <= LENGTH_GUARD,
    )
    return (
        F.when(F.coalesce(F.size("defenders"), F.lit(0)) <= 0, "nonempty_xy_matrix_required")
        .when(bad(carrier) | F.exists("defenders", bad), "finite_numeric_coordinates_required")
        .when(near, "origin_defender_direction_undefined")
    )


def field_relations(states: DataFrame) -> DataFrame:
    """Edge x defender rows of the states whose geometry allows a direction."""
    return pass_vector(relation_rows(states.where(geometry_error().isNull())))


def strength(field: str | g.FieldFunction, qx: Column, qy: Column) -> Column:
    """Strength of the row's defender at (qx, qy) for a named or user-given field."""
    function = g.FIELDS[field] if isinstance(field, str) else field
    return function(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"), qx, qy)


def endpoint_strengths(relations: DataFrame, field) -> DataFrame:
    return relations.withColumn("value", strength(field, F.col("rx"), F.col("ry")))


def combined(rows: DataFrame, keys: Sequence[str], rules: Sequence[str] = ("union", "maximum")) -> DataFrame:
    return rows.groupBy(*keys).agg(*[g.COMBINATIONS[r](F.col("value")).alias(r) for r in rules])


def grid_intervals(spacing: float) -> Column:
    """An even number of intervals no longer than ``spacing`` along the row's edge, two at least."""
    dx, dy = F.col("rx") - F.col("cx"), F.col("ry") - F.col("cy")
    return F.greatest(F.lit(2), 2 * F.ceil(F.sqrt(dx * dx + dy * dy) / (2 * spacing))).cast("int")


def edge_fields(states: DataFrame, field) -> DataFrame:
    """Endpoint and segment field per edge, with the coarse/fine agreement of all components.

    An edge shorter than 1e-9 m takes its endpoint values and no interval. Where a component moves by more than the
    agreement limit, the row names the component and its two values.
    """
    return sampled.summaries(sampled.edge_rows(states), field, tuple(SPACINGS.values()), AGREEMENT)


def resolution_ladder(states: DataFrame, field, counts: Sequence[int] = LADDER, with_combined: bool = True, on_level=None) -> DataFrame:
    """Double the intervals until every component of an edge moves by at most 1e-7.

    Components are the single defenders and, unless ``with_combined`` is off, their union and maximum. Edges
    open after the last level come back with ``intervals`` null. ``on_level(count, open_edges)`` is called for
    every level with what Spark observed while the rows were written down.
    """
    found = sampled.ladder(sampled.edge_rows(states), field, counts, LADDER_CHANGE, with_combined)
    if not on_level:
        return found
    # An edge is open after a level unless it settled by then; its first component counts it.
    seen = Observation("ladder")
    still = lambda n: F.count_if((F.col("component") == "0") & (F.col("intervals").isNull() | (F.col("intervals") > n)))
    kept = cut_lineage(found.observe(seen, *[still(n).alias(str(n)) for n in counts]))
    for n in counts:
        on_level(n, seen.get[str(n)])
    return kept


def onset_breakpoints(relations: DataFrame) -> DataFrame:
    """Edge fractions strictly inside (0, 1) where a defender's onset begins or ends."""
    radius = F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    ux, uy = (F.col("px") - F.col("cx")) / radius, (F.col("py") - F.col("cy")) / radius
    slope = F.col("longitudinal_displacement") * ux + F.col("lateral_displacement") * uy
    base = relations.withColumn("_slope", slope).withColumn("_radius", radius).where(F.col("_slope") != 0)
    located = base.select(
        *EDGE_KEYS, "_slope", "_radius", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("_target")
    ).select(*EDGE_KEYS, ((F.col("_target") + F.col("_radius")) / F.col("_slope")).alias("t"))
    return located.where((F.col("t") > 0) & (F.col("t") < 1)).distinct()
