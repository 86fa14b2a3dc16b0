"""Plane geometry and directional fields as column expressions (metres)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from touchline.functions.scalars import LENGTH_GUARD

# Fixed values of the field hypotheses.
FIELD_SIGMA = 2.0
FIELD_ANGLE_DEGREES = 10.0
ATTENUATION_METRES = 5.0


def length(x: Column, y: Column) -> Column:
    """sqrt(x^2 + y^2) as SQL computes it: ``hypot`` rounds differently, which orders near ties differently."""
    return F.sqrt(x * x + y * y)


def segment_fraction(px, py, ax, ay, bx, by) -> Column:
    """Clamped projection of a point on a segment; 0 for a degenerate segment."""
    vx, vy = bx - ax, by - ay
    length2 = vx * vx + vy * vy
    along = ((px - ax) * vx + (py - ay) * vy) / length2
    return F.when(length2 <= LENGTH_GUARD * LENGTH_GUARD, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    )


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = segment_fraction(px, py, ax, ay, bx, by)
    return length(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def isotropic_field(ox, oy, dx, dy, qx, qy) -> Column:
    reach = F.hypot(qx - dx, qy - dy) / FIELD_SIGMA
    return F.exp(-0.5 * reach * reach)


def _shadow(ox, oy, dx, dy, qx, qy, tangent: float) -> Column:
    """Smooth onset behind the defender times a lateral bell of (growing) width."""
    radius = F.hypot(dx - ox, dy - oy)
    ux, uy = (dx - ox) / radius, (dy - oy) / radius
    behind = (qx - dx) * ux + (qy - dy) * uy
    beside = F.abs((qx - dx) * uy - (qy - dy) * ux)
    onset = F.greatest(F.lit(0.0), F.least(F.lit(1.0), behind))
    width = FIELD_SIGMA + F.greatest(behind, F.lit(0.0)) * tangent if tangent else F.lit(FIELD_SIGMA)
    lateral = beside / width
    return onset * onset * (3.0 - 2.0 * onset) * F.exp(-0.5 * lateral * lateral)


def constant_width_field(ox, oy, dx, dy, qx, qy) -> Column:
    return _shadow(ox, oy, dx, dy, qx, qy, 0.0)


def expanding_field(ox, oy, dx, dy, qx, qy) -> Column:
    import math

    return _shadow(ox, oy, dx, dy, qx, qy, math.tan(math.radians(FIELD_ANGLE_DEGREES)))


FieldFunction = Callable[..., Column]

# Users add their own field here or pass a callable wherever a field name is taken.
FIELDS: dict[str, FieldFunction] = {
    "isotropic": isotropic_field,
    "expanding": expanding_field,
    "constant_width": constant_width_field,
}


def union_strength(value: Column) -> Column:
    """Aggregate 1 - prod(1 - v), summed in log space; 1 as soon as one v is 1."""
    log_sum = F.sum(F.log1p(F.when(value < 1.0, -value)))
    return F.when(F.max(value) >= 1.0, F.lit(1.0)).otherwise(-F.expm1(log_sum))


# Aggregates over the defender strengths at one point; users add their own.
COMBINATIONS: dict[str, Callable[[Column], Column]] = {"union": union_strength, "maximum": F.max}


def goalward_progress(x: Column, length: Column) -> Column:
    """0 at the own goal line, 1 at the opposing one; null outside the pitch."""
    return F.when(F.abs(x) <= length / 2, 0.5 + x / length)


def pitch_coordinate(value: Column, size: Column) -> Column:
    """Shift a centred coordinate to a corner origin; null when it falls outside."""
    moved = value + size / 2
    return F.when((moved >= 0) & (moved <= size), moved)
