"""Column helpers over tie blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fractional_membership(first: Column, last: Column, k) -> Column:
    """Share of a tie block that falls within the top k positions."""
    k = k if isinstance(k, Column) else F.lit(k)
    inside = F.greatest(F.lit(0), F.least(last, k) - first + 1)
    return inside / (last - first + 1)


def block_hits(first: Column, last: Column, k: int) -> Column:
    """Share of the positions of a block that are at most k."""
    return fractional_membership(first, last, k)


def expected_reciprocal(first: Column, last: Column) -> Column:
    """Mean of 1/position over a tie block."""
    total = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda acc, p: acc + 1.0 / p)
    # Single positions need no fold.
    return F.when(first == last, 1.0 / first).otherwise(total / (last - first + 1))
