"""Broadcast only what was counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from touchline.session import cut_lineage

# Rows of a narrow lookup (a few keys and numbers) that every executor may hold.
BROADCAST_ROWS = 500_000


def counted_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise an aggregate, count it, and broadcast it only when it is small.

    Above the limit the same frame comes back unhinted, so the join shuffles both
    sides and adaptive skew handling splits the hot ones.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= limit else kept
