"""Tie blocks anchored at their first value.

Ordered values fall into islands wherever neighbours differ by more than 1e-12. An
island whose values all lie within 1e-12 of its first one is a block. Wider islands are
split exactly as a left-to-right scan would: the values that lie beyond the first anchor
are folded into further anchors. That running list is empty for almost every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.scalars import TIE


def _further_anchors(values: Column) -> Column:
    start = F.slice(values, 1, 1)
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.when(v - F.element_at(acc, -1) <= TIE, acc).otherwise(F.array_append(acc, v)),
    )


def tie_blocks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    descending: bool = False,
    order: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """Add position, block (0-based), first, last (1-based positions) and rank.

    Meant for groups that are short by nature, the players around one ball carrier.
    """
    v = -F.col(value) if descending else F.col(value)
    # One order for all windows, so that the rows are sorted once.
    along = Window.partitionBy(*keys).orderBy("_v", *order)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = along.rowsBetween(1, Window.unboundedFollowing)
    opens = F.coalesce(F.col("_v") - F.lag("_v").over(along) > TIE, F.lit(True))
    # A list per group, not per row: an equal value opens no anchor, so the values up to a row's own are its own prefix.
    beyond = F.filter("_beyond", lambda x: x <= F.col("_v"))
    position, block = f"{prefix}position", f"{prefix}block"
    return (
        df.withColumn("_v", v)
        .withColumns({"_opens": opens, position: F.row_number().over(along)})
        .withColumns(
            {
                "_island": F.sum(F.col("_opens").cast("int")).over(running) - 1,
                "_start": F.last(F.when(F.col("_opens"), F.col("_v")), ignorenulls=True).over(running),
            }
        )
        .withColumn("_beyond", F.collect_list(F.when(F.col("_v") - F.col("_start") > TIE, F.col("_v"))).over(whole))
        .withColumn(
            block,
            (F.col("_island") + F.when(F.size("_beyond") == 0, 0).otherwise(F.size(_further_anchors(beyond)))).cast("int"),
        )
        .withColumn("_begins", F.coalesce(F.col(block) != F.lag(block).over(along), F.lit(True)))
        .withColumns(
            {
                f"{prefix}first": F.last(F.when(F.col("_begins"), F.col(position)), ignorenulls=True).over(running),
                f"{prefix}last": F.coalesce(
                    F.min(F.when(F.col("_begins"), F.col(position) - 1)).over(after), F.count(F.lit(1)).over(whole).cast("int")
                ),
            }
        )
        .withColumn(f"{prefix}rank", (F.col(f"{prefix}first") + F.col(f"{prefix}last")) / 2.0)
        .drop("_v", "_opens", "_island", "_start", "_beyond", "_begins")
    )
