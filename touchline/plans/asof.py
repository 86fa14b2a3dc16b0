"""Strict as-of join with a tolerance, cut into time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_before(
    events: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    event_id: str,
    clock: str,
    frame: str,
    tolerance_us: int,
    bucket_us: int | None = None,
) -> DataFrame:
    """Latest frame strictly earlier than each event, at most ``tolerance_us`` old.

    Both sides carry ``keys`` and the integer ``clock``. The partition of the window is
    (keys, time bucket), never a whole match: a bucket is at least as long as the
    tolerance, so beside its own frames it needs just the last frame of the bucket
    before, one carry row per bucket. Returns keys, ``event_id``, event clock,
    ``frame`` and ``frame_clock``, nulls where no frame qualifies.
    """
    keys = list(keys)
    width = max(tolerance_us, bucket_us or tolerance_us)
    bucket = F.floor(F.col(clock) / width)
    none = F.lit(None)
    sample = F.struct(F.col(clock).alias("t"), F.col(frame).cast("long").alias("f"))
    tracked = frames.select(*keys, clock, bucket.alias("_bucket"), sample.alias("_frame"))
    carried = tracked.groupBy(*keys, "_bucket").agg(F.max("_frame").alias("_frame")).select(
        *keys, F.col("_frame.t").alias(clock), (F.col("_bucket") + 1).alias("_bucket"), "_frame"
    )
    kind = events.schema[event_id].dataType
    frame_rows = tracked.unionByName(carried).select(
        *keys, clock, "_bucket", F.lit(1).alias("_side"), "_frame", none.cast(kind).alias(event_id)
    )
    event_rows = events.select(
        *keys, clock, bucket.alias("_bucket"), F.lit(0).alias("_side"),
        none.cast(tracked.schema["_frame"].dataType).alias("_frame"), event_id,
    )
    # Events sort before frames at equal clock, so an equal clock never matches.
    order = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(clock, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        event_rows.unionByName(frame_rows)
        .withColumn("_hit", F.last("_frame", ignorenulls=True).over(order))
        .where(F.col("_side") == 0)
    )
    fresh = F.col(clock) - F.col("_hit.t") <= tolerance_us
    return matched.select(
        *keys,
        event_id,
        clock,
        F.when(fresh, F.col("_hit.f")).alias(frame),
        F.when(fresh, F.col("_hit.t")).alias("frame_clock"),
    )
