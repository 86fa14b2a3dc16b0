"""Ordered computations that do not put one whole group into one task.

A window over a plain group key sends the group to a single task. Here the order
itself is cut into buckets: a small table holds one total per (group, bucket), its
running sum gives every bucket its starting offset, and the fine window runs inside
(group, bucket) only. Buckets come from the value, so no sampling is involved and a
retried task sees the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.plans.sizing import counted_side

# Buckets per factor e of the value: neighbours in a bucket differ by under 0.4 %.
VALUE_BUCKETS = 256
_LOG_SHIFT = 800 * VALUE_BUCKETS
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
# Weights are counted in whole units, 2^52 for the group's largest weight, so that their sums are
# the same in any order. A double and its rounding are less than two units off, so a quantile counts
# as reached from two units a row below: a 2^-51 of the largest weight, and no share of the total.
WHOLE = 2**52
# Quantile shares are compared as whole numbers of 1 / SHARES.
SHARES = 10_000


def value_bucket(value: Column) -> Column:
    """A long that never decreases as the double ``value`` grows."""
    scaled = F.floor(F.log(F.abs(value)) * VALUE_BUCKETS) + _LOG_SHIFT
    return (
        F.when(value == 0.0, F.lit(0).cast("long"))
        .when(value > 0, scaled)
        .otherwise(-scaled)
        .cast("long")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in ``order``.

    ``bucket`` must not decrease along the first order column.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    steps = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_total").over(steps), F.lit(0)).alias("_offset"))
    )
    fine = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.sum("_value").over(fine))
        .drop("_bucket", "_value", "_offset")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: Column,
    carried: Sequence[str],
    name: str,
) -> DataFrame:
    """Struct ``name`` with ``carried`` of the row just before, in ``order`` and then by ``carried``.

    Inside a bucket it is a plain lag; the first row of a bucket takes the last row of
    the nearest earlier bucket, found on one row per bucket.
    """
    keys = list(keys)
    tagged = df.withColumn("_bucket", bucket).withColumn("_row", F.struct(order, *carried))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carry = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.max("_row").alias("_last"))
        .select(*keys, "_bucket", F.lag("_last").over(by_bucket).alias("_carry"))
    )
    fine = Window.partitionBy(*keys, "_bucket").orderBy("_row")
    return (
        tagged.join(carry, [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.lag("_row").over(fine), F.col("_carry")))
        .drop("_bucket", "_row", "_carry")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank of equal values within ``keys`` (the Spearman convention)."""
    keys = list(keys)
    distinct = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(distinct, keys, [value], value_bucket(F.col(value)), F.col("_n"), "_upto")
    ranks = ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def row_number_by_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """1-based position within ``keys`` in a total ``order``."""
    return running_sum(df, keys, order, bucket, F.lit(1).cast("long"), name)


def weight_units(weight: Column, largest: Column) -> Column:
    """Whole units of a weight; equal weights have equal units."""
    units = F.floor(weight / largest * F.lit(float(WHOLE)))
    return F.when((weight > 0) & (largest > 0), units).otherwise(F.lit(0)).cast("long")


def unit_sum(units: Column) -> Column:
    """Exact sum of whole units as a decimal, from sums of their halves: long additions on the rows."""
    high, low = F.shiftright(units, 26), units.bitwiseAND(F.lit(2**26 - 1).cast("long"))
    return (F.sum(high).cast("decimal(19,0)") * F.lit(2**26).cast("decimal(9,0)") + F.sum(low).cast("decimal(19,0)")).cast("decimal(38,0)")


def reached(cumulative: Column, total: Column, rows: Column, q: float) -> Column:
    return (cumulative + 2 * rows.cast("decimal(18,0)")).cast("decimal(33,0)") * F.lit(SHARES).cast("decimal(5,0)") >= total.cast("decimal(33,0)") * F.lit(round(q * SHARES)).cast("decimal(5,0)")


def weighted_summary(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weight: str,
    quantiles: Sequence[float] = QUANTILES,
    largest: DataFrame | None = None,
) -> DataFrame:
    """count, mean, minimum, maximum and inverse-ECDF quantiles per group.

    A quantile is the smallest value whose cumulative weight reaches q of the total.
    Pass one aggregates the rows to (group, bucket); that table names the buckets in
    which the quantiles lie. Pass two looks only at rows of those buckets. Rows with a
    null value or weight are left out. ``largest`` (groups, _most) spares the pass that
    looks for the largest weights, where they are known.
    """
    groups = list(groups)
    rows = (
        df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
        .select(*groups, F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w"))
        .withColumn("_bucket", value_bucket(F.col("_v")))
    )
    if largest is None:
        largest = rows.groupBy(*groups).agg(F.max("_w").alias("_most"))
    rows = rows.join(counted_side(largest), groups).withColumn("_units", weight_units(F.col("_w"), F.col("_most"))).drop("_most")
    buckets = rows.groupBy(*groups, "_bucket").agg(
        F.sum("_w").alias("_bw"),
        unit_sum(F.col("_units")).alias("_bu"),
        F.sum(F.col("_v") * F.col("_w")).alias("_bvw"),
        F.count(F.lit(1)).alias("_bn"),
        F.min("_v").alias("_bmin"),
        F.max("_v").alias("_bmax"),
    )
    return _finish_summary(rows, counted_side(buckets), groups, quantiles)


def counted_summary(
    df: DataFrame, lines: DataFrame, keys: Sequence[str], groups: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """``weighted_summary`` where all rows of the same ``keys`` weigh the same.

    ``lines`` gives a key's groups, each with its weight ``_w`` and ``_units``. Rows are aggregated once by key and
    bucket, without their groups; only for the critical buckets are they read again.
    """
    keys, groups = list(keys), list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_bucket", value_bucket(F.col("_v")))
    cells = rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_bn"), F.sum("_v").alias("_bv"), F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")
    )
    buckets = cells.join(lines, keys).groupBy(*groups, "_bucket").agg(
        F.sum(F.col("_bn") * F.col("_w")).alias("_bw"),
        F.sum(F.col("_bn").cast("decimal(18,0)") * F.col("_units").cast("decimal(20,0)")).cast("decimal(38,0)").alias("_bu"),
        F.sum(F.col("_bv") * F.col("_w")).alias("_bvw"),
        F.sum("_bn").alias("_bn"),
        F.min("_bmin").alias("_bmin"),
        F.max("_bmax").alias("_bmax"),
    )
    grouped = rows.join(lines.drop("_w"), keys).select(*groups, "_v", "_bucket", "_units")
    return _finish_summary(grouped, counted_side(buckets), groups, quantiles)


def _finish_summary(rows, buckets, groups, quantiles):
    along = Window.partitionBy(*groups).orderBy("_bucket")
    whole = Window.partitionBy(*groups)
    stepped = (
        buckets.withColumn("_upto", F.sum("_bu").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_bu").over(whole))
        .withColumn("_rows", F.sum("_bn").over(whole))
        .withColumn("_before", F.col("_upto") - F.col("_bu"))
    )
    at = lambda column, q: reached(F.col(column), F.col("_total"), F.col("_rows"), q)
    # A bucket is needed when some quantile is reached inside it.
    needed = F.lit(False)
    for q in quantiles:
        needed = needed | (~at("_before", q) & at("_upto", q))
    critical = counted_side(
        stepped.where(needed).select(*groups, "_bucket", "_before", "_total", "_rows")
    )
    fine = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = (
        rows.join(critical, [*groups, "_bucket"])
        .groupBy(*groups, "_bucket", "_v", "_before", "_total", "_rows")
        .agg(unit_sum(F.col("_units")).alias("_units"))
        .withColumn("_cum", F.col("_before") + F.sum("_units").over(fine))
        .groupBy(*groups)
        .agg(*[F.min(F.when(at("_cum", q), F.col("_v"))).alias(_quantile_name(q)) for q in quantiles])
    )
    overall = buckets.groupBy(*groups).agg(
        F.sum("_bn").alias("count"),
        F.try_divide(F.sum("_bvw"), F.sum("_bw")).alias("mean"),
        F.min("_bmin").alias("minimum"),
        F.max("_bmax").alias("maximum"),
    )
    return overall.join(located, groups)


def _quantile_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


MACRO = "macro"


def match_macro_summary(
    df: DataFrame, keys: Sequence[str], match: str, value: str, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """One row per (keys, match) with equal weights and one 'macro' row per keys in
    which every represented match weighs the same.

    Weights depend only on counts, so they are put on the bucket table instead of on
    the rows: the rows are read for pass one and again for the few critical buckets.
    """
    keys = list(keys)
    rows = (
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(match).cast("string").alias("alias"), F.col(value).cast("double").alias("_v"))
        .withColumn("_bucket", value_bucket(F.col("_v")))
    )
    per_match = counted_side(
        rows.groupBy(*keys, "alias", "_bucket").agg(
            F.count(F.lit(1)).alias("_bn"),
            F.sum("_v").alias("_bv"),
            F.min("_v").alias("_bmin"),
            F.max("_v").alias("_bmax"),
        )
    )
    counts = per_match.groupBy(*keys, "alias").agg(F.sum("_bn").alias("_n"))
    represented = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("represented_matches"))
    shares = counts.join(represented, keys).withColumn("_each", 1.0 / F.col("represented_matches") / F.col("_n"))
    most = F.max("_each").over(Window.partitionBy(*keys))
    weights = counted_side(
        shares.select(*keys, "alias", "represented_matches", "_each", weight_units(F.col("_each"), most).alias("_own_units"))
    )
    by_match = per_match.select(
        *keys, "alias", "_bucket", F.col("_bn").cast("double").alias("_bw"),
        (F.col("_bn").cast("decimal(17,0)") * F.lit(WHOLE).cast("decimal(20,0)")).cast("decimal(38,0)").alias("_bu"), F.col("_bv").alias("_bvw"), "_bn", "_bmin", "_bmax",
    )
    by_macro = (
        per_match.join(weights, [*keys, "alias"])
        .groupBy(*keys, F.lit(MACRO).alias("alias"), "_bucket")
        .agg(
            F.sum(F.col("_bn") * F.col("_each")).alias("_bw"),
            F.sum(F.col("_bn").cast("decimal(18,0)") * F.col("_own_units").cast("decimal(20,0)")).cast("decimal(38,0)").alias("_bu"),
            F.sum(F.col("_bv") * F.col("_each")).alias("_bvw"),
            F.sum("_bn").alias("_bn"),
            F.min("_bmin").alias("_bmin"),
            F.max("_bmax").alias("_bmax"),
        )
    )
    weighted_rows = (
        rows.join(weights.select(*keys, "alias", "_own_units"), [*keys, "alias"])
        .select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col("alias"), F.lit(WHOLE).cast("long").alias("_units")),
                    F.struct(F.lit(MACRO).alias("alias"), F.col("_own_units").alias("_units")),
                )
            ).alias("_side"),
            "_v",
            "_bucket",
        )
        .select(*keys, "_side.alias", "_side._units", "_v", "_bucket")
    )
    summary = _finish_summary(
        weighted_rows, counted_side(by_match.unionByName(by_macro)), [*keys, "alias"], quantiles
    )
    matches = F.when(F.col("alias") == MACRO, F.col("represented_matches")).otherwise(F.lit(1))
    return summary.join(represented, keys).withColumn("represented_matches", matches)


def linear_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float] = QUANTILES
) -> DataFrame:
    """Linearly interpolated quantiles per group, exact, without holding a group in memory.

    The two neighbouring order statistics of every quantile are looked up in the few
    value buckets that contain them.
    """
    groups = list(groups)
    rows = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*groups, F.col(value).cast("double").alias("_v"))
        .withColumn("_bucket", value_bucket(F.col("_v")))
    )
    buckets = counted_side(rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    along = Window.partitionBy(*groups).orderBy("_bucket")
    stepped = (
        buckets.withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    place = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_upto"))
    needed = F.lit(False)
    for q in quantiles:
        needed = needed | holds(F.floor(place(q))) | holds(F.ceil(place(q)))
    critical = counted_side(stepped.where(needed).select(*groups, "_bucket", "_before", "_total"))
    fine = (
        Window.partitionBy(*groups, "_bucket").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = (
        rows.join(critical, [*groups, "_bucket"])
        .groupBy(*groups, "_bucket", "_v", "_before", "_total")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(fine))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    picks = []
    for i, q in enumerate(quantiles):
        picks += [
            F.max(F.when(holds(F.floor(place(q))), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when(holds(F.ceil(place(q))), F.col("_v"))).alias(f"_hi{i}"),
        ]
    found = located.groupBy(*groups, "_total").agg(*picks)
    between = [
        (F.col(f"_lo{i}") + (place(q) - F.floor(place(q))) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(
            _quantile_name(q)
        )
        for i, q in enumerate(quantiles)
    ]
    return found.select(*groups, *between)
