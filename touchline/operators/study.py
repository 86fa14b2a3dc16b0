"""State-first reductions and the long metric table with match and macro rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from touchline.operators.evaluation import correlation
from touchline.operators.options import KEYS, receiver_pairs
from touchline.plans.ordered import MACRO, counted_summary, match_macro_summary, weight_units
from touchline.plans.sizing import counted_side
from touchline.session import cut_lineage


def pair_means(pairs: DataFrame, value: str) -> DataFrame:
    """One mean per state; states without a pair stay out."""
    return pairs.groupBy(*KEYS).agg(F.avg(value).alias("value"), F.count(value).alias("source_observations"))


def category_proportions(pairs: DataFrame, category: str, names: Sequence[str]) -> DataFrame:
    """Share of every category per state with pairs, zero shares included."""
    shares = pairs.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("source_observations"),
        *[F.avg((F.col(category) == n).cast("double")).alias(n) for n in names],
    )
    items = [F.struct(F.lit(n).alias("category"), F.col(n).alias("value")) for n in names]
    return shares.select(*KEYS, "source_observations", F.inline(F.array(*items)))


def state_table(discovered: DataFrame, values: DataFrame) -> DataFrame:
    """Match and macro rows over state values, with assessable and unavailable states."""
    joined = discovered.select(*KEYS).join(values.select(*KEYS, "value", "source_observations"), list(KEYS), "left")
    per_match = joined.groupBy(F.col("match_id").alias("alias")).agg(
        F.count(F.lit(1)).alias("states_total"),
        F.count("value").alias("states_assessable"),
        F.coalesce(F.sum("source_observations"), F.lit(0)).alias("source_observations"),
    )
    counts = per_match.unionByName(
        per_match.groupBy(F.lit(MACRO).alias("alias")).agg(
            *[F.sum(c).alias(c) for c in ("states_total", "states_assessable", "source_observations")]
        )
    )
    stats = match_macro_summary(values.withColumn("_k", F.lit(0)), ["_k"], "match_id", "value").drop("_k", "count")
    unavailable = F.col("states_total") - F.col("states_assessable")
    reason = F.when(unavailable > 0, "no_eligible_pairs").otherwise("none")
    return counts.join(stats, "alias", "left").withColumns(
        {
            "states_unavailable": unavailable,
            "unavailable_reason": reason,
            "represented_matches": F.coalesce("represented_matches", F.lit(0)),
        }
    )


def metric_tables(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, alias) rows over (keys, state, value) items.

    An item weighs 1 / items of its state; in the macro row additionally
    1 / represented matches / represented states of its match.
    """
    keys = list(keys)
    state = Window.partitionBy(*keys, *KEYS)
    # The items are read several times; their state's count is found once.
    held = cut_lineage(
        values.where(F.col("value").isNotNull()).select(*keys, "match_id", "value", F.count(F.lit(1)).over(state).alias("n"))
    )
    # A state of n items has n rows with this n.
    per_match = held.groupBy(*keys, "match_id", "n").agg(F.count(F.lit(1)).alias("rows")).groupBy(*keys, "match_id").agg(
        F.sum(F.expr("rows div n")).alias("states"), F.sum("rows").alias("items")
    )
    represented = per_match.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    weights = counted_side(
        per_match.join(represented, keys).select(
            *keys, "match_id", (1.0 / F.col("matches") / F.col("states")).alias("each")
        )
    )
    # Weights depend on the match and the state's count alone: they are put on few lines, not on the items.
    lines = counted_side(
        held.groupBy(*keys, "match_id", "n").agg(F.count(F.lit(1)).alias("_items")).join(weights, [*keys, "match_id"])
        .select(
            *keys, "match_id", "n",
            F.inline(
                F.array(
                    F.struct(F.col("match_id").alias("alias"), (1.0 / F.col("n")).alias("_w")),
                    F.struct(F.lit(MACRO).alias("alias"), (1.0 / F.col("n") * F.col("each")).alias("_w")),
                )
            ),
        )
        .withColumn("_units", weight_units(F.col("_w"), F.max("_w").over(Window.partitionBy(*keys, "alias"))))
    )
    return counted_summary(held, lines, [*keys, "match_id", "n"], [*keys, "alias"], "value")


def order_category(x, y):
    """Category of a pair's order signs under two rankings."""
    return (
        F.when((x == 0) & (y == 0), "both_tied")
        .when(y == 0, "tie_creation")
        .when(x == 0, "tie_removal")
        .when(x == y, "agreement")
        .otherwise("strict_reversal")
    )


ORDER_CATEGORIES = ("agreement", "strict_reversal", "tie_creation", "tie_removal", "both_tied")
FOLLOWS = ("endpoint_following", "corridor_following", "tied")


def ranked_pairs(ranked: DataFrame, *ranks: str) -> DataFrame:
    """Pairs of a state's edges with the order sign under every rank column."""
    pairs = receiver_pairs(ranked, *ranks)
    sign = lambda r: F.signum(F.col(f"b_{r}") - F.col(f"a_{r}")).alias(r)
    return pairs.select(*KEYS, "a_ord", "b_ord", *[sign(r) for r in ranks])


def followed(pairs: DataFrame, receiver: str, segment: str, field: str) -> DataFrame:
    """Pairs the two distances order differently, and which of the two the field follows."""
    apart = pairs.where(F.col(receiver) * F.col(segment) < 0)
    kind = (
        F.when(F.col(field) == 0, "tied")
        .when(F.col(field) == F.col(receiver), "endpoint_following")
        .otherwise("corridor_following")
    )
    return apart.withColumn("follows", kind)


def state_spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman per state; the few edges of a state are ranked by a window."""

    def average_rank(c: str):
        below = F.rank().over(Window.partitionBy(*KEYS).orderBy(c))
        same = F.count(F.lit(1)).over(Window.partitionBy(*KEYS, c))
        return below + (same - 1) / 2.0

    ranked = rows.withColumn("_x", average_rank(x)).withColumn("_y", average_rank(y))
    return ranked.groupBy(*KEYS).agg(correlation("_x", "_y").alias("rho"))
