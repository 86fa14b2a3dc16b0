"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its target share of the rows times all rows,
divided by its own rows. A document's number of copies is the inverse of the Poisson
distribution with that mean at a point fixed by a hash of the seed and its id (without one: its text), so a
rerun or a lost executor gives the same copies. The copies are then dealt to partitions by a
second hash and ordered by it, which is a global shuffle without a global sort.

Cases: a null source is a source of its own; rows of one id share their draws, as do rows of one
text without an id (a null text counts as empty, and without a text column they all share one); an empty table stays empty; a
source without a weight has weight 0 and disappears; columns of other names pass through,
columns called ``copy`` or ``shuffle_key`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored, unit_interval, with_clean_names

# Above this mean a document is split into draws with half of the mean (sums of Poisson draws are Poisson).
LARGEST_MEAN = 16.0
# Terms of the distribution; at a mean of 16 the rest weighs less than 2^-53.
TERMS = 80
# Source rows (name and rate) that may be broadcast; beyond it the rates are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def source_sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    return docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows"))


def tempered_weights(sizes: DataFrame, temperature: float) -> DataFrame:
    """Target weights: the share of each source, raised to ``temperature`` and scaled to sum 1."""
    raised = sizes.withColumn("raised", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    total = raised.agg(F.sum("raised").alias("all_raised"))
    return raised.crossJoin(F.broadcast(total)).select("mix_source", (F.col("raised") / F.col("all_raised")).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, scale: float = 1.0) -> DataFrame:
    """``scale`` is the size of the mixture in units of the input rows."""
    total = sizes.agg(F.sum("n_rows").alias("all_rows"))
    named = weights.select(F.col("mix_source").alias("weight_source"), "weight")
    return (
        sizes.join(named, F.col("mix_source").eqNullSafe(F.col("weight_source")), "left")
        .crossJoin(F.broadcast(total))
        .select(
            "mix_source",
            (F.coalesce("weight", F.lit(0.0)) * F.lit(scale) * F.col("all_rows") / F.col("n_rows")).alias("mix_rate"),
        )
    )


def poisson_count(mean: "F.Column", point: "F.Column") -> "F.Column":
    """The smallest k whose cumulative probability exceeds ``point``; ``mean`` is at most 16."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda a, i: F.when(a["below"] > point, a).otherwise(
            F.struct(
                (a["term"] * mean / i).alias("term"),
                (a["below"] + a["term"] * mean / i).alias("below"),
                i.alias("k"),
            )
        ),
        lambda a: a["k"],
    )


def draw_key(docs: DataFrame, doc_id: str, text: str = "text") -> "F.Column":
    """What tells rows apart when draws are hashed: the id, or the text of a row without one."""
    if text not in docs.columns:
        return F.col(doc_id).cast("string")
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))


def replicate(docs: DataFrame, rates: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, dealt out in a random order."""
    docs = with_clean_names(docs, "copy", "shuffle_key", "mix_rate", "mix_source", "mix_copies")
    rates = stored(rates, "mix-rates")
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    largest = rates.agg(F.max("mix_rate")).first()[0] or 0.0
    draws = max(1, math.ceil(largest / LARGEST_MEAN))
    rated = docs.join(F.broadcast(rates) if small else rates, F.col(source).eqNullSafe(F.col("mix_source")), "left")
    counted = F.lit(0)
    for draw in range(draws):
        counted = counted + poisson_count(F.col("mix_rate") / draws, unit_interval(seed, draw, draw_key(docs, doc_id)))
    return (
        rated.withColumn("mix_copies", counted)
        .where("mix_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .withColumn("shuffle_key", unit_interval(seed, "order", draw_key(docs, doc_id), F.col("copy")))
        .drop("mix_rate", "mix_source", "mix_copies")
        .repartition(F.col("shuffle_key"))
        .sortWithinPartitions("shuffle_key", doc_id, "copy")
    )


def mix(docs: DataFrame, temperature: float = 0.5, scale: float = 1.0, seed: int = 17, weights: DataFrame | None = None) -> DataFrame:
    """Mix to ``weights`` (mix_source, weight), or to tempered shares of the sources."""
    sizes = stored(source_sizes(docs), "mix-sizes")
    return replicate(docs, repetition_rates(sizes, weights if weights is not None else tempered_weights(sizes, temperature), scale), seed=seed)
