"""Defender relations, their ranks, and involvement summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import (
    EDGES,
    RANKED,
    RANKS,
    ROUNDED_STATS,
    SCORED,
    STAT_COLUMNS,
    macro_summary_sql,
    query,
    with_ctes,
)
from touchline.catalog.options import M1
from touchline.functions.scalars import rounded
from touchline.operators import options as op
from touchline.operators import relations as rel
from touchline.plans.ordered import match_macro_summary
from touchline.sources.testtables import states, stored_states


def relations(spark, sf_dir):
    return rel.defender_relations(states(spark, sf_dir))


@query(
    "jn08_edge_defender_relation",
    with_ctes(EDGES)
    + """SELECT event_id, id, CAST(d AS BIGINT) AS d, round(rdist, 6) + 0e0 AS receiver_distance,
    round(sdist, 6) + 0e0 AS segment_distance FROM relation""",
)
def _(spark, sf_dir):
    rows = op.relation_rows(states(spark, sf_dir))
    return rows.select(
        "event_id",
        "id",
        F.col("d").cast("long").alias("d"),
        rounded(F.col("receiver_distance")).alias("receiver_distance"),
        rounded(F.col("segment_distance")).alias("segment_distance"),
    )


_BOTH_KINDS = """SELECT r.k, r.match_id, r.j, r.id, r.d, r.nc, r.nd,
    {fields}
  FROM ranked r JOIN ranked s USING (k, j, d) WHERE r.kind = 'receiver' AND s.kind = 'segment'"""


@query(
    "win02_ascending_tie_blocks",
    with_ctes(RANKS)
    + """SELECT CAST(k AS VARCHAR) AS event_id, kind, id, CAST(d AS BIGINT) AS d, CAST(block AS BIGINT) AS block,
    CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, (first + last) / 2e0 AS rank FROM ranked""",
)
def _(spark, sf_dir):
    side = lambda kind: F.struct(
        F.lit(kind).alias("kind"),
        *[F.col(f"{kind}_{f}").cast("long").alias(f) for f in ("block", "first", "last")],
        F.col(f"{kind}_rank").alias("rank"),
    )
    return relations(spark, sf_dir).select(
        "event_id", "id", F.col("d").cast("long").alias("d"),
        F.inline(F.array(side("receiver"), side("segment"))),
    )


@query(
    "win03_expected_rank_both_ways",
    with_ctes(RANKS)
    + """SELECT CAST(k AS VARCHAR) AS event_id, id, CAST(d AS BIGINT) AS d, (first + last) / 2e0 AS nearest_first,
    nd + 1 - (first + last) / 2e0 AS farthest_first FROM ranked WHERE kind = 'segment'""",
)
def _(spark, sf_dir):
    from touchline.plans.ties import tie_blocks

    rows = op.relation_rows(states(spark, sf_dir))
    near = tie_blocks(rows, op.EDGE_KEYS, "segment_distance", prefix="near_")
    both = tie_blocks(near, op.EDGE_KEYS, "segment_distance", descending=True, prefix="far_")
    return both.select(
        "event_id",
        "id",
        F.col("d").cast("long").alias("d"),
        F.col("near_rank").alias("nearest_first"),
        F.col("far_rank").alias("farthest_first"),
    )


@query(
    "win07_fractional_membership",
    with_ctes(RANKS)
    + "SELECT CAST(k AS VARCHAR) AS event_id, id, CAST(d AS BIGINT) AS d, "
    + ", ".join(
        f"round(greatest(0, least(last, {k}) - first + 1) / (last - first + 1), 6) AS top{k}"
        for k in (1, 2, 3)
    )
    + " FROM ranked WHERE kind = 'segment'",
)
def _(spark, sf_dir):
    return relations(spark, sf_dir).select(
        "event_id",
        "id",
        F.col("d").cast("long").alias("d"),
        *[rounded(rel.membership("segment", k)).alias(f"top{k}") for k in rel.TOPS],
    )


@query(
    "flt08_receiver_and_nearest_relations",
    with_ctes(RANKS)
    + """SELECT CAST(k AS VARCHAR) AS event_id, 'first_receiver' AS picked, id, CAST(d AS BIGINT) AS d
    FROM ranked WHERE kind = 'segment' AND j = 0
    UNION ALL SELECT CAST(k AS VARCHAR), 'nearest', id, CAST(d AS BIGINT) FROM ranked WHERE kind = 'segment' AND block = 0""",
)
def _(spark, sf_dir):
    rows = relations(spark, sf_dir)
    pick = lambda df, name: df.select(
        "event_id", F.lit(name).alias("picked"), "id", F.col("d").cast("long").alias("d")
    )
    return pick(rel.relations_of(rows, 0), "first_receiver").unionByName(
        pick(rel.nearest_relations(rows, "segment"), "nearest")
    )


@query(
    "top03_nearest_defenders",
    with_ctes(RANKS)
    + """SELECT CAST(k AS VARCHAR) AS event_id, id, n AS k, string_agg(d, ',' ORDER BY d) AS defenders
    FROM ranked, (VALUES (1), (2), (3)) t(n) WHERE kind = 'segment' AND first <= n GROUP BY ALL""",
)
def _(spark, sf_dir):
    sets = rel.top_defender_sets(relations(spark, sf_dir)).join(
        op.candidate_rows(states(spark, sf_dir)).select(*op.EDGE_KEYS, "id"), list(op.EDGE_KEYS)
    )
    side = lambda k: F.struct(
        F.lit(k).alias("k"), F.array_join(F.array_sort(f"top{k}"), ",").alias("defenders")
    )
    return sets.select("event_id", "id", F.inline(F.array(*[side(k) for k in rel.TOPS])))


_INVOLVED = (
    RANKS
    + """,
pivoted AS (
  SELECT *, (first + last) / 2e0 AS rank,
    greatest(0, least(last, 1) - first + 1) / (last - first + 1) AS t1,
    greatest(0, least(last, 2) - first + 1) / (last - first + 1) AS t2,
    greatest(0, least(last, 3) - first + 1) / (last - first + 1) AS t3
  FROM ranked),
involved AS (
  SELECT k, match_id, d, kind, count(*) FILTER (block = 0) AS nearest_edges, avg(rank) AS mean_rank, median(rank) AS median_rank,
    min(dist) AS distance_min, median(dist) AS distance_median, max(dist) AS distance_max,
    sum(t1) AS top1_involvement, sum(t2) AS top2_involvement, sum(t3) AS top3_involvement,
    avg(t1) AS top1_edge_share, avg(t2) AS top2_edge_share, avg(t3) AS top3_edge_share
  FROM pivoted GROUP BY k, match_id, d, kind)"""
)
_INVOLVED_FIELDS = (
    "mean_rank", "median_rank", "distance_min", "distance_median", "distance_max",
    "top1_involvement", "top2_involvement", "top3_involvement",
    "top1_edge_share", "top2_edge_share", "top3_edge_share",
)


@query(
    "agg33_defender_involvement",
    with_ctes(_INVOLVED)
    + "SELECT CAST(k AS VARCHAR) AS event_id, CAST(d AS BIGINT) AS d, kind, nearest_edges, "
    + ", ".join(f"round({f}, 6) + 0e0 AS {f}" for f in _INVOLVED_FIELDS)
    + " FROM involved",
)
def _(spark, sf_dir):
    rows = rel.defender_involvement(relations(spark, sf_dir))
    side = lambda kind: F.struct(
        F.lit(kind).alias("kind"),
        F.col(f"{kind}_nearest_edges").alias("nearest_edges"),
        *[rounded(F.col(f"{kind}_{f}")).alias(f) for f in _INVOLVED_FIELDS],
    )
    return rows.select(
        "event_id", F.col("d").cast("long").alias("d"), F.inline(F.array(*map(side, rel.KINDS)))
    )


_OVERLAP = """
gaps AS (
  SELECT k, j, list_sort(list(dist)) AS ds FROM ranked WHERE kind = 'segment' GROUP BY k, j),
overlap AS (
  SELECT r.k, r.match_id, r.j, r.id, count(*) FILTER (r.block = 0) AS receiver_nearest_count,
    count(*) FILTER (s.block = 0) AS segment_nearest_count,
    count(*) FILTER (r.block = 0 AND s.block = 0) AS both_n, count(*) FILTER (r.block = 0 OR s.block = 0) AS any_n,
    max(ds[2] - ds[1]) AS segment_d2_d1, max(ds[3] - ds[1]) AS segment_d3_d1,
    max(ds[1]) AS segment_d1, max(ds[2]) AS segment_d2, max(ds[3]) AS segment_d3
  FROM ranked r JOIN ranked s USING (k, j, d) JOIN gaps g ON g.k = r.k AND g.j = r.j
  WHERE r.kind = 'receiver' AND s.kind = 'segment' GROUP BY r.k, r.match_id, r.j, r.id)
"""


@query(
    "agg34_edge_overlap",
    with_ctes(RANKS, _OVERLAP)
    + """SELECT CAST(k AS VARCHAR) AS event_id, CAST(j AS BIGINT) AS ord, receiver_nearest_count, segment_nearest_count,
    both_n > 0 AS nearest_intersects, both_n = any_n AS nearest_equal, round(both_n / any_n, 6) AS nearest_jaccard,
    both_n = any_n AND any_n = 1 AS same_unique_nearest FROM overlap""",
)
def _(spark, sf_dir):
    return rel.edge_overlap(relations(spark, sf_dir)).select(
        "event_id",
        F.col("ord").cast("long").alias("ord"),
        "receiver_nearest_count",
        "segment_nearest_count",
        "nearest_intersects",
        "nearest_equal",
        rounded(F.col("nearest_jaccard")).alias("nearest_jaccard"),
        "same_unique_nearest",
    )


@query(
    "set02_nearest_set_operations",
    with_ctes(RANKS, _OVERLAP)
    + """SELECT CAST(k AS VARCHAR) AS event_id, CAST(j AS BIGINT) AS ord, both_n AS intersection_size,
    any_n AS union_size FROM overlap""",
)
def _(spark, sf_dir):
    near = lambda kind: F.collect_set(F.when(F.col(f"{kind}_block") == 0, F.col("d")))
    sets = relations(spark, sf_dir).groupBy(*op.EDGE_KEYS).agg(
        near("receiver").alias("r"), near("segment").alias("s")
    )
    return sets.select(
        "event_id",
        F.col("ord").cast("long").alias("ord"),
        F.size(F.array_intersect("r", "s")).cast("long").alias("intersection_size"),
        F.size(F.array_union("r", "s")).cast("long").alias("union_size"),
    )


@query(
    "agg28_smallest_segment_distances",
    with_ctes(RANKS, _OVERLAP)
    + """SELECT CAST(k AS VARCHAR) AS event_id, CAST(j AS BIGINT) AS ord, round(segment_d1, 6) + 0e0 AS segment_d1,
    round(segment_d2, 6) + 0e0 AS segment_d2, round(segment_d3, 6) + 0e0 AS segment_d3,
    round(segment_d2_d1, 6) + 0e0 AS segment_d2_d1, round(segment_d3_d1, 6) + 0e0 AS segment_d3_d1 FROM overlap""",
)
def _(spark, sf_dir):
    fields = ("segment_d1", "segment_d2", "segment_d3", "segment_d2_d1", "segment_d3_d1")
    return rel.edge_overlap(relations(spark, sf_dir)).select(
        "event_id", F.col("ord").cast("long").alias("ord"), *[rounded(F.col(f)).alias(f) for f in fields]
    )


_JACCARD = """
tops AS (
  SELECT k, match_id, j, list(d) FILTER (first <= 1) AS a1, list(d) FILTER (first <= 2) AS a2,
         list(d) FILTER (first <= 3) AS a3
  FROM ranked WHERE kind = 'segment' GROUP BY k, match_id, j),
jaccard AS (
  SELECT l.k, l.j AS a_ord, r.j AS b_ord,
    len(list_intersect(l.a1, r.a1)) / (len(l.a1) + len(r.a1) - len(list_intersect(l.a1, r.a1))) AS top1,
    len(list_intersect(l.a2, r.a2)) / (len(l.a2) + len(r.a2) - len(list_intersect(l.a2, r.a2))) AS top2,
    len(list_intersect(l.a3, r.a3)) / (len(l.a3) + len(r.a3) - len(list_intersect(l.a3, r.a3))) AS top3
  FROM tops l JOIN tops r ON l.k = r.k AND l.j < r.j)
"""


@query(
    "agg35_pair_jaccard",
    with_ctes(RANKS, _JACCARD)
    + """SELECT CAST(k AS VARCHAR) AS event_id, CAST(a_ord AS BIGINT) AS a_ord, CAST(b_ord AS BIGINT) AS b_ord,
    round(top1, 6) AS top1_jaccard, round(top2, 6) AS top2_jaccard, round(top3, 6) AS top3_jaccard FROM jaccard""",
)
def _(spark, sf_dir):
    return rel.pair_jaccard(relations(spark, sf_dir)).select(
        "event_id",
        F.col("a_ord").cast("long").alias("a_ord"),
        F.col("b_ord").cast("long").alias("b_ord"),
        *[rounded(F.col(f"top{k}_jaccard")).alias(f"top{k}_jaccard") for k in rel.TOPS],
    )


@query(
    "agg36_distinct_nearest_defenders",
    with_ctes(RANKS)
    + """SELECT CAST(k AS VARCHAR) AS event_id,
    count(DISTINCT d) FILTER (kind = 'receiver' AND block = 0) AS receiver_unique_nearest_defenders,
    count(DISTINCT d) FILTER (kind = 'segment' AND block = 0) AS segment_unique_nearest_defenders
    FROM ranked GROUP BY k""",
)
def _(spark, sf_dir):
    return rel.distinct_nearest(relations(spark, sf_dir)).select(
        "event_id", "receiver_unique_nearest_defenders", "segment_unique_nearest_defenders"
    )


_STATE_METRICS = (
    EDGES
    + ",\n"
    + SCORED.strip()
    + ",\n"
    + RANKED.strip()
    + ",\n"
    + _OVERLAP.strip()
    + ",\n"
    + _JACCARD.strip()
    + """,
per_edge AS (
  SELECT k, match_id, count(*) AS edges, avg(CAST(both_n > 0 AS DOUBLE)) AS nearest_intersects,
    avg(CAST(both_n = any_n AS DOUBLE)) AS nearest_equal,
    avg(CAST(both_n = any_n AND any_n = 1 AS DOUBLE)) AS same_unique_nearest,
    avg(CAST(receiver_nearest_count = 1 AS DOUBLE)) AS receiver_unique_nearest_edges,
    avg(CAST(segment_nearest_count = 1 AS DOUBLE)) AS segment_unique_nearest_edges,
    avg(segment_d2_d1) AS segment_d2_d1, avg(segment_d3_d1) AS segment_d3_d1
  FROM overlap GROUP BY k, match_id),
shares AS (SELECT k, j, share FROM scored WHERE model = 'm1'),
per_defender AS (
  SELECT k, d, count(*) FILTER (kind = 'receiver' AND block = 0) AS rn, count(*) FILTER (kind = 'segment' AND block = 0) AS sn,
    sum(CASE WHEN kind = 'segment' THEN greatest(0, least(last, 1) - first + 1) / (last - first + 1) END) AS i1,
    sum(CASE WHEN kind = 'segment' THEN greatest(0, least(last, 2) - first + 1) / (last - first + 1) END) AS i2,
    sum(CASE WHEN kind = 'segment' THEN greatest(0, least(last, 3) - first + 1) / (last - first + 1) END) AS i3,
    sum(CASE WHEN kind = 'segment' THEN share * greatest(0, least(last, 1) - first + 1) / (last - first + 1) END) AS w1,
    sum(CASE WHEN kind = 'segment' THEN share * greatest(0, least(last, 2) - first + 1) / (last - first + 1) END) AS w2,
    sum(CASE WHEN kind = 'segment' THEN share * greatest(0, least(last, 3) - first + 1) / (last - first + 1) END) AS w3,
    count(*) FILTER (kind = 'segment') AS n
  FROM ranked JOIN shares USING (k, j) GROUP BY k, d),
per_state AS (
  SELECT k, count(*) AS defenders, count(*) FILTER (rn > 0) AS receiver_unique_nearest_defenders,
    count(*) FILTER (sn > 0) AS segment_unique_nearest_defenders,
    max(CASE WHEN rn >= 2 THEN 1e0 ELSE 0e0 END) AS any_receiver_multi_edge,
    max(CASE WHEN sn >= 2 THEN 1e0 ELSE 0e0 END) AS any_segment_multi_edge,
    max(rn) AS max_receiver_nearest_edges, max(sn) AS max_segment_nearest_edges,
    max(i1 / n) AS max_segment_top1_edge_share, max(i2 / n) AS max_segment_top2_edge_share,
    max(i3 / n) AS max_segment_top3_edge_share, max(w1) AS max_segment_top1_m1_weighted,
    max(w2) AS max_segment_top2_m1_weighted, max(w3) AS max_segment_top3_m1_weighted
  FROM per_defender GROUP BY k),
per_pair AS (
  SELECT k, avg(top1) AS segment_top1_pair_jaccard, avg(top2) AS segment_top2_pair_jaccard,
    avg(top3) AS segment_top3_pair_jaccard FROM jaccard GROUP BY k),
distances AS (SELECT k, avg(rdist) AS receiver_distance_mean, avg(sdist) AS segment_distance_mean FROM relation GROUP BY k),
state_metrics AS (
  SELECT * FROM per_edge JOIN per_state USING (k) JOIN distances USING (k) LEFT JOIN per_pair USING (k))"""
)


@query(
    "agg37_state_metrics",
    with_ctes(_STATE_METRICS)
    + "SELECT CAST(k AS VARCHAR) AS event_id, "
    + ", ".join(f"round(CAST({m} AS DOUBLE), 6) + 0e0 AS {m}" for m in rel.STATE_METRICS)
    + " FROM state_metrics",
)
def _(spark, sf_dir):
    return wide_metrics(spark, sf_dir).select(
        "event_id", *[rounded(F.col(m).cast("double")).alias(m) for m in rel.STATE_METRICS]
    )


def wide_metrics(spark, sf_dir):
    return rel.state_metrics(stored_states(spark, sf_dir), M1)


@query(
    "agg22_match_macro_metrics",
    with_ctes(
        _STATE_METRICS,
        "metric_rows AS ("
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, match_id, CAST({m} AS DOUBLE) AS value FROM state_metrics"
            for m in rel.STATE_METRICS
        )
        + ")",
        macro_summary_sql("metric_rows", ["metric"]),
    )
    + f"SELECT metric, alias, represented_matches, count, {ROUNDED_STATS} FROM macro_rows",
)
def _(spark, sf_dir):
    # The wide rows feed two passes; computing them again costs less than writing them down.
    long = op.long_metrics(wide_metrics(spark, sf_dir), rel.STATE_METRICS, [])
    summary = match_macro_summary(long, ["metric"], "match_id", "value")
    return summary.select(
        "metric", "alias", "represented_matches", "count", *[rounded(F.col(c)).alias(c) for c in STAT_COLUMNS]
    )
