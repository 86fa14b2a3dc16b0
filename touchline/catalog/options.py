"""Projections, shares and comparisons of pass options."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import (
    EDGES,
    ROUNDED_STATS,
    SCORES,
    STAT_COLUMNS,
    SUMMARIES,
    macro_summary_sql,
    query,
    with_ctes,
)
from touchline.functions.scalars import pass_direction, rounded, three_way_sign
from touchline.operators import options as op
from touchline.plans.ordered import match_macro_summary
from touchline.session import cut_lineage
from touchline.sources.models import DEMO_MODELS
from touchline.sources.testtables import states

M0, M1, M2 = (DEMO_MODELS[name] for name in ("m0", "m1", "m2"))


def scored(spark, sf_dir, *models):
    return op.evaluate_options(states(spark, sf_dir), models or (M0, M1))


@query(
    "prj08_pass_vector_features",
    with_ctes(EDGES)
    + """SELECT event_id, id, round(dist, 6) + 0e0 AS distance, round(dx, 6) + 0e0 AS dx,
    round(dy, 6) + 0e0 AS dy FROM edge""",
)
def _(spark, sf_dir):
    rows = op.pass_vector(op.candidate_rows(states(spark, sf_dir)))
    return rows.select(
        "event_id",
        "id",
        rounded(F.col("distance")).alias("distance"),
        rounded(F.col("longitudinal_displacement")).alias("dx"),
        rounded(F.col("lateral_displacement")).alias("dy"),
    )


@query(
    "prj09_defended_features",
    with_ctes(EDGES)
    + """SELECT event_id, id, round(rd, 6) + 0e0 AS receiver_distance, round(sd, 6) + 0e0 AS segment_distance,
    dist <= 1e-9 AS degenerate FROM edge""",
)
def _(spark, sf_dir):
    return op.edge_features(states(spark, sf_dir)).select(
        "event_id",
        "id",
        rounded(F.col("nearest_receiver_defender_distance")).alias("receiver_distance"),
        rounded(F.col("minimum_segment_defender_distance")).alias("segment_distance"),
        (F.col("distance") <= 1e-9).alias("degenerate"),
    )


@query(
    "prj10_segment_attenuation",
    with_ctes(EDGES) + "SELECT event_id, id, round(att, 6) + 0e0 AS attenuation FROM edge",
)
def _(spark, sf_dir):
    return op.edge_features(states(spark, sf_dir)).select(
        "event_id", "id", rounded(F.col("summed_segment_attenuation")).alias("attenuation")
    )


@query(
    "prj11_nonnearest_mass",
    with_ctes(EDGES)
    + """, rest AS (
      SELECT k, event_id, j, sum(CASE WHEN rn > 1 THEN exp(-sdist / 5e0) ELSE 0 END) AS mass
      FROM (SELECT *, row_number() OVER (PARTITION BY k, j ORDER BY sdist, d) AS rn FROM relation)
      GROUP BY k, event_id, j)
    SELECT event_id, round(avg(mass), 6) + 0e0 AS mass FROM rest GROUP BY event_id""",
)
def _(spark, sf_dir):
    edges = op.edge_features(states(spark, sf_dir))
    return edges.groupBy(*op.KEYS).agg(rounded(F.avg("nonnearest_mass")).alias("mass")).select(
        "event_id", "mass"
    )


@query(
    "prj12_linear_utility",
    with_ctes(SCORES) + "SELECT event_id, model, id, round(u, 6) + 0e0 AS utility FROM utility",
)
def _(spark, sf_dir):
    rows = op.utility_rows(op.edge_features(states(spark, sf_dir)), (M0, M1, M2))
    return rows.select("event_id", "model", "id", rounded(F.col("utility")).alias("utility"))


@query(
    "prj15_pass_direction",
    with_ctes(EDGES)
    + """SELECT event_id, id, CASE WHEN dist <= 1e-9 THEN 'degenerate' WHEN dx / dist > sin(radians(10)) THEN 'forward'
    WHEN dx / dist < -sin(radians(10)) THEN 'backward' ELSE 'approximately_lateral' END AS direction FROM edge""",
)
def _(spark, sf_dir):
    rows = op.pass_vector(op.candidate_rows(states(spark, sf_dir)))
    return rows.select(
        "event_id",
        "id",
        pass_direction(F.col("distance"), F.col("longitudinal_displacement")).alias("direction"),
    )


@query(
    "prj16_three_way_sign",
    with_ctes(EDGES)
    + """SELECT event_id, id, CASE WHEN rd - sd < -1e-12 THEN 'negative' WHEN rd - sd > 1e-12 THEN 'positive'
    ELSE 'zero' END AS gap_sign FROM edge""",
)
def _(spark, sf_dir):
    rows = op.edge_features(states(spark, sf_dir))
    gap = F.col("nearest_receiver_defender_distance") - F.col("minimum_segment_defender_distance")
    return rows.select("event_id", "id", three_way_sign(gap).alias("gap_sign"))


@query(
    "prj36_share_map",
    with_ctes(SCORES)
    + """SELECT event_id, string_agg(id || '=' || printf('%.4f', share), ';' ORDER BY id) AS weights
    FROM scored WHERE model = 'm1' GROUP BY event_id""",
)
def _(spark, sf_dir):
    # Receiver -> share as a map column, printed for comparison.
    mapped = scored(spark, sf_dir, M1).groupBy(*op.KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "share"))).alias("option_weights")
    )
    printed = F.transform(
        F.array_sort(F.map_entries("option_weights")),
        lambda kv: F.concat(kv["key"], F.lit("="), F.format_string("%.4f", kv["value"])),
    )
    return mapped.select("event_id", F.array_join(printed, ";").alias("weights"))


_SUMMARY_SQL = """round(top_one_share, 6) AS top_one_share, round(top_two_share, 6) AS top_two_share,
    round(entropy, 6) + 0e0 AS entropy, round(CASE WHEN nc > 1 THEN entropy / ln(nc) ELSE 0 END, 6) + 0e0 AS normalized_entropy,
    round(exp(entropy), 6) AS effective_option_count, round(utility_range, 6) + 0e0 AS utility_range"""


@query(
    "agg17_option_distribution",
    with_ctes(SUMMARIES) + f"SELECT event_id, {_SUMMARY_SQL} FROM summary WHERE model = 'm1'",
)
def _(spark, sf_dir):
    df = op.state_summaries(scored(spark, sf_dir, M1))
    return df.select("event_id", *[rounded(F.col(f)).alias(f) for f in op.SUMMARY_FIELDS])


@query(
    "agg18_evaluate_options",
    with_ctes(SUMMARIES)
    + f"SELECT event_id, model, {_SUMMARY_SQL}, top_options FROM summary WHERE model <> 'm2'",
)
def _(spark, sf_dir):
    return op.state_summaries(scored(spark, sf_dir)).select(
        "event_id",
        "model",
        *[rounded(F.col(f)).alias(f) for f in op.SUMMARY_FIELDS],
        F.array_join("top_options", ",").alias("top_options"),
    )


PAIRS_SQL = """blocks AS MATERIALIZED (
  SELECT k, j, max(block) FILTER (model = 'm0') AS b0, max(block) FILTER (model = 'm1') AS b1
  FROM scored GROUP BY k, j),
paired AS (
  SELECT a.k, sign(a.b0 - b.b0) AS x, sign(a.b1 - b.b1) AS y
  FROM blocks a JOIN blocks b ON a.k = b.k AND a.j < b.j),
pairs AS (
  SELECT k, count(*) AS pairs, count(*) FILTER (x = y) AS unchanged,
         count(*) FILTER (x <> y AND x <> 0 AND y <> 0) AS strict_reversal,
         count(*) FILTER (x <> y AND y = 0) AS tie_created,
         count(*) FILTER (x <> y AND x = 0) AS tie_removed
  FROM paired GROUP BY k),
changed AS (
  SELECT l.k, l.match_id, l.event_id,
         r.top_one_share - l.top_one_share AS top_one_share, r.top_two_share - l.top_two_share AS top_two_share,
         r.entropy - l.entropy AS entropy,
         CASE WHEN l.nc > 1 THEN r.entropy / ln(l.nc) - l.entropy / ln(l.nc) ELSE 0 END AS normalized_entropy,
         exp(r.entropy) - exp(l.entropy) AS effective_option_count, r.utility_range - l.utility_range AS utility_range,
         CASE WHEN l.top_options <> r.top_options THEN 1e0 ELSE 0e0 END AS top_set_changed,
         p.strict_reversal / p.pairs AS strict_reversal, p.tie_created / p.pairs AS tie_created,
         p.tie_removed / p.pairs AS tie_removed, 1 - p.unchanged / p.pairs AS ordering_changed
  FROM summary l JOIN summary r ON l.k = r.k AND l.model = 'm0' AND r.model = 'm1'
  LEFT JOIN pairs p ON p.k = l.k)"""


@query(
    "agg19_compare_options",
    with_ctes(SUMMARIES, PAIRS_SQL)
    + "SELECT event_id, "
    + ", ".join(f"round({f}, 6) + 0e0 AS {f}" for f in op.CHANGE_FIELDS)
    + " FROM changed",
)
def _(spark, sf_dir):
    change = op.compare_options(scored(spark, sf_dir), "m0", "m1")
    return change.select("event_id", *[rounded(F.col(f)).alias(f) for f in op.CHANGE_FIELDS])


@query(
    "snk05_edge_export",
    with_ctes(SCORES)
    + """SELECT event_id, id AS receiver_id, round(u, 6) + 0e0 AS utility, round(share, 6) + 0e0 AS option_share,
    (first + last) / 2e0 AS expected_rank, CAST(block AS BIGINT) AS tie_block, block = 0 AS is_top_option
    FROM scored WHERE model = 'm1'""",
)
def _(spark, sf_dir):
    return op.network_export(scored(spark, sf_dir, M1)).select(
        "event_id",
        "receiver_id",
        rounded(F.col("utility")).alias("utility"),
        rounded(F.col("option_share")).alias("option_share"),
        "expected_rank",
        F.col("tie_block").cast("long").alias("tie_block"),
        "is_top_option",
    )


@query(
    "win01_descending_tie_blocks",
    with_ctes(SCORES)
    + """SELECT event_id, model, id, CAST(block AS BIGINT) AS block, (first + last) / 2e0 AS rank
    FROM scored WHERE model <> 'm2'""",
)
def _(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "event_id", "model", "id", F.col("block").cast("long").alias("block"), "rank"
    )


@query(
    "top01_top_option_set",
    with_ctes(SUMMARIES)
    + """SELECT event_id, top_options, CASE WHEN top_options NOT LIKE '%,%' THEN top_options END AS top_option
    FROM summary WHERE model = 'm1'""",
)
def _(spark, sf_dir):
    return op.state_summaries(scored(spark, sf_dir, M1)).select(
        "event_id", F.array_join("top_options", ",").alias("top_options"), "top_option"
    )


@query(
    "top02_top_shares",
    with_ctes(SUMMARIES)
    + "SELECT event_id, model, round(top_one_share, 6) AS one, round(top_two_share, 6) AS two FROM summary",
)
def _(spark, sf_dir):
    return op.state_summaries(scored(spark, sf_dir, M0, M1, M2)).select(
        "event_id",
        "model",
        rounded(F.col("top_one_share")).alias("one"),
        rounded(F.col("top_two_share")).alias("two"),
    )


@query(
    "jn10_model_alignment",
    with_ctes(SCORES)
    + """SELECT count(*) AS edges, count(*) FILTER (l.id IS NULL OR r.id IS NULL) AS violations
    FROM (SELECT * FROM scored WHERE model = 'm0') l
    FULL JOIN (SELECT * FROM scored WHERE model = 'm1') r ON l.k = r.k AND l.j = r.j AND l.id = r.id""",
)
def _(spark, sf_dir):
    rows = scored(spark, sf_dir)
    side = lambda m, tag: rows.where(F.col("model") == m).select(
        *op.EDGE_KEYS, "id", F.lit(True).alias(tag)
    )
    joined = side("m0", "in_left").join(side("m1", "in_right"), [*op.EDGE_KEYS, "id"], "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("in_left").isNull() | F.col("in_right").isNull()).alias("violations"),
    )


def _metric_union_sql():
    parts = []
    for model in ("m0", "m1"):
        for f in op.SUMMARY_FIELDS:
            value = {
                "normalized_entropy": "CASE WHEN nc > 1 THEN entropy / ln(nc) ELSE 0 END",
                "effective_option_count": "exp(entropy)",
            }.get(f, f)
            parts.append(
                f"SELECT '{model}' AS scope, '{f}' AS metric, match_id, {value} AS value "
                f"FROM summary WHERE model = '{model}'"
            )
    for f in op.CHANGE_FIELDS:
        parts.append(f"SELECT 'change', '{f}', match_id, {f} FROM changed")
    return "metrics AS (\n" + "\nUNION ALL ".join(parts) + ")"


@query(
    "agg38_network_summary",
    with_ctes(SUMMARIES, PAIRS_SQL, _metric_union_sql(), macro_summary_sql("metrics", ["scope", "metric"]))
    + f"SELECT scope, metric, alias, represented_matches, count, {ROUNDED_STATS} FROM macro_rows",
)
def _(spark, sf_dir):
    # Scores feed the summaries, the comparison and both quantile passes: written once.
    metrics = cut_lineage(op.network_metrics(cut_lineage(scored(spark, sf_dir)), "m0", "m1"))
    summary = match_macro_summary(metrics, ["scope", "metric"], "match_id", "value")
    return summary.select(
        "scope",
        "metric",
        "alias",
        "represented_matches",
        "count",
        *[rounded(F.col(c)).alias(c) for c in STAT_COLUMNS],
    )


@query(
    "snk07_wide_summary",
    with_ctes(SUMMARIES)
    + """, means AS (
      SELECT match_id, count(*) FILTER (model = 'm0') AS states,
        avg(entropy) FILTER (model = 'm0') AS m0_entropy, avg(entropy) FILTER (model = 'm1') AS m1_entropy,
        avg(top_one_share) FILTER (model = 'm0') AS m0_top_one_share,
        avg(top_one_share) FILTER (model = 'm1') AS m1_top_one_share
      FROM summary GROUP BY match_id)
    SELECT alias, CAST(states AS BIGINT) AS states, round(m0_entropy, 6) AS m0_entropy, round(m1_entropy, 6) AS m1_entropy,
      round(m0_top_one_share, 6) AS m0_top_one_share, round(m1_top_one_share, 6) AS m1_top_one_share
    FROM (SELECT match_id AS alias, * EXCLUDE (match_id) FROM means UNION ALL
      SELECT 'macro', sum(states), avg(m0_entropy), avg(m1_entropy), avg(m0_top_one_share), avg(m1_top_one_share) FROM means)""",
)
def _(spark, sf_dir):
    from touchline.sources.sinks import wide_summary

    long = op.long_metrics(
        op.state_summaries(scored(spark, sf_dir)), ("entropy", "top_one_share"), ["model"]
    ).withColumn("name", F.concat_ws("_", "model", "metric"))
    names = ["m0_entropy", "m1_entropy", "m0_top_one_share", "m1_top_one_share"]
    wide = wide_summary(long, "match_id", "name", "value", names)
    return wide.select("alias", "states", *[rounded(F.col(n)).alias(n) for n in names])