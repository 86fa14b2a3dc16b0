"""Components, strata, case selection and progression value."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import (
    CANDIDATE, EDGES, ROUNDED_STATS, SCORES, STAT_COLUMNS, quantiles_sql, query, reached_sql, units_sql, with_ctes,
)
from touchline.catalog.evaluation import CREDIT
from touchline.catalog.options import M0, M1, M2, PAIRS_SQL
from touchline.catalog.points import PITCH
from touchline.functions.scalars import rounded
from touchline.operators import diagnostics as dg
from touchline.operators import options as op
from touchline.operators import value as vl
from touchline.session import cut_lineage
from touchline.sources import testtables as tt

MODELS = (M0, M1, M2)


def edges(spark, sf_dir):
    return op.edge_features(tt.states(spark, sf_dir))


_ATTACK = "dist / 20e0 * -1e0 + dx / 20e0 * 0.35e0 + dy / 20e0 * 0e0"
_PARTS_SQL = f"""
part AS (
  SELECT k, match_id, event_id, j, id, unnest(['m0', 'm1', 'm1', 'm1', 'm2', 'm2', 'm2', 'm2']) AS model,
    unnest(['attacking', 'attacking', 'receiver', 'segment', 'attacking', 'receiver', 'segment', 'attenuation']) AS component,
    unnest([{_ATTACK}, {_ATTACK}, rd / 10e0 * 0.6e0, sd / 10e0 * 1.2e0, {_ATTACK}, rd / 10e0 * 0.5e0, sd / 10e0 * 1e0, att / 2e0 * -0.4e0]) AS value
  FROM edge),
centred AS (SELECT *, value - avg(value) OVER (PARTITION BY k, model, component) AS centred FROM part)
"""


@query(
    "prj13_component_decomposition",
    with_ctes(EDGES, _PARTS_SQL)
    + """SELECT event_id, id, model, component, round(value, 6) + 0e0 AS value, round(centred, 6) + 0e0 AS centred,
    true AS reconstructs FROM centred""",
)
def _(spark, sf_dir):
    return dg.components(edges(spark, sf_dir), MODELS).select(
        "event_id", "id", "model", "component", rounded(F.col("value")).alias("value"),
        rounded(F.col("centred")).alias("centred"), "reconstructs",
    )


@query(
    "prj14_model_bookkeeping",
    with_ctes(EDGES)
    + """, parts AS (SELECT k, event_id, id, (rd / 10e0 * 0.5e0 - rd / 10e0 * 0.6e0) + (sd / 10e0 * 1e0 - sd / 10e0 * 1.2e0) AS shared,
      att / 2e0 * -0.4e0 AS added FROM edge)
    SELECT event_id, id, round(shared, 6) + 0e0 AS shared, round(added, 6) + 0e0 AS added,
      round(shared - avg(shared) OVER (PARTITION BY k), 6) + 0e0 AS centred_shared,
      round(added - avg(added) OVER (PARTITION BY k), 6) + 0e0 AS centred_added FROM parts""",
)
def _(spark, sf_dir):
    rows = dg.bookkeeping(edges(spark, sf_dir), M1, M2)
    fields = ("shared", "added", "centred_shared", "centred_added")
    return rows.select("event_id", "id", *[rounded(F.col(f)).alias(f) for f in fields])


_DISTANCE_PAIRS = """
dpairs AS (SELECT a.k, a.match_id, a.event_id, a.j AS a_ord, b.j AS b_ord, (a.rd - b.rd > 0) <> (a.sd - b.sd > 0) AS discordant
  FROM edge a JOIN edge b ON a.k = b.k AND a.j < b.j WHERE abs(a.rd - b.rd) > 1e-12 AND abs(a.sd - b.sd) > 1e-12)
"""


@query(
    "flt07_discordant_pairs",
    with_ctes(EDGES, _DISTANCE_PAIRS)
    + "SELECT event_id, CAST(a_ord AS INTEGER) AS a_ord, CAST(b_ord AS INTEGER) AS b_ord, discordant FROM dpairs",
)
def _(spark, sf_dir):
    return dg.distance_pairs(edges(spark, sf_dir)).select("event_id", "a_ord", "b_ord", "discordant")


_CUTS = f"""
sized AS (SELECT match_id, k, count(*) OVER (PARTITION BY k) AS n, dist, dx, abs(dy) AS ady, rd, sd, att FROM edge),
per_match AS (SELECT match_id, count(DISTINCT k) AS states, (SELECT count(DISTINCT match_id) FROM edge) AS m FROM edge GROUP BY match_id),
masses AS (SELECT match_id, k, avg(greatest(0, att - exp(-sd / 5e0))) AS mass FROM edge GROUP BY match_id, k),
strat AS (
  SELECT unnest(['distance', 'longitudinal', 'absolute_lateral', 'receiver_distance', 'segment_distance', 'attenuation']) AS feature,
    unnest([dist, dx, ady, rd, sd, att]) AS v, 1e0 / m / states / n AS w FROM sized JOIN per_match USING (match_id)
  UNION ALL SELECT 'nonnearest_mass', mass, 1e0 / m / states FROM masses JOIN per_match USING (match_id)),
strat_units AS (SELECT *, {units_sql("w", "feature")} AS units FROM strat),
strat_cum AS (SELECT *, sum(units) OVER (PARTITION BY feature ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum, sum(units) OVER (PARTITION BY feature) AS total, count(*) OVER (PARTITION BY feature) AS rows_ FROM strat_units),
quartile AS (SELECT feature, min(v) FILTER ({reached_sql(0.25)}) AS a, min(v) FILTER ({reached_sql(0.5)}) AS b,
  min(v) FILTER ({reached_sql(0.75)}) AS c FROM strat_cum GROUP BY feature)
"""


@query(
    "agg41_stratum_cuts",
    with_ctes(EDGES, _CUTS)
    + "SELECT feature, round(a, 6) + 0e0 AS q25, round(b, 6) + 0e0 AS q50, round(c, 6) + 0e0 AS q75 FROM quartile",
)
def _(spark, sf_dir):
    cuts = dg.stratum_cuts(tt.stored_states(spark, sf_dir))
    at = lambda i: rounded(F.get("cuts", F.lit(i)))
    return cuts.select("feature", at(0).alias("q25"), at(1).alias("q50"), at(2).alias("q75"))


POPULATION = "population"


def diagnosed(spark, sf_dir):
    return dg.diagnose(tt.stored_states(spark, sf_dir), MODELS, POPULATION)


def stored_cases(spark, sf_dir):
    """What the pools ask of a state, written once for their turns; the long tie keys are derived again when it is read."""
    columns = ("match_id", "ordinal", "m1_delta", "m2_delta", "m0_top", "m1_top", "m2_top", "target_id", "disagreement_fraction", "changed_fraction")
    kept = tt._stored(spark, sf_dir, "cases", lambda *_: diagnosed(spark, sf_dir).select(*columns))
    return dg.with_tie_key(kept, POPULATION)


_DIAGNOSED = (
    SCORES
    + ",\n"
    + CREDIT.strip()
    + ",\n"
    + _DISTANCE_PAIRS.strip()
    + """,
wide AS (SELECT k, j, max(block) FILTER (model = 'm1') AS b1, max(block) FILTER (model = 'm2') AS b2 FROM scored GROUP BY k, j),
moves AS (SELECT a.k, count(*) AS pairs, count(*) FILTER (sign(a.b1 - b.b1) = sign(a.b2 - b.b2)) AS unchanged,
  count(*) FILTER (sign(a.b1 - b.b1) * sign(a.b2 - b.b2) < 0) AS strict_reversal
  FROM wide a JOIN wide b ON a.k = b.k AND a.j < b.j GROUP BY a.k),
tops AS (SELECT k, string_agg(id, ',' ORDER BY id) FILTER (model = 'm0' AND block = 0) AS m0_top,
  string_agg(id, ',' ORDER BY id) FILTER (model = 'm1' AND block = 0) AS m1_top,
  string_agg(id, ',' ORDER BY id) FILTER (model = 'm2' AND block = 0) AS m2_top,
  max(id) FILTER (j = target_index) AS target_id FROM scored GROUP BY k),
deltas AS (SELECT k, match_id, event_id, max(target_rank) FILTER (model = 'm1') - max(target_rank) FILTER (model = 'm0') AS m1_delta,
  max(target_rank) FILTER (model = 'm2') - max(target_rank) FILTER (model = 'm1') AS m2_delta
  FROM credit WHERE target_index IS NOT NULL GROUP BY k, match_id, event_id),
disagree AS (SELECT k, count(*) AS eligible_pairs, count(*) FILTER (discordant) AS discordant_pairs FROM dpairs GROUP BY k),
diagnosed AS (
  SELECT d.*, t.* EXCLUDE (k), coalesce(eligible_pairs, 0) AS eligible_pairs, coalesce(discordant_pairs, 0) AS discordant_pairs,
    discordant_pairs / eligible_pairs AS disagreement_fraction, pairs, strict_reversal / pairs AS reversal, 1 - unchanged / pairs AS changed_fraction,
    sha256('population:' || CAST(d.k AS VARCHAR)) AS tie_key
  FROM deltas d JOIN tops t USING (k) LEFT JOIN disagree USING (k) LEFT JOIN moves USING (k))"""
)


@query(
    "agg43_role_rows",
    with_ctes(_DIAGNOSED)
    + """, per_match AS (SELECT match_id AS alias, count(*) AS states, count(*) FILTER (m2_delta < 0) AS improved,
      count(*) FILTER (m2_delta > 0) AS worsened, count(*) FILTER (m2_delta = 0) AS tied, count(*) FILTER (pairs > 0) AS pair_assessable_states,
      avg(CAST(m2_delta < 0 AS INTEGER)) AS improved_fraction, avg(CAST(m2_delta > 0 AS INTEGER)) AS worsened_fraction,
      avg(CAST(m1_top <> m2_top AS INTEGER)) AS top_set_changed_fraction, avg(changed_fraction) AS changed_pair_fraction,
      avg(reversal) AS strict_reversal_fraction FROM diagnosed GROUP BY match_id),
    whole AS (SELECT * FROM per_match UNION ALL SELECT 'macro', sum(states), sum(improved), sum(worsened), sum(tied), sum(pair_assessable_states),
      avg(improved_fraction), avg(worsened_fraction), avg(top_set_changed_fraction), avg(changed_pair_fraction), avg(strict_reversal_fraction) FROM per_match)
    SELECT alias, CAST(states AS BIGINT) AS states, CAST(improved AS BIGINT) AS improved, CAST(worsened AS BIGINT) AS worsened, CAST(tied AS BIGINT) AS tied,
      CAST(pair_assessable_states AS BIGINT) AS pair_assessable_states, round(improved_fraction, 6) AS improved_fraction,
      round(worsened_fraction, 6) AS worsened_fraction, round(top_set_changed_fraction, 6) AS top_set_changed_fraction,
      round(changed_pair_fraction, 6) AS changed_pair_fraction, round(strict_reversal_fraction, 6) AS strict_reversal_fraction FROM whole""",
)
def _(spark, sf_dir):
    rows = dg.role_rows(diagnosed(spark, sf_dir))
    return rows.withColumns({c: rounded(F.col(c)) for c in rows.columns if c.endswith("_fraction")})


@query(
    "agg43_disagreement_rows",
    with_ctes(_DIAGNOSED)
    + """, per_match AS (SELECT match_id AS alias, count(*) AS states, count(*) FILTER (eligible_pairs > 0) AS eligible_states,
      sum(eligible_pairs) AS eligible_pairs, sum(discordant_pairs) AS discordant_pairs, count(*) FILTER (discordant_pairs > 0) AS discordant_states,
      avg(disagreement_fraction) AS weighted_disagreement FROM diagnosed GROUP BY match_id),
    whole AS (SELECT * FROM per_match UNION ALL SELECT 'macro', sum(states), sum(eligible_states), sum(eligible_pairs), sum(discordant_pairs),
      sum(discordant_states), avg(weighted_disagreement) FROM per_match)
    SELECT alias, CAST(states AS BIGINT) AS states, CAST(eligible_states AS BIGINT) AS eligible_states, CAST(eligible_pairs AS BIGINT) AS eligible_pairs,
      CAST(discordant_pairs AS BIGINT) AS discordant_pairs, CAST(discordant_states AS BIGINT) AS discordant_states,
      round(weighted_disagreement, 6) AS weighted_disagreement FROM whole""",
)
def _(spark, sf_dir):
    rows = dg.disagreement_rows(diagnosed(spark, sf_dir))
    return rows.withColumn("weighted_disagreement", rounded(F.col("weighted_disagreement")))


_STRATA = """
own AS (SELECT k, dist, dx, abs(dy) AS ady, rd, sd, att, CASE WHEN dist <= 1e-9 THEN 'degenerate' WHEN dx / dist > sin(radians(10)) THEN 'forward'
  WHEN dx / dist < -sin(radians(10)) THEN 'backward' ELSE 'approximately_lateral' END AS direction FROM edge WHERE j = target_index),
valued AS (
  SELECT d.match_id, m1_delta, m2_delta, unnest(['distance', 'longitudinal', 'absolute_lateral', 'receiver_distance', 'segment_distance', 'attenuation', 'nonnearest_mass']) AS feature,
    unnest([dist, dx, ady, rd, sd, att, mass]) AS v FROM diagnosed d JOIN own USING (k) JOIN masses USING (k)),
placed AS (
  SELECT match_id, m1_delta, m2_delta, feature, 'bin_' || CAST(1 + CAST(a < v AS INTEGER) + CAST(b <> a AND b < v AS INTEGER) + CAST(c <> b AND c < v AS INTEGER) AS VARCHAR) AS bin
  FROM valued JOIN quartile USING (feature)
  UNION ALL SELECT d.match_id, m1_delta, m2_delta, 'direction', direction FROM diagnosed d JOIN own USING (k)),
cell AS (
  SELECT feature, 'bin_' || CAST(unnest(range(1, 3 + CAST(b <> a AS INTEGER) + CAST(c <> b AS INTEGER))) AS VARCHAR) AS bin FROM quartile
  UNION ALL SELECT 'direction', unnest(['forward', 'approximately_lateral', 'backward', 'degenerate'])),
counted AS (
  SELECT feature, bin, match_id AS alias, count(*) AS states, count(*) FILTER (m1_delta < 0) AS m1_improved, count(*) FILTER (m1_delta > 0) AS m1_worsened,
    count(*) FILTER (m1_delta = 0) AS m1_tied, count(*) FILTER (m2_delta < 0) AS m2_improved, count(*) FILTER (m2_delta > 0) AS m2_worsened,
    count(*) FILTER (m2_delta = 0) AS m2_tied, avg(m1_delta) AS m1_mean_rank_change, avg(m2_delta) AS m2_mean_rank_change FROM placed GROUP BY ALL),
summed AS (
  SELECT * FROM counted
  UNION ALL SELECT feature, bin, 'macro', sum(states), sum(m1_improved), sum(m1_worsened), sum(m1_tied), sum(m2_improved), sum(m2_worsened), sum(m2_tied),
    avg(m1_mean_rank_change), avg(m2_mean_rank_change) FROM counted GROUP BY feature, bin),
aliases AS (SELECT DISTINCT match_id AS alias FROM diagnosed UNION ALL SELECT 'macro')
"""
_COUNTS = ("states", *[f"{m}_{c}" for m in ("m1", "m2") for c in ("improved", "worsened", "tied")])


@query(
    "agg42_strata_table",
    with_ctes(_DIAGNOSED, _CUTS, _STRATA)
    + f"""SELECT alias, feature, bin, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS)},
    round(m1_mean_rank_change, 6) + 0e0 AS m1_mean_rank_change, round(m2_mean_rank_change, 6) + 0e0 AS m2_mean_rank_change
    FROM (SELECT * FROM aliases, cell) LEFT JOIN summed USING (alias, feature, bin)""",
)
def _(spark, sf_dir):
    cuts = dg.stratum_cuts(tt.stored_states(spark, sf_dir))
    rows = dg.strata_table(diagnosed(spark, sf_dir), cuts)
    return rows.withColumns({c: rounded(F.col(c)) for c in ("m1_mean_rank_change", "m2_mean_rank_change")})


@query(
    "agg44_contribution_summary",
    with_ctes(EDGES, _PARTS_SQL)
    + """, per_match AS (SELECT match_id, 1e0 / count(DISTINCT match_id) OVER () / count(DISTINCT k) AS unused FROM edge GROUP BY match_id),
    weight AS (SELECT match_id, 1e0 / (SELECT count(DISTINCT match_id) FROM edge) / count(DISTINCT k) AS w FROM edge GROUP BY match_id),
    rows AS (
      SELECT model, component, 'components' AS kind, value AS v, w / count(*) OVER (PARTITION BY k, model, component) AS w FROM centred JOIN weight USING (match_id)
      UNION ALL SELECT model, component, 'centered_components', centred, w / count(*) OVER (PARTITION BY k, model, component) FROM centred JOIN weight USING (match_id)
      UNION ALL SELECT model, component, 'within_choice_range', max(value) - min(value), any_value(w) FROM centred JOIN weight USING (match_id) GROUP BY k, model, component),
    u AS (SELECT *, UNITS AS units FROM rows),
    c AS (SELECT *, sum(units) OVER (PARTITION BY model, component, kind ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum,
      sum(units) OVER (PARTITION BY model, component, kind) AS total, count(*) OVER (PARTITION BY model, component, kind) AS rows_ FROM u)
    SELECT model, component, kind, count(*) AS count, round(sum(v * w) / sum(w), 6) + 0e0 AS mean, round(min(v), 6) + 0e0 AS minimum,
      round(max(v), 6) + 0e0 AS maximum, QUANTILES FROM c GROUP BY model, component, kind""".replace("UNITS", units_sql("w", "model, component, kind")).replace(
        "QUANTILES", quantiles_sql("round({}, 6) + 0e0")
    ).replace(
        "per_match AS (SELECT match_id, 1e0 / count(DISTINCT match_id) OVER () / count(DISTINCT k) AS unused FROM edge GROUP BY match_id),\n    ", ""
    ),
)
def _(spark, sf_dir):
    raw = cut_lineage(edges(spark, sf_dir))
    per_match = raw.groupBy("match_id").agg(F.count_distinct("ordinal").alias("states"))
    matches = per_match.agg(F.count(F.lit(1)).alias("m")).first()["m"]
    weights = per_match.select("match_id", (1.0 / matches / F.col("states")).alias("w"))
    rows = dg.contribution_summary(dg.components(raw, MODELS), weights)
    return rows.select(
        "model", "component", "kind", "count", *[rounded(F.col(c)).alias(c) for c in STAT_COLUMNS]
    )


def _pools_sql():
    """The pools in turn: what a match may still give, best rows first, nobody twice."""
    pools = [
        ("failure", "m1_delta >= 2", 2, "m1_delta DESC, tie_key"),
        ("failure", "m2_delta >= 2", 1, "m2_delta DESC, tie_key"),
        ("feature_disagreement", "disagreement_fraction > 0 AND m0_top <> m1_top", 3, "disagreement_fraction DESC, tie_key"),
        ("m2_ordering_change", "m1_top <> m2_top", 3, "changed_fraction DESC NULLS LAST, abs(m2_delta) DESC, tie_key"),
        ("agreement", "m0_top = m1_top AND m1_top = m2_top AND m0_top = target_id", 3, "tie_key"),
    ]
    steps, used = [], "SELECT k, match_id, category, tie_key FROM (SELECT 0 AS k, '' AS match_id, '' AS category, '' AS tie_key) WHERE false"
    for i, (category, condition, quota, order) in enumerate(pools):
        steps.append(f"""used{i} AS ({used}),
pool{i} AS (SELECT k, match_id, '{category}' AS category, tie_key FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY {order}) AS place FROM diagnosed WHERE {condition} AND k NOT IN (SELECT k FROM used{i}))
  LEFT JOIN (SELECT match_id, count(*) AS taken FROM used{i} GROUP BY match_id) USING (match_id)
  WHERE place <= 2 - coalesce(taken, 0) ORDER BY {order} LIMIT {quota})""")
        used = f"SELECT * FROM used{i} UNION ALL SELECT * FROM pool{i}"
    return ",\n".join([*steps, f"picked AS ({used})"])


@query(
    "top05_quota_case_selection",
    with_ctes(_DIAGNOSED, _pools_sql())
    + """SELECT 'case_' || lpad(CAST(row_number() OVER (ORDER BY tie_key) AS VARCHAR), 2, '0') AS case_id, CAST(k AS BIGINT) AS ordinal, match_id, category, tie_key FROM picked""",
)
def _(spark, sf_dir):
    return dg.select_cases(stored_cases(spark, sf_dir), dg.study_pools())


def scored_with_points(spark, sf_dir):
    models = (M0, M1)
    base = op.edge_features(tt.states(spark, sf_dir))
    return op.score(op.utility_rows(base, models, "cx", "cy", "rx", "ry"))


def progressions(spark, sf_dir):
    rows = scored_with_points(spark, sf_dir).join(tt.pitches(spark, sf_dir), "match_id")
    return vl.horizon_comparison(rows, vl.progression_surface(F.col("pitch_length")), "m0", "m1")


_HORIZON = """
horizon AS (
  SELECT k, match_id, event_id, model, sum(share * (rx - cx) / len) AS h, sum(share * (0.5e0 + rx / len)) AS v, bool_and(abs(rx) <= len / 2 AND abs(cx) <= len / 2) AS valid,
    exp(sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END)) AS n
  FROM scored JOIN pitch USING (match_id) GROUP BY ALL),
progression AS (
  SELECT l.k, l.match_id, l.event_id, l.h AS H0, r.h AS H1, r.h - l.h AS S, r.n - l.n AS D, r.v - l.v AS by_value
  FROM horizon l JOIN horizon r USING (k) WHERE l.model = 'm0' AND r.model = 'm1' AND l.valid)
"""


@query(
    "agg39_value_horizon",
    with_ctes(SCORES, PITCH, _HORIZON)
    + """SELECT event_id, round(H0, 6) + 0e0 AS H0, round(H1, 6) + 0e0 AS H1, round(S, 6) + 0e0 AS S, round(D, 6) + 0e0 AS D,
    abs(S - by_value) <= 1e-10 AS identity_holds FROM progression""",
)
def _(spark, sf_dir):
    rows = progressions(spark, sf_dir).where("valid")
    return rows.select(
        "event_id", *[rounded(F.col(c)).alias(c) for c in vl.PROGRESSION], "identity_holds"
    )


@query(
    "agg39_edge_contributions",
    with_ctes(SCORES, PITCH)
    + """SELECT l.event_id, l.id, round((r.share - l.share) * CASE WHEN abs(l.rx) <= len / 2 AND abs(l.cx) <= len / 2 THEN (l.rx - l.cx) / len END, 6) + 0e0 AS contribution
    FROM scored l JOIN scored r ON l.k = r.k AND l.j = r.j JOIN pitch ON pitch.match_id = l.match_id WHERE l.model = 'm0' AND r.model = 'm1'""",
)
def _(spark, sf_dir):
    rows = scored_with_points(spark, sf_dir).join(tt.pitches(spark, sf_dir), "match_id")
    found = vl.edge_contributions(rows, vl.progression_surface(F.col("pitch_length")), "m0", "m1")
    return found.select("event_id", "id", rounded(F.col("contribution")).alias("contribution"))


@query(
    "agg40_shift_correlation",
    with_ctes(SCORES, PITCH, _HORIZON) + "SELECT match_id, round(corr(S, D), 6) + 0e0 AS pearson_S_D FROM progression GROUP BY match_id",
)
def _(spark, sf_dir):
    rows = vl.shift_correlation(cut_lineage(progressions(spark, sf_dir).where("valid")))
    return rows.select("match_id", rounded(F.col("pearson_S_D")).alias("pearson_S_D"))


@query(
    "agg40_progression_typology",
    with_ctes(SCORES, PITCH, _HORIZON)
    + """, signed AS (SELECT match_id, CASE WHEN D < -1e-12 THEN 'negative' WHEN D > 1e-12 THEN 'positive' ELSE 'zero' END AS d_sign,
      CASE WHEN S < -1e-12 THEN 'negative' WHEN S > 1e-12 THEN 'positive' ELSE 'zero' END AS s_sign FROM progression),
    sgn AS (SELECT unnest(['negative', 'zero', 'positive']) AS s),
    grid AS (SELECT match_id, a.s AS d_sign, b.s AS s_sign FROM (SELECT DISTINCT match_id FROM signed), sgn a, sgn b),
    filled AS (SELECT g.match_id AS alias, g.d_sign, g.s_sign, count(x.match_id) AS count FROM grid g LEFT JOIN signed x USING (match_id, d_sign, s_sign) GROUP BY ALL),
    shares AS (SELECT *, count / sum(count) OVER (PARTITION BY alias) AS proportion FROM filled)
    SELECT alias, d_sign, s_sign, count, round(proportion, 6) AS proportion FROM shares
    UNION ALL SELECT 'macro', d_sign, s_sign, CAST(sum(count) AS BIGINT), round(avg(proportion), 6) FROM shares GROUP BY d_sign, s_sign""",
)
def _(spark, sf_dir):
    rows = vl.sign_typology(progressions(spark, sf_dir).where("valid"))
    return rows.withColumn("proportion", rounded(F.col("proportion")))


@query(
    "udf01_custom_value_surface",
    with_ctes(SCORES)
    + """SELECT event_id, model, round(sum(share * (1 / (1 + exp(-rx / 20e0)) - 1 / (1 + exp(-cx / 20e0)))), 6) + 0e0 AS horizon
    FROM scored WHERE model <> 'm2' GROUP BY event_id, model""",
)
def _(spark, sf_dir):
    logistic = lambda x, y: 1.0 / (1.0 + F.exp(-x / 20.0))
    rows = vl.horizons(scored_with_points(spark, sf_dir), logistic)
    return rows.select("event_id", "model", rounded(F.col("horizon")).alias("horizon"))
