"""Ranking metrics, the choice model, and the feature audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from touchline.catalog.base import EDGES, QUANTILES, RANKS, SCORES, STAT_COLUMNS, quantiles_sql, query, units_sql, with_ctes
from touchline.catalog.options import M0, M1, M2
from touchline.catalog.population import DECISION, MOMENTS
from touchline.catalog.relations import _OVERLAP
from touchline.functions.scalars import rounded
from touchline.operators import choice_model as cm
from touchline.operators import evaluation as ev
from touchline.operators import folds as fo
from touchline.operators import options as op
from touchline.plans.ordered import average_rank, linear_quantiles, running_sum, value_bucket, weighted_summary
from touchline.sources import testtables as tt
from touchline.sources.models import M0_FEATURES, M1_FEATURES, M2_FEATURES

FEATURE_SQL = dict(zip(M1_FEATURES, ("dist", "dx", "dy", "rd", "sd")))


def edges(spark, sf_dir):
    return op.edge_features(tt.states(spark, sf_dir), "target_index")


def credits(spark, sf_dir, models=(M0, M1)):
    scored = op.score(op.utility_rows(edges(spark, sf_dir), models, "target_index"))
    return ev.expected_credits(scored)


CREDIT = """
credit AS (
  SELECT k, match_id, event_id, model, target_index, min((first + last) / 2e0) FILTER (j = target_index) AS target_rank,
    coalesce(sum(CASE WHEN j = target_index THEN list_sum(list_transform(range(first, last + 1), lambda p: 1e0 / p)) / (last - first + 1) END), 0) AS rr,
    coalesce(sum(CASE WHEN j = target_index THEN greatest(0, least(last, 1) - first + 1) / (last - first + 1) END), 0) AS hit1,
    coalesce(sum(CASE WHEN j = target_index THEN greatest(0, least(last, 3) - first + 1) / (last - first + 1) END), 0) AS hit3,
    coalesce(bool_or(j = target_index AND last > first), false) AS tied
  FROM scored GROUP BY ALL),
metric AS (
  SELECT model, match_id, count(*) AS evaluation_eligible, count(target_index) AS fit_eligible,
    count(*) - count(target_index) AS target_outside_zero_credit, avg(rr) AS mrr, avg(hit1) AS hit_at_1, avg(hit3) AS hit_at_3,
    count(*) FILTER (tied) AS tied_target_blocks FROM credit GROUP BY model, match_id)
"""


@query(
    "agg13_expected_credits",
    with_ctes(SCORES, CREDIT)
    + """SELECT event_id, model, round(rr, 6) AS rr, round(hit1, 6) AS hit1, round(hit3, 6) AS hit3, tied
    FROM credit WHERE model <> 'm2'""",
)
def _(spark, sf_dir):
    return credits(spark, sf_dir).select(
        "event_id", "model", *[rounded(F.col(c)).alias(c) for c in ("rr", "hit1", "hit3")], "tied"
    )


@query(
    "agg14_match_metric_rows",
    with_ctes(SCORES, CREDIT)
    + """SELECT model, match_id, evaluation_eligible, fit_eligible, target_outside_zero_credit, round(mrr, 6) AS mrr,
    round(hit_at_1, 6) AS hit_at_1, round(hit_at_3, 6) AS hit_at_3, tied_target_blocks FROM metric""",
)
def _(spark, sf_dir):
    rows = ev.metric_rows(credits(spark, sf_dir, (M0, M1, M2)))
    return rows.withColumns({m: rounded(F.col(m)) for m in ev.METRICS})


@query(
    "agg15_macro_and_pooled_means",
    with_ctes(SCORES, CREDIT)
    + "SELECT model, "
    + ", ".join(
        f"round(avg({m}), 6) AS macro_{m}, round(sum({m} * evaluation_eligible) / sum(evaluation_eligible), 6) AS pooled_{m}"
        for m in ev.METRICS
    )
    + " FROM metric WHERE model <> 'm2' GROUP BY model",
)
def _(spark, sf_dir):
    both = ev.macro_and_pooled(ev.metric_rows(credits(spark, sf_dir)))
    return both.select("model", *[rounded(F.col(c)).alias(c) for c in both.columns if c != "model"])


@query(
    "agg16_paired_model_difference",
    with_ctes(SCORES, CREDIT)
    + """, gap AS (SELECT unnest(['mrr', 'hit_at_1', 'hit_at_3']) AS metric,
      unnest([r.mrr - l.mrr, r.hit_at_1 - l.hit_at_1, r.hit_at_3 - l.hit_at_3]) AS d
      FROM metric l JOIN metric r USING (match_id) WHERE l.model = 'm0' AND r.model = 'm1')
    SELECT metric, round(avg(d), 6) + 0e0 AS mean, round(median(d), 6) + 0e0 AS median, count(*) FILTER (d > 0) AS positive,
      count(*) FILTER (d < 0) AS negative, count(*) FILTER (d = 0) AS zero FROM gap GROUP BY metric""",
)
def _(spark, sf_dir):
    rows = ev.metric_rows(credits(spark, sf_dir))
    return ev.paired_differences(rows, "m0", "m1").withColumns(
        {c: rounded(F.col(c)) for c in ("mean", "median")}
    )


def _nested(value):
    return (
        f"SELECT avg(m) FROM (SELECT avg(c) AS m FROM (SELECT match_id, avg({value}) AS c FROM edge "
        "GROUP BY match_id, k) GROUP BY match_id)"
    )


@query(
    "agg06_nested_standardization",
    with_ctes(EDGES)
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, round(({_nested(c)}), 6) + 0e0 AS mean,
        round(sqrt(({_nested(f'({c} - ({_nested(c)})) * ({c} - ({_nested(c)}))')})), 6) + 0e0 AS scale, false AS zero_scale"""
        for name, c in FEATURE_SQL.items()
    ),
)
def _(spark, sf_dir):
    scaling = cm.weighted_standardization(edges(spark, sf_dir), M1_FEATURES)
    return scaling.withColumns({c: rounded(F.col(c)) for c in ("mean", "scale")})


@query(
    "agg07_within_choice_differences",
    with_ctes(EDGES)
    + "SELECT o.event_id, CAST(o.j AS INTEGER) AS ord, "
    + ", ".join(f"round(t.{c} - o.{c}, 6) + 0e0 AS {n}" for n, c in FEATURE_SQL.items())
    + " FROM edge o JOIN edge t USING (k) WHERE t.j = t.target_index AND o.j <> t.j",
)
def _(spark, sf_dir):
    rows = cm.within_choice_differences(edges(spark, sf_dir), M1_FEATURES)
    return rows.select("event_id", "ord", *[rounded(F.col(f)).alias(f) for f in M1_FEATURES])


BETA = (-0.05, 0.02, 0.01, 0.03, 0.06)
_SCORE_SQL = " + ".join(f"{c} * ({b}e0)" for c, b in zip(FEATURE_SQL.values(), BETA))


@query(
    "agg08_softmax_loss_and_gradient",
    with_ctes(EDGES)
    + f""", usable AS (SELECT *, {_SCORE_SQL} AS s FROM edge WHERE target_index IS NOT NULL),
    weighed AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY k) AS p, ln(sum(exp(s)) OVER (PARTITION BY k)) AS norm FROM usable),
    choice AS (SELECT match_id, k, max(norm) - sum(CASE WHEN j = target_index THEN s ELSE 0 END) AS loss, """
    + ", ".join(
        f"sum(p * {c}) - sum(CASE WHEN j = target_index THEN {c} ELSE 0 END) AS g{i}"
        for i, c in enumerate(FEATURE_SQL.values())
    )
    + " FROM weighed GROUP BY match_id, k), per_match AS (SELECT avg(loss) AS loss, "
    + ", ".join(f"avg(g{i}) AS g{i}" for i in range(5))
    + " FROM choice GROUP BY match_id) SELECT round(avg(loss), 6) + 0e0 AS loss, "
    + ", ".join(f"round(avg(g{i}), 6) + 0e0 AS g{i}" for i in range(5))
    + " FROM per_match",
)
def _(spark, sf_dir):
    row = cm.conditional_objective(edges(spark, sf_dir), M1_FEATURES, BETA)
    return row.select(*[rounded(F.col(c)).alias(c) for c in row.columns])


def feature_edges(spark, sf_dir, features):
    return edges(spark, sf_dir).select(*op.EDGE_KEYS, "id", "target_index", *features)


NESTED = {"m0": M0_FEATURES, "m1": M1_FEATURES, "m2": M2_FEATURES}


@query("agg09_softmax_fit")
def _(spark, sf_dir):
    fits = fo.fit_folds(feature_edges(spark, sf_dir, M1_FEATURES), M1_FEATURES, [fo.ALL])
    return fo.fold_table(spark, fits, M1_FEATURES).drop("ord", "mean", "scale", "steps")


@query("udf05_recorded_fit")
def _(spark, sf_dir):
    """What a recorder sees of the running fits: objective and gradient after every step of every model and fold."""
    steps, choices = [], fo.prepared_choices(feature_edges(spark, sf_dir, M2_FEATURES), M2_FEATURES)
    for model, features in NESTED.items():
        record = lambda step, fold, loss, gradient, model=model: steps.append((model, fold, step, loss, gradient))
        fo.fit_folds(choices, features, on_step=record)
    return spark.createDataFrame(steps, "model string, fold string, step int, objective double, max_gradient double")


@query("agg10_rank_gate")
def _(spark, sf_dir):
    gate = cm.identifiability(cm.within_choice_differences(edges(spark, sf_dir), M1_FEATURES), M1_FEATURES)
    return spark.createDataFrame([(gate["rank"], gate["columns"], gate["rows"])], "rank int, columns int, differences long")


def fitted_folds(spark, sf_dir):
    """(model, fold, feature, mean, scale, coef, ...): every model fitted with every match left out, once per application."""
    def build(s, d):
        choices = fo.prepared_choices(feature_edges(s, d, M2_FEATURES), M2_FEATURES)
        tables = [
            fo.fold_table(s, fo.fit_folds(choices, features), features).withColumn("model", F.lit(model))
            for model, features in NESTED.items()
        ]
        return reduce(DataFrame.unionByName, tables)

    return tt._stored(spark, sf_dir, "fitted-folds", build)


@query("agg11_leave_one_match_out")
def _(spark, sf_dir):
    from touchline.session import cut_lineage

    folds, raw = fitted_folds(spark, sf_dir), cut_lineage(feature_edges(spark, sf_dir, M2_FEATURES))
    scored = [fo.scored_by_fold(raw, folds.where(F.col("model") == model), features, model) for model, features in NESTED.items()]
    return ev.metric_rows(ev.expected_credits(op.score(reduce(DataFrame.unionByName, scored))))


@query("agg11_fold_parameters")
def _(spark, sf_dir):
    """Scaling and coefficients of every fold, with how it converged."""
    return fitted_folds(spark, sf_dir)


@query("agg12_frozen_reserved_scoring")
def _(spark, sf_dir):
    from touchline.session import cut_lineage

    raw = cut_lineage(feature_edges(spark, sf_dir, M2_FEATURES))
    development = raw.where(F.col("match_id").cast("long") < 6)
    reserved = raw.where(F.col("match_id").cast("long") >= 6)
    scored, choices = [], fo.prepared_choices(development, M2_FEATURES)
    for model, features in NESTED.items():
        frozen = fo.fold_table(spark, fo.fit_folds(choices, features, [fo.ALL]), features)
        scored.append(fo.scored_by_fold(reserved, frozen, features, model, None))
    return ev.metric_rows(ev.expected_credits(op.score(reduce(DataFrame.unionByName, scored))))


@query(
    "agg20_weighted_quantiles",
    """WITH rows AS (SELECT o_custkey % 9 AS g, o_totalprice AS v, 1e0 + o_orderkey % 7 AS w FROM orders),
    u AS (SELECT *, """
    + units_sql("w", "g")
    + """ AS units FROM rows),
    c AS (SELECT *, sum(units) OVER (PARTITION BY g ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum, sum(units) OVER (PARTITION BY g) AS total, count(*) OVER (PARTITION BY g) AS rows_ FROM u)
    SELECT g, """
    + quantiles_sql()
    + " FROM c GROUP BY g",
)
def _(spark, sf_dir):
    return weighted_summary(_weighted_orders(spark, sf_dir), ["g"], "v", "w").select(
        "g", "q05", "q25", "q50", "q75", "q95"
    )


def _weighted_orders(spark, sf_dir):
    return tt.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 9).alias("g"),
        F.col("o_totalprice").alias("v"),
        (F.lit(1.0) + F.col("o_orderkey") % 7).alias("w"),
        F.col("o_orderkey").alias("id"),
    )


@query(
    "agg21_weighted_distribution",
    """WITH rows AS (SELECT l_linenumber AS g, l_extendedprice AS v, l_quantity AS w FROM lineitem),
    u AS (SELECT *, """
    + units_sql("w", "g")
    + """ AS units FROM rows),
    c AS (SELECT *, sum(units) OVER (PARTITION BY g ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum, sum(units) OVER (PARTITION BY g) AS total, count(*) OVER (PARTITION BY g) AS rows_ FROM u)
    SELECT g, count(*) AS count, round(sum(v * w) / sum(w), 4) AS mean, min(v) AS minimum, max(v) AS maximum, """
    + quantiles_sql()
    + " FROM c GROUP BY g",
)
def _(spark, sf_dir):
    rows = tt.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("g"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w")
    )
    return weighted_summary(rows, ["g"], "v", "w").withColumn("mean", rounded(F.col("mean"), 4))


@query(
    "win09_running_weight",
    """SELECT g, id, sum(w) OVER (PARTITION BY g ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS running FROM (
      SELECT o_custkey % 9 AS g, o_totalprice AS v, 1e0 + o_orderkey % 7 AS w, o_orderkey AS id FROM orders)""",
)
def _(spark, sf_dir):
    rows = _weighted_orders(spark, sf_dir)
    return running_sum(rows, ["g"], ["v", "id"], value_bucket(F.col("v")), F.col("w"), "running").select(
        "g", "id", "running"
    )


@query(
    "win08_average_ranks",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
      rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2e0 AS average_rank
    FROM lineitem""",
)
def _(spark, sf_dir):
    rows = tt.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    return average_rank(rows, ["l_linenumber"], "l_quantity", "average_rank").drop("l_quantity")


_QS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "agg23_linear_quantiles_and_variance",
    with_ctes(EDGES)
    + """, per_match AS (SELECT match_id, var_pop(sd) AS variance, """
    + ", ".join(f"quantile_cont(sd, {q}) AS q{round(q * 100):02d}" for q in _QS)
    + " FROM edge GROUP BY match_id) SELECT round(avg(variance), 6) AS variance, "
    + ", ".join(f"round(avg(q{round(q * 100):02d}), 6) + 0e0 AS q{round(q * 100):02d}" for q in _QS)
    + " FROM per_match",
)
def _(spark, sf_dir):
    from touchline.session import cut_lineage

    rows = cut_lineage(
        edges(spark, sf_dir).select("match_id", F.col("minimum_segment_defender_distance").alias("sd"))
    )
    per_match = linear_quantiles(rows, ["match_id"], "sd").join(
        rows.groupBy("match_id").agg(F.var_pop("sd").alias("variance")), "match_id"
    )
    names = ["variance", *[f"q{round(q * 100):02d}" for q in _QS]]
    return per_match.agg(*[rounded(F.avg(n)).alias(n) for n in names])


@query(
    "agg24_pearson",
    with_ctes(EDGES) + "SELECT match_id, round(corr(rd, sd), 6) AS pearson FROM edge GROUP BY match_id",
)
def _(spark, sf_dir):
    rows = ev.pearson(
        edges(spark, sf_dir), ["match_id"], "nearest_receiver_defender_distance",
        "minimum_segment_defender_distance", "pearson",
    )
    return rows.withColumn("pearson", rounded(F.col("pearson")))


@query(
    "agg25_spearman",
    """WITH r AS (SELECT l_linenumber AS g,
      rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2e0 AS a,
      rank() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linenumber, l_extendedprice) - 1) / 2e0 AS b
      FROM lineitem) SELECT g, round(corr(a, b), 6) AS spearman FROM r GROUP BY g""",
)
def _(spark, sf_dir):
    rows = tt.table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("g"), "l_quantity", "l_extendedprice"
    )
    return ev.spearman(rows, ["g"], "l_quantity", "l_extendedprice", "spearman").withColumn(
        "spearman", rounded(F.col("spearman"))
    )


_CENTRED = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY k) AS {c}" for c in FEATURE_SQL.values())
_CELLS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, match_id, k, avg({x} * {y}) AS v FROM middle GROUP BY match_id, k"
    for a, x in FEATURE_SQL.items() for b, y in FEATURE_SQL.items()
)


@query(
    "agg26_centred_correlation",
    with_ctes(EDGES)
    + f""", middle AS (SELECT match_id, k, {_CENTRED} FROM edge), cells AS ({_CELLS}),
    covariance AS (SELECT a, b, avg(m) AS v FROM (SELECT a, b, match_id, avg(v) AS m FROM cells GROUP BY ALL) GROUP BY a, b)
    SELECT c.a, c.b, round(c.v / sqrt(l.v) / sqrt(r.v), 6) + 0e0 AS correlation FROM covariance c
    JOIN covariance l ON l.a = c.a AND l.b = c.a JOIN covariance r ON r.a = c.b AND r.b = c.b""",
)
def _(spark, sf_dir):
    covariance = cm.centred_covariance(edges(spark, sf_dir), M1_FEATURES)
    return cm.centred_correlation(covariance).withColumn("correlation", rounded(F.col("correlation")))


@query("agg26_correlation_condition")
def _(spark, sf_dir):
    """Rank and condition number of the correlation within choices."""
    correlation = cm.centred_correlation(cm.centred_covariance(edges(spark, sf_dir), M1_FEATURES))
    found = cm.matrix_condition(correlation, list(M1_FEATURES))
    return spark.createDataFrame([(found["rank"], len(M1_FEATURES), found["condition"])], "rank int, columns int, condition double")


_PAIR_SQL = """
pairs AS (SELECT a.k, a.match_id, a.event_id, a.j AS a_ord, b.j AS b_ord, a.rd - b.rd AS drd, a.sd - b.sd AS dsd
  FROM edge a JOIN edge b ON a.k = b.k AND a.j < b.j)
"""


@query(
    "agg27_ordering_disagreement",
    with_ctes(EDGES, _PAIR_SQL)
    + """SELECT event_id, count(*) FILTER (abs(drd) > 1e-12 AND abs(dsd) > 1e-12) AS comparable_pairs,
    count(*) FILTER (abs(drd) > 1e-12 AND abs(dsd) > 1e-12 AND sign(drd) <> sign(dsd)) AS discordant_pairs
    FROM pairs GROUP BY event_id""",
)
def _(spark, sf_dir):
    rows = ev.ordering_disagreement(
        edges(spark, sf_dir), "nearest_receiver_defender_distance", "minimum_segment_defender_distance"
    )
    return rows.select("event_id", "comparable_pairs", "discordant_pairs")


@query(
    "jn09_candidate_pairs",
    with_ctes(EDGES, _PAIR_SQL)
    + """SELECT event_id, CAST(a_ord AS INTEGER) AS a_ord, CAST(b_ord AS INTEGER) AS b_ord, round(dsd, 6) + 0e0 AS segment_gap FROM pairs""",
)
def _(spark, sf_dir):
    pairs = op.receiver_pairs(edges(spark, sf_dir), "minimum_segment_defender_distance")
    gap = F.col("a_minimum_segment_defender_distance") - F.col("b_minimum_segment_defender_distance")
    return pairs.select("event_id", "a_ord", "b_ord", rounded(gap).alias("segment_gap"))


def fold_parameters(spark, sf_dir):
    """(fold, feature, coef): match means of the features stand in for fitted folds."""
    per_match = edges(spark, sf_dir).groupBy(F.col("match_id").alias("fold")).agg(
        *[F.avg(f).alias(f) for f in M1_FEATURES]
    )
    return per_match.unpivot(["fold"], list(M1_FEATURES), "feature", "coef")


_PARAMETER_SQL = "parameter AS (" + " UNION ALL ".join(
    f"SELECT match_id AS fold, '{n}' AS feature, avg({c}) AS coef FROM edge GROUP BY match_id"
    for n, c in FEATURE_SQL.items()
) + ")"


@query(
    "agg29_coefficient_stability",
    with_ctes(EDGES, _PARAMETER_SQL)
    + """SELECT feature, count(*) FILTER (coef > 0) AS positive_folds, count(*) FILTER (coef < 0) AS negative_folds,
    count(*) FILTER (coef = 0) AS zero_folds, round(min(coef), 6) + 0e0 AS minimum, round(median(coef), 6) + 0e0 AS median,
    round(max(coef), 6) + 0e0 AS maximum FROM parameter GROUP BY feature""",
)
def _(spark, sf_dir):
    rows = ev.coefficient_stability(fold_parameters(spark, sf_dir))
    return rows.withColumns({c: rounded(F.col(c)) for c in ("minimum", "median", "maximum")})


@query("agg29_fitted_stability")
def _(spark, sf_dir):
    """Signs, minimum, median and maximum of every coefficient over the fitted folds of each model."""
    found = [
        ev.coefficient_stability(fitted_folds(spark, sf_dir).where(F.col("model") == model)).withColumn("model", F.lit(model))
        for model in NESTED
    ]
    return reduce(DataFrame.unionByName, found)


@query(
    "agg30_nondegenerate_gap",
    with_ctes(RANKS, _OVERLAP)
    + """SELECT match_id, coalesce(count(segment_d2_d1) >= 2 AND max(segment_d2_d1) - min(segment_d2_d1) >
      count(segment_d2_d1) * 2.220446049250313e-16 * greatest(max(abs(segment_d2_d1)), 1), false) AS nondegenerate
    FROM overlap GROUP BY match_id""",
)
def _(spark, sf_dir):
    from touchline.operators.relations import defender_relations, edge_overlap

    gaps = edge_overlap(defender_relations(tt.states(spark, sf_dir)))
    return ev.nondegenerate(gaps, ["match_id"], "segment_d2_d1")


@query(
    "agg31_detection_provenance",
    with_ctes(*MOMENTS)
    + """, ordered AS (SELECT match_id, period, frame, lag(frame) OVER (PARTITION BY match_id, period ORDER BY t_us) AS prior FROM frame),
    judged AS (SELECT m.match_id, coalesce(p.is_detected, false) AS now, q.player_id IS NOT NULL AS known, coalesce(q.is_detected, false) AS past
      FROM moment m JOIN position p USING (match_id, period, frame, player_id) JOIN ordered o USING (match_id, period, frame)
      LEFT JOIN (SELECT * FROM position WHERE x IS NOT NULL AND y IS NOT NULL) q ON q.match_id = m.match_id AND q.period = m.period AND q.frame = o.prior AND q.player_id = m.player_id
      WHERE m.active AND m.team_id <> m.carrier_team)
    SELECT match_id, count(*) AS defender_instances, count(*) FILTER (now) AS current_detected, count(*) FILTER (known) AS past_available,
      count(*) FILTER (known AND now AND past) AS detected_detected, count(*) FILTER (known AND now AND NOT past) AS detected_extrapolated,
      count(*) FILTER (known AND NOT now AND past) AS extrapolated_detected,
      count(*) FILTER (known AND NOT now AND NOT past) AS extrapolated_extrapolated FROM judged GROUP BY match_id""",
)
def _(spark, sf_dir):
    return provenance(spark, sf_dir)


def provenance(spark, sf_dir):
    """Detection now against detection in the frame before, over decision-frame defenders."""
    from touchline.catalog.population import BUCKET, moments
    from touchline.functions.scalars import filled, is_finite
    from touchline.operators import population as pop

    frames = tt.tracking_frames(spark, sf_dir)
    opponents = moments(spark, sf_dir).where("active AND team_id <> carrier_team")
    defenders = pop.with_detections(opponents, frames).select(
        "match_id", "period", "frame", "frame_clock", "event_id", "player_id",
        F.coalesce("is_detected", F.lit(False)).alias("detected"),
    )
    before = pop.frames_with_previous(frames, BUCKET).select(
        "match_id", "period", "frame", F.col("previous.frame").alias("prior"), F.col("previous.t_us").alias("prior_us")
    )
    past = pop.tracked_positions(frames).select(
        "match_id", "period", F.col("frame").alias("prior"), "player_id",
        F.coalesce("is_detected", F.lit(False)).alias("prior_detected"),
    )
    joined = defenders.join(before, ["match_id", "period", "frame"], "left").join(
        past, ["match_id", "period", "prior", "player_id"], "left"
    )
    known = F.col("prior_detected").isNotNull()
    return joined.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("defender_instances"),
        F.count_if("detected").alias("current_detected"),
        F.count_if(known).alias("past_available"),
        F.count_if(known & F.col("detected") & F.col("prior_detected")).alias("detected_detected"),
        F.count_if(known & F.col("detected") & ~F.col("prior_detected")).alias("detected_extrapolated"),
        F.count_if(known & ~F.col("detected") & F.col("prior_detected")).alias("extrapolated_detected"),
        F.count_if(known & ~F.col("detected") & ~F.col("prior_detected")).alias("extrapolated_extrapolated"),
    )


@query(
    "agg31_elapsed_quantiles",
    with_ctes(*DECISION)
    + """, ordered AS (SELECT *, lag(t_us) OVER (PARTITION BY match_id, period ORDER BY t_us) AS prior_us FROM frame),
    elapsed AS (SELECT d.match_id, o.t_us - o.prior_us AS e FROM decided d JOIN ordered o USING (match_id, period, frame) WHERE o.prior_us IS NOT NULL)
    SELECT match_id, count(*) AS frames, min(e) AS minimum, max(e) AS maximum, """
    + ", ".join(f"round(quantile_cont(e, {q}), 3) + 0e0 AS q{round(q * 100):02d}" for q in QUANTILES)
    + " FROM elapsed GROUP BY match_id",
)
def _(spark, sf_dir):
    from touchline.catalog.population import BUCKET, decided
    from touchline.operators import population as pop
    from touchline.session import cut_lineage

    before = pop.frames_with_previous(tt.tracking_frames(spark, sf_dir), BUCKET)
    found = decided(spark, sf_dir).where(F.col("frame").isNotNull()).select("match_id", "period", "frame").join(
        before, ["match_id", "period", "frame"]
    )
    elapsed = (F.col("t_us") - F.col("previous.t_us")).alias("e")
    rows = cut_lineage(found.select("match_id", elapsed).where("e IS NOT NULL"))
    counted = rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.min("e").alias("minimum"), F.max("e").alias("maximum"))
    spread = linear_quantiles(rows.withColumn("v", F.col("e").cast("double")), ["match_id"], "v", QUANTILES)
    names = [c for c in spread.columns if c.startswith("q")]
    return counted.join(spread.select("match_id", *[rounded(F.col(c), 3).alias(c) for c in names]), "match_id")


# Probe distances of the sensitivity grid (metres).
ANCHORS = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0)


@query(
    "agg32_sensitivity_grid",
    with_ctes(EDGES, _PARAMETER_SQL)
    + """, wide AS (SELECT fold, max(coef) FILTER (feature = 'nearest_receiver_defender_distance') AS cr,
      max(coef) FILTER (feature = 'minimum_segment_defender_distance') AS cs FROM parameter GROUP BY fold),
    change AS (SELECT fold, r, s, cr * (r - 20e0) / 10e0 + cs * (s - 20e0) / 10e0 AS d FROM wide,
      (SELECT unnest([0e0, 1e0, 2e0, 5e0, 10e0, 20e0, 40e0]) AS r), (SELECT unnest([0e0, 1e0, 2e0, 5e0, 10e0, 20e0, 40e0]) AS s) WHERE s <= r)
    SELECT r AS receiver, s AS segment, round(min(d), 6) + 0e0 AS minimum, round(median(d), 6) + 0e0 AS median, round(max(d), 6) + 0e0 AS maximum
    FROM change GROUP BY r, s""",
)
def _(spark, sf_dir):
    folds = fold_parameters(spark, sf_dir).groupBy("fold").pivot("feature", list(M1_FEATURES[3:])).agg(F.max("coef"))
    grid = F.array(
        *[
            F.struct(F.lit(r).alias("receiver"), F.lit(s).alias("segment"))
            for r in ANCHORS for s in ANCHORS if s <= r
        ]
    )
    change = (
        F.col("nearest_receiver_defender_distance") * (F.col("receiver") - 20.0) / 10.0
        + F.col("minimum_segment_defender_distance") * (F.col("segment") - 20.0) / 10.0
    )
    rows = folds.select("*", F.inline(grid)).withColumn("d", change)
    cells = ["receiver", "segment"]
    spread = rows.groupBy(*cells).agg(F.min("d").alias("minimum"), F.max("d").alias("maximum"))
    middle = linear_quantiles(rows, cells, "d", (0.5,)).withColumnRenamed("q50", "median")
    return spread.join(middle, cells).withColumns(
        {c: rounded(F.col(c)) for c in ("minimum", "median", "maximum")}
    )


@query("agg32_fitted_sensitivity")
def _(spark, sf_dir):
    """Utility change of the second model at fixed anchors against a defender at 20 m, over its fitted folds."""
    probe = F.array(*[F.struct(F.lit(r).alias("receiver"), F.lit(s).alias("segment")) for r in ANCHORS for s in ANCHORS if s <= r])
    slope = lambda f: F.max(F.when(F.col("feature") == f, F.col("coef") / F.col("scale")))
    folds = fitted_folds(spark, sf_dir).where("model = 'm1'").groupBy("fold").agg(
        slope("nearest_receiver_defender_distance").alias("cr"), slope("minimum_segment_defender_distance").alias("cs")
    )
    rows = folds.select("fold", "cr", "cs", F.inline(probe)).withColumn(
        "d", F.col("cr") * (F.col("receiver") - 20.0) + F.col("cs") * (F.col("segment") - 20.0)
    )
    return rows.groupBy("receiver", "segment").agg(
        F.count_if(F.col("d") > 0).alias("positive_folds"), F.count_if(F.col("d") < 0).alias("negative_folds"),
        F.min("d").alias("minimum"), F.median("d").alias("median"), F.max("d").alias("maximum"),  # a row per fold
    )
