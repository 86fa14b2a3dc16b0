"""Scalar projections, validation and row-level filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import (
    CANDIDATE, DEFENDER, EDGES, EVENT, FRAME, MATCH, POSITION, ROSTER, STATE, query, with_ctes,
)
from touchline.functions import geometry as g
from touchline.functions import scalars as sc
from touchline.functions.scalars import rounded
from touchline.operators import options as op
from touchline.sources import testtables as tt
from touchline.sources.models import model_table, model_violations

STATES = (STATE, CANDIDATE, DEFENDER)
PITCH = """pitch AS (SELECT CAST(n_nationkey % 9 AS VARCHAR) AS match_id, CAST(min(n_nationkey) % 9 + 96 AS DOUBLE) AS len
  FROM nation GROUP BY n_nationkey % 9)"""


@query(
    "prj01_clock_microseconds",
    with_ctes(EVENT)
    + "SELECT event_id, CASE WHEN time_end <> 'bad' THEN CAST(true_us AS BIGINT) END AS t_us FROM vendor",
)
def _(spark, sf_dir):
    return tt.match_events(spark, sf_dir).select(
        "event_id", sc.clock_microseconds(F.col("time_end")).alias("t_us")
    )


@query(
    "prj02_identity_form",
    """WITH ids AS (
      SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN ' ' || source
        ELSE source END AS v FROM documents)
    SELECT doc_id, CASE WHEN v IS NULL THEN 'null' WHEN v = '' THEN 'empty' WHEN trim(v) = '' THEN 'whitespace_only'
      WHEN trim(v) <> v THEN 'padded' ELSE 'ordinary' END AS form FROM ids""",
)
def _(spark, sf_dir):
    d = F.col("doc_id") % 7
    value = (
        F.when(d == 0, None).when(d == 1, "").when(d == 2, "  ")
        .when(d == 3, F.concat(F.lit(" "), "source")).otherwise(F.col("source"))
    )
    docs = tt.table(spark, sf_dir, "documents").select("doc_id", value.alias("v"))
    return docs.select("doc_id", sc.identity_form(F.col("v")).alias("form"))


@query("prj02_identity_form_json")
def _(spark, sf_dir):
    # Numbers, booleans and objects are told apart from text by their JSON type.
    value = F.element_at(
        F.array(
            F.lit("null"), F.lit("true"), F.lit("1.5"), F.lit("12"), F.lit('""'), F.lit('" a"'), F.lit('"a"')
        ),
        (F.col("event_id") % 7 + 1).cast("int"),
    )
    forms = tt.table(spark, sf_dir, "events").select(
        sc.variant_identity_form(F.parse_json(value)).alias("form")
    )
    return forms.groupBy("form").agg(F.count(F.lit(1)).alias("values"))


@query(
    "prj03_carrier_selection",
    with_ctes(EVENT)
    + """SELECT event_id, CASE WHEN player_id <> '' THEN player_id ELSE coalesce(player_in_possession_id, '') END AS carrier,
    NOT (player_id <> '') AND coalesce(player_in_possession_id, '') <> '' AS fallback,
    player_id <> '' AND coalesce(player_in_possession_id, '') <> '' AND coalesce(player_in_possession_id <> player_id, false) AS conflict
    FROM vendor WHERE event_type = 'player_possession'""",
)
def _(spark, sf_dir):
    a, b = F.col("player_id"), F.col("player_in_possession_id")
    return tt.match_events(spark, sf_dir).where("event_type = 'player_possession'").select(
        "event_id",
        sc.carrier_of(a, b).alias("carrier"),
        sc.carrier_fallback_used(a, b).alias("fallback"),
        sc.carrier_conflict(a, b).alias("conflict"),
    )


@query(
    "prj04_attack_sign",
    with_ctes(MATCH, ROSTER)
    + """SELECT player_id, p AS period, CASE WHEN side = 'unknown' THEN NULL ELSE
      (CASE WHEN side = 'left_to_right' THEN 1 ELSE -1 END) * (CASE WHEN team_id = home_team_id THEN 1 ELSE -1 END) END AS sign
    FROM (SELECT *, CASE WHEN p = 1 THEN side1 ELSE side2 END AS side FROM roster JOIN matches USING (match_id), (VALUES (1), (2)) t(p))""",
)
def _(spark, sf_dir):
    players = tt.roster(spark, sf_dir).join(tt.matches(spark, sf_dir), "match_id")
    sides = players.select(
        "player_id", "team_id", "home_team_id", F.posexplode("home_side").alias("pos", "side")
    )
    return sides.select(
        "player_id",
        (F.col("pos") + 1).alias("period"),
        sc.attack_sign(F.col("home_team_id"), F.col("team_id"), F.col("side")).alias("sign"),
    )


@query(
    "prj05_attacking_coordinates",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT match_id, frame, player_id, x * s AS ax, y AS ay FROM (
      SELECT *, CASE WHEN CAST(player_id AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM position) WHERE x IS NOT NULL""",
)
def _(spark, sf_dir):
    sign = F.when(F.col("player_id").cast("long") % 2 == 0, 1).otherwise(-1)
    rows = positions(spark, sf_dir).where(sc.is_finite(F.col("x")) & sc.is_finite(F.col("y")))
    return rows.select(
        "match_id", "frame", "player_id", (F.col("x") * sign).alias("ax"), F.col("y").alias("ay")
    )


def positions(spark, sf_dir):
    from touchline.operators.population import position_rows

    return position_rows(tt.tracking_frames(spark, sf_dir))


@query(
    "prj06_geometry_validation",
    with_ctes(*STATES)
    + """SELECT event_id, CASE WHEN count(*) FILTER (sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy)) <= 1e-9) > 0
      THEN 'origin_defender_direction_undefined' ELSE 'valid' END AS geometry
    FROM state JOIN defender USING (k) GROUP BY event_id""",
)
def _(spark, sf_dir):
    from touchline.operators.fields import geometry_error

    return tt.states(spark, sf_dir).select(
        "event_id", F.coalesce(geometry_error(), F.lit("valid")).alias("geometry")
    )


@query(
    "prj07_segment_distance",
    with_ctes(EDGES)
    + """SELECT event_id, id, CAST(d AS BIGINT) AS d, round(sdist, 6) + 0e0 AS distance, round(t, 6) + 0e0 AS fraction
    FROM relation""",
)
def _(spark, sf_dir):
    rows = op.relation_rows(tt.states(spark, sf_dir))
    fraction = g.segment_fraction(*[F.col(c) for c in ("px", "py", "cx", "cy", "rx", "ry")])
    return rows.select(
        "event_id", "id", F.col("d").cast("long").alias("d"),
        rounded(F.col("segment_distance")).alias("distance"), rounded(fraction).alias("fraction"),
    )


@query(
    "prj17_goalward_progression",
    with_ctes(STATE, CANDIDATE, PITCH)
    + """SELECT event_id, id, CASE WHEN abs(rx) <= len / 2 THEN round(0.5e0 + rx / len, 9) + 0e0 END AS progress
    FROM candidate JOIN pitch USING (match_id)""",
)
def _(spark, sf_dir):
    rows = op.candidate_rows(tt.states(spark, sf_dir)).join(tt.pitches(spark, sf_dir), "match_id")
    return rows.select(
        "event_id", "id", rounded(g.goalward_progress(F.col("rx"), F.col("pitch_length")), 9).alias("progress")
    )


@query(
    "prj18_bin_label",
    with_ctes(EDGES)
    + """SELECT event_id, id, 'bin_' || CAST(1 + (CASE WHEN 5 < dist THEN 1 ELSE 0 END) + (CASE WHEN 10 < dist THEN 1 ELSE 0 END)
    + (CASE WHEN 15 < dist THEN 1 ELSE 0 END) AS VARCHAR) AS bin FROM edge""",
)
def _(spark, sf_dir):
    rows = op.pass_vector(op.candidate_rows(tt.states(spark, sf_dir)))
    cuts = F.array(F.lit(5.0), F.lit(10.0), F.lit(15.0))
    return rows.select("event_id", "id", sc.bin_label(F.col("distance"), cuts).alias("bin"))


@query("prj25_float_bits")
def _(spark, sf_dir):
    value = F.col("o_totalprice")
    return tt.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sc.float_bits_text(value).alias("bits"),
        sc.signed_zero(value * 0.0 * F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)).alias("zero"),
        sc.ulp_distance(value, value * (1.0 + 2.220446049250313e-16)).alias("ulps"),
    )


@query("prj26_component_comparison")
def _(spark, sf_dir):
    from touchline.operators.quality import component_record

    rows = tt.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey"), F.col("l_extendedprice").alias("expected"),
        (F.col("l_extendedprice") / 3.0 * 3.0).alias("actual"),
    )
    return rows.select("l_orderkey", component_record(F.col("expected"), F.col("actual")).alias("r")).select(
        "l_orderkey", "r.*"
    )


@query(
    "prj27_path_generalisation",
    """SELECT doc_id, regexp_replace(p, '\\[[^\\]]*\\]', '[]', 'g') AS path FROM (
      SELECT doc_id, '$.a[' || CAST(doc_id % 9 AS VARCHAR) || '].b[' || source || '].c' AS p FROM documents)""",
)
def _(spark, sf_dir):
    path = F.concat(
        F.lit("$.a["), (F.col("doc_id") % 9).cast("string"), F.lit("].b["), F.col("source"), F.lit("].c")
    )
    return tt.table(spark, sf_dir, "documents").select("doc_id", sc.generalised_path(path).alias("path"))


@query("prj28_schema_fingerprint")
def _(spark, sf_dir):
    from touchline.operators.quality import schema_fingerprint

    rows = schema_fingerprint(tt.table(spark, sf_dir, "events").select("props"), "props")
    return rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("records"))


@query(
    "prj29_match_alias",
    with_ctes(STATE)
    + """SELECT event_id, 'development_' || lpad(CAST(rank AS VARCHAR), 2, '0') AS alias FROM state JOIN (
      SELECT match_id, row_number() OVER (ORDER BY CAST(match_id AS BIGINT)) AS rank
      FROM (SELECT DISTINCT match_id FROM state)) USING (match_id)""",
)
def _(spark, sf_dir):
    from touchline.operators.population import with_alias

    return with_alias(tt.states(spark, sf_dir), "development_").select("event_id", "alias")


@query(
    "prj30_tie_key",
    """SELECT o_orderkey, sha256('population:' || CAST(o_orderkey AS VARCHAR)) AS tie_key FROM orders""",
)
def _(spark, sf_dir):
    return tt.table(spark, sf_dir, "orders").select(
        "o_orderkey", sc.tie_key(F.lit("population"), F.col("o_orderkey")).alias("tie_key")
    )


@query(
    "prj31_pitch_placement",
    with_ctes(STATE, CANDIDATE, PITCH)
    + """SELECT event_id, id, CASE WHEN rx + len / 2 BETWEEN 0 AND len THEN round(rx + len / 2, 6) + 0e0 END AS px,
    CASE WHEN ry + 34e0 BETWEEN 0 AND 68 THEN round(ry + 34e0, 6) + 0e0 END AS py FROM candidate JOIN pitch USING (match_id)""",
)
def _(spark, sf_dir):
    rows = op.candidate_rows(tt.states(spark, sf_dir)).join(tt.pitches(spark, sf_dir), "match_id")
    return rows.select(
        "event_id", "id",
        rounded(g.pitch_coordinate(F.col("rx"), F.col("pitch_length"))).alias("px"),
        rounded(g.pitch_coordinate(F.col("ry"), F.col("pitch_width"))).alias("py"),
    )


@query(
    "prj32_identity_guard",
    with_ctes(EDGES)
    + """SELECT count(*) AS edges, count(*) FILTER (NOT abs((dist - rd) - (dist + sd - rd - sd)) <=
      64 * 2.220446049250313e-16 * greatest(1e0, dist + sd + rd)) AS violations FROM edge""",
)
def _(spark, sf_dir):
    e = op.edge_features(tt.states(spark, sf_dir))
    dist, rd, sd = (
        F.col("distance"), F.col("nearest_receiver_defender_distance"), F.col("minimum_segment_defender_distance")
    )
    holds = sc.identity_holds(dist - rd, dist + sd - rd - sd, dist + sd + rd)
    return e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~holds).alias("violations"))


@query(
    "prj33_finite_output_guard",
    """SELECT count(*) AS records, count(*) FILTER (isinf(q) OR isnan(q)) AS rejected FROM (
      SELECT CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax / l_discount END AS q FROM lineitem)""",
)
def _(spark, sf_dir):
    from touchline.operators.quality import nonfinite_counts

    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax") / F.col("l_discount"))
    rows = tt.table(spark, sf_dir, "lineitem").select(ratio.alias("ratio"))
    return nonfinite_counts(rows).select("records", F.col("ratio").alias("rejected"))


@query(
    "prj34_selected_edge",
    with_ctes(*STATES)
    + """SELECT event_id, id, rx, ry, cx, cy, nd AS defenders FROM candidate WHERE j = k % nc""",
)
def _(spark, sf_dir):
    n = F.col("ordinal") % F.size("candidates")
    picked = tt.states(spark, sf_dir).select(
        "event_id", F.element_at("candidates", (n + 1).cast("int")).alias("c"), "carrier",
        F.size("defenders").cast("long").alias("defenders"),
    )
    return picked.select(
        "event_id", "c.id", F.col("c.x").alias("rx"), F.col("c.y").alias("ry"),
        F.col("carrier.x").alias("cx"), F.col("carrier.y").alias("cy"), "defenders",
    )


@query(
    "prj35_detection_status",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT match_id, frame, player_id, CASE WHEN is_detected IS NULL THEN 'unavailable' WHEN is_detected THEN 'detected'
    ELSE 'extrapolated' END AS status FROM position WHERE x IS NOT NULL""",
)
def _(spark, sf_dir):
    rows = positions(spark, sf_dir).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return rows.select(
        "match_id", "frame", "player_id", sc.detection_status(F.col("is_detected")).alias("status")
    )


@query(
    "flt01_pass_attempts",
    with_ctes(EVENT)
    + "SELECT event_id FROM vendor WHERE event_type = 'player_possession' AND pass_outcome <> ''",
)
def _(spark, sf_dir):
    from touchline.operators.population import pass_attempts

    return pass_attempts(tt.match_events(spark, sf_dir)).select("event_id")


@query(
    "flt04_finite_positions",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT match_id, period, frame, count(*) AS players, count(*) - count(DISTINCT player_id) AS duplicates
    FROM position WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY match_id, period, frame""",
)
def _(spark, sf_dir):
    from touchline.operators.population import tracked_positions

    frames = tracked_positions(tt.tracking_frames(spark, sf_dir))
    return frames.groupBy("match_id", "period", "frame").agg(
        F.count(F.lit(1)).alias("players"),
        (F.count(F.lit(1)) - F.count_distinct("player_id")).alias("duplicates"),
    )


@query(
    "flt06_out_of_pitch_points",
    with_ctes(STATE, CANDIDATE, PITCH)
    + """SELECT event_id, 'carrier' AS role, NULL AS candidate_ordinal, cx AS x FROM state JOIN pitch USING (match_id) WHERE abs(cx) > len / 2
    UNION ALL SELECT event_id, 'candidate', CAST(j AS INTEGER), rx FROM candidate JOIN pitch USING (match_id) WHERE abs(rx) > len / 2""",
)
def _(spark, sf_dir):
    from touchline.operators.boundary import out_of_pitch_points

    return out_of_pitch_points(tt.states(spark, sf_dir), tt.pitches(spark, sf_dir)).select(
        "event_id", "role", "candidate_ordinal", "x"
    )


@query(
    "src10_frozen_models",
    """WITH base AS (SELECT * FROM (VALUES ('m0', 3), ('m1', 5), ('m2', 6)) t(model, n)),
    used AS (SELECT s_suppkey, model, n, s_suppkey % 7 = 3 AS flat, s_suppkey % 11 = 4 AS wild, s_suppkey % 13 = 5 AS turned, s_suppkey % 17 = 6 AS cut
      FROM supplier CROSS JOIN base)
    SELECT s_suppkey, model, CASE WHEN turned THEN 2 ELSE 0 END AS feature_order, CAST(wild AS INTEGER) AS nonfinite_parameter,
      CAST(flat AS INTEGER) AS nonpositive_scale, CAST(cut AS INTEGER) AS feature_count
    FROM used WHERE flat OR wild OR turned OR cut""",
)
def _(spark, sf_dir):
    # Every supplier delivers the three models, some with a fault; the checks find all of them.
    key = F.col("s_suppkey")
    delivered = tt.table(spark, sf_dir, "supplier").select("s_suppkey").crossJoin(F.broadcast(model_table(spark)))
    first, second = (F.col("ord") == 0), (F.col("ord") == 1)
    turned = key % 13 == 5
    faulty = delivered.where(~((key % 17 == 6) & (F.col("ord") == 2))).withColumns(
        {
            "scale": F.when((key % 7 == 3) & second, 0.0).otherwise(F.col("scale")),
            "coef": F.when((key % 11 == 4) & first, F.lit(float("nan"))).otherwise(F.col("coef")),
            "feature": F.when(turned & first, "longitudinal_displacement").when(turned & second, "distance").otherwise(F.col("feature")),
        }
    )
    rules = ("feature_order", "nonfinite_parameter", "nonpositive_scale", "feature_count")
    broken = model_violations(faulty, "s_suppkey")
    return broken.groupBy("s_suppkey", "model").agg(*[F.count_if(F.col("rule") == r).cast("int").alias(r) for r in rules])


@query(
    "src11_frame_adapter",
    with_ctes(EVENT, FRAME, POSITION)
    + """, cast_list AS (
      SELECT match_id, period, frame, t_us, player_id, x, y, CAST(player_id AS BIGINT) % 22 AS n FROM position WHERE x IS NOT NULL)
    SELECT match_id, frame, t_us, max(CASE WHEN n = 0 THEN x END) AS carrier_x, count(*) FILTER (n > 0 AND n % 2 = 0) AS candidates,
      count(*) FILTER (n % 2 = 1) AS defenders
    FROM cast_list GROUP BY match_id, frame, t_us
    HAVING count(*) FILTER (n = 0) = 1 AND count(*) FILTER (n > 0 AND n % 2 = 0) > 0 AND count(*) FILTER (n % 2 = 1) > 0""",
)
def _(spark, sf_dir):
    from touchline.operators.population import states_from_selection

    frames = tt.tracking_frames(spark, sf_dir)
    number = F.col("player_id").cast("long") % 22
    role = F.when(number == 0, "carrier").when(number % 2 == 0, "candidate").otherwise("defender")
    built = states_from_selection(frames, role)
    return built.where(F.col("reject").isNull()).select(
        "match_id", "frame", "t_us", F.col("carrier.x").alias("carrier_x"),
        F.size("candidates").cast("long").alias("candidates"),
        F.size("defenders").cast("long").alias("defenders"),
    )


@query(
    "udf04_state_expansion",
    with_ctes(STATE, CANDIDATE) + "SELECT event_id, CAST(j AS INTEGER) AS ord, id, rx, ry FROM candidate",
)
def _(spark, sf_dir):
    tt.states(spark, sf_dir).createOrReplaceTempView("touchline_states")
    return spark.sql(
        """SELECT event_id, ord, c.id AS id, c.x AS rx, c.y AS ry
        FROM touchline_states LATERAL VIEW posexplode(candidates) e AS ord, c"""
    )


@query(
    "top06_ordered_output",
    with_ctes(STATE) + "SELECT CAST(match_id AS BIGINT) AS match_number, event_id FROM state ORDER BY 1, 2",
)
def _(spark, sf_dir):
    return tt.states(spark, sf_dir).select(
        F.col("match_id").cast("long").alias("match_number"), "event_id"
    ).orderBy("match_number", "event_id")
