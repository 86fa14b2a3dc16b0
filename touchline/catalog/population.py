"""Joins that build decision states, the exclusion waterfall, tracking profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.catalog.base import (
    CANDIDATE, DEFENDER, EDGES, EVENT, FRAME, INTERVAL, MATCH, POSITION, ROSTER, STATE, TRACKING, query, with_ctes,
)
from touchline.catalog.points import PITCH
from touchline.functions import scalars as sc
from touchline.functions.scalars import rounded
from touchline.operators import boundary as bd
from touchline.operators import population as pop
from touchline.operators.options import KEYS
from touchline.plans.ordered import previous_row
from touchline.sources import testtables as tt

# Frames of the test tables are about half an hour apart.
TOLERANCE = 1_800_000_000
BUCKET = 4 * TOLERANCE

ATTEMPT = """
attempt AS (
  SELECT match_id, event_id, pass_outcome, coalesce(player_targeted_id, '') AS target,
         CASE WHEN player_id <> '' THEN player_id ELSE coalesce(player_in_possession_id, '') END AS carrier,
         CAST(period AS INTEGER) AS period, CASE WHEN time_end <> 'bad' THEN CAST(true_us AS BIGINT) END AS t_us
  FROM vendor WHERE event_type = 'player_possession' AND pass_outcome <> '')
"""

DECIDED = f"""
decided AS (
  SELECT a.*, CASE WHEN a.t_us - f.t_us <= {TOLERANCE} THEN f.frame END AS frame,
         CASE WHEN a.t_us - f.t_us <= {TOLERANCE} THEN f.t_us END AS frame_clock
  FROM attempt a ASOF LEFT JOIN frame f
    ON a.match_id = f.match_id AND a.period = f.period AND a.t_us > f.t_us
  WHERE a.t_us IS NOT NULL AND a.period IN (1, 2))
"""

MOMENT = """
single AS (
  SELECT match_id, player_id, period, min(start_frame) AS s, max(end_frame) AS e FROM playing
  GROUP BY ALL HAVING count(*) = 1),
moment AS (
  SELECT d.match_id, d.event_id, d.period, d.frame, d.t_us, d.carrier, d.target, p.player_id, p.x, p.y, r.team_id,
         coalesce(d.frame BETWEEN g.s AND g.e, false) AS active, c.team_id AS carrier_team
  FROM decided d JOIN position p ON d.match_id = p.match_id AND d.period = p.period AND d.frame = p.frame
  JOIN roster r ON r.match_id = p.match_id AND r.player_id = p.player_id
  LEFT JOIN single g ON g.match_id = p.match_id AND g.player_id = p.player_id AND g.period = d.period
  LEFT JOIN roster c ON c.match_id = d.match_id AND c.player_id = d.carrier
  WHERE p.x IS NOT NULL AND p.y IS NOT NULL)
"""

FLOW = """
sets AS (
  SELECT match_id, event_id,
    count(*) FILTER (active AND team_id = carrier_team AND player_id <> carrier) AS n_candidates,
    count(*) FILTER (active AND team_id <> carrier_team) AS n_defenders,
    bool_or(player_id = target) AS target_tracked,
    bool_or(active AND team_id = carrier_team AND player_id <> carrier AND player_id = target) AS target_in,
    bool_or(player_id = carrier AND active) AS carrier_active
  FROM moment GROUP BY match_id, event_id),
flow AS (
  SELECT a.match_id, a.event_id, t.team_id AS target_team, c.team_id AS carrier_team, s.*  EXCLUDE (match_id, event_id),
    CASE WHEN target = '' OR t.team_id IS NULL OR target = carrier THEN 'missing_or_unusable_target'
      WHEN a.t_us IS NULL OR a.period NOT IN (1, 2) THEN 'invalid_event_or_transition'
      WHEN d.frame IS NULL THEN 'invalid_decision_frame'
      WHEN c.team_id IS NULL OR NOT coalesce(s.carrier_active, false)
        OR (CASE WHEN a.period = 1 THEN side1 ELSE side2 END) = 'unknown' THEN 'invalid_carrier'
      WHEN s.n_candidates = 0 THEN 'empty_candidate_set'
      WHEN s.n_defenders = 0 THEN 'empty_defender_set_or_geometry' END AS exclusion
  FROM attempt a
  LEFT JOIN roster t ON t.match_id = a.match_id AND t.player_id = a.target
  LEFT JOIN roster c ON c.match_id = a.match_id AND c.player_id = a.carrier
  LEFT JOIN matches m ON m.match_id = a.match_id
  LEFT JOIN (SELECT match_id, event_id, frame FROM decided WHERE frame IS NOT NULL) d ON d.match_id = a.match_id AND d.event_id = a.event_id
  LEFT JOIN sets s ON s.match_id = a.match_id AND s.event_id = a.event_id)
"""

DECISION = (TRACKING, ATTEMPT, DECIDED)
MOMENTS = (*DECISION, MOMENT)
FLOWS = (*MOMENTS, FLOW)


def attempts(spark, sf_dir):
    return pop.attempts_with_clock(tt.match_events(spark, sf_dir))


def decided(spark, sf_dir):
    return pop.decision_frames(attempts(spark, sf_dir), tt.tracking_frames(spark, sf_dir), TOLERANCE, BUCKET)


def moments(spark, sf_dir):
    carriers = tt.roster(spark, sf_dir).select(
        "match_id", F.col("player_id").alias("carrier"), F.col("team_id").alias("carrier_team")
    )
    facts = attempts(spark, sf_dir).select("match_id", "event_id", "carrier", "target")
    hits = decided(spark, sf_dir).where(F.col("frame").isNotNull()).join(facts, ["match_id", "event_id"])
    players = pop.moment_players(
        hits, tt.tracking_frames(spark, sf_dir), tt.roster(spark, sf_dir), tt.active_intervals(spark, sf_dir)
    )
    return players.join(carriers, ["match_id", "carrier"], "left")


def flow(spark, sf_dir):
    return pop.exclusion_waterfall(
        tt.match_events(spark, sf_dir), tt.tracking_frames(spark, sf_dir), tt.roster(spark, sf_dir),
        tt.active_intervals(spark, sf_dir), tt.matches(spark, sf_dir), TOLERANCE,
    )


@query(
    "jn01_decision_frame_asof",
    with_ctes(*DECISION) + "SELECT event_id, t_us, frame, frame_clock FROM decided",
)
def _(spark, sf_dir):
    return decided(spark, sf_dir).select("event_id", "t_us", "frame", "frame_clock")


@query(
    "jn02_frame_before_decision",
    with_ctes(*DECISION)
    + """, ordered AS (SELECT *, lag(frame) OVER w AS prior_frame, lag(t_us) OVER w AS prior_clock FROM frame
      WINDOW w AS (PARTITION BY match_id, period ORDER BY t_us))
    SELECT d.event_id, d.frame, o.prior_frame, d.frame_clock - o.prior_clock AS elapsed_us
    FROM decided d JOIN ordered o ON o.match_id = d.match_id AND o.period = d.period AND o.frame = d.frame""",
)
def _(spark, sf_dir):
    previous = pop.frames_with_previous(tt.tracking_frames(spark, sf_dir), BUCKET)
    keys = ["match_id", "period", "frame"]
    joined = decided(spark, sf_dir).where(F.col("frame").isNotNull()).drop("t_us").join(previous, keys)
    return joined.select(
        "event_id", "frame", F.col("previous.frame").alias("prior_frame"),
        (F.col("frame_clock") - F.col("previous.t_us")).alias("elapsed_us"),
    )


@query(
    "jn03_previous_frame_equijoin",
    with_ctes(*DECISION)
    + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY t_us) AS pos FROM frame)
    SELECT a.match_id || '/' || CAST(a.period AS VARCHAR) || '/' || CAST(a.pos AS VARCHAR) AS frame_key,
      CASE WHEN b.t_us IS NULL THEN 'unmatched' WHEN a.t_us - b.t_us <= 0 THEN 'noncausal'
        WHEN a.t_us - b.t_us > 1800000000 THEN 'over_tolerance' ELSE 'aligned' END AS class
    FROM ordered a LEFT JOIN ordered b ON a.match_id = b.match_id AND a.period = b.period AND b.pos = a.pos - 1""",
)
def _(spark, sf_dir):
    # Frame numbers of the test tables have gaps, so the position plays their part.
    index = bd.frame_index(tt.tracking_frames(spark, sf_dir), BUCKET)
    before = index.select(
        "match_id", "period", (F.col("pos") + 1).alias("pos"), F.col("t_us").alias("prior_us")
    )
    age = F.col("t_us") - F.col("prior_us")
    kind = (
        F.when(F.col("prior_us").isNull(), "unmatched").when(age <= 0, "noncausal")
        .when(age > TOLERANCE, "over_tolerance").otherwise("aligned")
    )
    return index.join(before, ["match_id", "period", "pos"], "left").select(
        F.concat_ws("/", "match_id", F.col("period").cast("string"), (F.col("pos") + 1).cast("string")).alias(
            "frame_key"
        ),
        kind.alias("class"),
    )


@query(
    "jn04_roster_lookup",
    with_ctes(*DECISION)
    + """SELECT a.event_id, c.team_id AS carrier_team, t.team_id AS target_team FROM attempt a
    LEFT JOIN roster c ON c.match_id = a.match_id AND c.player_id = a.carrier
    LEFT JOIN roster t ON t.match_id = a.match_id AND t.player_id = a.target""",
)
def _(spark, sf_dir):
    players = tt.roster(spark, sf_dir)
    team = lambda role: players.select(
        "match_id", F.col("player_id").alias(role), F.col("team_id").alias(f"{role}_team")
    )
    return (
        attempts(spark, sf_dir)
        .join(team("carrier"), ["match_id", "carrier"], "left")
        .join(team("target"), ["match_id", "target"], "left")
        .select("event_id", "carrier_team", "target_team")
    )


@query(
    "jn05_active_intervals",
    with_ctes(*MOMENTS) + "SELECT event_id, player_id, active FROM moment",
)
def _(spark, sf_dir):
    return moments(spark, sf_dir).select("event_id", "player_id", "active")


_SETS_SQL = """SELECT event_id, string_agg(player_id, ',' ORDER BY player_id) AS members FROM moment
    WHERE active AND {rule} GROUP BY event_id"""


@query(
    "jn06_candidate_sets",
    with_ctes(*MOMENTS) + _SETS_SQL.format(rule="team_id = carrier_team AND player_id <> carrier"),
)
def _(spark, sf_dir):
    rows = moments(spark, sf_dir).where(
        F.col("active") & (F.col("team_id") == F.col("carrier_team")) & (F.col("player_id") != F.col("carrier"))
    )
    return _members(rows)


@query(
    "jn07_defender_sets",
    with_ctes(*MOMENTS) + _SETS_SQL.format(rule="team_id <> carrier_team"),
)
def _(spark, sf_dir):
    return _members(moments(spark, sf_dir).where(F.col("active") & (F.col("team_id") != F.col("carrier_team"))))


def _members(rows):
    # One frame lists a squad at most once, so each list is short.
    listed = F.array_join(F.array_sort(F.collect_list("player_id")), ",")
    return rows.groupBy("match_id", "event_id").agg(listed.alias("members")).select("event_id", "members")


@query(
    "jn11_wanted_events",
    with_ctes(*DECISION)
    + """SELECT (SELECT count(*) FROM vendor WHERE event_id IN (SELECT event_id FROM attempt)) AS found,
    (SELECT count(*) FROM attempt WHERE event_id NOT IN (SELECT event_id FROM vendor)) AS missing, 0 AS repeated""",
)
def _(spark, sf_dir):
    from touchline.operators.quality import recovered

    return recovered(tt.match_events(spark, sf_dir), attempts(spark, sf_dir), ["match_id", "event_id"])


@query(
    "jn12_unresolved_identities",
    with_ctes(*DECISION)
    + """SELECT 'tracked' AS source, count(*) AS unresolved FROM position p ANTI JOIN roster r USING (match_id, player_id)
    UNION ALL SELECT 'target', count(*) FROM (SELECT match_id, target AS player_id FROM attempt WHERE target <> '') ANTI JOIN roster USING (match_id, player_id)""",
)
def _(spark, sf_dir):
    keys = ["match_id", "player_id"]
    known = tt.roster(spark, sf_dir).select(*keys)
    tracked = pop.position_rows(tt.tracking_frames(spark, sf_dir)).select(*keys)
    aimed = attempts(spark, sf_dir).where("target <> ''").select("match_id", F.col("target").alias("player_id"))
    side = lambda df, name: df.join(known, keys, "left_anti").groupBy().agg(
        F.lit(name).alias("source"), F.count(F.lit(1)).alias("unresolved")
    )
    return side(tracked, "tracked").unionByName(side(aimed, "target"))


@query(
    "jn13_unique_links",
    """WITH linked AS (SELECT o_orderkey, o_custkey AS link FROM orders),
    resolved AS (SELECT c_nationkey AS link, count(*) AS n, min(c_custkey) AS target FROM customer GROUP BY c_nationkey)
    SELECT o_orderkey, CASE WHEN n = 1 THEN target END AS target,
      CASE WHEN n > 1 THEN 'ambiguous_link' WHEN n IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
    FROM linked LEFT JOIN resolved USING (link)""",
)
def _(spark, sf_dir):
    from touchline.operators.quality import resolve_links

    orders = tt.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("link"))
    targets = tt.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("link"), F.col("c_custkey").alias("target")
    )
    return resolve_links(orders, targets, "link", "target").select("o_orderkey", "target", "status")


_INDEXED = """
indexed AS (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY t_us) - 1 AS pos FROM frame),
centred AS (SELECT d.event_id, d.match_id, d.period, i.pos, i.t_us AS centre FROM decided d JOIN indexed i
  ON i.match_id = d.match_id AND i.period = d.period AND i.frame = d.frame),
near AS (SELECT c.event_id, i.match_id, i.period, i.pos, i.frame, i.t_us, c.pos AS centre_pos FROM centred c JOIN indexed i
  ON i.match_id = c.match_id AND i.period = c.period AND abs(i.pos - c.pos) <= 2 AND abs(i.t_us - c.centre) <= 3600000000)
"""


def windows_around(spark, sf_dir):
    index = bd.frame_index(tt.tracking_frames(spark, sf_dir), BUCKET)
    centres = decided(spark, sf_dir).where(F.col("frame").isNotNull()).select(
        "match_id", "period", "frame", "event_id"
    ).join(index, ["match_id", "period", "frame"])
    return bd.neighbours(index, centres, 2 * TOLERANCE)


@query(
    "jn14_neighbour_frames",
    with_ctes(*DECISION, _INDEXED) + "SELECT event_id, frame, CAST(pos AS BIGINT) AS pos FROM near",
)
def _(spark, sf_dir):
    return windows_around(spark, sf_dir).select("event_id", "frame", "pos")


@query(
    "jn15_pitch_verification",
    with_ctes(STATE, CANDIDATE, PITCH)
    + """, native AS (SELECT *, CASE WHEN k % 83 = 7 THEN 0.5e0 - rx ELSE -rx END AS nx, CASE WHEN match_id = '4' THEN len + 1 ELSE len END AS declared
      FROM candidate JOIN pitch USING (match_id))
    SELECT event_id, id, CASE WHEN declared <> len THEN 'pitch_size_mismatch' WHEN rx <> -nx THEN 'transformation_defect'
    WHEN abs(rx) - len / 2 <= 0 THEN 'dimension_join_defect' ELSE 'verified' END AS status FROM native""",
)
def _(spark, sf_dir):
    from touchline.operators.options import candidate_rows

    # A team attacking left has its points turned around in the files. Some native points are moved, one match's size is wrong.
    rows = candidate_rows(tt.states(spark, sf_dir)).join(tt.pitches(spark, sf_dir), "match_id")
    moved = F.when(F.col("ordinal") % 83 == 7, 0.5 - F.col("rx")).otherwise(-F.col("rx"))
    declared = F.when(F.col("match_id") == "4", F.col("pitch_length") + 1).otherwise(F.col("pitch_length"))
    status = bd.verified_point(F.col("rx"), F.col("ry"), moved, F.col("ry"), F.lit(-1), F.col("pitch_length"), declared)
    return rows.select("event_id", "id", status.alias("status"))


@query(
    "flt02_exclusion_waterfall",
    with_ctes(*FLOWS) + "SELECT event_id, coalesce(exclusion, 'eligible') AS outcome FROM flow",
)
def _(spark, sf_dir):
    return flow(spark, sf_dir).select(
        "event_id", F.coalesce("exclusion", F.lit("eligible")).alias("outcome")
    )


@query(
    "flt03_target_outside_reason",
    with_ctes(*FLOWS)
    + """SELECT event_id, CASE WHEN target_team <> carrier_team THEN 'target_not_same_team'
    WHEN NOT coalesce(target_tracked, false) THEN 'target_missing_current_tracking'
    ELSE 'target_outside_verified_active_interval' END AS reason
    FROM flow WHERE exclusion IS NULL AND NOT coalesce(target_in, false)""",
)
def _(spark, sf_dir):
    return pop.outside_reason(flow(spark, sf_dir)).select("event_id", "reason")


_COUNTS = ", ".join(f"count(*) FILTER (exclusion = '{e}') AS {e}" for e in pop.EXCLUSIONS)


@query(
    "agg01_population_counters",
    with_ctes(*FLOWS)
    + f"""SELECT coalesce(match_id, 'total') AS match_id, count(*) AS attempts, {_COUNTS},
    count(*) FILTER (exclusion IS NULL) AS evaluation_eligible,
    count(*) FILTER (exclusion IS NULL AND coalesce(target_in, false)) AS fit_eligible,
    count(*) FILTER (exclusion IS NULL AND NOT coalesce(target_in, false)) AS target_outside
    FROM flow GROUP BY ROLLUP (match_id)""",
)
def _(spark, sf_dir):
    return pop.population_counters(flow(spark, sf_dir))


@query(
    "agg02_target_and_carrier_checks",
    with_ctes(*FLOWS)
    + """, judged AS (
      SELECT CASE WHEN a.target = '' THEN 'missing' WHEN a.target = a.carrier THEN 'self' WHEN f.target_team IS NULL THEN 'unresolved'
        WHEN f.exclusion = 'invalid_carrier' THEN 'not_assessed_invalid_state' WHEN f.exclusion IS NOT NULL THEN 'not_reached'
        WHEN f.target_team <> f.carrier_team THEN 'other_team'
        WHEN coalesce(f.target_in, false) THEN 'valid_current_state' WHEN NOT coalesce(f.target_tracked, false) THEN 'untracked'
        ELSE 'inactive' END AS status
      FROM attempt a JOIN flow f USING (match_id, event_id))
    SELECT status, count(*) AS attempts FROM judged GROUP BY status""",
)
def _(spark, sf_dir):
    return pop.target_checks(flow(spark, sf_dir))


@query(
    "agg02_carrier_checks",
    with_ctes(*FLOWS)
    + """, tracked AS (SELECT match_id, event_id, bool_or(player_id = carrier) AS seen FROM moment GROUP BY ALL),
    unplaced AS (SELECT d.match_id, d.event_id FROM decided d JOIN position p ON p.match_id = d.match_id AND p.period = d.period AND p.frame = d.frame
      AND p.player_id = d.carrier WHERE p.x IS NULL OR p.y IS NULL),
    judged AS (
      SELECT a.match_id, a.carrier, f.carrier_team, v.player_id = '' AND coalesce(v.player_in_possession_id, '') <> '' AS fallback,
        coalesce(f.exclusion = 'invalid_carrier', false) AND f.carrier_team IS NOT NULL AS judged, coalesce(t.seen, false) AS seen, coalesce(f.carrier_active, false) AS active,
        u.event_id IS NOT NULL AS unplaced
      FROM attempt a JOIN flow f USING (match_id, event_id) JOIN vendor v USING (match_id, event_id)
      LEFT JOIN tracked t ON t.match_id = a.match_id AND t.event_id = a.event_id LEFT JOIN unplaced u ON u.match_id = a.match_id AND u.event_id = a.event_id)
    SELECT match_id, count(*) FILTER (carrier = '') AS both_missing, count(*) FILTER (fallback) AS fallback_used,
      count(*) FILTER (carrier <> '' AND carrier_team IS NULL) AS selected_absent_roster, count(*) FILTER (judged AND NOT seen) AS selected_untracked,
      count(*) FILTER (judged AND seen AND NOT active) AS selected_inactive, count(*) FILTER (unplaced) AS nonfinite_coordinate FROM judged GROUP BY match_id""",
)
def _(spark, sf_dir):
    keys = ["match_id", "event_id"]
    fallback = tt.match_events(spark, sf_dir).select(
        *keys, ((F.coalesce("player_id", F.lit("")) == "") & (F.coalesce("player_in_possession_id", F.lit("")) != "")).alias("fallback")
    )
    placed = pop.position_rows(tt.tracking_frames(spark, sf_dir)).where("x IS NULL OR y IS NULL").select(
        "match_id", "period", "frame", F.col("player_id").alias("carrier"), F.lit(True).alias("unplaced")
    )
    facts = attempts(spark, sf_dir).select(*keys, "carrier")
    bare = decided(spark, sf_dir).join(facts, keys).join(placed, ["match_id", "period", "frame", "carrier"]).select(*keys, "unplaced")
    return pop.carrier_checks(flow(spark, sf_dir).join(fallback, keys).join(bare, keys, "left"))


@query(
    "agg03_identity_form_counts",
    with_ctes(EVENT)
    + """, ids AS (SELECT unnest(['player_id', 'player_in_possession_id', 'player_targeted_id']) AS scope,
      unnest([player_id, player_in_possession_id, player_targeted_id]) AS v FROM vendor)
    SELECT scope, CASE WHEN v IS NULL THEN 'null' WHEN v = '' THEN 'empty' ELSE 'ordinary' END AS form, count(*) AS n
    FROM ids GROUP BY ALL""",
)
def _(spark, sf_dir):
    from touchline.operators.quality import identity_form_counts

    return identity_form_counts(
        tt.match_events(spark, sf_dir), ["player_id", "player_in_possession_id", "player_targeted_id"]
    )


@query(
    "agg04_surplus_duplicates",
    """SELECT 'l_orderkey' AS scope, count(*) - count(DISTINCT l_orderkey) AS surplus FROM lineitem
    UNION ALL SELECT 'l_partkey', count(*) - count(DISTINCT l_partkey) FROM lineitem""",
)
def _(spark, sf_dir):
    from touchline.operators.quality import surplus_duplicates

    return surplus_duplicates(tt.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "agg05_count_summary",
    with_ctes(STATE)
    + """SELECT match_id, count(*) AS n, min(nc) AS minimum, median(nc) AS median, round(avg(nc), 6) AS mean, max(nc) AS maximum
    FROM state GROUP BY match_id""",
)
def _(spark, sf_dir):
    from touchline.operators.evaluation import count_summary

    sizes = tt.states(spark, sf_dir).select("match_id", F.size("candidates").cast("long").alias("n"))
    return count_summary(sizes, ["match_id"], "n").withColumn("mean", rounded(F.col("mean")))


@query(
    "agg45_tracking_profile",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT period, count(DISTINCT (match_id, frame)) AS frames, count(*) AS player_rows,
    count(*) FILTER (is_detected) AS detected, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y
    FROM position GROUP BY period""",
)
def _(spark, sf_dir):
    return pop.tracking_profile(tt.tracking_frames(spark, sf_dir))


@query(
    "agg45_step_and_cadence_histograms",
    with_ctes(EVENT, FRAME)
    + """, stepped AS (SELECT period, frame - lag(frame) OVER w AS step, t_us - lag(t_us) OVER w AS gap FROM frame WINDOW w AS (PARTITION BY match_id, period ORDER BY t_us))
    SELECT period, 'frame_step' AS kind, step AS value, count(*) AS frames FROM stepped WHERE step IS NOT NULL GROUP BY ALL
    UNION ALL SELECT period, 'cadence_minutes', gap // 60000000, count(*) FROM stepped WHERE gap IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = pop.frames_with_previous(tt.tracking_frames(spark, sf_dir), BUCKET).where("previous IS NOT NULL")
    gap = F.floor((F.col("t_us") - F.col("previous.t_us")) / 60_000_000)
    kinds = F.array(
        F.struct(F.lit("frame_step").alias("kind"), (F.col("frame") - F.col("previous.frame")).alias("value")),
        F.struct(F.lit("cadence_minutes").alias("kind"), gap.alias("value")),
    )
    return rows.select("period", F.inline(kinds)).groupBy("period", "kind", "value").agg(F.count(F.lit(1)).alias("frames"))


@query(
    "agg46_age_and_candidate_histograms",
    with_ctes(*FLOWS)
    + """SELECT 'age_minutes' AS kind, (t_us - frame_clock) // 60000000 AS value, count(*) AS attempts FROM decided WHERE frame IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'candidates', n_candidates, count(*) FROM flow WHERE exclusion IS NULL GROUP BY ALL
    UNION ALL SELECT 'defenders', n_defenders, count(*) FROM flow WHERE exclusion IS NULL GROUP BY ALL""",
)
def _(spark, sf_dir):
    ages = decided(spark, sf_dir).where(F.col("frame").isNotNull()).select(
        F.lit("age_minutes").alias("kind"), F.floor((F.col("t_us") - F.col("frame_clock")) / 60_000_000).alias("value")
    )
    sizes = flow(spark, sf_dir).where(F.col("exclusion").isNull()).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.size(n).cast("long").alias("value")) for n in ("candidates", "defenders")]))
    )
    return ages.unionByName(sizes).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("attempts"))


@query(
    "agg46_alignment_profile",
    with_ctes(*FLOWS)
    + """SELECT a.pass_outcome, count(*) AS attempts, count(*) FILTER (a.target <> '') AS with_target,
    count(d.frame) AS aligned, CAST(median(d.t_us - d.frame_clock) AS DOUBLE) AS median_age_us,
    count(*) FILTER (f.exclusion IS NULL AND coalesce(f.target_in, false)) AS target_in
    FROM attempt a JOIN flow f USING (match_id, event_id) LEFT JOIN decided d ON d.match_id = a.match_id AND d.event_id = a.event_id
    GROUP BY a.pass_outcome""",
)
def _(spark, sf_dir):
    keys = ["match_id", "event_id"]
    placed = flow(spark, sf_dir).select(
        *keys, (F.col("exclusion").isNull() & F.col("target_index").isNotNull()).alias("target_in")
    )
    ages = decided(spark, sf_dir).select(
        *keys, "frame", (F.col("t_us") - F.col("frame_clock")).cast("double").alias("age_us")
    )
    joined = attempts(spark, sf_dir).select(*keys, "pass_outcome", "target").join(placed, keys).join(ages, keys, "left")
    from touchline.plans.ordered import linear_quantiles

    counted = joined.groupBy("pass_outcome").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("target") != "").alias("with_target"),
        F.count("frame").alias("aligned"),
        F.count_if("target_in").alias("target_in"),
    )
    middle = linear_quantiles(joined, ["pass_outcome"], "age_us", (0.5,))
    return counted.join(middle.withColumnRenamed("q50", "median_age_us"), "pass_outcome", "left")


_REVIEW = """
points AS (
  SELECT event_id, match_id, 'carrier' AS role, cx AS x, len FROM state JOIN pitch USING (match_id) WHERE abs(cx) > len / 2
  UNION ALL SELECT event_id, match_id, 'candidate', rx, len FROM candidate JOIN pitch USING (match_id) WHERE abs(rx) > len / 2)
"""


@query(
    "agg47_boundary_review",
    with_ctes(STATE, CANDIDATE, PITCH, _REVIEW)
    + """SELECT role, CASE WHEN x > 0 THEN 'attacking_end' ELSE 'defending_end' END AS side, len AS pitch_length, count(*) AS occurrences,
    count(DISTINCT (match_id, event_id)) AS states, round(min(abs(x) - len / 2), 6) + 0e0 AS min_excess,
    round(max(abs(x) - len / 2), 6) + 0e0 AS max_excess FROM points GROUP BY ALL""",
)
def _(spark, sf_dir):
    points = bd.out_of_pitch_points(tt.states(spark, sf_dir), tt.pitches(spark, sf_dir))
    return points.groupBy("role", "side", "pitch_length").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.count_distinct("match_id", "event_id").alias("states"),
        rounded(F.min("excess")).alias("min_excess"),
        rounded(F.max("excess")).alias("max_excess"),
    )


LIMIT_METRES = 40
_OCCURRENCE = f"""
occurrence AS (SELECT m.match_id, m.period, m.event_id, m.player_id, m.frame, abs(m.x) - {LIMIT_METRES} AS excess, abs(m.y) > 30 AS wide,
    CASE WHEN p.is_detected IS NULL THEN 'unavailable' WHEN p.is_detected THEN 'detected' ELSE 'extrapolated' END AS status
  FROM moment m JOIN position p USING (match_id, period, frame, player_id) WHERE abs(m.x) > {LIMIT_METRES})
"""


def occurrences(spark, sf_dir):
    """Players beyond +-40 m in decision frames; a frame that decides several events gives several."""
    beyond = moments(spark, sf_dir).where(F.abs("x") > LIMIT_METRES)
    return pop.with_detections(beyond, tt.tracking_frames(spark, sf_dir)).select(
        "match_id", "period", "event_id", "player_id", "frame", (F.abs("x") - LIMIT_METRES).alias("excess"),
        (F.abs("y") > 30).alias("lateral"), sc.detection_status(F.col("is_detected")).alias("status"),
    )


@query(
    "agg47_excess_by_status",
    with_ctes(*MOMENTS, _OCCURRENCE)
    + """SELECT status, count(*) AS occurrences, count(*) FILTER (wide) AS lateral_crossings, round(min(excess), 6) + 0e0 AS minimum,
    round(median(excess), 6) + 0e0 AS median, round(max(excess), 6) + 0e0 AS maximum FROM occurrence GROUP BY status""",
)
def _(spark, sf_dir):
    from touchline.plans.ordered import linear_quantiles
    from touchline.session import cut_lineage

    rows = cut_lineage(occurrences(spark, sf_dir))
    counted = rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_if("lateral").alias("lateral_crossings"),
        F.min("excess").alias("minimum"), F.max("excess").alias("maximum"),
    )
    middle = linear_quantiles(rows, ["status"], "excess", (0.5,)).withColumnRenamed("q50", "median")
    return counted.join(middle, "status").withColumns({c: rounded(F.col(c)) for c in ("minimum", "median", "maximum")})


@query(
    "agg47_repeated_occurrences",
    with_ctes(*MOMENTS, _OCCURRENCE)
    + """, per_frame AS (SELECT match_id, period, player_id, frame, count(*) AS n FROM occurrence GROUP BY ALL),
    per_player AS (SELECT match_id, player_id, sum(n) AS n, count(*) AS frames FROM per_frame GROUP BY ALL)
    SELECT match_id, CAST(sum(n) AS BIGINT) AS occurrences, CAST(sum(frames) AS BIGINT) AS distinct_player_frames, CAST(sum(n) - sum(frames) AS BIGINT) AS repeated,
      count(*) AS players, count(*) FILTER (n > 1) AS players_with_repeats FROM per_player GROUP BY match_id""",
)
def _(spark, sf_dir):
    per_frame = occurrences(spark, sf_dir).groupBy("match_id", "period", "player_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    per_player = per_frame.groupBy("match_id", "player_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames"))
    return per_player.groupBy("match_id").agg(
        F.sum("n").alias("occurrences"), F.sum("frames").alias("distinct_player_frames"), (F.sum("n") - F.sum("frames")).alias("repeated"),
        F.count(F.lit(1)).alias("players"), F.count_if(F.col("n") > 1).alias("players_with_repeats"),
    )


@query(
    "agg47_overlapping_windows",
    with_ctes(*MOMENTS, _INDEXED, _OCCURRENCE)
    + """, span AS (SELECT event_id, match_id, period, min(pos) AS lo, max(pos) AS hi FROM near GROUP BY ALL),
    win AS (SELECT row_number() OVER () AS id, o.match_id, o.period, o.player_id, lo, hi FROM occurrence o JOIN span s USING (match_id, period, event_id)),
    pairs AS (SELECT a.match_id, count(*) AS n FROM win a JOIN win b ON a.match_id = b.match_id AND a.period = b.period AND a.player_id = b.player_id
      AND a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY a.match_id),
    own AS (SELECT match_id, count(*) AS windows, count(DISTINCT (period, player_id, lo, hi)) AS distinct_windows FROM win GROUP BY match_id)
    SELECT match_id, windows, distinct_windows, coalesce(n, 0) AS overlapping_pairs FROM own LEFT JOIN pairs USING (match_id)""",
)
def _(spark, sf_dir):
    from touchline.session import cut_lineage

    spans = bd.window_spans(windows_around(spark, sf_dir))
    windows = occurrences(spark, sf_dir).join(spans, ["match_id", "period", "event_id"]).select(*bd.SAMPLE_KEYS, "lo", "hi")
    return bd.overlap_counts(cut_lineage(windows))


@query(
    "agg65_array_size_profile",
    with_ctes(EDGES)
    + """SELECT s.match_id, count(*) AS states, min(nd) AS min_defenders, max(nd) AS max_defenders,
    count(DISTINCT nd) AS distinct_sizes, CAST(sum(degenerate) AS BIGINT) AS degenerate_edges
    FROM state s JOIN (SELECT k, count(*) FILTER (dist <= 1e-9) AS degenerate FROM edge GROUP BY k) USING (k) GROUP BY s.match_id""",
)
def _(spark, sf_dir):
    from touchline.operators.options import candidate_rows, pass_vector

    per_state = pass_vector(candidate_rows(tt.states(spark, sf_dir), "defenders")).groupBy(
        *KEYS, F.size("defenders").cast("long").alias("n")
    ).agg(F.count_if(F.col("distance") <= 1e-9).alias("degenerate"))
    return per_state.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("states"),
        F.min("n").alias("min_defenders"),
        F.max("n").alias("max_defenders"),
        F.count_distinct("n").alias("distinct_sizes"),
        F.sum("degenerate").alias("degenerate_edges"),
    )


@query(
    "win04_frame_steps",
    with_ctes(EVENT, FRAME)
    + """SELECT match_id, period, frame, frame - lag(frame) OVER w AS step, t_us - lag(t_us) OVER w AS cadence_us,
    coalesce(t_us > lag(t_us) OVER w, true) AS increasing FROM frame WINDOW w AS (PARTITION BY match_id, period ORDER BY t_us)""",
)
def _(spark, sf_dir):
    rows = pop.frames_with_previous(tt.tracking_frames(spark, sf_dir), BUCKET)
    return rows.select(
        "match_id", "period", "frame",
        (F.col("frame") - F.col("previous.frame")).alias("step"),
        (F.col("t_us") - F.col("previous.t_us")).alias("cadence_us"),
        F.coalesce(F.col("t_us") > F.col("previous.t_us"), F.lit(True)).alias("increasing"),
    )


def samples(spark, sf_dir):
    """Tracked samples with their frame position, side beyond +-40 m and detection status."""
    index = bd.frame_index(tt.tracking_frames(spark, sf_dir), BUCKET)
    rows = pop.tracked_positions(tt.tracking_frames(spark, sf_dir)).join(
        index.select("match_id", "period", "frame", "pos"), ["match_id", "period", "frame"]
    )
    return rows.select(
        "match_id", "period", "player_id", "pos", "frame",
        F.when(F.col("x") > 40, 1).when(F.col("x") < -40, -1).otherwise(0).alias("side"),
        sc.detection_status(F.col("is_detected")).alias("status"),
        (F.col("pos") % 50 == 0).alias("edge"),
    )


_SAMPLE = """
indexed AS (SELECT match_id, period, frame, row_number() OVER (PARTITION BY match_id, period ORDER BY t_us) - 1 AS pos FROM frame),
sample AS (
  SELECT p.match_id, p.period, p.player_id, i.pos, CASE WHEN x > 40 THEN 1 WHEN x < -40 THEN -1 ELSE 0 END AS side,
    CASE WHEN is_detected IS NULL THEN 'unavailable' WHEN is_detected THEN 'detected' ELSE 'extrapolated' END AS status,
    i.pos % 50 = 0 AS edge
  FROM position p JOIN indexed i USING (match_id, period, frame) WHERE x IS NOT NULL AND y IS NOT NULL)
"""


@query(
    "win05_outside_runs",
    with_ctes(EVENT, FRAME, POSITION, _SAMPLE)
    + """, island AS (
      SELECT *, pos - row_number() OVER (PARTITION BY match_id, period, player_id, side ORDER BY pos) AS grp FROM sample WHERE side <> 0),
    runs AS (SELECT count(*) AS n, bool_or(edge) AS censored FROM island GROUP BY match_id, period, player_id, side, grp)
    SELECT count(*) AS observed_runs, count(*) FILTER (censored) AS censored_runs, count(*) FILTER (n = 1) AS single_sample_runs FROM runs""",
)
def _(spark, sf_dir):
    return bd.run_summary(samples(spark, sf_dir))


@query(
    "win06_status_transitions",
    with_ctes(EVENT, FRAME, POSITION, _SAMPLE)
    + """SELECT b.status AS before_status, a.status AS after_status, count(*) AS transitions FROM sample a JOIN sample b
    ON a.match_id = b.match_id AND a.period = b.period AND a.player_id = b.player_id AND a.pos = b.pos + 1
    WHERE a.status <> b.status GROUP BY ALL""",
)
def _(spark, sf_dir):
    return bd.status_transitions(samples(spark, sf_dir)).groupBy(
        F.col("previous").alias("before_status"), F.col("status").alias("after_status")
    ).agg(F.count(F.lit(1)).alias("transitions"))


@query(
    "top04_first_frames",
    with_ctes(EVENT, FRAME)
    + """SELECT match_id, period, frame FROM (SELECT *, row_number() OVER (PARTITION BY match_id, period ORDER BY t_us) AS n FROM frame)
    WHERE n <= 300""",
)
def _(spark, sf_dir):
    index = bd.frame_index(tt.tracking_frames(spark, sf_dir), BUCKET)
    return index.where(F.col("pos") < 300).select("match_id", "period", "frame")


@query(
    "src13_frame_index",
    with_ctes(EVENT, FRAME)
    + """SELECT match_id, period, frame, t_us, row_number() OVER (PARTITION BY match_id, period ORDER BY t_us) - 1 AS pos FROM frame""",
)
def _(spark, sf_dir):
    return bd.frame_index(tt.tracking_frames(spark, sf_dir), BUCKET)


@query(
    "flt05_input_contract",
    with_ctes(TRACKING)
    + """SELECT 'carrier_conflict' AS rule, count(*) AS violations FROM vendor WHERE event_type = 'player_possession' AND pass_outcome <> ''
      AND player_id <> '' AND player_in_possession_id <> player_id
    UNION ALL SELECT 'duplicate_event', count(*) - count(DISTINCT (match_id, event_id)) FROM vendor
    UNION ALL SELECT 'duplicate_interval', count(*) FROM (SELECT 1 FROM playing GROUP BY match_id, player_id, period HAVING count(*) > 1)
    UNION ALL SELECT 'duplicate_roster', count(*) - count(DISTINCT (match_id, player_id)) FROM roster
    UNION ALL SELECT 'direction_unknown', count(*) FROM matches WHERE side1 = 'unknown' OR side2 = 'unknown'
    UNION ALL SELECT 'interval_order', count(*) FROM playing WHERE start_frame > end_frame
    UNION ALL SELECT 'roster_team', 0
    UNION ALL SELECT 'same_teams', 0
    UNION ALL SELECT 'clock_order', count(*) FROM (SELECT t_us <= lag(t_us) OVER (PARTITION BY match_id, period ORDER BY frame, t_us) AS bad FROM frame) WHERE bad
    UNION ALL SELECT 'tracking_identity', count(*) FROM (SELECT match_id, player_id FROM position) ANTI JOIN roster USING (match_id, player_id)""",
)
def _(spark, sf_dir):
    return pop.contract_violations(
        tt.match_events(spark, sf_dir), tt.tracking_frames(spark, sf_dir), tt.roster(spark, sf_dir),
        tt.active_intervals(spark, sf_dir), tt.matches(spark, sf_dir), BUCKET,
    )


@query(
    "set01_union_of_matches",
    with_ctes(STATE) + "SELECT match_id, count(*) AS states FROM state GROUP BY match_id",
)
def _(spark, sf_dir):
    from functools import reduce

    population = tt.states(spark, sf_dir)
    parts = [population.where(F.pmod(F.col("ordinal"), F.lit(3)) == part) for part in range(3)]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.groupBy("match_id").agg(F.count(F.lit(1)).alias("states"))


@query(
    "win10_target_index",
    with_ctes(STATE, CANDIDATE)
    + """SELECT event_id, id, CAST(row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS INTEGER) AS ordinal_by_id,
    target_index IS NOT NULL AND j = target_index AS is_target FROM candidate""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    from touchline.operators.options import candidate_rows

    rows = candidate_rows(tt.states(spark, sf_dir), "target_index")
    by_id = Window.partitionBy(*KEYS).orderBy("id")
    return rows.select(
        "event_id", "id", (F.row_number().over(by_id) - 1).alias("ordinal_by_id"),
        F.coalesce(F.col("ord") == F.col("target_index"), F.lit(False)).alias("is_target"),
    )
