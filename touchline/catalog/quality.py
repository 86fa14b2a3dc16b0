"""Comparisons, checks, lineage, file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from touchline.catalog.base import (
    CANDIDATE, DEFENDER, EDGES, EVENT, FRAME, INTERVAL, POSITION, RANKS, ROSTER, SCORES, STATE, query, with_ctes,
)
from touchline.catalog.evaluation import CREDIT
from touchline.functions.scalars import rounded
from touchline.operators import options as op
from touchline.operators import quality as ql
from touchline.session import cut_lineage, shared_folder, written_once
from touchline.sources import files as fl
from touchline.sources import sinks as sk
from touchline.sources import testtables as tt


def fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def stored_text(spark, sf_dir, name, build):
    """Write text files once per application and return their folder."""
    from touchline.session import _WRITTEN

    key = (spark.sparkContext.applicationId, f"{name}|{sf_dir}")
    if key not in _WRITTEN:
        path = fresh(spark, name)
        build(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


@query(
    "jn16_record_set_comparison",
    """WITH l AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
    r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority
      FROM orders WHERE o_orderkey % 77 <> 3)
    SELECT count(*) AS records, count(*) FILTER (l.o_orderkey IS NULL OR r.o_orderkey IS NULL) AS one_sided,
      bool_and(l.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus) AS routing_equal,
      bool_and(l.o_totalprice IS NOT DISTINCT FROM r.o_totalprice AND l.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority) AS components_equal
    FROM l FULL JOIN r USING (o_orderkey)""",
)
def _(spark, sf_dir):
    left = tt.table(spark, sf_dir, "orders")
    changed = F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus"))
    right = left.where(F.col("o_orderkey") % 77 != 3).withColumn("o_orderstatus", changed)
    groups = {"routing": ["o_orderstatus"], "components": ["o_totalprice", "o_orderpriority"]}
    return ql.compare_records(left, right, ["o_orderkey"], groups)


def _document_pair(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    document = lambda price, status: F.to_json(
        F.struct(status.alias("status"), F.struct(price.alias("price"), F.array(price, price * 2).alias("steps")).alias("amounts"))
    )
    orders = tt.table(spark, sf_dir, "orders")
    left = orders.select(k, document(p, F.col("o_orderstatus")).alias("doc"))
    moved = F.when(k % 40 == 0, p + 0.5).otherwise(p)
    right = orders.select(k, document(moved, F.when(k % 90 == 0, "?").otherwise(F.col("o_orderstatus"))).alias("doc"))
    return left, right


_NESTED = """WITH priced AS (SELECT o_orderkey, o_totalprice AS p, o_totalprice + 5e-1 AS q FROM orders WHERE o_orderkey % 40 = 0),
found AS (
  SELECT o_orderkey, '$.amounts.price' AS path, abs(p - q) AS gap FROM priced
  UNION ALL SELECT o_orderkey, '$.amounts.steps[0]', abs(p - q) FROM priced
  UNION ALL SELECT o_orderkey, '$.amounts.steps[1]', abs(p * 2 - q * 2) FROM priced),
differences AS (
  SELECT o_orderkey, path, 'numeric_value' AS category, 'float' AS left_type, 'float' AS right_type, gap AS absolute_difference, false AS bits_equal FROM found
  UNION ALL SELECT o_orderkey, '$.status', 'scalar_value', 'string', 'string', NULL, NULL FROM orders WHERE o_orderkey % 90 = 0)
"""


@query("jn17_nested_exact_diff", _NESTED + "SELECT * FROM differences")
def _(spark, sf_dir):
    return ql.exact_differences(*_document_pair(spark, sf_dir), "o_orderkey", "doc")


@query(
    "agg59_difference_summary",
    _NESTED
    + """SELECT regexp_replace(path, '[[][0-9]+[]]', '[]') AS path, category, left_type, right_type, count(*) AS count,
      coalesce(bool_and(bits_equal), true) AS all_bits_equal, coalesce(max(absolute_difference), 0e0) AS maximum_difference
    FROM differences GROUP BY ALL""",
)
def _(spark, sf_dir):
    return ql.difference_summary(ql.exact_differences(*_document_pair(spark, sf_dir), "o_orderkey", "doc"))


@query(
    "set03_duplicate_states",
    """SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    rows = tt.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey")
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "set04_population_equality",
    """WITH a AS (SELECT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 2)
    SELECT 'left_only' AS side, count(*) AS rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT 'right_only', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def _(spark, sf_dir):
    rows = tt.table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return ql.same_multiset(rows.select(*keys), rows.where("l_quantity > 2").select(*keys))


@query(
    "set05_key_set_equality",
    """SELECT 'right' AS side, count(*) AS missing FROM (SELECT DISTINCT o_custkey AS k FROM orders) ANTI JOIN (SELECT c_custkey AS k FROM customer) USING (k)
    UNION ALL SELECT 'left', count(*) FROM (SELECT DISTINCT c_custkey AS k FROM customer) ANTI JOIN (SELECT o_custkey AS k FROM orders) USING (k)""",
)
def _(spark, sf_dir):
    left = tt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    right = tt.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return ql.key_set_gaps(left, right, ["k"])


@query(
    "set06_distinct_keys",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT count(DISTINCT player_id) AS players, count(DISTINCT (match_id, period, frame, player_id)) AS player_frames FROM position""",
)
def _(spark, sf_dir):
    from touchline.operators.population import position_rows

    # Two de-duplications on their own keys; neither collects a set.
    rows = position_rows(tt.tracking_frames(spark, sf_dir))
    count = lambda keys, name: rows.groupBy(*keys).agg(F.lit(1).alias("_")).groupBy().agg(F.count(F.lit(1)).alias(name))
    players = count(["player_id"], "players").withColumn("one", F.lit(1))
    frames = count(["match_id", "period", "frame", "player_id"], "player_frames").withColumn("one", F.lit(1))
    return players.join(frames, "one").drop("one")


@query(
    "set07_expected_count_gate",
    with_ctes(STATE)
    + """, counts AS (SELECT match_id, count(*) AS actual FROM state GROUP BY match_id),
    expected AS (SELECT CAST(c_custkey % 9 AS VARCHAR) AS match_id, count(*) * 10 AS n FROM customer GROUP BY c_custkey % 9)
    SELECT match_id, actual, n FROM counts FULL JOIN expected USING (match_id) WHERE coalesce(actual, 0) <> coalesce(n, 0)""",
)
def _(spark, sf_dir):
    expected = tt.table(spark, sf_dir, "customer").groupBy(
        (F.col("c_custkey") % 9).cast("string").alias("match_id")
    ).agg((F.count(F.lit(1)) * 10).alias("n"))
    return ql.count_gate(tt.states(spark, sf_dir), "match_id", expected)


_LINE = "match_id || '|' || event_id || '|' || coalesce(CAST(target_index AS VARCHAR), '-') || '|' || CAST(nc AS VARCHAR)"


def _tree_sql(source, line):
    sql = f"level0 AS (SELECT match_id, k AS o, {line} AS h FROM {source})"
    for i in range(4):
        sql += (
            f",\nlevel{i + 1} AS (SELECT match_id, o // 4096 AS o, sha256(string_agg(h, chr(10) ORDER BY o)) AS h "
            f"FROM level{i} GROUP BY match_id, o // 4096)"
        )
    return sql


@query(
    "snk02_population_freeze",
    with_ctes(STATE, _tree_sql("state", _LINE))
    + """SELECT match_id, count(*) AS states, count(target_index) AS fit_eligible, max(h) AS digest
    FROM state JOIN level4 USING (match_id) GROUP BY match_id""",
)
def _(spark, sf_dir):
    population = tt.states(spark, sf_dir)
    line = F.concat_ws(
        "|", "match_id", "event_id", F.coalesce(F.col("target_index").cast("string"), F.lit("-")),
        F.size("candidates").cast("string"),
    )
    counts = population.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("states"), F.count("target_index").alias("fit_eligible")
    )
    return counts.join(ql.ordered_digest(population, "match_id", "ordinal", line), "match_id")


# Rows of a digest are numbered by state and candidate; no state has more candidates than this.
CANDIDATES = 1 << 16
_FEATURE_ROW = ", ".join(["dist", "dx", "dy", "rd", "sd"])


@query(
    "agg60_feature_digest",
    with_ctes(EDGES, _tree_sql(f"(SELECT match_id, k * {CANDIDATES} + j AS k, {_FEATURE_ROW} FROM edge)", f"printf('%.6f,%.6f,%.6f,%.6f,%.6f', {_FEATURE_ROW})"))
    + "SELECT match_id, h AS digest FROM level4",
)
def _(spark, sf_dir):
    from touchline.sources.models import M1_FEATURES

    rows = op.edge_features(tt.states(spark, sf_dir))
    numbered = rows.withColumn("row", F.col("ordinal") * CANDIDATES + F.col("ord"))
    return ql.ordered_digest(numbered, "match_id", "row", F.format_string(",".join(["%.6f"] * 5), *[F.col(f) for f in M1_FEATURES]))


@query(
    "agg61_nesting_and_conservation",
    with_ctes(RANKS)
    + """, member AS (SELECT k, j, kind, nd, sum(greatest(0, least(last, 2) - first + 1) / (last - first + 1)) AS top2 FROM ranked GROUP BY ALL)
    SELECT count(*) AS edge_kinds, count(*) FILTER (abs(top2 - least(2, nd)) > 1e-9) AS conservation_breaks,
      (SELECT count(*) FROM edge JOIN (SELECT k, j, min(rdist) AS r, min(sdist) AS s FROM relation GROUP BY k, j) USING (k, j) WHERE r <> rd OR s <> sd) AS minimum_breaks,
      (SELECT count(*) FROM edge e JOIN candidate c USING (k, j) WHERE e.dx <> c.rx - c.cx OR e.dy <> c.ry - c.cy) AS nesting_breaks FROM member""",
)
def _(spark, sf_dir):
    from touchline.operators import relations as rel

    population = tt.states(spark, sf_dir)
    relations = rel.defender_relations(population)
    kept = relations.groupBy(*op.EDGE_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(rel.membership(kind, 2)).alias(f"{kind}_top2") for kind in rel.KINDS],
        *[F.min(f"{kind}_distance").alias(f"{kind}_min") for kind in rel.KINDS],
    )
    features = op.edge_features(population).select(
        *op.EDGE_KEYS, "nearest_receiver_defender_distance", "minimum_segment_defender_distance"
    )
    joined = kept.join(features, list(op.EDGE_KEYS))
    off = lambda kind: (F.abs(F.col(f"{kind}_top2") - F.least(F.lit(2), F.col("n"))) > 1e-9).cast("long")
    same = (F.col("receiver_min") == F.col("nearest_receiver_defender_distance")) & (
        F.col("segment_min") == F.col("minimum_segment_defender_distance")
    )
    # The first model's features stand by themselves; the others must carry them unchanged.
    names = ("distance", "longitudinal_displacement", "lateral_displacement")
    alone = op.pass_vector(op.candidate_rows(population)).select(*op.EDGE_KEYS, *[F.col(n).alias(f"own_{n}") for n in names])
    nested = op.edge_features(population).join(alone, list(op.EDGE_KEYS))
    apart = [~F.col(n).eqNullSafe(F.col(f"own_{n}")) for n in names]
    breaks = nested.agg(F.count_if(apart[0] | apart[1] | apart[2]).alias("nesting_breaks"))
    return joined.agg(
        (F.count(F.lit(1)) * 2).alias("edge_kinds"),
        (F.sum(off("receiver")) + F.sum(off("segment"))).alias("conservation_breaks"),
        F.count_if(~same).alias("minimum_breaks"),
    ).join(breaks)


def lifecycle_journal(spark, sf_dir):
    """run, state, edge, action records derived from order lines."""
    line = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    actions = F.array_compact(
        F.array(
            F.lit("discovered"),
            F.when(F.col("l_returnflag") != "N", F.lit("started")),
            F.when((F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "F"), F.lit("completed")),
            F.when((F.col("l_returnflag") != "N") & (F.col("l_linestatus") == "O") & (F.col("l_tax") == 0), F.lit("failed")),
        )
    )
    return tt.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5).alias("run"), F.col("l_orderkey").alias("state"), line.alias("edge"),
        F.explode(actions).alias("action"),
    )


_ACCOUNTS = """
piece AS (SELECT l_orderkey % 5 AS run, l_orderkey AS state, l_partkey, l_suppkey, l_linenumber,
  bool_or(l_returnflag <> 'N') AS started, bool_or(l_returnflag <> 'N' AND l_linestatus = 'F') AS completed,
  bool_or(l_returnflag <> 'N' AND l_linestatus = 'O' AND l_tax = 0) AS failed FROM lineitem GROUP BY ALL),
whole AS (SELECT run, state, count(*) AS d, count(*) FILTER (started) AS s, count(*) FILTER (completed) AS c, count(*) FILTER (failed) AS f FROM piece GROUP BY run, state),
accounts AS (SELECT run, count(*) AS states_discovered, count(*) FILTER (s > 0) AS states_evaluation_started, count(*) FILTER (c = d) AS states_completed,
  CAST(sum(d) AS BIGINT) AS edges_discovered, CAST(sum(s) AS BIGINT) AS edges_evaluation_started, CAST(sum(c) AS BIGINT) AS edges_completed, CAST(sum(f) AS BIGINT) AS edge_failures
  FROM whole GROUP BY run)
"""


@query("agg62_lifecycle_accounts", with_ctes(_ACCOUNTS) + "SELECT * FROM accounts")
def _(spark, sf_dir):
    return ql.lifecycle_accounts(lifecycle_journal(spark, sf_dir))


@query(
    "agg63_lifecycle_violations",
    with_ctes(_ACCOUNTS)
    + """SELECT run, 'edge_lifecycle_order' AS violation FROM accounts WHERE NOT (edges_completed <= edges_evaluation_started AND edges_evaluation_started <= edges_discovered)
    UNION ALL SELECT run, 'edge_terminal_count' FROM accounts WHERE edges_completed + edge_failures > edges_discovered
    UNION ALL SELECT run, 'state_lifecycle_order' FROM accounts WHERE states_completed > states_evaluation_started""",
)
def _(spark, sf_dir):
    return ql.lifecycle_violations(ql.lifecycle_accounts(lifecycle_journal(spark, sf_dir)))


@query(
    "agg64_distribution_sanity",
    """SELECT g, CASE g WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS violations
    FROM (SELECT DISTINCT l_linenumber AS g FROM lineitem)""",
)
def _(spark, sf_dir):
    from touchline.catalog.base import QUERIES

    # Three groups are spoilt: quantiles out of order, a mean outside the range, no rows.
    g = F.col("g")
    stats = QUERIES["agg21_weighted_distribution"](spark, sf_dir).withColumns(
        {
            "q25": F.when(g == 3, F.col("q75") + 1).otherwise(F.col("q25")),
            "mean": F.when(g == 5, F.col("maximum") * 2 + 1).otherwise(F.col("mean")),
            "count": F.when(g == 7, 0).otherwise(F.col("count")),
        }
    )
    bad = ql.distribution_violations(stats, ["g"]).withColumn("bad", F.lit(1))
    return stats.join(bad, "g", "left").groupBy("g").agg(F.count("bad").alias("violations"))


_JOURNAL = """
line AS (SELECT o_orderkey AS k, o_orderkey // 1000 AS run, o_orderkey % 1000 AS sequence,
  'order:' || CAST(o_orderkey AS VARCHAR) || ':' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS line FROM orders),
journal AS (SELECT a.run, a.sequence, CASE WHEN a.sequence = 0 THEN NULL WHEN a.k % 211 = 5 THEN 'broken' ELSE sha256(b.line) END AS previous
  FROM line a LEFT JOIN line b ON b.k = a.k - 1 WHERE a.k % 307 <> 9)
"""


def chained_journal(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = tt.table(spark, sf_dir, "orders").select(
        k, F.floor(k / 1000).alias("run"), (k % 1000).alias("sequence"),
        F.concat(F.lit("order:"), k.cast("string"), F.lit(":"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("line"),
    )
    before = lines.select((k + 1).alias("o_orderkey"), F.sha2("line", 256).alias("hash"))
    previous = F.when(F.col("sequence") == 0, None).when(k % 211 == 5, "broken").otherwise(F.col("hash"))
    return lines.join(before, "o_orderkey", "left").withColumn("previous", previous).where(k % 307 != 9)


@query(
    "win14_hash_chain",
    with_ctes(_JOURNAL)
    + """SELECT run, sequence, CASE WHEN expected IS NULL THEN 'sequence_gap' ELSE 'hash_mismatch' END AS violation FROM (
      SELECT j.run, j.sequence, j.previous, sha256(l.line) AS expected, l.k AS lk FROM journal j
      LEFT JOIN (SELECT * FROM line WHERE k % 307 <> 9) l ON l.run = j.run AND l.sequence = j.sequence - 1 WHERE j.sequence > 0)
    WHERE lk IS NULL OR expected IS DISTINCT FROM previous""",
)
def _(spark, sf_dir):
    return ql.chain_violations(chained_journal(spark, sf_dir))


@query(
    "snk06_publication_leak_scan",
    r"""SELECT doc_id, rule FROM (
      SELECT doc_id, unnest(['seven_digit_identity', 'private_path', 'mail_address']) AS rule,
        unnest([regexp_matches(text, '\b\d{7}\b'), regexp_matches(text, '(/Users/|/home/|[A-Z]:\\)'),
          regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')]) AS hit FROM documents) WHERE hit""",
)
def _(spark, sf_dir):
    return sk.leak_scan(tt.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("snk01_canonical_lines")
def _(spark, sf_dir):
    return sk.canonical_lines(tt.states(spark, sf_dir))


def metric_rows(spark, sf_dir):
    from touchline.catalog.evaluation import credits
    from touchline.operators import evaluation as ev

    return ev.metric_rows(credits(spark, sf_dir))


@query(
    "snk03_metric_csv",
    with_ctes(SCORES, CREDIT)
    + """SELECT model, match_id, evaluation_eligible, round(mrr, 6) AS mrr, round(hit_at_1, 6) AS hit_at_1, round(hit_at_3, 6) AS hit_at_3
    FROM metric WHERE model IN ('m0', 'm1')""",
)
def _(spark, sf_dir):
    path = fresh(spark, "metrics")
    fields = ("model", "match_id", "evaluation_eligible", "mrr", "hit_at_1", "hit_at_3")
    sk.write_metric_csv(metric_rows(spark, sf_dir), path, fields)
    read = spark.read.csv(path, header=True, schema="model string, match_id string, evaluation_eligible long, mrr double, hit_at_1 double, hit_at_3 double")
    return read.withColumns({m: rounded(F.col(m)) for m in fields[3:]})


@query(
    "snk04_create_once",
    with_ctes(STATE) + "SELECT match_id, count(*) AS states, true AS written, false AS overwritten FROM state GROUP BY match_id",
)
def _(spark, sf_dir):
    path = fresh(spark, "closed")
    counts = tt.states(spark, sf_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("states"))
    first, second = sk.write_once(counts, path), sk.write_once(counts, path)
    return spark.read.parquet(path).withColumns({"written": F.lit(first), "overwritten": F.lit(second)})


def canonical_folder(spark, sf_dir):
    return stored_text(spark, sf_dir, "canonical", lambda p: sk.write_canonical(tt.stored_states(spark, sf_dir), p))


@query(
    "src04_choice_states",
    with_ctes(STATE, CANDIDATE)
    + """SELECT event_id, id, rx, ry, nd AS defenders, target_index, target_index IS NULL AS target_outside FROM candidate""",
)
def _(spark, sf_dir):
    rows = fl.choice_states(spark, canonical_folder(spark, sf_dir))
    return rows.select(
        "event_id", F.size("defenders").cast("long").alias("defenders"), "target_index", "target_outside", F.inline("candidates")
    ).withColumnsRenamed({"x": "rx", "y": "ry"})


@query(
    "src05_geometry_only_states",
    with_ctes(STATE) + "SELECT event_id, cx, cy, nc AS candidates, nd AS defenders FROM state",
)
def _(spark, sf_dir):
    rows = fl.geometry_states(spark, canonical_folder(spark, sf_dir))
    return rows.select(
        "event_id", F.col("carrier.x").alias("cx"), F.col("carrier.y").alias("cy"),
        F.size("candidates").cast("long").alias("candidates"), F.size("defenders").cast("long").alias("defenders"),
    )


def _documents(spark, sf_dir):
    """Match metadata documents as JSON text, one per match."""
    spans = tt.active_intervals(spark, sf_dir).groupBy("match_id", "player_id").agg(
        F.collect_list(
            F.struct(F.concat(F.lit("period_"), F.col("period").cast("string")).alias("name"), "start_frame", "end_frame")
        ).alias("by_period")
    )
    # A squad is 22 customers by construction of the roster.
    players = tt.roster(spark, sf_dir).join(spans, ["match_id", "player_id"]).groupBy("match_id").agg(
        F.collect_list(
            F.struct(F.col("player_id").alias("id"), "team_id", F.struct("by_period").alias("playing_time"))
        ).alias("players")
    )
    return tt.matches(spark, sf_dir).join(players, "match_id").select(
        F.to_json(
            F.struct(
                "match_id", F.struct(F.col("home_team_id").alias("id")).alias("home_team"),
                F.struct(F.col("away_team_id").alias("id")).alias("away_team"),
                F.col("home_side").alias("home_team_side"), "pitch_length", "pitch_width", "players",
                F.lit("not decoded").alias("venue"),
            )
        ).alias("value")
    )


def document_folder(spark, sf_dir):
    return stored_text(spark, sf_dir, "documents", lambda p: _documents(spark, sf_dir).write.text(p))


@query(
    "src01_match_metadata",
    with_ctes(ROSTER, INTERVAL)
    + "SELECT match_id, player_id, team_id, period, start_frame, end_frame FROM roster JOIN playing USING (match_id, player_id)",
)
def _(spark, sf_dir):
    documents = fl.match_documents(spark, document_folder(spark, sf_dir), one_per_file=False)
    return fl.roster_of(documents).join(fl.intervals_of(documents), ["match_id", "player_id"])


@query(
    "src02_event_csv",
    with_ctes(EVENT)
    + """SELECT match_id, event_id, event_type, nullif(pass_outcome, '') AS pass_outcome, period, time_end, nullif(player_id, '') AS player_id,
    player_in_possession_id, nullif(player_targeted_id, '') AS player_targeted_id FROM vendor""",
)
def _(spark, sf_dir):
    def build(path):
        # Two layouts in one folder: other order and one more column.
        events = tt.match_events(spark, sf_dir)
        wide = events.withColumn("unused_vendor_column", F.lit("x"))
        odd = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 1
        turned = ["unused_vendor_column", *reversed(events.columns)]
        for part in (events.where(~odd), wide.where(odd).select(*turned)):
            part.write.mode("append").option("header", True).option("emptyValue", "").csv(path)

    return fl.event_rows(spark, stored_text(spark, sf_dir, "events_csv", build))


@query(
    "src03_tracking_frames",
    with_ctes(EVENT, FRAME, POSITION) + "SELECT match_id, period, frame, t_us, player_id, x, y, is_detected FROM position",
)
def _(spark, sf_dir):
    from touchline.operators.population import position_rows

    def build(path):
        record = F.struct("match_id", "frame", "period", "timestamp", "player_data", F.lit(0).alias("ball"))
        tt.tracking_frames(spark, sf_dir).select(F.to_json(record).alias("value")).write.text(path)

    return position_rows(fl.tracking_frames(spark, stored_text(spark, sf_dir, "tracking_jsonl", build)))


@query(
    "src06_pitch_dimensions",
    """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN -1e0 WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 9 + 96 AS DOUBLE) END AS pitch_length,
    CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 <> 0 THEN 68e0 END AS pitch_width,
    CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'dimension_invalid' END AS reject FROM customer""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    document = (
        F.when(k % 11 == 0, F.lit('{"pitch_length": -1, "pitch_width": 68}'))
        .when(k % 13 == 0, F.lit('{"pitch_length": "long"}'))
        .otherwise(F.to_json(F.struct((k % 9 + 96).cast("double").alias("pitch_length"), F.lit(68.0).alias("pitch_width"))))
    )
    rows = tt.table(spark, sf_dir, "customer").select("c_custkey", document.alias("document"))
    return fl.pitch_dimensions(rows, "document").drop("document")


@query("src07_schema_inventory")
def _(spark, sf_dir):
    return fl.json_inventory(tt.table(spark, sf_dir, "events"), "props", "event_type")


@query(
    "src08_allow_list_scan",
    with_ctes(STATE)
    + "SELECT match_id, event_id FROM state WHERE match_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 0)",
)
def _(spark, sf_dir):
    allowed = tt.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(
        F.col("n_nationkey").cast("string").alias("match_id")
    )
    return fl.allowed_only(tt.states_by_match(spark, sf_dir), allowed).select("match_id", "event_id")


@query(
    "src08_row_local_study",
    with_ctes(STATE, CANDIDATE)
    + """SELECT match_id, event_id, count(*) AS candidates, round(max(sqrt((rx - cx) * (rx - cx) + (ry - cy) * (ry - cy))), 6) + 0e0 AS longest
    FROM candidate WHERE match_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 0) GROUP BY match_id, event_id""",
)
def _(spark, sf_dir):
    """A study per state of the permitted matches: pruned to their folders, grouped without an exchange."""
    allowed = tt.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("match_id"))
    return fl.candidate_spans(fl.allowed_only(tt.states_by_match(spark, sf_dir), F.broadcast(allowed))).withColumn("longest", rounded(F.col("longest")))


@query("src09_file_integrity")
def _(spark, sf_dir):
    # The manifest is taken from the files first; one entry is falsified and one added.
    found = fl.file_integrity(spark, sf_dir, spark.createDataFrame([], "name string, bytes long, sha256 string"))
    true_hash = F.when(F.col("name") == "orders.parquet", "0" * 64).otherwise(F.col("actual_sha256"))
    manifest = cut_lineage(found.select("name", F.col("actual_bytes").alias("bytes"), true_hash.alias("sha256")))
    extra = spark.createDataFrame([("absent.parquet", 1, "0" * 64)], "name string, bytes long, sha256 string")
    return fl.file_integrity(spark, sf_dir, manifest.unionByName(extra)).select("name", "actual_bytes", "blob_sha1", "status")
