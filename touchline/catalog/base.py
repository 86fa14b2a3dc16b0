"""Query registry and the SQL twins of the test-table views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from touchline.session import pin_utc

            pin_utc(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def with_ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


STATE = """
seeded AS (
  SELECT o_orderkey AS k, CAST(o_custkey % 9 AS VARCHAR) AS match_id,
         CAST(o_orderkey AS VARCHAR) AS event_id,
         CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey * 7919 AS s,
         o_orderkey % 6 + 1 AS nc, (o_orderkey // 6) % 6 + 1 AS nd
  FROM orders),
state AS (
  SELECT *, (s % 10500) / 100e0 - 52.5e0 AS cx, ((s // 7) % 6800) / 100e0 - 34e0 AS cy,
         CASE WHEN (k // 3) % (nc + 1) < nc THEN CAST((k // 3) % (nc + 1) AS INTEGER) END AS target_index
  FROM seeded)
"""

CANDIDATE = """
candidate AS (
  SELECT k, match_id, event_id, s, nc, nd, cx, cy, target_index, j,
         'P' || lpad(CAST(j + 1 AS VARCHAR), 2, '0') AS id,
         CASE WHEN k % 97 = 0 AND j = 0 THEN cx
              ELSE cx + ((s * (i * 2 + 3) + (i + 1) * 104729) % 3000) / 100e0 - 15e0 END AS rx,
         CASE WHEN k % 97 = 0 AND j = 0 THEN cy
              ELSE cy + ((s * (i * 3 + 5) + (i + 1) * 1299709) % 2400) / 100e0 - 12e0 END AS ry
  FROM (SELECT *, CASE WHEN k % 5 = 0 AND j = 1 THEN 0 ELSE j END AS i
        FROM (SELECT *, unnest(range(nc)) AS j FROM state)))
"""

DEFENDER = """
defender AS (
  SELECT k, j AS d,
         CASE WHEN k % 101 = 0 AND j = 0 THEN cx
              ELSE cx + (((s // 3) * (i * 2 + 5) + (i + 1) * 15485863) % 4000) / 100e0 - 20e0 END AS px,
         CASE WHEN k % 101 = 0 AND j = 0 THEN cy
              ELSE cy + (((s // 3) * (i * 4 + 3) + (i + 1) * 32452843) % 3000) / 100e0 - 15e0 END AS py
  FROM (SELECT *, CASE WHEN k % 7 = 0 AND j = 1 THEN 0 ELSE j END AS i
        FROM (SELECT *, unnest(range(nd)) AS j FROM state)))
"""

# One row per candidate and defender with both distances.
RELATION = """
aimed AS (
  SELECT c.*, d.d, d.px, d.py, rx - cx AS vx, ry - cy AS vy
  FROM candidate c JOIN defender d USING (k)),
projected AS (
  SELECT *, CASE WHEN vx * vx + vy * vy <= 1e-18 THEN 0e0
    ELSE greatest(0e0, least(1e0, ((px - cx) * vx + (py - cy) * vy) / (vx * vx + vy * vy))) END AS t
  FROM aimed),
relation AS MATERIALIZED (
  SELECT *, sqrt((px - rx) * (px - rx) + (py - ry) * (py - ry)) AS rdist,
         sqrt((px - (cx + t * vx)) * (px - (cx + t * vx)) + (py - (cy + t * vy)) * (py - (cy + t * vy))) AS sdist
  FROM projected)
"""

# One row per candidate with the features of all three models.
EDGE = """
edge AS MATERIALIZED (
  SELECT k, match_id, event_id, j, id, nc, nd, target_index, cx, cy, rx, ry,
         rx - cx AS dx, ry - cy AS dy,
         sqrt((rx - cx) * (rx - cx) + (ry - cy) * (ry - cy)) AS dist,
         min(rdist) AS rd, min(sdist) AS sd, sum(exp(-sdist / 5e0)) AS att
  FROM relation
  GROUP BY ALL)
"""

EDGES = ",\n".join(x.strip() for x in (STATE, CANDIDATE, DEFENDER, RELATION, EDGE))

# Utilities, shares and tie blocks of the three demonstration models.
SCORED = """
utility AS (
  SELECT k, match_id, event_id, j, id, nc, target_index, 'm0' AS model,
         dist / 20e0 * -1e0 + dx / 20e0 * 0.35e0 + dy / 20e0 * 0e0 AS u, cx, rx FROM edge
  UNION ALL
  SELECT k, match_id, event_id, j, id, nc, target_index, 'm1',
         dist / 20e0 * -1e0 + dx / 20e0 * 0.35e0 + dy / 20e0 * 0e0 + rd / 10e0 * 0.6e0
         + sd / 10e0 * 1.2e0, cx, rx FROM edge
  UNION ALL
  SELECT k, match_id, event_id, j, id, nc, target_index, 'm2',
         dist / 20e0 * -1e0 + dx / 20e0 * 0.35e0 + dy / 20e0 * 0e0 + rd / 10e0 * 0.5e0
         + sd / 10e0 * 1e0 + att / 2e0 * -0.4e0, cx, rx FROM edge),
weighed AS (
  SELECT *, exp(u - max(u) OVER st) AS w,
         CASE WHEN lag(u) OVER (st ORDER BY u DESC, j) - u <= 1e-12 THEN 0 ELSE 1 END AS opens
  FROM utility WINDOW st AS (PARTITION BY model, k)),
blocked AS (
  SELECT *, w / sum(w) OVER (PARTITION BY model, k) AS share,
         sum(opens) OVER (PARTITION BY model, k ORDER BY u DESC, j ROWS UNBOUNDED PRECEDING) - 1 AS block
  FROM weighed),
scored AS MATERIALIZED (
  SELECT *, 1 + count(*) OVER (PARTITION BY model, k ORDER BY block
              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS first,
         count(*) OVER (PARTITION BY model, k ORDER BY block
              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM blocked)
"""

SCORES = EDGES + ",\n" + SCORED.strip()

# Per-state summary of every model.
SUMMARY = """
summary AS MATERIALIZED (
  SELECT k, match_id, event_id, model, nc, max(share) AS top_one_share,
         list_sum(list_slice(list_reverse_sort(list(share)), 1, 2)) AS top_two_share,
         sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) AS entropy,
         max(u) - min(u) AS utility_range,
         string_agg(CASE WHEN block = 0 THEN id END, ',' ORDER BY id) AS top_options
  FROM scored GROUP BY ALL)
"""

SUMMARIES = SCORES + ",\n" + SUMMARY.strip()

# Tie ranks of the defenders along each edge (two distance kinds, long form).
RANKED = """
kinds AS (
  SELECT k, match_id, j, id, d, nc, nd, 'receiver' AS kind, rdist AS dist FROM relation
  UNION ALL
  SELECT k, match_id, j, id, d, nc, nd, 'segment', sdist FROM relation),
opened AS (
  SELECT *, CASE WHEN dist - lag(dist) OVER (PARTITION BY kind, k, j ORDER BY dist, d) <= 1e-12
            THEN 0 ELSE 1 END AS opens FROM kinds),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY kind, k, j ORDER BY dist, d ROWS UNBOUNDED PRECEDING) - 1 AS block
  FROM opened),
ranked AS MATERIALIZED (
  SELECT *, 1 + count(*) OVER (PARTITION BY kind, k, j ORDER BY block
              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS first,
         count(*) OVER (PARTITION BY kind, k, j ORDER BY block
              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM numbered)
"""

RANKS = EDGES + ",\n" + RANKED.strip()

# Tracking, events, rosters.
EVENT = """
clocked AS (
  SELECT event_id AS e, user_id AS u, user_id // 22 AS m, event_type AS kind, value,
         CASE WHEN day(ts) <= 15 THEN 1 ELSE 2 END AS period,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS t_us
  FROM events),
vendor AS (
  SELECT CAST(m AS VARCHAR) AS match_id, CAST(e AS VARCHAR) AS event_id,
         CASE WHEN kind = 'purchase' THEN 'player_possession' ELSE 'off_ball' END AS event_type,
         CASE WHEN kind = 'purchase' THEN CASE WHEN e % 17 = 0 THEN '' WHEN e % 3 = 0 THEN 'unsuccessful'
              ELSE 'successful' END END AS pass_outcome,
         CASE WHEN e % 41 = 0 THEN '3' ELSE CAST(period AS VARCHAR) END AS period,
         CASE WHEN e % 23 = 0 THEN 'bad' ELSE
           CASE WHEN t_us // 60000000 < 10 THEN '0' ELSE '' END || CAST(t_us // 60000000 AS VARCHAR) || ':'
           || lpad(CAST((t_us // 1000000) % 60 AS VARCHAR), 2, '0') || '.'
           || lpad(CAST(t_us % 1000000 AS VARCHAR), 6, '0') END AS time_end,
         CASE WHEN e % 10 = 0 THEN '' ELSE CAST(u AS VARCHAR) END AS player_id,
         CASE WHEN e % 6 = 0 THEN NULL WHEN e % 19 = 0 THEN CAST(u + 1 AS VARCHAR)
              ELSE CAST(u AS VARCHAR) END AS player_in_possession_id,
         CASE WHEN e % 31 = 0 THEN '' WHEN e % 37 = 0 THEN NULL
              ELSE CAST(m * 22 + (e * 7) % 24 AS VARCHAR) END AS player_targeted_id,
         t_us AS true_us
  FROM clocked)
"""

FRAME = """
frame AS (
  SELECT CAST(m AS VARCHAR) AS match_id, m, e, period, t_us // 100000 AS frame, t_us, value
  FROM clocked WHERE kind <> 'purchase')
"""

POSITION = """
position AS (
  SELECT match_id, period, frame, t_us, CAST(m * 22 + j AS VARCHAR) AS player_id,
         CASE WHEN (e + j) % 29 = 0 THEN NULL ELSE
           ((e * 31 + j * 977 + CAST(round(value * 100) AS BIGINT)) % 11000) / 100e0 - 55e0 END AS x,
         ((e * 17 + j * 1409 + CAST(round(value * 100) AS BIGINT) * 3) % 7000) / 100e0 - 35e0 AS y,
         CASE WHEN (e + j) % 5 = 0 THEN NULL ELSE (e + j) % 5 <> 1 END AS is_detected
  FROM (SELECT *, unnest(range(22)) AS j FROM frame) WHERE (e + j * 3) % 11 <> 0)
"""

ROSTER = """
roster AS (
  SELECT CAST(c_custkey // 22 AS VARCHAR) AS match_id, CAST(c_custkey AS VARCHAR) AS player_id,
         CAST(c_custkey % 2 AS VARCHAR) AS team_id FROM customer)
"""

INTERVAL = """
playing AS (
  SELECT CAST(c_custkey // 22 AS VARCHAR) AS match_id, CAST(c_custkey AS VARCHAR) AS player_id, 1 AS period,
         (c_custkey % 5) * 1000000 AS start_frame, 13000000 - (c_custkey % 3) * 2000000 AS end_frame
  FROM customer
  UNION ALL
  SELECT CAST(c_custkey // 22 AS VARCHAR), CAST(c_custkey AS VARCHAR), 2, 12000000, 25920000
  FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL
  SELECT CAST(c_custkey // 22 AS VARCHAR), CAST(c_custkey AS VARCHAR), 1, 1000000, 2000000
  FROM customer WHERE c_custkey % 13 = 0)
"""

MATCH = """
matches AS (
  SELECT CAST(m AS VARCHAR) AS match_id, '0' AS home_team_id, '1' AS away_team_id,
         CASE WHEN m % 5 = 3 THEN 'unknown' WHEN m % 2 = 0 THEN 'left_to_right' ELSE 'right_to_left' END AS side1,
         CASE WHEN m % 5 = 3 THEN 'unknown' WHEN m % 2 = 1 THEN 'left_to_right' ELSE 'right_to_left' END AS side2,
         CAST(m % 9 + 96 AS DOUBLE) AS pitch_length, CAST(m % 4 + 64 AS DOUBLE) AS pitch_width
  FROM (SELECT DISTINCT c_custkey // 22 AS m FROM customer))
"""

TRACKING = ",\n".join(x.strip() for x in (EVENT, FRAME, POSITION, ROSTER, INTERVAL, MATCH))


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def units_sql(weight: str, partition: str) -> str:
    """Whole units of a weight, as many as 2^52 for the largest of the partition."""
    return f"CAST(floor({weight} / max({weight}) OVER (PARTITION BY {partition}) * 4503599627370496e0) AS HUGEINT)"


def reached_sql(q: float) -> str:
    return f"(cum + 2 * rows_) * 10000 >= total * {round(q * 10000)}"


def quantiles_sql(form: str = "{}") -> str:
    return ", ".join(form.format(f"min(CASE WHEN {reached_sql(q)} THEN v END)") + f" AS q{round(q * 100):02d}" for q in QUANTILES)


def macro_summary_sql(source: str, keys: list[str], value: str = "value") -> str:
    """CTEs ``weighted``/``macro_rows``: per match and macro rows of ``source``.

    ``source`` is a CTE name with the keys, ``match_id`` and ``value``.
    """
    ks = ", ".join(keys)
    return f"""
sized AS (
  SELECT {ks}, match_id AS alias, {value} AS v, count(*) OVER (PARTITION BY {ks}, match_id) AS n
  FROM {source} WHERE {value} IS NOT NULL),
represented AS (SELECT {ks}, count(DISTINCT alias) AS r FROM sized GROUP BY {ks}),
weighted AS (
  SELECT {ks}, alias, v, 1e0 AS w, 1 AS r FROM sized
  UNION ALL
  SELECT {ks}, 'macro', v, 1e0 / r / n, r FROM sized JOIN represented USING ({ks})),
counted AS (SELECT *, {units_sql("w", ks + ", alias")} AS units FROM weighted),
cumulated AS (
  SELECT *, sum(units) OVER (PARTITION BY {ks}, alias ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum,
         sum(units) OVER (PARTITION BY {ks}, alias) AS total, count(*) OVER (PARTITION BY {ks}, alias) AS rows_
  FROM counted),
macro_rows AS (
  SELECT {ks}, alias, max(r) AS represented_matches, count(*) AS count, sum(v * w) / sum(w) AS mean,
         min(v) AS minimum, max(v) AS maximum, {quantiles_sql()}
  FROM cumulated GROUP BY {ks}, alias)
""".strip()


ROUNDED_STATS = ", ".join(
    f"round({c}, 6) + 0e0 AS {c}"
    for c in ("mean", "minimum", "maximum", "q05", "q25", "q50", "q75", "q95")
)
STAT_COLUMNS = ["mean", "minimum", "maximum", "q05", "q25", "q50", "q75", "q95"]
