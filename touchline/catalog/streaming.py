"""Streaming operators, run over everything available and read back."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window, functions as F

from touchline.catalog.base import EVENT, FRAME, POSITION, query, with_ctes
from touchline.catalog.population import _INDEXED, BUCKET, DECISION, TOLERANCE, decided
from touchline.catalog.quality import fresh
from touchline.session import _WRITTEN, shared_folder
from touchline.sources import testtables as tt
from touchline.streaming import operators as st

DELAY = "10 minutes"


def source(spark, sf_dir, name, build, files=None):
    """A parquet folder written once and ended by a closing row, opened as a stream.

    The closing row is the folder's last file. ``files`` reads so many files a batch.
    """
    place = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    key = (spark.sparkContext.applicationId, f"{name}-{place}")
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}-{place}"
        rows = build()
        rows.write.mode("overwrite").parquet(path)
        st.closing_row(rows).write.mode("append").parquet(path)
        _WRITTEN[key] = path
    reader = spark.readStream.schema(spark.read.parquet(_WRITTEN[key]).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(_WRITTEN[key])


def frame_stream(spark, sf_dir):
    return source(
        spark, sf_dir, "stream_frames",
        lambda: tt.tracking_frames(spark, sf_dir).select("match_id", "period", "frame", "t_us", st.event_time(F.col("t_us")).alias("ts")),
    )


def event_stream(spark, sf_dir):
    from touchline.operators.population import attempts_with_clock

    def build():
        timed = attempts_with_clock(tt.match_events(spark, sf_dir)).where("t_us IS NOT NULL AND period IN (1, 2)")
        return timed.select("match_id", "period", "event_id", "t_us", st.event_time(F.col("t_us")).alias("ts"))

    return source(spark, sf_dir, "stream_events", build)


def finished(spark, stream, name):
    """Run a stream to its end and read what it wrote."""
    out = fresh(spark, name)
    st.run_available(stream, out, f"{out}-state")
    return spark.read.parquet(out)


@query(
    "stm01_streaming_decision_frames",
    with_ctes(*DECISION)
    + """SELECT event_id, t_us, frame, frame_clock, CASE WHEN frame IS NULL THEN 'invalid_decision_frame' ELSE 'aligned' END AS status
    FROM decided""",
)
def _(spark, sf_dir):
    st.use_rocksdb(spark)
    matched = st.decision_frames(event_stream(spark, sf_dir), frame_stream(spark, sf_dir), TOLERANCE, BUCKET, DELAY)
    return finished(spark, matched, "decisions").select("event_id", "t_us", "frame", "frame_clock", "status")


# Some frames come with a clock that is a little or far behind, or with none, or outside play.
OLDEST = 86_400_000_000


@query(
    "stm02_rejected_frames",
    with_ctes(EVENT, FRAME)
    + f""", noisy AS (SELECT match_id, frame, t_us AS arrival, CASE WHEN frame % 13 = 0 THEN NULL WHEN frame % 17 = 0 THEN 5 ELSE period END AS period,
        CASE WHEN frame % 19 = 0 THEN NULL WHEN frame % 23 = 0 THEN t_us - 7200000000 WHEN frame % 29 = 0 THEN t_us - 432000000000 ELSE t_us END AS clock FROM frame),
      reasoned AS (SELECT *, CASE WHEN period IS NULL THEN 'ignored_non_playing_period' WHEN period = 5 THEN 'unsupported_period'
        WHEN clock IS NULL THEN 'unsupported_clock' END AS reason FROM noisy),
      followed AS (SELECT *, max(CASE WHEN reason IS NULL THEN clock END) OVER (PARTITION BY match_id, period ORDER BY arrival
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM reasoned)
    SELECT match_id, frame, coalesce(reason, CASE WHEN highest IS NULL OR clock > highest THEN 'usable'
      WHEN highest - clock > {OLDEST} THEN 'too_old_frame' ELSE 'non_monotone_clock' END) AS outcome FROM followed""",
)
def _(spark, sf_dir):
    st.use_rocksdb(spark)
    good, bad = fresh(spark, "frames_good"), fresh(spark, "frames_rejected")
    n, t = F.col("frame"), F.col("t_us")
    noisy = frame_stream(spark, sf_dir).where("match_id IS NOT NULL").select(
        "match_id", "frame", t.alias("arrival"),
        F.when(n % 13 == 0, None).when(n % 17 == 0, 5).otherwise(F.col("period")).alias("period"),
        F.when(n % 19 == 0, None).when(n % 23 == 0, t - 7_200_000_000).when(n % 29 == 0, t - 432_000_000_000).otherwise(t).alias("t_us"),
    )
    run = st.judged_frames(noisy, OLDEST).writeStream.foreachBatch(st.routed(good, bad)).trigger(availableNow=True)
    run.option("checkpointLocation", f"{good}-state").start().awaitTermination()
    read = lambda path: spark.read.parquet(path).select("match_id", "frame", "outcome")
    return read(good).unionByName(read(bad))


def numbered_journal(spark, sf_dir):
    """The journal with a number for each record of a state; some records are lost, files are mixed."""
    from touchline.catalog.quality import lifecycle_journal

    order = F.when(F.col("action") == "started", 0).when(F.col("action") == "completed", 1).otherwise(2)
    records = lifecycle_journal(spark, sf_dir).where("action <> 'discovered'")
    number = F.row_number().over(Window.partitionBy("run", "state").orderBy(order, "edge"))  # an order has a few lines
    kept = records.withColumn("sequence", number.cast("long")).where("NOT (state % 53 = 0 AND sequence = 2)")
    return kept.withColumn("ts", st.event_time(F.col("sequence") * 1_000_000)).repartition(4, "edge", "sequence")


@query(
    "stm03_journal_replay",
    """WITH record AS (
      SELECT l_orderkey % 5 AS run, l_orderkey AS state, l_partkey || ':' || l_suppkey || ':' || l_linenumber AS edge,
        unnest(['started', CASE WHEN l_linestatus = 'F' THEN 'completed' END, CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN 'failed' END]) AS action
      FROM lineitem WHERE l_returnflag <> 'N'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY CASE action WHEN 'started' THEN 0 WHEN 'completed' THEN 1 ELSE 2 END, edge) AS sequence
      FROM record WHERE action IS NOT NULL),
    kept AS (SELECT * FROM numbered WHERE NOT (state % 53 = 0 AND sequence = 2)),
    edges AS (SELECT run, state, edge, bool_or(action = 'started') AS s, bool_or(action = 'completed') AS c, bool_or(action = 'failed') AS f FROM kept GROUP BY ALL),
    account AS (SELECT run, state, count(*) FILTER (s) AS started, count(*) FILTER (s AND c) AS completed, count(*) FILTER (c AND NOT s) AS orphans,
      count(*) FILTER (f) AS failures, bool_or(f AND s AND NOT c) AS failed FROM edges GROUP BY ALL),
    gap AS (SELECT state, max(sequence) - count(*) AS gaps FROM kept GROUP BY state)
    SELECT run, state, started AS edges_started, completed AS edges_completed, orphans + failures - CAST(failed AS INTEGER) AS violations, gaps,
      CASE WHEN failed THEN 'failure' WHEN started > 0 AND started = completed THEN 'complete' ELSE 'unresolved' END AS status
    FROM account JOIN gap USING (state)""",
)
def _(spark, sf_dir):
    st.use_rocksdb(spark)
    journal = source(spark, sf_dir, "stream_journal", lambda: numbered_journal(spark, sf_dir), files=2)
    return finished(spark, st.replay_journal(journal, "1 day", DELAY), "replay")


@query(
    "stm04_sliding_neighbourhood",
    with_ctes(*DECISION, _INDEXED) + "SELECT event_id, frame, CAST(pos - centre_pos AS BIGINT) AS step FROM near",
)
def _(spark, sf_dir):
    st.use_rocksdb(spark)

    def build():
        t = F.col("frame_clock")
        found = decided(spark, sf_dir).where(F.col("frame").isNotNull())
        return found.select("match_id", "period", "event_id", "frame", t.alias("t_us"), st.event_time(t).alias("ts"))

    centres = source(spark, sf_dir, "stream_centres", build)
    near = st.neighbour_frames(centres, frame_stream(spark, sf_dir), 2, 2 * TOLERANCE, BUCKET, DELAY)
    return finished(spark, near, "neighbours").select("event_id", "frame", "step")


@query(
    "stm05_tumbling_profile",
    with_ctes(EVENT, FRAME, POSITION)
    + """SELECT match_id, t_us // 3600000000 * 3600000000 + epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS window_us, count(*) AS player_rows,
      count(*) FILTER (is_detected) AS detected FROM position GROUP BY ALL""",
)
def _(spark, sf_dir):
    from touchline.operators.population import position_rows

    stream = source(
        spark, sf_dir, "stream_positions",
        lambda: position_rows(tt.tracking_frames(spark, sf_dir)).select("match_id", "is_detected", st.event_time(F.col("t_us")).alias("ts")),
    )
    rows = finished(spark, st.tumbling_profile(stream, "1 hour", DELAY), "profile")
    return rows.select("match_id", F.unix_micros("window_start").alias("window_us"), "player_rows", "detected")
