"""Views of the generated test tables in the shapes the operators expect.

Every state is derived from one ``orders`` row, so its candidate and defender arrays
are bounded (at most 6 and 6). Tracking frames
and pass attempts come from ``events``, rosters and playing intervals from
``customer``. Repeated positions, degenerate edges, missing ids and malformed clocks
are planted by arithmetic so that every branch occurs at every scale.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.session import written_once

SQUAD = 22
PERIOD_SPLIT_DAY = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MAX_CANDIDATES = 6
MAX_DEFENDERS = 6


def _grid(value: Column, size: int) -> Column:
    return (value % size) / F.lit(100.0) - F.lit(size / 200.0)


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    place = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    return written_once(spark, f"{name}-{place}", lambda: build(spark, sf_dir))


def stored_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared population as it was written, for readers that take every state by itself."""
    return _stored(spark, sf_dir, "population", derived_states)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared population, hash-partitioned by the state keys.

    That partitioning is the only shuffle the in-state operators need. The number of
    partitions is the session's: a compact record grows many times over when exploded,
    so coalescing by its stored size would leave too few tasks.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored_states(spark, sf_dir).repartition(partitions, "match_id", "event_id", "ordinal")


def states_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared population as a table with a folder per match and buckets of the state keys."""
    from touchline.session import _WRITTEN, shared_folder
    from touchline.sources.sinks import write_by_match

    name = f"population_by_match_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}"
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        write_by_match(derived_states(spark, sf_dir), name, f"{shared_folder(spark)}/{name}", ["event_id", "ordinal"], partitions)
        _WRITTEN[key] = name
    return spark.table(name)


def derived_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, event_id, ordinal, carrier, candidates, defenders, target_index."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s, o = F.col("seed"), F.col("ordinal")
    base = (
        table(spark, sf_dir, "orders")
        .select(
            (c % 9).cast("string").alias("match_id"),
            k.cast("string").alias("event_id"),
            k.alias("ordinal"),
            (F.round(F.col("o_totalprice") * 100).cast("long") + k * 7919).alias("seed"),
        )
        .repartition("match_id", "event_id", "ordinal")
        .select(
            "*",
            (o % MAX_CANDIDATES + 1).cast("int").alias("n_candidates"),
            (F.floor(o / MAX_CANDIDATES) % MAX_DEFENDERS + 1).cast("int").alias("n_defenders"),
            _grid(s, 10500).alias("cx"),
            _grid(F.floor(s / 7), 6800).alias("cy"),
            F.floor(s / 3).alias("third"),
        )
    )
    cx, cy, third = F.col("cx"), F.col("cy"), F.col("third")
    near = lambda centre, value, size: centre + (value % size) / F.lit(100.0) - F.lit(size / 200.0)

    def candidate(j: int) -> Column:
        i = F.when(o % 5 == 0, 0).otherwise(1) if j == 1 else F.lit(j)
        x = near(cx, s * (i * 2 + 3) + (i + 1) * 104729, 3000)
        y = near(cy, s * (i * 3 + 5) + (i + 1) * 1299709, 2400)
        if j == 0:
            x, y = (F.when(o % 97 == 0, own).otherwise(v) for own, v in ((cx, x), (cy, y)))
        return F.struct(F.lit(f"P{j + 1:02d}").alias("id"), x.alias("x"), y.alias("y"))

    def defender(j: int) -> Column:
        i = F.when(o % 7 == 0, 0).otherwise(1) if j == 1 else F.lit(j)
        x = near(cx, third * (i * 2 + 5) + (i + 1) * 15485863, 4000)
        y = near(cy, third * (i * 4 + 3) + (i + 1) * 32452843, 3000)
        if j == 0:
            x, y = (F.when(o % 101 == 0, own).otherwise(v) for own, v in ((cx, x), (cy, y)))
        return F.struct(x.alias("x"), y.alias("y"))

    aim = (F.floor(o / 3) % (F.col("n_candidates") + 1)).cast("int")
    return base.select(
        "match_id",
        "event_id",
        "ordinal",
        F.struct(cx.alias("x"), cy.alias("y")).alias("carrier"),
        F.slice(F.array(*map(candidate, range(MAX_CANDIDATES))), F.lit(1), F.col("n_candidates")).alias(
            "candidates"
        ),
        F.slice(F.array(*map(defender, range(MAX_DEFENDERS))), F.lit(1), F.col("n_defenders")).alias(
            "defenders"
        ),
        F.when(aim < F.col("n_candidates"), aim).alias("target_index"),
    )


def _match_of(player: Column) -> Column:
    return F.floor(player / SQUAD)


def _clock(df: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    period = F.when(F.dayofmonth(ts) <= PERIOD_SPLIT_DAY, 1).otherwise(2)
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return df.withColumn("period", period).withColumn("t_us", F.unix_micros(ts) - start)


def _events(spark, sf_dir):
    return _clock(table(spark, sf_dir, "events")).withColumn("match_id", _match_of(F.col("user_id")))


def clock_text(t_us: Column) -> Column:
    """Microseconds as MM:SS.ffffff (minutes may exceed two digits)."""
    seconds = F.floor(t_us / 1_000_000)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat(
        two(F.floor(seconds / 60)), F.lit(":"), two(seconds % 60), F.lit("."),
        F.lpad((t_us % 1_000_000).cast("string"), 6, "0"),
    )


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as the vendor file stores them: nine text columns."""
    e, u = F.col("event_id"), F.col("user_id")
    attempt = F.col("event_type") == "purchase"
    text = lambda c: c.cast("string")
    target = F.col("match_id") * SQUAD + (e * 7) % 24
    return _events(spark, sf_dir).select(
        text(F.col("match_id")).alias("match_id"),
        text(e).alias("event_id"),
        F.when(attempt, "player_possession").otherwise("off_ball").alias("event_type"),
        F.when(attempt & (e % 17 == 0), "")
        .when(attempt & (e % 3 == 0), "unsuccessful")
        .when(attempt, "successful")
        .alias("pass_outcome"),
        F.when(e % 41 == 0, "3").otherwise(text(F.col("period"))).alias("period"),
        F.when(e % 23 == 0, "bad").otherwise(clock_text(F.col("t_us"))).alias("time_end"),
        F.when(e % 10 == 0, "").otherwise(text(u)).alias("player_id"),
        F.when(e % 6 == 0, None).when(e % 19 == 0, text(u + 1)).otherwise(text(u)).alias(
            "player_in_possession_id"
        ),
        F.when(e % 31 == 0, "").when(e % 37 == 0, None).otherwise(text(target)).alias(
            "player_targeted_id"
        ),
    )


def tracking_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "tracking", derived_frames)


def derived_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, period, frame, timestamp text, t_us, player_data (bounded to a squad)."""
    e = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("long")

    def player(j: Column) -> Column:
        return F.struct(
            (F.col("match_id") * SQUAD + j).cast("string").alias("player_id"),
            F.when((e + j) % 29 == 0, None).otherwise(_grid(e * 31 + j * 977 + cents, 11000)).alias("x"),
            _grid(e * 17 + j * 1409 + cents * 3, 7000).alias("y"),
            F.when((e + j) % 5 == 0, None).otherwise((e + j) % 5 != 1).alias("is_detected"),
        )

    squad = F.sequence(F.lit(0).cast("long"), F.lit(SQUAD - 1).cast("long"))
    present = F.filter(squad, lambda j: (e + j * 3) % 11 != 0)
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") != "purchase")
        .repartition("event_id")
        .select(
            F.col("match_id").cast("string").alias("match_id"),
            "period",
            F.floor(F.col("t_us") / 100_000).alias("frame"),
            clock_text(F.col("t_us")).alias("timestamp"),
            "t_us",
            F.transform(present, player).alias("player_data"),
        )
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        _match_of(c).cast("string").alias("match_id"),
        c.cast("string").alias("player_id"),
        (c % 2).cast("string").alias("team_id"),
    )


def active_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period intervals per player; some players have none, some have two."""
    c = F.col("c_custkey")
    last = 25_920_000
    interval = lambda period, start, end: F.struct(
        F.lit(period).alias("period"),
        start.cast("long").alias("start_frame"),
        end.cast("long").alias("end_frame"),
    )
    first_half = interval(1, (c % 5) * 1_000_000, F.lit(13_000_000) - (c % 3) * 2_000_000)
    second_half = interval(2, F.lit(12_000_000), F.lit(last))
    doubled = interval(1, F.lit(1_000_000), F.lit(2_000_000))
    listed = F.concat(
        F.array(first_half),
        F.when(c % 7 == 0, F.array().cast("array<struct<period:int,start_frame:bigint,end_frame:bigint>>"))
        .otherwise(F.array(second_half)),
        F.when(c % 13 == 0, F.array(doubled)).otherwise(
            F.array().cast("array<struct<period:int,start_frame:bigint,end_frame:bigint>>")
        ),
    )
    return table(spark, sf_dir, "customer").select(
        _match_of(c).cast("string").alias("match_id"),
        c.cast("string").alias("player_id"),
        F.inline(listed),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match: teams, home directions, pitch size."""
    m = F.col("m")
    side = lambda flip: F.when(m % 5 == 3, "unknown").when(m % 2 == flip, "left_to_right").otherwise(
        "right_to_left"
    )
    return (
        table(spark, sf_dir, "customer")
        .groupBy(_match_of(F.col("c_custkey")).alias("m"))
        .agg(F.count(F.lit(1)).alias("players"))
        .select(
            m.cast("string").alias("match_id"),
            F.lit("0").alias("home_team_id"),
            F.lit("1").alias("away_team_id"),
            F.array(side(0), side(1)).alias("home_side"),
            (m % 9 + 96).cast("double").alias("pitch_length"),
            (m % 4 + 64).cast("double").alias("pitch_width"),
        )
    )


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch size of the nine state matches, from ``nation``."""
    n = F.col("n_nationkey")
    return (
        table(spark, sf_dir, "nation")
        .groupBy((n % 9).cast("string").alias("match_id"))
        .agg((F.min(n) % 9 + 96).cast("double").alias("pitch_length"), F.lit(68.0).alias("pitch_width"))
    )
