"""Structured Streaming forms of the time-ordered operators; each has a batch twin.

A source ends with a closing row: no keys, and an event time beyond all others. It moves the watermark
past every open window and timer, so what the last rows opened is finished and its state freed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH, CLOSING = "2024-01-01 00:00:00", "2100-01-01 00:00:00"


def epoch_us() -> Column:
    return F.unix_micros(F.lit(EPOCH).cast("timestamp"))


def event_time(t_us: Column) -> Column:
    return F.timestamp_micros(epoch_us() + t_us)


def fields(text: str) -> T.StructType:
    """A schema from its text; needs the session, so processors make theirs when they are made."""
    return T._parse_datatype_string(text)


def closing_row(like: DataFrame, ts: str = "ts") -> DataFrame:
    """The row that ends a source: nulls and a time after all others."""
    fields = [F.lit(CLOSING if f.name == ts else None).cast(f.dataType).alias(f.name) for f in like.schema]
    return like.sparkSession.range(1).select(*fields)


# Lanes of a time bucket: the matches of a bucket share this many states, whatever their number.
BUCKET_LANES = 16


class TimeBucket(StatefulProcessor):
    """Holds the rows of one lane of a time bucket until no more can come, then resolves them.

    A timer at ``close_ms`` fires once the watermark has passed; ``resolve`` gets all rows by clock, with
    a number for each match and period, and the state is emptied. Matches share lanes, as a state and a timer for each of
    them cost more than its few rows; a busy match spreads over its buckets. A lane's state is never older than
    the bucket, its reach and the watermark's delay.
    """

    def __init__(self, columns: list[str], schema: T.StructType, resolve: Callable[[pd.DataFrame], pd.DataFrame]):
        self.columns, self.schema, self.resolve = columns, schema, resolve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        if not self.rows.exists():
            self.handle.registerTimer(int(batch["close_ms"].iloc[0]))
        # Whole numbers beside nulls reach pandas as floats, which a long of the state doesn't take.
        held = []
        for field in self.schema:
            kind = str if isinstance(field.dataType, T.StringType) else int
            column = batch[field.name]
            held.append([None if gone else kind(v) for v, gone in zip(column.tolist(), column.isna().tolist())])
        self.rows.appendList(list(zip(*held)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(list(self.rows.get()), columns=self.columns).sort_values("t_us", kind="stable", ignore_index=True)
        self.rows.clear()
        rows.insert(0, "group", rows.groupby(["match_id", "period"], dropna=False).ngroup())
        yield self.resolve(rows)

    def close(self) -> None:
        pass


BUCKET_ROWS = "match_id string, period int, t_us long, side string, event_id string, frame long"
BUCKET_COLUMNS = ["match_id", "period", "t_us", "side", "event_id", "frame"]


def watermarked(stream: DataFrame, delay: str) -> DataFrame:
    """The stream with its watermark, without the closing row: a filter on the event time stays above the watermark."""
    return stream.withWatermark("ts", delay).where(F.col("ts") < F.lit(CLOSING).cast("timestamp"))


def _by_bucket(asked: DataFrame, frames: DataFrame, delay: str, width_us: int, before_us: int, after_us: int) -> DataFrame:
    """Both streams as rows of time buckets; frames also go to the buckets that they are near to.

    A bucket needs the frames up to ``before_us`` before its start and ``after_us`` beyond its end.
    """
    bucket = lambda t: F.floor(t / width_us)
    none = lambda kind: F.lit(None).cast(kind)
    own = watermarked(asked, delay).select(
        "match_id", "period", bucket(F.col("t_us")).alias("bucket"), "ts", "t_us", F.lit("asked").alias("side"), "event_id", F.col("frame").cast("long").alias("frame")
    )
    t = F.col("t_us")
    wanted = F.when(t.isNull(), F.array(none("long"))).otherwise(F.sequence(bucket(t - after_us), bucket(t + before_us)))
    seen = watermarked(frames, delay).select(
        "match_id", "period", F.explode(wanted).alias("bucket"), "ts", "t_us", F.lit("frame").alias("side"), none("string").alias("event_id"), F.col("frame").cast("long").alias("frame")
    )
    closes = F.ceil((epoch_us() + (F.col("bucket") + 1) * width_us + after_us) / 1000)
    return own.unionByName(seen).withColumn("close_ms", closes)


def _in_buckets(rows: DataFrame, output: str, resolve: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    schema = fields(f"match_id string, period int, {output}")
    processor = TimeBucket(BUCKET_COLUMNS, fields(BUCKET_ROWS), resolve)
    lane = F.pmod(F.xxhash64("match_id", "period"), F.lit(BUCKET_LANES))
    return rows.withColumn("lane", lane).groupBy("bucket", "lane").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def decision_frames(events: DataFrame, frames: DataFrame, tolerance_us: int, width_us: int, delay: str) -> DataFrame:
    """(match_id, period, event_id, t_us, frame, frame_clock, status) for every event of the stream.

    The frame is the latest strictly earlier one, ``aligned`` if at most ``tolerance_us`` old; an
    event whose latest frame is older, or that has none, is an ``invalid_decision_frame`` without one.
    Both streams carry match_id, period, t_us and the event time ``ts``; events also event_id, frames
    also frame. The batch twin is ``plans.asof.asof_before``.
    """

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        seen, asked = rows[rows["side"] == "frame"], rows[rows["side"] == "asked"]
        frames = pd.DataFrame({"group": seen["group"], "t_us": seen["t_us"].astype("int64"), "at": np.arange(len(seen))})
        wanted = pd.DataFrame({"group": asked["group"], "t_us": asked["t_us"].astype("int64")})
        found = pd.merge_asof(wanted, frames, on="t_us", by="group", allow_exact_matches=False, tolerance=tolerance_us)
        at = found["at"].fillna(-1).to_numpy(np.int64)
        pick = lambda column: pd.array([seen[column].iloc[i] if i >= 0 else None for i in at], "Int64")
        return pd.DataFrame(
            {
                "match_id": asked["match_id"].to_numpy(), "period": asked["period"].to_numpy(),
                "event_id": asked["event_id"].to_numpy(), "t_us": asked["t_us"].to_numpy(np.int64),
                "frame": pick("frame"), "frame_clock": pick("t_us"),
                "status": np.where(at >= 0, "aligned", "invalid_decision_frame"),
            }
        )

    rows = _by_bucket(events.withColumn("frame", F.lit(None).cast("long")), frames, delay, width_us, tolerance_us, 0)
    return _in_buckets(rows, "event_id string, t_us long, frame long, frame_clock long, status string", resolve)


def neighbour_frames(centres: DataFrame, frames: DataFrame, positions: int, reach_us: int, width_us: int, delay: str) -> DataFrame:
    """(match_id, period, event_id, frame, step): frames around each centre, in order of clock.

    ``step`` counts frames from the centre's own, from -positions to positions; frames further than ``reach_us``
    from it are left out. A centre names its frame and that frame's clock. The batch twin is
    ``operators.boundary.neighbours``.
    """

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group", kind="stable")
        seen, asked = rows[rows["side"] == "frame"], rows[rows["side"] == "asked"]
        group, clocks, numbers = (seen[c].to_numpy(np.int64) for c in ("group", "t_us", "frame"))
        own = seen.assign(at=np.arange(len(seen))).drop_duplicates(["group", "t_us", "frame"])
        centres = asked.merge(own[["group", "t_us", "frame", "at"]], on=["group", "t_us", "frame"])
        at = np.repeat(centres["at"].to_numpy(np.int64), 2 * positions + 1)
        step = np.tile(np.arange(-positions, positions + 1), len(centres))
        which = np.repeat(np.arange(len(centres)), 2 * positions + 1)
        inside = (at + step >= 0) & (at + step < len(seen))
        at, step, which = at[inside], step[inside], which[inside]
        near = (group[at + step] == group[at]) & (np.abs(clocks[at + step] - clocks[at]) <= reach_us)
        at, step, which = at[near], step[near], which[near]
        taken = centres.iloc[which]
        return pd.DataFrame(
            {"match_id": taken["match_id"].to_numpy(), "period": taken["period"].to_numpy(), "event_id": taken["event_id"].to_numpy(), "frame": numbers[at + step], "step": step}
        )

    # A frame between two of a centre's neighbours is itself within reach, so steps counted in the bucket are the whole order's.
    rows = _by_bucket(centres, frames, delay, width_us, reach_us, reach_us)
    return _in_buckets(rows, "event_id string, frame long, step long", resolve)


def with_reason(frames: DataFrame) -> DataFrame:
    """Reasons that a frame row shows by itself."""
    return frames.withColumn(
        "outcome",
        F.when(F.col("period").isNull(), "ignored_non_playing_period")
        .when(~F.col("period").isin(1, 2), "unsupported_period")
        .when(F.col("t_us").isNull(), "unsupported_clock"),
    )


class RisingClock(StatefulProcessor):
    """Keeps the latest clock of one period of a match and judges every later frame by it."""

    def __init__(self, oldest_us: int):
        self.oldest_us, self.clock = oldest_us, fields("clock long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", self.clock)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        open_rows = batch["outcome"].isna().to_numpy()
        clocks = batch.loc[open_rows, "t_us"].to_numpy(np.int64)
        if len(clocks):
            first = self.latest.get()[0] if self.latest.exists() else np.iinfo(np.int64).min // 2
            highest = np.maximum.accumulate(np.append(first, clocks))
            behind = highest[:-1] - clocks
            outcomes = batch["outcome"].to_numpy(object)
            outcomes[open_rows] = np.where(behind < 0, "usable", np.where(behind > self.oldest_us, "too_old_frame", "non_monotone_clock"))
            batch = batch.assign(outcome=outcomes)
            self.latest.update((int(highest[-1]),))
        yield batch[["match_id", "period", "frame", "t_us", "arrival", "outcome"]]

    def close(self) -> None:
        pass


def judged_frames(frames: DataFrame, oldest_us: int) -> DataFrame:
    """Every frame of the stream with its outcome: ``usable``, or why it is rejected.

    ``arrival`` numbers the frames of a period in the order in which the source gives them. A clock that doesn't rise above
    all usable ones before is ``non_monotone_clock``, more than ``oldest_us`` behind ``too_old_frame``. Frames that
    are rejected by what they say themselves touch no clock and need no state.
    """
    output = "match_id string, period int, frame long, t_us long, arrival long, outcome string"
    rows = with_reason(frames).select("match_id", "period", "frame", "t_us", "arrival", "outcome")
    judged = rows.where(F.col("outcome").isNull()).groupBy("match_id", "period").transformWithStateInPandas(
        statefulProcessor=RisingClock(oldest_us), outputStructType=fields(output), outputMode="Append", timeMode="None"
    )
    return judged.unionByName(rows.where(F.col("outcome").isNotNull()))


def routed(good_path: str, reject_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink with a side output; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # judged once for both outputs
        try:
            usable = F.col("outcome") == "usable"
            batch.where(usable).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            batch.where(~usable).write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def tumbling_profile(positions: DataFrame, width: str, delay: str) -> DataFrame:
    """Player rows and detections per match and window."""
    return (
        watermarked(positions, delay)
        .groupBy(F.window("ts", width), "match_id")
        .agg(F.count(F.lit(1)).alias("player_rows"), F.count_if("is_detected").alias("detected"))
        .select("match_id", F.col("window.start").alias("window_start"), "player_rows", "detected")
    )


JOURNAL_OUTPUT = (
    "run long, state long, edges_started long, edges_completed long, violations long, gaps long, status string"
)
PLACES, TRANSITIONS = ["state", "sequence", "close_ms"], ["edge", "action"]
# A run's states are dealt to so many keys; a call to a key's state costs more than replaying its records.
LANES = 1024


def account_of(run: int, state: int, records: list[tuple]) -> tuple:
    """The final account of a state from its (sequence, edge, action) in order, each number once.

    An illegal transition counts as a violation, and after a failure every record is one.
    """
    edges: dict[str, str] = {}
    started = completed = violations = gaps = failed = 0
    upto = 0
    for sequence, edge, action in records:
        gaps += sequence - upto - 1
        upto = sequence
        known = edges.get(edge)
        if failed:
            violations += 1
        elif action == "started" and known is None:
            edges[edge] = "started"
            started += 1
        elif action == "completed" and known == "started":
            edges[edge] = "completed"
            completed += 1
        elif action == "failed" and known == "started":
            failed = 1
        else:
            violations += 1
    done = started > 0 and started == completed
    return run, state, started, completed, violations, gaps, "failure" if failed else "complete" if done else "unresolved"


class LifecycleReplay(StatefulProcessor):
    """Ordered start / complete / fail transitions of the states in one lane of a run.

    Records are numbered from 1 within their state and wait, in whatever order they come, until the state is closed; a
    repeated delivery counts once. ``waiting`` has the place of each record, ``edges`` its transition in the same order,
    ``counters`` the earliest closing. Its timer replays the states that are due across their gaps, gives their final
    accounts and keeps the others.
    """

    def __init__(self):
        self.shapes = [fields(shape) for shape in ("state long, sequence long, close_ms long", "edge string, action string", "close_ms long")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place, transition, closing = self.shapes
        self.waiting = handle.getListState("waiting", place)
        self.edges = handle.getListState("edges", transition)
        self.counters = handle.getValueState("counters", closing)

    def _wake(self, close_ms: int) -> None:
        self.handle.registerTimer(close_ms)
        self.counters.update((close_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["state", "sequence"], kind="stable")
        self.waiting.appendList(list(zip(*(batch[c].tolist() for c in PLACES))))
        self.edges.appendList(list(zip(*(batch[c].tolist() for c in TRANSITIONS))))
        earliest = int(batch["close_ms"].min())
        known = self.counters.get()[0] if self.counters.exists() else None
        if known is None or earliest < known:
            if known is not None:
                self.handle.deleteTimer(known)
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All that the watermark has passed: a timer set here for a time that is over may find no further batch.
        now = timerValues.getCurrentWatermarkInMs()
        states: dict[int, list[tuple]] = {}
        for place, transition in zip(list(self.waiting.get()), list(self.edges.get())):
            states.setdefault(place[0], []).append((*place, *transition))
        for held in (self.waiting, self.edges, self.counters):
            held.clear()
        # A state closes by the first record that was read of it.
        later = [rows for rows in states.values() if rows[0][2] > now]
        if later:
            self.waiting.put([row[:3] for rows in later for row in rows])
            self.edges.put([row[3:] for rows in later for row in rows])
            self._wake(min(rows[0][2] for rows in later))
        found = []
        for state, rows in states.items():
            if rows[0][2] <= now:
                first = {row[1]: (row[1], *row[3:]) for row in reversed(rows)}
                found.append(account_of(key[0], state, [first[n] for n in sorted(first)]))
        yield pd.DataFrame(found, columns=[part.split()[0] for part in JOURNAL_OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def replay_journal(journal: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Journal rows (run, state, edge, sequence, action, ts) -> one final account per state (append mode).

    A state is closed once the watermark is ``horizon`` beyond the first record that was read of it.
    """
    closes = F.unix_millis(F.col("ts") + F.expr(f"INTERVAL {horizon}"))
    timed = watermarked(journal, delay).withColumn("close_ms", closes)
    return timed.withColumn("lane", F.pmod(F.xxhash64("state"), F.lit(LANES))).groupBy("run", "lane").transformWithStateInPandas(
        statefulProcessor=LifecycleReplay(),
        outputStructType=fields(JOURNAL_OUTPUT),
        outputMode="Append",
        timeMode="EventTime",
    )


def use_rocksdb(spark: SparkSession) -> None:
    """The stateful processors need the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available now into a parquet folder and stop (append mode)."""
    writer = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    writer.format("parquet").option("path", path).start().awaitTermination()
