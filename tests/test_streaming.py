"""Streams over small hand-made sources: several batches, late order, emptied state."""

import pytest
from pyspark.sql import functions as F

from touchline.streaming import operators as st


@pytest.fixture()
def stream_of(spark, tmp_path):
    """Files written one after the other and read one a batch, the closing row last."""
    st.use_rocksdb(spark)

    def build(name, schema, *files):
        path = f"{tmp_path}/{name}"
        for rows in files:
            frame = spark.createDataFrame(rows, schema).withColumn("ts", st.event_time(F.col("t_us")))
            frame.coalesce(1).write.mode("append").parquet(path)
        st.closing_row(frame).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return build


def run(spark, tmp_path, stream):
    st.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    return spark.read.parquet(f"{tmp_path}/out")


def left_in_state(spark, tmp_path, name):
    reader = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", name)
    return reader.load().count()


JOURNAL = "run long, state long, edge string, sequence long, action string, t_us long"


def test_journal_waits_for_early_records_and_frees_its_state(spark, tmp_path, stream_of):
    record = lambda state, n, edge, action: (1, state, edge, n, action, n)
    batches = [
        [record(1, 3, "a", "completed"), record(2, 2, "b", "failed"), record(3, 4, "z", "started")],
        [record(1, 2, "b", "started"), record(2, 3, "a", "completed"), record(1, 3, "a", "completed")],
        [record(1, 1, "a", "started"), record(1, 4, "b", "completed"), record(2, 1, "b", "started"), record(3, 1, "y", "completed")],
    ]
    found = run(spark, tmp_path, st.replay_journal(stream_of("journal", JOURNAL, *batches), "1 hour", "1 minute"))
    rows = {r["state"]: (r["status"], r["edges_started"], r["edges_completed"], r["violations"], r["gaps"]) for r in found.collect()}
    assert rows == {1: ("complete", 2, 2, 0, 0), 2: ("failure", 1, 0, 1, 0), 3: ("unresolved", 1, 0, 1, 2)}
    assert [left_in_state(spark, tmp_path, name) for name in ("counters", "edges", "waiting")] == [0, 0, 0]


def test_decision_frames_to_the_last_event(spark, tmp_path, stream_of):
    events = stream_of("events", "match_id string, period int, event_id string, t_us long", [("m", 1, "e1", 100), ("m", 1, "e2", 1_000)], [("m", 2, "e3", 5), ("m", 1, "e4", 1_990)])
    frames = stream_of("frames", "match_id string, period int, frame long, t_us long", [("m", 1, 7, 100), ("m", 1, 6, 95)], [("m", 1, 8, 999), ("m", 1, 9, 1_000), ("m", 1, 10, 1_900)])
    found = run(spark, tmp_path, st.decision_frames(events, frames, 200, 1_000, "1 second"))
    rows = {r["event_id"]: (r["frame"], r["frame_clock"], r["status"]) for r in found.collect()}
    none = (None, None, "invalid_decision_frame")
    assert rows == {"e1": (6, 95, "aligned"), "e2": (8, 999, "aligned"), "e3": none, "e4": (10, 1_900, "aligned")}
    assert left_in_state(spark, tmp_path, "rows") == 0


def test_matches_share_the_states_of_a_bucket(spark, tmp_path):
    st.use_rocksdb(spark)
    opened = {}
    for name, schema, rows in (
        ("events", "match_id string, period int, event_id string, t_us long", [(f"m{m}", m % 2, f"e{m}", 500 + m) for m in range(60)]),
        ("frames", "match_id string, period int, frame long, t_us long", [(f"m{m}", m % 2, 7, 400 + 2 * m) for m in range(60)]),
    ):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", st.event_time(F.col("t_us")))
        frame.write.parquet(f"{tmp_path}/{name}")
        opened[name] = lambda name=name, frame=frame: spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/{name}")
    # Without closing rows the bucket stays open: its 60 matches hold no more states than there are lanes.
    assert run(spark, tmp_path, st.decision_frames(opened["events"](), opened["frames"](), 90, 10_000, "1 second")).count() == 0
    held = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "rows").load()
    assert held.count() == 120 and held.select("key").distinct().count() <= 16
    for name, like in opened.items():
        st.closing_row(spark.read.parquet(f"{tmp_path}/{name}")).write.mode("append").parquet(f"{tmp_path}/{name}")
    rows = run(spark, tmp_path, st.decision_frames(opened["events"](), opened["frames"](), 90, 10_000, "1 second")).collect()
    expected = {f"e{m}": (f"m{m}", m % 2, 400 + 2 * m if 10 <= m else None) for m in range(60)}
    assert {r["event_id"]: (r["match_id"], r["period"], r["frame_clock"]) for r in rows} == expected


def test_neighbours_across_buckets(spark, tmp_path, stream_of):
    clocks = [10, 90, 100, 130, 400, 410]
    frames = stream_of("frames", "match_id string, period int, frame long, t_us long", [("m", 1, i, t) for i, t in enumerate(clocks)])
    centres = stream_of("centres", "match_id string, period int, event_id string, frame long, t_us long", [("m", 1, "a", 2, 100), ("m", 1, "b", 4, 400), ("m", 1, "c", 3, 131)])
    found = run(spark, tmp_path, st.neighbour_frames(centres, frames, 2, 50, 100, "1 second"))
    rows = sorted((r["event_id"], r["frame"], r["step"]) for r in found.collect())
    assert rows == [("a", 1, -1), ("a", 2, 0), ("a", 3, 1), ("b", 4, 0), ("b", 5, 1)]


def test_clocks_must_rise_across_batches(spark, tmp_path, stream_of):
    schema = "match_id string, period int, frame long, t_us long, arrival long"
    first = [("m", 1, 1, 100, 1), ("m", 1, 2, 50, 2), ("m", 1, 3, 200, 3), ("m", None, 4, 300, 4), ("m", 5, 5, 300, 5)]
    second = [("m", 1, 6, 200, 6), ("m", 1, 7, 201, 7), ("m", 2, 8, 1, 8), ("m", 1, 9, 20, 9)]
    stream = stream_of("frames", schema, first, second).where("match_id IS NOT NULL").select("match_id", "period", "frame", "t_us", "arrival")
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    writer = st.judged_frames(stream, 100).writeStream.foreachBatch(st.routed(good, bad)).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    outcome = lambda path: {r["frame"]: r["outcome"] for r in spark.read.parquet(path).collect()}
    assert set(outcome(good)) == {1, 3, 7, 8}
    assert outcome(bad) == {
        2: "non_monotone_clock", 4: "ignored_non_playing_period", 5: "unsupported_period", 6: "non_monotone_clock", 9: "too_old_frame",
    }


def test_states_of_a_lane_with_different_closings_all_close(spark, tmp_path, stream_of, monkeypatch):
    monkeypatch.setattr(st, "LANES", 1)
    rows = [(1, state, "a", 1, "started", state * 1_000_000) for state in range(1, 251)]
    found = run(spark, tmp_path, st.replay_journal(stream_of("journal", JOURNAL, rows), "1 hour", "1 minute"))
    assert sorted(r["state"] for r in found.collect()) == list(range(1, 251))


def test_states_of_a_lane_close_at_their_own_time(spark, tmp_path, stream_of, monkeypatch):
    """Many states share a key; one is closed and freed while others still wait."""
    hour = 3_600_000_000
    monkeypatch.setattr(st, "LANES", 1)
    record = lambda state, n, edge, action, hours: (1, state, edge, n, action, hours * hour)
    batches = [
        [record(7, 1, "a", "started", 0), record(8, 1, "a", "started", 5)],
        [record(9, 1, "a", "started", 5)],
        [record(9, 2, "a", "completed", 5)],
        [record(7, 1, "a", "started", 5), record(8, 2, "a", "completed", 5)],
    ]
    found = run(spark, tmp_path, st.replay_journal(stream_of("journal", JOURNAL, *batches), "1 hour", "1 minute"))
    rows = sorted((r["state"], r["status"], r["edges_started"], r["violations"], r["gaps"]) for r in found.collect())
    # State 7 is closed before its record comes again; that one opens a new account.
    assert rows == [(7, "unresolved", 1, 0, 0), (7, "unresolved", 1, 0, 0), (8, "complete", 1, 0, 0), (9, "complete", 1, 0, 0)]
    assert left_in_state(spark, tmp_path, "waiting") == 0


def test_frames_rejected_by_themselves_need_no_state(spark, tmp_path, stream_of):
    schema = "match_id string, period int, frame long, t_us long, arrival long"
    rows = [("m", None, i, i, i) for i in range(40)] + [("m", 5, i, i, i) for i in range(40, 80)] + [("m", 1, 90, 7, 90)]
    stream = stream_of("frames", schema, rows).where("match_id IS NOT NULL").select("match_id", "period", "frame", "t_us", "arrival")
    found = run(spark, tmp_path, st.judged_frames(stream, 100))
    assert sorted(r["outcome"] for r in found.collect()) == ["ignored_non_playing_period"] * 40 + ["unsupported_period"] * 40 + ["usable"]
    keys = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "latest").load()
    assert keys.count() == 1
