"""Layout by match, streamed file hashes, overlapping windows."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

import __spark_entry__ as driver
from touchline.operators import boundary as bd
from touchline.sources import files as fl
from touchline.sources import sinks as sk

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def files_read(df):
    df.collect()
    leaves, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.metrics().contains("numFiles"):
            leaves += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return leaves


def test_only_permitted_matches_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(str(i % 6), str(i), i, float(i)) for i in range(600)], "match_id string, event_id string, ordinal long, v double")
    table = sk.write_by_match(rows, "layout_test", f"{tmp_path}/t", ["event_id", "ordinal"], 4)
    lists = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1), ("4", 1)], "match_id string, part int")
    lists.write.parquet(f"{tmp_path}/lists")
    wanted = lambda part: spark.read.parquet(f"{tmp_path}/lists").where(f"part = {part}")
    one, three = (fl.allowed_only(table, F.broadcast(wanted(part))) for part in (0, 1))
    assert one.count() == 100 and three.count() == 300
    assert "dynamicpruning" in plan_of(one)
    whole = files_read(table.select("v"))
    assert whole == 24 and files_read(one.select("v")) - 1 <= 4 + 1 and files_read(three.select("v")) <= 12 + 2
    grouped = table.groupBy("match_id", "event_id", "ordinal").agg(F.sum("v"))
    assert "Exchange hashpartitioning" not in plan_of(grouped) and grouped.count() == 600


def test_row_local_study_has_no_exchange(spark):
    study = driver.queries()["src08_row_local_study"](spark, SF)
    assert "Exchange hashpartitioning" not in plan_of(study)


def test_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fl, "BLOCK_BYTES", 1000)
    contents = {"one.bin": b"x", "small.bin": b"abc", "large.bin": random.Random(3).randbytes(9_000_001)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    listed = spark.read.format("binaryFile").load(str(tmp_path))
    assert "content" not in plan_of(fl.file_hashes(listed)).split("ReadSchema")[1]
    absent = spark.createDataFrame([(f"file:{tmp_path}/gone.bin", 7), ("nosuchstore://x/y.bin", 1)], "path string, length long")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in fl.file_hashes(listed.select("path", "length").unionByName(absent)).collect()}
    for name, content in contents.items():
        blob = hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()
        assert (rows[name]["actual_sha256"], rows[name]["blob_sha1"], rows[name]["refused"]) == (hashlib.sha256(content).hexdigest(), blob, None)
    assert rows["gone.bin"]["refused"] and rows["y.bin"]["refused"] and rows["gone.bin"]["actual_sha256"] is None
    manifest = spark.createDataFrame([("small.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("large.bin", 5, "0"), ("other.bin", 1, "0")], "name string, bytes long, sha256 string")
    status = {r["name"]: r["status"] for r in fl.file_integrity(spark, str(tmp_path), manifest).collect()}
    assert status == {"small.bin": "verified", "large.bin": "mismatch", "one.bin": "unexpected", "other.bin": "missing"}


def test_overlapping_windows_against_every_pair(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        lo = rng.randrange(60)
        rows.append((str(rng.randrange(2)), rng.randrange(1, 3), str(rng.randrange(2)), lo, lo + rng.randrange(5)))
    rows += [("0", 1, "0", 7, 9)] * 30
    frame = spark.createDataFrame(rows, "match_id string, period int, player_id string, lo long, hi long")
    found = {r["match_id"]: (r["windows"], r["distinct_windows"], r["overlapping_pairs"]) for r in bd.overlap_counts(frame).collect()}
    for match in ("0", "1"):
        own = [r for r in rows if r[0] == match]
        pairs = sum(a[:3] == b[:3] and a[3] <= b[4] and b[3] <= a[4] for a, b in itertools.combinations(own, 2))
        assert found[match] == (len(own), len(set(own)), pairs)
    pairs = bd.overlapping_windows(frame).collect()
    assert len(pairs) == len({tuple(r) for r in pairs})
