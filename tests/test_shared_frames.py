"""Clocks less than a frame apart share a frame number; the queries on frames still equal their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """The smallest tables; every third event comes again 20 ms later, every fifth 40 ms earlier."""
    from check import TABLES

    folder = tmp_path_factory.mktemp("doubled")
    for name in TABLES:
        if name != "events":
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    again = lambda shift, ms, every: (
        f"SELECT * REPLACE (event_id + {shift} AS event_id, ts + INTERVAL ({ms}) MILLISECOND AS ts) FROM '{SF}/events.parquet' WHERE event_id % {every} = 0"
    )
    rows = f"SELECT * FROM '{SF}/events.parquet' UNION ALL {again(1_000_000, 20, 3)} UNION ALL {again(2_000_000, -40, 5)}"
    duckdb.sql(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "agg31_detection_provenance", "agg45_tracking_profile", "agg47_excess_by_status", "agg47_overlapping_windows",
        "agg47_repeated_occurrences", "flt05_input_contract", "win05_outside_runs",
    ],
)
def test_shared_frames_equal_sql(spark, doubled, name):
    from check import TABLES, compare

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{doubled}/{table}.parquet'")
    message, _, good = compare(spark, con, name, driver.queries()[name], driver.oracle_sql()[name], doubled)
    assert good, message
