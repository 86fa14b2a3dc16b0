"""Session defaults and the checkpoint folder used to cut long lineages."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | None = None, **overrides: str) -> SparkSession:
    """A session for one machine (tests and bench); clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("touchline")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        **overrides,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Clock arithmetic assumes UTC; the test tables hold zone-less timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach; set here only where unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the cluster's ``spark.checkpoint.dir``; a temporary one is made
    only where the session names none, as in tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: dict[tuple[str, str], str] = {}


def written_once(spark: SparkSession, name: str, build) -> DataFrame:
    """Write ``build()`` as parquet to the shared folder once per application and read it.

    A lost executor costs a re-read instead of a recomputation, and every later query
    scans plain records with column pruning.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/{name}"
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
