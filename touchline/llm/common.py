"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.session import shared_folder


# Rows that a Python worker gets at once. Texts are long, and two workers and their batches share an
# executor's memory with its heap.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a read, not the computation before it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_clean_names(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator gives to its own results."""
    return df.drop(*[c for c in df.columns if c in names])


def unit_interval(*parts) -> "F.Column":
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(F.lit(p).cast("string") if not hasattr(p, "cast") else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
