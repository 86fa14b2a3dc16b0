"""Readers for match documents, event files, tracking files and canonical states."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from touchline.functions import scalars as sc
from touchline.schemas import (
    CHOICE_RECORD, EVENT_FIELDS, GEOMETRY_RECORD, MATCH_DOCUMENT, TRACKING_FRAME,
)

# A layout of .../match_id=<id>/... gives every reader the partition column.
MATCH = T.StructField("match_id", T.StringType())


def _with_match(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, MATCH])


def match_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Nested metadata, one document per file (or per line); other fields are never decoded."""
    return spark.read.schema(_with_match(MATCH_DOCUMENT)).json(path, multiLine=one_per_file, mode="FAILFAST")


def roster_of(documents: DataFrame) -> DataFrame:
    return documents.select("match_id", F.explode("players").alias("p")).select(
        "match_id", F.col("p.id").alias("player_id"), F.col("p.team_id").alias("team_id")
    )


def intervals_of(documents: DataFrame) -> DataFrame:
    listed = documents.select("match_id", F.explode("players").alias("p")).select(
        "match_id", F.col("p.id").alias("player_id"), F.explode("p.playing_time.by_period").alias("i")
    )
    period = F.regexp_extract("i.name", r"^period_(\d+)$", 1).try_cast("int")
    return listed.select("match_id", "player_id", period.alias("period"), "i.start_frame", "i.end_frame")


def _headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Different header lines under ``path``, each with its files.

    The header is the line of a file's first split that names every wanted column.
    """
    names = F.split(F.regexp_replace("value", '[\ufeff"\\r]', ""), ",")
    complete = F.size(F.array_except(F.array(*map(F.lit, EVENT_FIELDS)), names)) == 0
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where("file_block_start = 0")
    by_file = lines.groupBy("file_path").agg(F.max(F.when(complete, F.col("value"))).alias("header"))
    groups = by_file.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).collect()
    for row in groups:
        if row["header"] is None:
            raise ValueError(f"event columns missing in {row['files'][:3]}")
    return [(row["header"], row["files"]) for row in groups]


def event_rows(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The permitted event columns as text, each file read by its own header line.

    Files are grouped by header, groups are read apart and united by name. A byte-order mark is
    ignored, a short row has nulls, and a header without a wanted column raises. Quoted line breaks
    need ``multi_line``, which makes every file one task.
    """
    found = None
    for _, files in _headers(spark, path):
        raw = spark.read.csv(files, header=True, encoding="UTF-8", multiLine=multi_line, mode="PERMISSIVE", enforceSchema=False)
        clean = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
        keep = [*(["match_id"] if "match_id" in clean.columns else []), *EVENT_FIELDS]
        part = clean.select(*[F.col(c).cast("string").alias(c) for c in keep])
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise ValueError("no event files")
    return found


def tracking_frames(spark: SparkSession, path: str) -> DataFrame:
    frames = spark.read.schema(_with_match(TRACKING_FRAME)).json(path, mode="FAILFAST")
    return frames.withColumn("t_us", sc.clock_microseconds(F.col("timestamp")))


def _as_states(records: DataFrame, label: bool) -> DataFrame:
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    candidates = F.transform(
        F.arrays_zip("candidate_ids", "candidate_xy"),
        lambda z: F.struct(
            z["candidate_ids"].alias("id"), z["candidate_xy"][0].alias("x"), z["candidate_xy"][1].alias("y")
        ),
    )
    kept = ["target_index", "target_outside"] if label else []
    return records.select(
        "match_id", "event_id", point(F.col("carrier_xy")).alias("carrier"), candidates.alias("candidates"),
        F.transform("defender_xy", point).alias("defenders"), *kept,
    )


def choice_states(spark: SparkSession, path: str) -> DataFrame:
    """Canonical labelled states."""
    return _as_states(spark.read.schema(CHOICE_RECORD).json(path, mode="FAILFAST"), True)


def geometry_states(spark: SparkSession, path: str) -> DataFrame:
    """States without their label columns, which the schema leaves undecoded."""
    return _as_states(spark.read.schema(GEOMETRY_RECORD).json(path, mode="FAILFAST"), False)


def key_violations(spark: SparkSession, path: str, expected: Sequence[str]) -> DataFrame:
    """Lines whose JSON key set is not exactly ``expected``."""
    keys = F.array_sort(F.json_object_keys("value"))
    return spark.read.text(path).where(~keys.eqNullSafe(F.array_sort(F.array(*map(F.lit, expected)))))


def pitch_dimensions(documents: DataFrame, column: str) -> DataFrame:
    """Two positive finite sizes out of a text document; other documents carry a reject."""
    sizes = F.from_json(column, "pitch_length DOUBLE, pitch_width DOUBLE")
    parsed = documents.withColumn("_s", sizes).select(
        *documents.columns, F.col("_s.pitch_length").alias("pitch_length"), F.col("_s.pitch_width").alias("pitch_width")
    )
    good = lambda c: sc.is_finite(F.col(c)) & (F.col(c) > 0)
    return parsed.withColumn("reject", F.when(~(good("pitch_length") & good("pitch_width")), "dimension_invalid"))


def json_inventory(documents: DataFrame, column: str, group: str) -> DataFrame:
    """Merged JSON schema (names and types, no values) per group."""
    return documents.groupBy(group).agg(F.schema_of_variant_agg(F.parse_json(column)).alias("schema"))


def allowed_only(df: DataFrame, allowlist: DataFrame, key: str = "match_id") -> DataFrame:
    """Rows of permitted matches; over a table laid out by match only their folders are read."""
    return df.join(allowlist.select(key), key, "left_semi")


def candidate_spans(states: DataFrame) -> DataFrame:
    """(match_id, event_id, candidates, longest): candidates of a state and the longest way to one."""
    each = states.select("match_id", "event_id", "ordinal", "carrier", F.explode("candidates").alias("c"))
    way = F.hypot(F.col("c.x") - F.col("carrier.x"), F.col("c.y") - F.col("carrier.y"))
    return each.groupBy("match_id", "event_id", "ordinal").agg(F.count(F.lit(1)).alias("candidates"), F.max(way).alias("longest")).drop("ordinal")


# Bytes of a file that a task holds at once while it hashes it.
BLOCK_BYTES = 4 << 20


def _hashed(batches):
    """Bytes, SHA-256 and git blob SHA-1 of the files of a batch, read block by block; or why a file can't be read."""
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            strong, blob, read, reason = hashlib.sha256(), hashlib.sha1(b"blob %d\0" % length), 0, None
            try:
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with store.open_input_stream(name) as stream:
                    while block := stream.read(BLOCK_BYTES):
                        strong.update(block)
                        blob.update(block)
                        read += len(block)
                if read != length:
                    reason = "length_changed"
            except (OSError, pa.ArrowException) as error:
                reason = type(error).__name__
            rows.append((path, length, *((None, None) if reason else (strong.hexdigest(), blob.hexdigest())), reason))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["path", "actual_bytes", "actual_sha256", "blob_sha1", "refused"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def file_hashes(files: DataFrame) -> DataFrame:
    """Hashes of the files of a listing (path, length), whatever their size; ``refused`` tells why one has none."""
    schema = "path string, actual_bytes long, actual_sha256 string, blob_sha1 string, refused string"
    return files.select("path", "length").mapInArrow(_hashed, schema)


def file_integrity(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Bytes and SHA-256 of every file against a manifest (name, bytes, sha256).

    Spark lists the files and deals them out by size without reading them; a task streams each of its files, so
    a file of any size takes one block of memory. A file that tasks can't open is ``unreadable``, not skipped. Spark lists
    no empty files, so an empty one counts as ``missing``.
    """
    listed = spark.read.format("binaryFile").load(path)  # the content column is never asked for
    files = file_hashes(listed).withColumn("name", F.element_at(F.split("path", "/"), -1)).drop("path")
    status = (
        F.when(F.col("actual_bytes").isNull(), "missing")
        .when(F.col("refused").isNotNull(), "unreadable")
        .when(F.col("bytes").isNull(), "unexpected")
        .when((F.col("bytes") != F.col("actual_bytes")) | (F.col("sha256") != F.col("actual_sha256")), "mismatch")
        .otherwise("verified")
    )
    return files.join(manifest, "name", "full_outer").withColumn("status", status)
