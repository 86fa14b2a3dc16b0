"""Writers and publication checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def wide_summary(
    long: DataFrame, match: str, name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """One row per match plus an equal-match macro row, one column per metric mean."""
    per_match = (
        long.groupBy(F.col(match).cast("string").alias("alias"))
        .pivot(name, list(names))
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    )
    means = per_match.select(
        "alias", F.col(f"{names[0]}_n").alias("states"), *[F.col(f"{n}_mean").alias(n) for n in names]
    )
    macro = means.groupBy(F.lit("macro").alias("alias")).agg(
        F.sum("states").alias("states"), *[F.avg(n).alias(n) for n in names]
    )
    return means.unionByName(macro)


def canonical_lines(states: DataFrame) -> DataFrame:
    """One compact JSON line per state, keys in sorted order, nulls kept."""
    xy = lambda p: F.array(p["x"], p["y"])
    fields = {
        "candidate_ids": F.transform("candidates", lambda c: c["id"]),
        "candidate_xy": F.transform("candidates", xy),
        "carrier_xy": xy(F.col("carrier")),
        "defender_xy": F.transform("defenders", xy),
        "event_id": F.col("event_id"),
        "match_id": F.col("match_id"),
        "target_index": F.col("target_index"),
        "target_outside": F.col("target_index").isNull(),
    }
    record = F.struct(*[c.alias(n) for n, c in sorted(fields.items())])
    return states.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def write_canonical(states: DataFrame, path: str) -> None:
    """Compressed files of lines, one a task; points repeat their key names and shrink to a fraction."""
    canonical_lines(states).write.mode("errorifexists").option("compression", "gzip").text(path)


def write_metric_csv(rows: DataFrame, path: str, fields: Sequence[str]) -> None:
    """One row per match and metric with the columns in their frozen order; every task writes its part."""
    rows.select(*fields).write.mode("errorifexists").option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write a closed result; False (and no change) when the path already holds one."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        return False
    return True


# What a publishable text may not contain.
LEAK_RULES = {
    "seven_digit_identity": r"\b\d{7}\b",
    "private_path": r"(/Users/|/home/|[A-Z]:\\)",
    "mail_address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
FORBIDDEN_HEADERS = ("match_id", "event_id", "player_id", "candidate_id", "timestamp", "x", "y", "score", "rank")


def leak_scan(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, rule) for every rule a text breaks; one pass over the whole text."""
    rules = F.array(*[F.when(F.col(column).rlike(p), F.lit(n)) for n, p in LEAK_RULES.items()])
    return texts.select(key, F.explode(F.array_compact(rules)).alias("rule"))


def forbidden_headers(columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) & set(FORBIDDEN_HEADERS))


def write_by_match(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, match: str = "match_id") -> DataFrame:
    """A table with a folder per match, each cut into buckets by ``keys``, and read back.

    Scans of some matches read their folders only, also where the matches come from another table at run time. Grouping
    or joining by the match and the keys needs no exchange, and a busy match is spread over its buckets.
    """
    spread = df.repartition(buckets, *keys)  # each task holds one bucket of every match
    spread.write.mode("overwrite").partitionBy(match).bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
