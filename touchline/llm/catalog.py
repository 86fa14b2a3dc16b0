"""Registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from touchline.llm import (
    cas_archive,
    gkl_whitening,
    kneser_ney,
    latent_leaks,
    poisson_mix,
    radix_windows,
    reversed_search,
    rule_forest,
    sentence_spans,
    simhash_bk,
    tag_paths,
    toxic_lexicon,
    transcript_hmm,
)
from touchline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


@query(
    "op3_cas_archive",
    """
WITH hashed AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         coalesce(html, '') AS body
  FROM pages),
linked AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS keeper FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
         (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)),
         lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM linked
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = cas_archive.write_archive(table(spark, sf_dir, "pages"))
    return cas_archive.read_archive(archive).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op10_poisson_mix",
    """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(CAST(n AS DOUBLE), 0.5) / sum(pow(CAST(n AS DOUBLE), 0.5)) OVER () * sum(n) OVER () / n AS rate
  FROM sizes),
points AS (
  SELECT d.*, rate, CAST(('0x' || substr(md5('17:0:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496e0 AS point
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS below FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), below + term * rate / (k + 1) FROM steps WHERE k < 80),
copies AS (
  SELECT p.*, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM p.source AND s.below <= p.point) AS n FROM points p),
repeated AS (SELECT *, unnest(range(1, n + 1)) AS c FROM copies WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy,
       CAST(('0x' || substr(md5('17:order:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || ':' || c), 1, 13)) AS BIGINT) / 4503599627370496e0 AS shuffle_key
FROM repeated
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(table(spark, sf_dir, "documents"))


@query("op1_rule_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_tag_paths")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_paths.extract(table(spark, sf_dir, "pages"))


@query("op4_simhash_bk")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op2_sentence_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_radix_windows")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_windows.dedup(table(spark, sf_dir, "documents"))


@query("op6_kneser_ney")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_latent_leaks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


@query("op7_transcript_hmm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are written down as transcripts, parsed, and rendered; ``role`` is the true one."""
    conversations = table(spark, sf_dir, "conversations")
    lines = transcript_hmm.written_down(conversations)
    found = transcript_hmm.recovered(lines.select("conv_id", "place", "part", "line"), lines)
    blocks = transcript_hmm.rendered_blocks(found).withColumnRenamed("place", "turn")
    truth = conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "role").distinct()
    return blocks.join(truth, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).drop("c", "t")


@query("op11_gkl_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gkl_whitening.whiten(table(spark, sf_dir, "embeddings"))


@query(
    "op12_reversed_search",
    r"""
WITH tokens AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
item_tokens AS (
  SELECT iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark)),
asked AS (SELECT iid, item_id, term, count(*) AS times FROM item_tokens GROUP BY ALL),
lengths AS (SELECT rid, count(*) AS n FROM tokens GROUP BY rid),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
met AS (SELECT rid, doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM met GROUP BY term), corpus),
gains AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) AS gain
  FROM met JOIN weights USING (term) JOIN lengths USING (rid), corpus),
scores AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(gain * times) AS BIGINT) AS score FROM gains JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) <= 20
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_toxic_lexicon")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_lexicon.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
