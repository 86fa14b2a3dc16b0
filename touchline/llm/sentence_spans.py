"""Substring dedup by sliding sentence spans.

A text is cut into sentences, and those of more than LONG_SENTENCE words into pieces at words chosen
by their content (the smallest CRC among the REACH words on either side), so that equal passages are
cut alike wherever they begin. A span is the shortest run of consecutive sentences from a sentence on
that has at least MIN_SENTENCES and MIN_WORDS. A passage copied from the middle of a sentence into the middle of
another loses the pieces at its ends, and is seen when a whole span is left between them. The
hash of every span meets its equals globally: a minimum with map-side partials finds the document
that has it first, a join on the hash finds the others. Every sentence inside a span that isn't
the first of its kind (by document id, then by place) is removed. Case and white space don't
matter for equality.

Spans are narrow rows, stored once; texts travel once, to meet the sentences to remove. Hot spans
are single rows after the partial aggregate, and a plain shuffle join that adaptive execution splits.

Cases: null texts stay null and have no sentences; empty texts stay empty; texts under the minimum
are never changed; rows of the same id count as one document, rows without an id are never changed;
an empty table gives an empty result; other columns pass through, also those named like the results
of intermediate steps.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored

MIN_SENTENCES = 2
MIN_WORDS = 20
# Sentences of more words are cut after words whose CRC is the smallest of so many words before and after.
LONG_SENTENCE = 12
REACH = 3
END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+\s*|\n+")
WORD = re.compile(r"\S+\s*")
SEPARATOR = re.compile(r"[\x1c-\x1f]")
SPANS = "doc_id long, span long, first int, last int, again boolean"


def piece_ends(words: list[bytes]) -> list[int]:
    """Numbers of words after which a sentence is cut; the last one is its end."""
    n = len(words)
    if n <= LONG_SENTENCE:
        return [n]
    crc = [zlib.crc32(word) for word in words]
    ends = [
        i + 1
        for i, own in enumerate(crc[:-1])
        if own < crc[i + 1] and (not i or own <= crc[i - 1]) and own < min(crc[i + 1 : i + 1 + REACH]) and own <= min(crc[max(0, i - REACH) : i + 1])
    ]
    return [*ends, n]


def sentences(text: str, placed: bool = True) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every sentence or piece of one that has a word; unless ``placed``, without places."""
    found, start = [], 0
    # Lower case may change lengths; then equality stays sensitive to case for this text.
    lower = text.lower()
    lower = lower if len(lower) == len(text) else text
    digest = xxhash.xxh3_64_digest
    # Bytes part words like text does, but for the four separators that text knows besides.
    plain = lower.isascii() and not SEPARATOR.search(lower)

    def add(a, b):
        words = lower[a:b].encode().split() if plain else [w.encode("utf-8", "surrogatepass") for w in lower[a:b].split()]
        if not words:
            return
        ends = piece_ends(words)
        if placed and len(ends) > 1:
            after = [match.end() for match in WORD.finditer(lower, a, b)]
        at, from_place = 0, a
        for end in ends:
            to_place = after[end - 1] if placed and len(ends) > 1 and end < len(words) else b
            found.append((from_place, to_place, end - at, digest(b" ".join(words[at:end]))))
            at, from_place = end, to_place

    for match in END.finditer(text):
        add(start, match.end())
        start = match.end()
    add(start, len(text))
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of every span."""
    parts = sentences(text, False)
    n = len(parts)
    if n < MIN_SENTENCES:
        return []
    before = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([part[2] for part in parts], out=before[1:])
    if before[n] < MIN_WORDS:
        return []
    # Shortest run from each sentence on, with enough words and sentences.
    index = np.arange(n)
    last = np.maximum(np.searchsorted(before, before[:-1] + MIN_WORDS, "left") - 1, index + MIN_SENTENCES - 1)
    digests = b"".join(part[3] for part in parts)
    return [(xxhash.xxh3_64_intdigest(digests[8 * i : 8 * j + 8]), i, j) for i, j in enumerate(last.tolist()) if j < n]


def _span_rows(batches):
    for batch in batches:
        docs, hashes, firsts, lasts, again = [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            known = set()
            for span, first, last in spans(text):
                docs.append(doc)
                hashes.append(span)
                firsts.append(first)
                lasts.append(last)
                again.append(span in known)
                known.add(span)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()), pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)),
                pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(again, pa.bool_()),
            ],
            names=["doc_id", "span", "first", "last", "again"],
        )


def span_table(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_span_rows, SPANS)


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """Per document, the spans to remove as an array of (first, last)."""
    found = stored(span_table(docs), "spans")
    once = found.where("not again")
    shared = stored(
        once.groupBy("span").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("span", "owner"),
        "spans-shared",
    )
    met = once.join(shared, "span").where("doc_id > owner").select("doc_id", "first", "last")
    own = found.where("again").select("doc_id", "first", "last")
    return met.unionByName(own).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def without(text: str, removed: list[dict]) -> tuple[str, int, int]:
    """The text without the sentences inside the given spans, sentences and maximal runs removed."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, dtype=np.int64)
    for span in removed:
        gone[span["first"]] += 1
        gone[span["last"] + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    kept, at, runs = [], 0, 0
    for number in np.flatnonzero(gone).tolist():
        a, b = parts[number][:2]
        runs += number == 0 or not gone[number - 1]
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return "".join(kept), int(gone.sum()), runs


def _rewritten(batches):
    for batch in batches:
        texts, counts, runs = [], [], []
        for text, removed in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            new = without(text, removed) if removed and text is not None else (text, 0, 0)
            for held, value in zip((texts, counts, runs), new):
                held.append(value)
        columns = {name: batch.column(name) for name in batch.schema.names if name != "spans"}
        columns["text"] = pa.array(texts, pa.string())
        columns["n_removed"], columns["n_spans"] = pa.array(counts, pa.int64()), pa.array(runs, pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences cut from ``text``; adds n_removed (sentences) and n_spans (runs of them)."""
    docs = docs.drop("n_removed", "n_spans", "spans")
    removed = stored(repeated_sentences(docs.select("doc_id", "text")), "spans-removed").withColumnRenamed("doc_id", "removed_from")
    joined = docs.join(removed, F.col("doc_id") == F.col("removed_from"), "left").drop("removed_from")
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return joined.mapInArrow(_rewritten, f"{kinds}, n_removed long, n_spans long")
