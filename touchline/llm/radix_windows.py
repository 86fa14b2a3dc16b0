"""Exact removal of repeated byte windows by depth-limited radix passes.

Only the order up to the threshold matters, so suffixes are never sorted beyond LENGTH bytes:
what falls into one group after the last pass is exactly a set of equal windows. The passes go
from the most significant digit on, and each keeps only what still has a partner:

1. The first digit of a window is a core of CORE bytes inside it, the one with the smallest hash
   (so equal windows have equal cores at equal places). Consecutive windows share a core; one row
   per core and place stands for all of them. Cores that occur once drop out.
2. The second digit is everything that the windows of a place span. Where all places of a core
   agree, all their windows are repeated and the group is done.
   In the other groups, places that some other place equals as a whole are repeated as well.
3. There, every window is its own last digit, together with core and offset; groups of two and more
   are the repeated windows. Of places that are equal as a whole, one stands for all.

Groups are counted, never gathered: counts have map-side partials, and the joins that bring a
verdict back are plain shuffle joins between written tables. Texts move once, those with any
repeated core twice. Removal is judged on the input: all bytes under a repeated window go.

Cases: null and empty texts have no bytes; texts shorter than LENGTH are never changed; rows that
repeat (also with the same id) are each other's copies and lose every byte; a null id is kept;
overlapping and self-overlapping repeats count; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored

LENGTH = 400
# Cores a window of LENGTH bytes has; a power of two.
STARTS = 128
CHUNK = 1 << 18
# Windows that a task holds before it hands them on.
WINDOWS_HELD = 200_000
BASE = 0x9E3779B97F4A7C15 | 1
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PLACES = "row_key long, core long, at int, first int, last int, spanned long"


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Cores:
    """Finds the places of cores in texts; holds the powers that the rolling hash needs."""

    def __init__(self, length: int = LENGTH, starts: int = STARTS):
        self.length, self.starts, self.core = length, starts, length - starts + 1
        if starts & (starts - 1) or self.core < 1:
            raise ValueError("starts must be a power of two below the length")
        size = CHUNK + length
        self.up = _powers(BASE, size + 1)
        self.down = _powers(pow(BASE, -1, 1 << 64), size + 1)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of every core of ``data``, the same wherever it stands."""
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=prefix[1:])
        found = (prefix[self.core :] - prefix[: -self.core]) * self.up[: len(data) - self.core + 1]
        for factor, shift in zip(MIX, (np.uint64(29), np.uint64(32))):
            found ^= found >> shift
            found *= np.uint64(factor)
        return found ^ (found >> np.uint64(31))

    def places(self, text: bytes):
        """(core hash, place of the core, first and last window that has it) in order of the text."""
        for start in range(0, len(text) - self.length + 1, CHUNK):
            data = np.frombuffer(text, dtype=np.uint8, offset=start, count=min(CHUNK + self.length - 1, len(text) - start))
            hashes = self.hashes(data)
            # The place in the low bits breaks ties towards the left.
            keyed = (hashes >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashes), dtype=np.uint64)
            step = 1
            while step < self.starts:
                keyed = np.minimum(keyed[:-step], keyed[step:])
                step *= 2
            place = (keyed & np.uint64((1 << 20) - 1)).astype(np.int64)
            cuts = np.flatnonzero(place[1:] != place[:-1]) + 1
            firsts = np.concatenate([[0], cuts])
            lasts = np.concatenate([cuts - 1, [len(place) - 1]])
            where = place[firsts]
            yield hashes[where].view(np.int64), where + start, firsts + start, lasts + start


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _place_rows(length: int, starts: int):
    def rows(batches):
        cores = Cores(length, starts)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            found: list[tuple] = []
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
                data = encoded(text)
                for core, at, first, last in cores.places(data):
                    spanned = np.fromiter(
                        (digest(data[a : b + length], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist())), dtype=np.uint64, count=len(at)
                    )
                    found.append((np.full(len(at), key), core, at, first, last, spanned.view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(column).astype(kind)) for column, kind in zip(zip(*found), ("i8", "i8", "i4", "i4", "i4", "i8"))],
                    names=["row_key", "core", "at", "first", "last", "spanned"],
                )

    return rows


def _window_rows(length: int):
    """The windows of open places, each with a digest of core, offset and bytes."""

    def batch_of(found):
        keys, starts, windows = (np.concatenate(column) for column in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(starts), pa.array(windows.view(np.int64))], names=["row_key", "start", "window"])

    def rows(batches):
        digest = xxhash.xxh3_64_intdigest
        found, held = [], 0
        for batch in batches:
            for key, text, places in zip(batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                data = encoded(text)
                for place in places:
                    if not place["emits"]:
                        continue
                    first, n = place["first"], place["last"] + 1 - place["first"]
                    seed = place["core"] + (place["at"] - first) * BASE
                    windows = np.fromiter(
                        (digest(data[first + i : first + i + length], (seed - i * BASE) & (2**64 - 1)) for i in range(n)), dtype=np.uint64, count=n
                    )
                    found.append((np.full(n, key, dtype=np.int64), np.arange(first, first + n, dtype=np.int32), windows))
                    held += n
                    if held > WINDOWS_HELD:
                        yield batch_of(found)
                        found, held = [], 0
        if found:
            yield batch_of(found)

    return rows


def covered(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of the union of ranges."""
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _digests(length: int):
    def rows(batches):
        for batch in batches:
            removed, spans, digests = [], [], []
            columns = [batch.column(name).to_pylist() for name in ("text", "places", "starts")]
            for text, places, starts in zip(*columns):
                data = encoded(text)
                ranges = [(p["first"], p["last"] + length) for p in places if p["done"]]
                runs = covered(ranges + [(start, start + length) for start in starts or ()])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows


def removed_windows(docs: DataFrame, length: int = LENGTH, starts: int = STARTS) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with their text where it has a repeated core and the places of such cores,
    and the starts of repeated windows of places that aren't repeated as a whole."""
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"row_key": F.xxhash64("doc_id", "text"), "n_bytes": F.octet_length("text").cast("long")})
    places = source.where(F.col("n_bytes") >= length).select("row_key", "text").mapInArrow(_place_rows(length, starts), PLACES)
    shared = stored(
        places.groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"), F.min("spanned").alias("low"), F.max("spanned").alias("high"))
        .where("n > 1")
        .select("core", (F.col("low") != F.col("high")).alias("open")),
        "windows-cores",
    )
    met = stored(places.join(shared, "core"), "windows-met")
    opened = met.where("open")
    alike = stored(
        opened.groupBy("core", "spanned").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("keeper")), "windows-alike"
    )
    marked = opened.join(alike, ["core", "spanned"]).withColumns(
        {"done": F.col("n") > 1, "emits": (F.col("n") == 1) | (F.col("row_key") == F.col("keeper"))}
    )
    settled = met.where("not open").withColumns({"done": F.lit(True), "emits": F.lit(False)})
    place = ("core", "at", "first", "last", "done", "emits")
    by_row = stored(
        marked.select("row_key", *place).unionByName(settled.select("row_key", *place)).groupBy("row_key").agg(F.collect_set(F.struct(*place)).alias("places")),
        "windows-places",
    )
    texts = stored(
        source.join(by_row, "row_key", "left").select(
            "row_key", "doc_id", "n_bytes", "places",
            F.when(F.col("places").isNull(), F.sha2("text", 256)).alias("untouched_sha256"),
            F.when(F.col("places").isNotNull(), F.col("text")).alias("text"),
        ),
        "windows-texts",
    )
    crowded = texts.where(F.exists("places", lambda place: place["emits"])).select("row_key", "text", "places")
    windows = stored(crowded.mapInArrow(_window_rows(length), "row_key long, start int, window long"), "windows-open")
    repeated = stored(windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "windows-repeated")
    return texts, stored(windows.join(repeated, "window").groupBy("row_key").agg(F.collect_set("start").alias("starts")), "windows-starts")


def dedup(docs: DataFrame, length: int = LENGTH, starts: int = STARTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every row."""
    texts, found = removed_windows(docs, length, starts)
    untouched = texts.where("places is null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("untouched_sha256").alias("kept_sha256")
    )
    touched = texts.where("places is not null").join(found, "row_key", "left").select("doc_id", "n_bytes", "text", "places", "starts")
    cut = touched.mapInArrow(_digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return untouched.unionByName(cut)
