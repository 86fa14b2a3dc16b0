"""Ranked lexical search turned round: documents stream through an index of the queries.

The items asked for are few against the documents, so their terms are inverted, not the documents':
term -> (item, times). Items are dealt to blocks of at most ``ITEMS_AT_ONCE`` items and
``POSTINGS_AT_ONCE`` postings (one item with more makes a block of its own), which bounds every
broadcast. For each block all documents are read twice: once to count terms, once to score.

* **Counting.** Each task counts the documents that hold a term of the block, the documents with any
  term, and all terms; the sums are exact.
* **Scoring.** A document's term counts are looked up in the index; every posting adds
  ``w * ((10^9 tf) div (1000 tf + 12 m))`` to its item. A task keeps a heap of the best ``top``
  documents per item, so it returns at most items x top rows whatever it read.
* **Merging.** Heaps meet in two rounds, first within (item, slice), then by item, so no task gets
  the rows of all partitions for one item at once.

Ties are broken by the smaller id, unknown ids last. All but the term weights is integer arithmetic.

Null, blank and symbol-only texts have no terms: such documents aren't counted and such items find
nothing. Very long texts are read whole. Repeated rows of documents are documents of their own and may
both be found; repeated items are answered once each. Empty tables give no rows. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm.common import stored

TOP = 20
ITEMS_AT_ONCE = 1_024
POSTINGS_AT_ONCE = 1_000_000
# Scores held at once in a task: documents of a chunk x items of the block.
CELLS_AT_ONCE = 500_000
SLICES = 16

# Bytes that part terms become a space, A-Z become a-z; bytes of other code points stay.
_FOLD = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if chr(b).isupper() else 0x20
    for b in range(256)
)
# Sums of doubles are exact below 2^53; an item with more terms than this is summed in integers.
EXACT_TERMS = 100_000


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and code points from 0x80 on, only A-Z lower-cased."""
    return text.encode("utf-8").translate(_FOLD).split(b" ") if text else []


def term_counts(text: str | None) -> tuple[int, Counter]:
    """All terms with repeats, and how often each occurs."""
    counts = Counter(terms(text))
    counts.pop(b"", None)
    return counts.total(), counts


class Index(NamedTuple):
    """The inverted items of a block: postings of term t are those from starts[t] to starts[t + 1]."""

    vocabulary: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    ids: list
    longest: int


def item_blocks(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(block, item_id, terms, times): items with terms, dealt to bounded blocks, written down."""
    rows = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text"))
    schema = f"block string, item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<binary>, times array<int>"
    id_type = rows.schema["item_id"].dataType
    parts = max(1, math.ceil(rows.count() / ITEMS_AT_ONCE))

    def dealt(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part, number, held, postings = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for start, item in enumerate(ids):
                _, counts = term_counts(texts[start].as_py())
                if not counts:
                    continue
                if held and (held == ITEMS_AT_ONCE or postings + len(counts) > POSTINGS_AT_ONCE):
                    number, held, postings = number + 1, 0, 0
                held, postings = held + 1, postings + len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}-{number}"]),
                        pa.array([item], to_arrow_type(id_type)),
                        pa.array([list(counts)], pa.list_(pa.binary())),
                        pa.array([list(counts.values())], pa.list_(pa.int32())),
                    ],
                    ["block", "item_id", "terms", "times"],
                )

    return stored(rows.repartition(parts).mapInArrow(dealt, schema), "item-blocks")


def index_of(rows) -> Index:
    vocabulary: dict[bytes, int] = {}
    postings: list[list[tuple[int, int]]] = []
    for place, row in enumerate(rows):
        for term, times in zip(row["terms"], row["times"]):
            number = vocabulary.setdefault(bytes(term), len(vocabulary))
            if number == len(postings):
                postings.append([])
            postings[number].append((place, times))
    flat = [p for each in postings for p in each]
    return Index(
        vocabulary,
        np.cumsum([0, *map(len, postings)]),
        np.array([p[0] for p in flat], np.int64),
        np.array([p[1] for p in flat], np.int64),
        [row["item_id"] for row in rows],
        max(sum(row["times"]) for row in rows),
    )


def document_counts(texts: DataFrame, index) -> tuple[np.ndarray, int, int]:
    """How many documents hold each term of the index, how many have a term, and all their terms."""
    size = len(index.value.vocabulary)

    def count(batches):
        vocabulary = index.value.vocabulary
        holding, with_terms, all_terms = np.zeros(size + 2, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                n, counts = term_counts(text.as_py())
                with_terms += n > 0
                all_terms += n
                holding[[vocabulary[t] for t in counts.keys() & vocabulary.keys()]] += 1
        holding[size:] = with_terms, all_terms
        slots = np.nonzero(holding)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(holding[slots])], ["slot", "n"])

    sums = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 2, np.int64)
    for row in sums.collect():  # a row per term of a bounded block
        found[row["slot"]] = row["n"]
    return found[:size], int(found[size]), int(found[size + 1])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(k) + 1))) for k in df], np.int64)


class Heaps:
    """The best ``top`` documents of every item, by falling score and rising id."""

    def __init__(self, items: int, top: int):
        self.score = np.zeros((items, top), np.int64)
        self.key = np.full((items, top), np.iinfo(np.int64).max)
        self.known = np.zeros((items, top), bool)

    def update(self, scores: np.ndarray, keys: np.ndarray, known: np.ndarray) -> None:
        """scores: documents x items."""
        last, last_key = self.score[:, -1], self.key[:, -1]
        docs, items = np.nonzero((scores > 0) & ((scores > last) | (scores == last) & (keys[:, None] < last_key)))
        order = np.argsort(items, kind="stable")
        docs, items = docs[order], items[order]
        touched, begins = np.unique(items, return_index=True)
        for item, here in zip(touched, np.split(docs, begins[1:])):
            score = np.concatenate([self.score[item], scores[here, item]])
            key = np.concatenate([self.key[item], keys[here]])
            best = np.lexsort((key, -score))[: self.score.shape[1]]
            self.score[item], self.key[item] = score[best], key[best]
            self.known[item] = np.concatenate([self.known[item], known[here]])[best]


def scores_of(index: Index, weight: np.ndarray, n_docs: int, n_terms: int, texts) -> np.ndarray:
    """Documents x items: integer scores of some texts."""
    docs, numbers, tf, m = [], [], [], []
    for place, text in enumerate(texts):
        n, counts = term_counts(text)
        met = counts.keys() & index.vocabulary.keys()
        docs += [place] * len(met)
        numbers += [index.vocabulary[t] for t in met]
        tf += [counts[t] for t in met]
        m += [100 - 25 + 25 * n * n_docs // n_terms] * len(met) if met else []
    items = len(index.ids)
    if not docs:
        return np.zeros((len(texts), items), np.int64)
    numbers, tf, m = np.array(numbers), np.array(tf, np.int64), np.array(m, np.int64)
    gain = weight[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    lengths = index.starts[numbers + 1] - index.starts[numbers]
    begins = np.cumsum(lengths) - lengths
    posting = np.arange(lengths.sum()) + np.repeat(index.starts[numbers] - begins, lengths)
    cells = np.repeat(np.array(docs) * items, lengths) + index.items[posting]
    added = np.repeat(gain, lengths) * index.times[posting]
    if index.longest <= EXACT_TERMS:
        flat = np.bincount(cells, added, len(texts) * items).astype(np.int64)
    else:
        flat = np.zeros(len(texts) * items, np.int64)
        np.add.at(flat, cells, added)
    return flat.reshape(len(texts), items)


def search_block(texts: DataFrame, index, weight: np.ndarray, n_docs: int, n_terms: int, top: int, item_type: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    schema = f"place int, item_id {item_type}, doc_id long, score long"

    def search(batches):
        own: Index = index.value
        heaps = Heaps(len(own.ids), top)
        chunk = max(1, CELLS_AT_ONCE // len(own.ids))
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                scores = scores_of(own, weight, n_docs, n_terms, part.column("text").to_pylist())
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(False)
                heaps.update(scores, ids.fill_null(np.iinfo(np.int64).max).to_numpy(False), known)
        places, ranks = np.nonzero(heaps.score > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(places.astype(np.int32)),
                pa.array([own.ids[p] for p in places], item_arrow),
                pa.array(heaps.key[places, ranks], mask=~heaps.known[places, ranks]),
                pa.array(heaps.score[places, ranks]),
            ],
            ["place", "item_id", "doc_id", "score"],
        )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_arrow = to_arrow_type(_parse_datatype_string(item_type))
    found = texts.select("doc_id", "text").mapInArrow(search, schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    for keys in ([F.col("place"), slice_of], [F.col("place")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, scores above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = item_blocks(items, item_id, text)
    item_type = blocks.schema["item_id"].dataType.simpleString()
    names = [row["block"] for row in blocks.select("block").distinct().orderBy("block").collect()]
    found = []
    for name in names:
        index = spark.sparkContext.broadcast(index_of(blocks.where(F.col("block") == name).drop("block").collect()))
        df, n_docs, n_terms = document_counts(texts, index)
        if n_docs:
            best = search_block(texts, index, weights(df, n_docs), n_docs, n_terms, top, item_type)
            found.append(stored(best, "search-block") if len(names) > 1 else best)
    if not found:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
