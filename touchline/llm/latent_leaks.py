"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items (the query set, taken in blocks of ITEMS_AT_ONCE) are cut into passages.
2. The document frequency of every word of a block is counted over all documents.
3. The passages are dealt to spaces of at most RANK. A randomised SVD of a space's TF-IDF rows,
   made in one task, is truncated to the fewest leading dimensions in which every passage keeps
   RETAINED of its square: what passages have in common stays, and none is lost to the others.
4. Every window of every document is a query against the latent vectors of every space, by its
   cosine with a passage's image in the space, which also weighs words that go with the passage's
   own. A bound that needs one number per word leaves out windows which cannot reach the cosine.
5. A candidate holds if the longest common subsequence of item and surrounding words covers
   LCS_SURE of the item, or LCS_LIKELY of it and ANSWER of the item's last sentence, its answer.

Documents stay where they are read: nothing but counts over a block's words is shuffled, and what
is broadcast (words, projections, items of a block) is bounded by ITEMS_AT_ONCE and SPACES_AT_ONCE.

Cases: null and empty texts have no hits; items without words find nothing; items shorter than
LEAST_WORDS must be found word by word; equal items are hit separately, equal documents alike; an
empty benchmark or corpus gives no hits; null ids are kept; other columns pass through the filter.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored

ITEMS_AT_ONCE = 4_000
RANK = 256
SPACES_AT_ONCE = 16
WINDOW = 48
STRIDE = 16
# A window that is a passage has a cosine of at least sqrt(RETAINED) with its image.
RETAINED = 0.8
COSINE = 0.25
LCS_SURE = 0.8
LCS_LIKELY = 0.6
ANSWER = 0.6
LEAST_WORDS = 6
SEED = 31
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
HITS = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION).split()


def passages(words: list[bytes]) -> list[list[bytes]]:
    if len(words) <= WINDOW + STRIDE:
        return [words] if words else []
    return [words[at : at + WINDOW] for at in range(0, len(words) - WINDOW // 2, WINDOW // 2)]


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Space:
    """Latent vectors of at most RANK passages."""

    row: np.ndarray  # row of ``heavy`` by column
    heavy: np.ndarray  # basis times weight, the last row for words of no passage here
    latent: np.ndarray  # passages x dimensions, of unit length in the space
    owner: np.ndarray  # item of each passage
    reach: np.ndarray  # weight times the largest entry of a column in any passage's unit image


@dataclass
class Block:
    """All that tasks need of one block of items."""

    items: list[Item]
    number: dict[bytes, int]  # word: column
    weight: np.ndarray  # inverse document frequency by column, the last for words of no item
    spaces: list[Space]


def subsequence(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` and the n words whose places are ``masks``."""
    full = (1 << n) - 1
    row = full
    for word in words:
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def places_of(words: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for at, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << at
    return masks


def read_items(benchmark: DataFrame):
    """Blocks of items in the order of their ids."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator()
    held: list[Item] = []
    count = 0
    for row in rows:
        words = words_of(row["text"])
        if not words:
            continue
        parts = [part for part in map(words_of, SENTENCE.split(row["text"])) if part]
        held.append(Item(row["item_id"], words, parts[-1]))
        count += len(passages(words))
        if len(held) == ITEMS_AT_ONCE or count >= SPACES_AT_ONCE * RANK:
            yield held
            held, count = [], 0
    if held:
        yield held


def document_frequencies(docs: DataFrame, number: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that have each word, over all rows, and the number of rows."""
    held = docs.sparkSession.sparkContext.broadcast(number)

    def counted(batches):
        columns = held.value
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update([columns[word] for word in set(words_of(text)) & columns.keys()])
            counts[len(columns)] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(number) + 1, dtype=np.int64)
    for row in rows:
        found[row["word"]] = row["n"]
    return found[:-1], int(found[-1])


def unit_rows(parts: list[list[bytes]], number: dict[bytes, int], weight: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
    rows = []
    for words in parts:
        counts = Counter(number[word] for word in words)
        values = np.array(list(counts.values()), dtype=float) * weight[list(counts)]
        rows.append((list(counts), values / np.linalg.norm(values)))
    return rows


def leading(rows: np.ndarray) -> np.ndarray:
    """Orthonormal basis (columns x rank) of leading right singular vectors of the rows, by random projections.

    The rank is the least at which every row keeps RETAINED of its square.
    """
    rank, width = min(rows.shape), rows.shape[1]
    basis = np.random.default_rng(SEED).standard_normal((width, min(rank + 16, width)))
    for _ in range(2):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    values, turn = np.linalg.eigh(basis.T @ (rows.T @ (rows @ basis)))
    basis = basis @ turn[:, np.argsort(-values)[:rank]]
    kept = np.cumsum((rows @ basis) ** 2, axis=1) / (rows**2).sum(axis=1, keepdims=True)
    return basis[:, : 1 + min(int((kept.min(axis=0) < RETAINED).sum()), rank - 1)]


def latent_spaces(spark, rows: list[tuple[list[int], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns and basis (columns x rank) of every RANK rows, one task a space."""
    table = spark.createDataFrame(
        [(at // RANK, columns, values.tolist()) for at, (columns, values) in enumerate(rows)], "space int, columns array<int>, weights array<double>"
    )

    def projected(part: pa.Table) -> pa.Table:
        columns, where = np.unique(np.concatenate([np.array(c) for c in part["columns"].to_pylist()]), return_inverse=True)
        dense = np.zeros((part.num_rows, len(columns)))
        dense[np.repeat(np.arange(part.num_rows), [len(c) for c in part["columns"].to_pylist()]), where] = np.concatenate(part["weights"].to_pylist())
        vectors = leading(dense).astype(np.float32)
        return pa.table(
            [pa.array([part["space"][0].as_py()] * len(columns), pa.int32()), pa.array(columns, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())],
            names=["space", "word", "vector"],
        )

    found: list[dict[int, np.ndarray]] = [{} for _ in range(0, len(rows), RANK)]
    for row in stored(table.groupBy("space").applyInArrow(projected, "space int, word int, vector binary"), "lsa-spaces").toLocalIterator():
        found[row["space"]][row["word"]] = np.frombuffer(row["vector"], dtype=np.float32)
    return [(np.array(list(space), dtype=np.int32), np.stack(list(space.values()))) for space in found]


def prepared(docs: DataFrame, items: list[Item]) -> Block:
    number: dict[bytes, int] = {}
    for item in items:
        for word in item.words:
            number.setdefault(word, len(number))
    frequency, n_docs = document_frequencies(docs, number)
    weight = np.log((1.0 + n_docs) / (1.0 + np.minimum(frequency, n_docs))) + 0.1
    parts = [(at, part) for at, item in enumerate(items) for part in passages(item.words)]
    rows = unit_rows([part for _, part in parts], number, weight)
    owner = np.array([at for at, _ in parts])
    spaces = []
    for start, (columns, basis) in zip(range(0, len(rows), RANK), latent_spaces(docs.sparkSession, rows)):
        some = rows[start : start + RANK]
        row = np.full(len(number) + 1, len(columns), dtype=np.int32)
        row[columns] = np.arange(len(columns))
        latent = np.stack([values @ basis[row[words]] for words, values in some])
        latent /= np.linalg.norm(latent, axis=1, keepdims=True)
        bound = np.zeros(len(number) + 1)
        bound[columns] = np.maximum((latent @ basis.T).max(axis=0), 0.0)
        heavy = np.vstack([weight[columns, None] * basis, np.zeros(basis.shape[1])])
        spaces.append(
            Space(row, heavy.astype(np.float32), latent.astype(np.float32), owner[start : start + RANK], (np.append(weight, 0.0) * bound).astype(np.float32))
        )
    # Words of no item weigh like words of one document in a hundred, whatever the size of the corpus.
    return Block(items, number, np.append(weight, np.log(100.0)), spaces)


class Searcher:
    def __init__(self, block: Block):
        self.block = block
        self.masks = [places_of(item.words) for item in block.items]
        self.answers = [places_of(item.answer) for item in block.items]
        self.square = block.weight**2

    def near(self, space: Space, columns: np.ndarray, starts: np.ndarray, ends: np.ndarray, norms: np.ndarray):
        """(item, cosine, start) of windows and passages of one space that reach the cosine."""
        n, none = len(columns), len(space.heavy) - 1
        sums = np.concatenate([[0.0], np.cumsum(space.reach[columns], dtype=float)])
        able = np.flatnonzero(sums[ends] - sums[starts] >= COSINE * norms * (1 - 1e-6))
        if not len(able):
            return
        rows = space.row[columns]
        for at in range(0, len(able), 256):
            some = able[at : at + 256]
            # A window is a few blocks of STRIDE words; sums are made once for a block.
            blocks = np.unique((some[:, None] + np.arange(WINDOW // STRIDE)).ravel())
            blocks = blocks[blocks * STRIDE < n]
            places = blocks[:, None] * STRIDE + np.arange(STRIDE)
            totals = space.heavy[np.where(places < n, rows[np.minimum(places, n - 1)], none)].sum(axis=1)
            where = np.searchsorted(blocks, some)
            latent = np.zeros((len(some), totals.shape[1]), dtype=np.float32)
            for step in range(WINDOW // STRIDE):
                inside = (some + step) * STRIDE < n
                latent[inside] += totals[where[inside] + step]
            cosines = latent @ space.latent.T / np.maximum(norms[some], 1e-9)[:, None]
            for row, passage in zip(*np.nonzero(cosines >= COSINE)):
                yield int(space.owner[passage]), float(cosines[row, passage]), int(starts[some[row]])

    def hits(self, text: str | None) -> list[tuple[int | None, float, float, float]]:
        """(item, cosine, share of the item, share of its answer) for every item that the text holds."""
        block, words = self.block, words_of(text)
        if not words:
            return []
        get, other = block.number.get, len(block.number)
        columns = np.array([get(word, other) for word in words], dtype=np.int32)
        n = len(words)
        starts = np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)
        ends = np.minimum(starts + WINDOW, n)
        sums = np.concatenate([[0.0], np.cumsum(self.square[columns])])
        norms = np.sqrt(sums[ends] - sums[starts])
        best: dict[int, tuple[float, int]] = {}
        for space in block.spaces:
            for item, cosine, start in self.near(space, columns, starts, ends, norms):
                key = (item, start // (WINDOW * 2))
                if cosine > best.get(key, (0.0, 0))[0]:
                    best[key] = (cosine, start)
        found: dict[int, tuple[float, float, float]] = {}
        for (item, _), (cosine, start) in best.items():
            size = len(block.items[item].words)
            around = words[max(0, start - size) : start + WINDOW + size]
            present = self.masks[item].keys() & around
            if sum(self.masks[item][word].bit_count() for word in present) < LCS_LIKELY * size:
                continue
            share = subsequence(self.masks[item], size, around) / size
            if share < LCS_LIKELY or share < 1 and size < LEAST_WORDS:
                continue
            answer = len(block.items[item].answer)
            answered = subsequence(self.answers[item], answer, around) / answer
            if (share >= LCS_SURE or answered >= ANSWER) and share > found.get(item, (0, 0.0))[1]:
                found[item] = (min(cosine, 1.0), share, answered)
        return [(block.items[item].item_id, *values) for item, values in sorted(found.items())]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of every document that holds an item."""
    found = docs.sparkSession.createDataFrame([], HITS)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for items in read_items(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(prepared(source, items))

        def searched(batches, held=held):
            searcher = Searcher(held.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in searcher.hits(text)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = found.unionByName(source.mapInArrow(searched, HITS))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    kept = docs
    for items in read_items(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(prepared(docs, items))

        def searched(batches, held=held):
            searcher = Searcher(held.value)
            for batch in batches:
                clean = [not searcher.hits(text) for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(searched, docs.schema)
    return kept
