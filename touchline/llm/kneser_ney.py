"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

A text is a sequence of subwords (``subwords``): frequent words, pieces of the others, one token for a word
that only repeats the word before, and edges. The model has all trigrams of all trusted texts by
language, with counts, continuation counts and discounts, in sharded tables; it grows with the corpus and is never
gathered. A trigram (l, m, r) belongs to the shard of its middle token m, so that its count, its
context (l, m), the continuations (m, r) and the mass that m leaves to unigrams meet in one place.

1. Trusted texts: every task sorts its trigrams and hands a shard its share; a shard sums them.
2. Shards send their bigrams to the shard of r, which sums the left neighbours of (m, r) and counts
   the bigrams that end with r, and sends (m, r) to the shards of m.
3. Counts of counts give the discounts; unigrams are a vector over the vocabulary (at most 65,536
   numbers a model, whatever the corpus), which is broadcast, LANGUAGES_AT_ONCE models at a time.
4. All documents: trigrams are counted per document by batches of documents and joined to the shards. A shard
   gives back sums per document, never probabilities of trigrams. This goes in SLICES of the
   documents, so that a slice's shuffle files are gone before the next.

A frequent middle token is split over shards by l, and its (m, r) go to each of them. A shard reads
its model, then requests as a stream: nothing of a frequent pair is gathered.

A document's perplexity per symbol (characters and one white space a word) is shrunk towards its language's mean by PRIOR_SYMBOLS
symbols, so that short texts are judged by more than chance. It is rejected above the QUANTILE of the trusted
documents of its language; languages with few trusted documents use the model and the quantile of all.
For means and quantiles, each half of the trusted documents is scored by a model of the other half, as a
model knows its own texts too well. Both halves' models are the same tables with other counts.

Cases: a null or empty text has no symbols, perplexity null, and is rejected; a null or unknown
language is scored with all languages' model; without trusted rows nothing is scored and every row
with text is kept; repeated rows get equal results, repeated labels count once (the worse one holds);
an empty table gives an empty result; other columns are ignored.

``Alphabet`` and ``model_table`` are the same model over 48 classes of characters in one dense table: small enough
to hold the sharded one against it.
"""

from __future__ import annotations

import struct
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import small_batches, stored
from touchline.llm.subwords import Subwords, vocabulary

SYMBOLS = 48
CELLS = SYMBOLS**3
# Languages with fewer trusted documents have no model of their own.
LEAST_TRUSTED = 50
# Languages whose unigrams are broadcast at once: 16 * 768 KB.
LANGUAGES_AT_ONCE = 16
# More languages than this (a key has 15 bits for them) use the model of all, those with the fewest trusted documents first.
LANGUAGES = 32_000
# Up to this many ids go to every executor; above, documents and ids meet in a shuffle.
BROADCAST_IDS = 2_000_000
SHARD_BYTES = 16 << 20
SLICES = 3
# Tokens and documents of a batch, trigrams that a task holds while counting.
BATCH_TOKENS = 1_500_000
BATCH_DOCS = 4_000
DOC_BITS = 12
COUNTED = 4_000_000
QUANTILE = 0.997
PRIOR_SYMBOLS = 60
BIN = 0.002
ALL = "*"

# Kinds of rows, in the order in which a shard reads them.
TRIGRAMS, BIGRAMS, REQUESTS, DOCUMENTS, ENDS, COUNTS = range(6)
SHARDED = "shard int, kind int, batch long, data binary"
SPACE, LETTER_A, OTHER_LETTER, CAPITAL, DIGIT = 0, 1, 27, 37, 38
STOP, COMMA, MARK, QUOTE, BRACKET, SIGN, BAR, CONTROL, REPEAT = 39, 40, 41, 42, 43, 44, 45, 46, 47
OTHER_LETTERS = CAPITAL - OTHER_LETTER
REPEATED_WORD = "\ue000"


def symbol(point: int) -> int:
    char = chr(point)
    if char == REPEATED_WORD:
        return REPEAT
    if char.isspace():
        return SPACE
    if "a" <= char <= "z":
        return LETTER_A + ord(char) - ord("a")
    if char.isupper() or char.istitle():
        return CAPITAL
    if char in ".…。":
        return STOP
    if char in ",;:，、；：":
        return COMMA
    if char in "!?！？":
        return MARK
    if char == "|":
        return BAR
    kind = unicodedata.category(char)
    if kind[0] in "LM":
        return OTHER_LETTER + point % OTHER_LETTERS
    if kind[0] == "N":
        return DIGIT
    if kind[0] == "C":
        return CONTROL
    if char in "'\"’‘“”«»-–—":
        return QUOTE
    return BRACKET if kind in ("Ps", "Pe") else SIGN


class Alphabet:
    """Symbols of code points; the table grows up to the highest one met."""

    def __init__(self):
        self.table = np.array([symbol(point) for point in range(0x500)], dtype=np.int32)

    def trigrams(self, text: str | None, training: bool = False) -> np.ndarray:
        """Trigrams of the text. In training, a run of equal words counts as one repetition, as a
        few texts with endless runs among the trusted ones would make repetition likely."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, dtype=np.int32)
        parts = [REPEATED_WORD if word == before else f" {word}" for before, word in zip([None, *words], words)]
        if training and REPEATED_WORD in parts:
            parts = [part for before, part in zip([None, *parts], parts) if not before == part == REPEATED_WORD]
        points = np.frombuffer(f" {''.join(parts)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if points.max() >= len(self.table):
            high = np.unique(points[points >= len(self.table)])
            found = self.table[np.minimum(points, len(self.table) - 1)]
            places = points >= len(self.table)
            found[places] = np.array([symbol(int(point)) for point in high], dtype=np.int32)[np.searchsorted(high, points[places])]
        else:
            found = self.table[points]
        return (found[:-2] * SYMBOLS + found[1:-1]) * SYMBOLS + found[2:]


def count_discounts(counts_of_counts) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(int(n), 1) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


def discounts(counts: np.ndarray) -> np.ndarray:
    return count_discounts([(counts == k).sum() for k in (1, 2, 3, 4)])


def interpolated(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis: discounted counts, the rest by ``lower``."""
    taken = discounts(counts)[np.minimum(counts, 3)]
    total = counts.sum(-1, keepdims=True)
    own = np.where(total > 0, (counts - taken) / np.maximum(total, 1), 0.0)
    rest = np.where(total > 0, taken.sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return own + rest * lower


def model_table(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of every trigram."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = (three > 0).sum(0)  # left neighbours of a bigram
    one = (two > 0).sum(0)
    p1 = interpolated(one[None, :], np.full((1, SYMBOLS), 1.0 / SYMBOLS))
    p2 = interpolated(two, p1)
    p3 = interpolated(three, p2[None, :, :])
    return -np.log(p3).reshape(-1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed planes of bytes."""
    planes, head = [], struct.pack("<B", len(arrays))
    for array in arrays:
        planes.append(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T.tobytes())
        head += struct.pack("<3sI", array.dtype.str[-2:].encode().ljust(3), len(array))
    whole = head + b"".join(planes)
    return struct.pack("<I", len(whole)) + pa.compress(whole, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    whole = pa.decompress(data[4:], decompressed_size=struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True)
    found, at = [], 1 + 7 * whole[0]
    for i in range(whole[0]):
        kind, n = struct.unpack_from("<3sI", whole, 1 + 7 * i)
        kind = np.dtype("<" + kind.decode().strip())
        planes = np.frombuffer(whole, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        found.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return found


def packed_keys(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Sorted keys as the first and the steps of all but the last token, and last tokens."""
    above = keys >> 16
    steps = np.diff(above, prepend=above[:1])
    # Steps inside a model take 32 bits.
    return packed(above[:1], steps.astype("<u8" if len(steps) and steps.max() >> 32 else "<u4"), (keys & 0xFFFF).astype("<u2"), *arrays)


def unpacked_keys(data: bytes) -> list[np.ndarray]:
    first, steps, last, *arrays = unpacked(data)
    return [np.cumsum(steps, dtype=np.int64) + (first[0] if len(first) else 0) << 16 | last, *arrays]


def keys_of(model: int, tokens: np.ndarray) -> np.ndarray:
    """Trigrams (l, m, r) as model, m, l, r; 15 bits and three times 16."""
    t = tokens.astype(np.int64)
    return ((model << 16 | t[1:-1]) << 16 | t[:-2]) << 16 | t[2:]


def without_left(keys: np.ndarray) -> np.ndarray:
    return keys >> 32 << 16 | keys & 0xFFFF


def sums(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of columns."""
    if not len(keys) or (keys[1:] > keys[:-1]).all():
        return [keys, *(column.astype(np.int64) for column in columns)]
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[firsts], *(np.add.reduceat(column[order].astype(np.int64), firsts) for column in columns)]


def variants(n0: np.ndarray, n1: np.ndarray) -> list[np.ndarray]:
    """Counts for all texts, for texts of half 0 (by half 1) and of half 1 (by half 0)."""
    return [n0 + n1, n1, n0]


def mixed(tokens: np.ndarray) -> np.ndarray:
    return ((tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


class Shards:
    """Shards of trigrams: a middle token with the share p of all tokens has about 2 p n of the n shards."""

    def __init__(self, n: int, weights: np.ndarray):
        self.n = n
        self.parts = np.clip(np.ceil(2 * n * weights / max(weights.sum(), 1)), 1, n).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        m, l = keys >> 32 & 0xFFFF, keys >> 16 & 0xFFFF
        return (mixed(m) + mixed(l) % self.parts[m]) % self.n

    def all_of(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``bigrams`` (model, m, r) and shards, for every shard of m."""
        m = bigrams >> 16 & 0xFFFF
        n = self.parts[m]
        places = np.repeat(np.arange(len(bigrams)), n)
        step = np.arange(len(places)) - np.repeat(np.cumsum(n) - n, n)
        return places, (mixed(m)[places] + step) % self.n


def dealt(shards: np.ndarray):
    """(shard, places in order) for every shard met."""
    order = np.argsort(shards.astype(np.uint16 if shards.max(initial=0) < 1 << 16 else np.int32), kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(shards[places[0]]), places


def record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["shard", "kind", "batch", "data"])


def _counted(held):
    """Trigrams of trusted texts, summed over many and dealt to their shards."""

    def rows(batches):
        words, pieces, shards = held.value
        subwords = Subwords(words, pieces)
        found: list[list[np.ndarray]] = [[], []]
        size = 0

        def emptied():
            by_half = [np.concatenate(part) if part else np.zeros(0, dtype=np.int64) for part in found]
            # Keys have 63 bits, so the half goes behind them.
            both = np.concatenate([part.astype(np.uint64) << np.uint64(1) | np.uint64(half) for half, part in enumerate(by_half)])
            both.sort()
            keys, of_half = (both >> np.uint64(1)).astype(np.int64), (both & np.uint64(1)).astype(np.int64)
            firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n1 = np.add.reduceat(of_half, firsts)
            n0 = np.diff(np.append(firsts, len(keys))) - n1
            keys = keys[firsts]
            for part in found:
                part.clear()
            return record(
                [(shard, TRIGRAMS, 0, packed_keys(keys[at], n0[at].astype("<u4"), n1[at].astype("<u4"))) for shard, at in dealt(shards.of(keys))]
            )

        for batch in batches:
            for models, half, text in zip(*(batch.column(name).to_pylist() for name in ("models", "half", "text"))):
                tokens, _ = subwords.tokens(text, training=True)
                if len(tokens):
                    for model in models:
                        found[half].append(keys_of(model, tokens))
                        size += len(tokens)
                if size > COUNTED:
                    yield emptied()
                    size = 0
        if size:
            yield emptied()

    return rows


def by_shard(batches):
    """(shard, rows of kind and data) of a partition sorted by shard; rows come one by one."""
    from itertools import groupby

    def every():
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("shard", "kind", "batch", "data")))

    return groupby(every(), key=lambda row: row[0])


def counts_of_counts(keys: np.ndarray, order: int, columns: list[np.ndarray]) -> list[tuple]:
    """A row per model: how many counts are 1 to 4, by variant."""
    models = keys >> 48 if order == 3 else keys >> 32
    return [
        (-1, COUNTS, int(model) << 2 | order, packed(np.array([[(column[models == model] == k).sum() for k in (1, 2, 3, 4)] for column in columns], dtype="<i8").reshape(-1)))
        for model in np.unique(models)
    ]


def _trigram_shards(held):
    """Sums of a shard's trigrams, and its bigrams for the shards of their last tokens."""

    def rows(batches):
        shards = held.value
        for shard, part in by_shard(batches):
            keys, n0, n1 = (np.concatenate(column) for column in zip(*(unpacked_keys(row[3]) for row in part)))
            keys, n0, n1 = sums(keys, n0, n1)
            counts = variants(n0, n1)
            yield record([(shard, TRIGRAMS, 0, packed_keys(keys, n0.astype("<u4"), n1.astype("<u4"))), *counts_of_counts(keys, 3, counts)])
            bigrams, *types = sums(without_left(keys), *(count > 0 for count in counts))
            types = [column.astype("<u4") for column in types]
            yield record(
                [(to, BIGRAMS, 0, packed_keys(bigrams[at], *(column[at] for column in types))) for to, at in dealt(mixed(bigrams & 0xFFFF) % shards.n)]
            )

    return rows


def _bigram_shards(held):
    """Sums of the bigrams of last tokens, for the shards of their first ones, and how many bigrams end so."""

    def rows(batches):
        shards = held.value
        for _, part in by_shard(batches):
            keys, *types = (np.concatenate(column) for column in zip(*(unpacked_keys(row[3]) for row in part)))
            keys, *types = sums(keys, *types)
            ends, *ones = sums(keys >> 32 << 16 | keys & 0xFFFF, *(column > 0 for column in types))
            rest = [(-1, ENDS, 0, packed_keys(ends, *(column.astype("<u4") for column in ones))), *counts_of_counts(keys, 2, types)]
            places, to = shards.all_of(keys)
            types = [column.astype("<u4") for column in types]
            yield record(rest + [(shard, BIGRAMS, 0, packed_keys(keys[places[at]], *(column[places[at]] for column in types))) for shard, at in dealt(to)])

    return rows


def discounted(counts: np.ndarray, contexts: np.ndarray, by_model: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What sorted ``contexts`` leave of each count, distinct contexts, and the share that each gives to the lower order."""
    firsts = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    taken = by_model[models, np.minimum(counts, 3)]
    total = np.add.reduceat(counts, firsts)
    n = np.diff(np.append(firsts, len(counts)))
    rest = np.where(total > 0, np.add.reduceat(taken, firsts) / np.maximum(total, 1), 1.0)
    return (counts - taken) / np.maximum(np.repeat(total, n), 1), contexts[firsts], rest


def found_at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return places, keys[places] == wanted


class ShardModel:
    """Probabilities of the trigrams of a shard.

    ``lower`` holds models' numbers, their discounts (order 3 and 2, variant, model, count) and the
    unigrams (variant, model, token).
    """

    def __init__(self, trigrams: list[bytes], bigrams: list[bytes], lower):
        self.names, by_order, self.unigrams = lower
        empty = np.zeros(0, dtype=np.int64)
        keys, n0, n1 = (np.concatenate(c) for c in zip(*map(unpacked_keys, trigrams))) if trigrams else (empty,) * 3
        three, n0, n1 = self.inside(48, keys, n0, n1)
        keys, *types = (np.concatenate(c) for c in zip(*map(unpacked_keys, bigrams))) if bigrams else (empty,) * 4
        two, *types = self.inside(32, keys, *types)
        # By order, the lower one first: keys, how a trigram's key and context are found, and what each variant leaves.
        self.orders = []
        for keys, of_trigram, context_of, by_variant, columns, bits in (
            (two, without_left, lambda keys: keys >> 32, by_order[1], types, 32),
            (three, lambda keys: keys, lambda keys: keys >> 16, by_order[0], variants(n0, n1), 48),
        ):
            if len(keys):
                found = [discounted(column, keys >> 16, taken, self.place(keys >> bits)) for column, taken in zip(columns, by_variant)]
                self.orders.append((keys, of_trigram, context_of, found))

    def inside(self, bits: int, keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        """Sums over the keys of the models at hand."""
        found = np.isin(keys >> bits, self.names)
        return sums(keys, *columns) if found.all() else sums(keys[found], *(column[found] for column in columns))

    def place(self, models: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, models)

    def costs(self, keys: np.ndarray, wanted: list[np.ndarray | slice]):
        """Negative log probabilities of the trigrams at the ``wanted`` places, variant by variant."""
        met = []
        for table, of_trigram, context_of, by_variant in self.orders:
            met.append((*found_at(by_variant[0][1], context_of(keys)), *found_at(table, of_trigram(keys)), by_variant))
        models, last = self.place(keys >> 48), keys & 0xFFFF
        for v, places in enumerate(wanted):
            found = self.unigrams[v][models[places], last[places]].astype(np.float64)
            for above, above_known, at, known, by_variant in met:
                own, _, rest = by_variant[v]
                found *= np.where(above_known[places], rest[above[places]], 1.0)
                found += np.where(known[places], own[at[places]], 0.0)
            yield places, -np.log(found)


def _requests(held):
    """Trigrams of batches of documents, counted per document and dealt to the shards; a row per batch holds its documents."""

    def rows(batches):
        words, pieces, shards = held.value
        subwords = Subwords(words, pieces)
        first = TaskContext.get().partitionId() << 32
        documents: list[tuple] = []
        found: list[np.ndarray] = []
        size, number = 0, 0

        def emptied():
            # Documents of a half side by side, so that a request's halves take a few bytes.
            by_half = sorted(range(len(documents)), key=lambda i: documents[i][2])
            whole = [np.array(column, dtype=kind) for column, kind in zip(zip(*(documents[i] for i in by_half)), ("<i8", "<i4", "u1", "<i8"))]
            halves = whole[2]
            own = first + number
            out = [(own % shards.n, DOCUMENTS, own, packed(*whole))]
            if size:
                # Tokens and the document's place share 64 bits, so each model's are sorted as plain numbers.
                by_model: dict[int, list[np.ndarray]] = {}
                for place, i in enumerate(by_half):
                    by_model.setdefault(documents[i][1], []).append(found[i] << DOC_BITS | place)
                columns = []
                for model in sorted(by_model):
                    both = np.concatenate(by_model[model])
                    both.sort()
                    firsts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
                    times = np.diff(np.append(firsts, len(both)))
                    both = both[firsts]
                    columns.append((both >> DOC_BITS | model << 48, both & (1 << DOC_BITS) - 1, times))
                keys, docs, times = (np.concatenate(column) for column in zip(*columns))
                times = times.astype("<u4" if times.max() > 255 else "u1")
                for shard, at in dealt(shards.of(keys)):
                    out.append((shard, REQUESTS, own, packed_keys(keys[at], docs[at].astype("<u2"), times[at], halves)))
            documents.clear()
            found.clear()
            return record(out)

        for batch in batches:
            for row_key, model, half, text in zip(*(batch.column(name).to_pylist() for name in ("row_key", "model", "half", "text"))):
                tokens, n = subwords.tokens(text)
                keys = keys_of(0, tokens) if n else np.zeros(0, dtype=np.int64)
                documents.append((row_key, model, half + 1, n))
                found.append(keys)
                size += len(keys)
                if size > BATCH_TOKENS or len(documents) == BATCH_DOCS:
                    yield emptied()
                    size, number = 0, number + 1
        if documents:
            yield emptied()

    return rows


def _answers(held):
    """Sums of costs per document: by the whole model, and by the other half's for trusted documents."""

    def rows(batches):
        for shard, part in by_shard(batches):
            tables: dict[int, list[bytes]] = {TRIGRAMS: [], BIGRAMS: []}
            model = None
            for _, kind, batch, data in part:
                if kind in tables:
                    tables[kind].append(data)
                    continue
                if kind == DOCUMENTS:
                    yield record([(-1, DOCUMENTS, batch, data)])
                    continue
                model = model or ShardModel(tables[TRIGRAMS], tables[BIGRAMS], held.value)
                keys, docs, times, halves = unpacked_keys(data)
                of = halves[docs]
                wanted = [slice(None), np.flatnonzero(of == 1), np.flatnonzero(of == 2)]
                whole, *crossed = (np.bincount(docs[at], weights=cost * times[at], minlength=len(halves)) for at, cost in model.costs(keys, wanted))
                out = (whole, sum(crossed))
                met = np.unique(docs)
                yield record([(shard, REQUESTS, batch, packed(met.astype("<u2"), *(column[met].astype("<f4") for column in out)))])

    return rows


SCORES = "row_key long, model int, half int, n_symbols long, total double, crossed double"


def _totals(batches):
    """Sums of a batch's documents over the shards, in the order of shards; the documents come first."""
    from itertools import groupby

    def every():
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("batch", "shard", "data")))

    for _, part in groupby(every(), key=lambda row: row[0]):
        row_keys, models, halves, n = unpacked(next(part)[2])
        total, crossed = np.zeros(len(n)), np.zeros(len(n))
        for _, _, data in part:
            docs, whole, other = unpacked(data)
            total[docs] += whole
            crossed[docs] += other
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_keys), pa.array(models), pa.array(halves.astype(np.int32) - 1), pa.array(n), pa.array(total), pa.array(crossed)],
            names=["row_key", "model", "half", "n_symbols", "total", "crossed"],
        )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never labelled bad or toxic."""
    worst = labels.groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return worst.where("quality = 1 and toxic = 0 and trusted_id is not null").select("trusted_id")


def with_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ids are trusted."""
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi")


def half_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)).cast("int")


def row_key() -> Column:
    """A key that equal rows share."""
    return F.xxhash64("doc_id", F.coalesce("lang", F.lit(ALL)), "text")


def swept(df: DataFrame, name: str) -> DataFrame:
    """``stored``, without the shuffle files that it needed."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def to_shards(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "shard").sortWithinPartitions("shard", "kind", "batch")


def trained(texts: DataFrame, shards: Shards, tokens: tuple) -> DataFrame:
    """Rows of the model of trusted ``texts`` (models, half, text): trigrams and bigrams by shard, ends and counts of counts."""
    broadcast = texts.sparkSession.sparkContext.broadcast
    counted = texts.select("models", "half", "text").mapInArrow(_counted(broadcast((*tokens, shards))), SHARDED)
    three = swept(to_shards(counted, shards.n).mapInArrow(_trigram_shards(broadcast(shards)), SHARDED), "kn-trigrams")
    two = swept(to_shards(three.where(F.col("kind") == BIGRAMS), shards.n).mapInArrow(_bigram_shards(broadcast(shards)), SHARDED), "kn-bigrams")
    return three.where(F.col("kind") != BIGRAMS).unionByName(two)


def lower_orders(model: DataFrame, names: list[int], size: int) -> tuple:
    """Discounts and unigrams of the models ``names`` for ``ShardModel``; a model has at most 65,536 unigrams."""
    places = {name: i for i, name in enumerate(names)}
    counts = np.zeros((2, 3, len(names), 4), dtype=np.int64)
    in_names = F.shiftright("batch", 2).isin(names)
    for row in model.where((F.col("kind") == COUNTS) & in_names).select("batch", "data").toLocalIterator():
        counts[3 - (row["batch"] & 3), :, places[row["batch"] >> 2]] += unpacked(row["data"])[0].reshape(3, 4)
    by_order = np.array([[[count_discounts(found) for found in by_model] for by_model in by_variant] for by_variant in counts])
    ones = np.zeros((3, len(names), size), dtype=np.int64)
    for row in model.where(F.col("kind") == ENDS).select("data").toLocalIterator():
        keys, *found = unpacked_keys(row["data"])
        inside = np.isin(keys >> 16, names)
        at = np.searchsorted(names, keys[inside] >> 16)
        for v in range(3):
            ones[v, at, keys[inside] & 0xFFFF] += found[v][inside]
    unigrams = np.array([[interpolated(of_model[None, :], np.full((1, size), 1.0 / size))[0] for of_model in by_variant] for by_variant in ones])
    return np.array(names), by_order, unigrams.astype(np.float32)


def scored(docs: DataFrame, model: DataFrame, names: list[int], shards: Shards, tokens: tuple, size: int) -> DataFrame:
    """Sums of costs of ``docs`` (row_key, model, half or -1, text), one row for equal rows."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    found = None
    vocabulary_held = broadcast((*tokens, shards))
    tables = model.where(F.col("kind").isin(TRIGRAMS, BIGRAMS))
    for at in range(0, len(names), LANGUAGES_AT_ONCE):
        group = names[at : at + LANGUAGES_AT_ONCE]
        lower = broadcast(lower_orders(model, group, size))
        for piece in range(SLICES):
            inside = docs.where(F.col("model").between(group[0], group[-1]) & (F.pmod("row_key", F.lit(SLICES)) == piece))
            requests = inside.select("row_key", "model", "half", "text").mapInArrow(_requests(vocabulary_held), SHARDED)
            answers = to_shards(tables.unionByName(requests), shards.n).mapInArrow(_answers(lower), SHARDED)
            # The documents of a batch have the shard -1.
            totals = answers.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(_totals, SCORES)
            part = swept(totals, "kn-scores")
            found = part if found is None else found.unionByName(part)
    return found.groupBy("row_key").agg(*(F.min(name).alias(name) for name in ("model", "half", "n_symbols", "total", "crossed")))


def thresholds(scores: DataFrame, quantile: float) -> DataFrame:
    """The score that ``quantile`` of a model's (trusted) rows stay below, from a histogram of all of them; -1 stands for all models."""
    bins = scores.groupBy("model", F.floor(F.col("score") / BIN).alias("bin")).agg(F.sum("weight").alias("n"))
    pooled = bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(-1).alias("model"), "bin", "n")

    def reached(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        at = int(np.searchsorted(part["n"].cumsum().to_numpy(), quantile * part["n"].sum(), "left"))
        return pd.DataFrame({"model": [key[0]], "threshold": [(float(part["bin"].iloc[at]) + 1) * BIN]})

    return bins.unionByName(pooled).groupBy("model").applyInPandas(reached, "model int, threshold double")


def shrunk(total: Column, mean: Column) -> Column:
    return (total + PRIOR_SYMBOLS * mean) / (F.col("n_symbols") + PRIOR_SYMBOLS)


def judged(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame | None:
    """row_key, n_symbols, perplexity, score, threshold and kept, one row for equal rows; None without trusted rows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("lang", F.lit(ALL)).alias("lang"), "text", row_key().alias("row_key"))
    trusted = stored(trusted_ids(labels), "kn-trusted")
    texts = with_trusted(docs, trusted).withColumn("half", half_of(F.col("doc_id")))
    languages = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_TRUSTED) & (F.col("lang") != ALL))
    own = sorted(row["lang"] for row in languages.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not own and not texts.limit(1).count():
        return None
    # Model 0 is of all languages; it is built where some row needs it.
    number = F.coalesce(F.create_map(*[F.lit(x) for i, lang in enumerate(own) for x in (lang, i + 1)])[F.col("lang")], F.lit(0)) if own else F.lit(0)
    docs = docs.withColumn("model", number)
    size, others = docs.agg(F.sum(F.octet_length("text")), F.max(F.col("model") == 0)).first()
    names = ([0] if others else []) + list(range(1, len(own) + 1))
    words, pieces, weights = vocabulary(texts)
    shards = Shards(max(1, -(-size // SHARD_BYTES)), weights)
    models = F.filter(F.array(number, F.lit(0)) if others else F.array(number), lambda x: x >= (0 if others else 1))
    model = trained(texts.withColumn("models", F.array_distinct(models)), shards, (words, pieces))
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    known = docs.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    half = F.when(F.col("trusted_id").isNull(), F.lit(-1)).otherwise(half_of(F.col("doc_id")))
    scores = swept(scored(known.withColumn("half", half), model, names, shards, (words, pieces), len(weights)), "kn-totals")
    with_half = scores.where("half >= 0 and n_symbols > 0")
    means = with_half.groupBy("model").agg((F.sum("crossed") / F.sum("n_symbols")).alias("mean"))
    pooled = with_half.agg((F.sum("crossed") / F.sum("n_symbols")).alias("mean"))
    of_model = {row["model"]: row["mean"] for row in means.unionByName(pooled.select(F.lit(-1).alias("model"), "mean")).collect()}
    valued = lambda values: F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("model")], F.lit(values[-1])).cast("double")
    crossed = with_half.select("model", F.lit(1).alias("weight"), shrunk(F.col("crossed"), valued(of_model)).alias("score"))
    limits = {row["model"]: row["threshold"] for row in thresholds(crossed, quantile).collect()}
    if 0 in limits:
        limits[0] = limits[-1]
    if not limits:
        return None
    has = F.col("n_symbols") > 0
    return scores.select(
        "row_key", "n_symbols",
        F.when(has, F.exp(F.col("total") / F.col("n_symbols"))).alias("perplexity"),
        F.when(has, shrunk(F.col("total"), valued(of_model))).alias("score"),
        valued(limits).alias("threshold"),
    ).withColumn("kept", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False)))


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, score (shrunk mean cost), threshold and kept of every row."""
    found = judged(docs, labels, quantile)
    if found is None:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), "lang", F.lit(None).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"),
            F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), has_words(F.col("text")).alias("kept"),
        )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", row_key().alias("row_key"))
    return rows.join(found, "row_key").drop("row_key")


def good_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps; where few are rejected, their keys go to the texts."""
    found = judged(docs, labels, quantile)
    if found is None:
        return docs.where(has_words(F.col("text")))
    rejected = stored(found.where("not kept").select(F.col("row_key").alias("kn_rejected")), "kn-rejected")
    few = rejected.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(rejected) if few else rejected, row_key() == F.col("kn_rejected"), "left_anti")
