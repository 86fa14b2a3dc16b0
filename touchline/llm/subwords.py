"""Subwords: the tokens of the Kneser-Ney model.

A vocabulary holds the WORDS most frequent words met at least twice in trusted text and the PIECES
that stand for most of the other words. A word outside it is spelled from its left end by the
longest pieces of up to PIECE characters, a character without a piece by its UTF-8 bytes. So no word and
no character is folded or left out, whatever the script, and a token takes 16 bits however large the corpus.
A word's first piece begins with a space; texts that differ by more than white space differ as tokens.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored

# Tokens 0 to 255 are bytes.
EDGE, REPEAT, FIRST = 256, 257, 258
WORDS = 57_000
PIECES = 8_000
PIECE = 4
# Longer words are always spelled.
LONGEST_WORD = 40
# Spelled words that a task remembers, and words that it counts before it hands them on.
REMEMBERED = 500_000
# A word equal to the one before; no word is a space.
REPEATED = " "


def parts(text: str | None, training: bool = False) -> list[str]:
    """Words, with REPEATED for a repeated one. In training, a run of equal words counts as one
    repetition, as a few texts with endless runs among the trusted ones would make repetition likely."""
    found = (text or "").split()
    repeated = list(map(eq, found, islice(found, 1, None)))
    if True not in repeated:
        return found
    for at in compress(range(1, len(found)), repeated):
        found[at] = REPEATED
    if training:
        found = [part for before, part in zip([None, *found], found) if not before == part == REPEATED]
    return found


class Subwords(dict):
    """Tokens of words as bytes; spelled words are remembered up to a limit."""

    def __init__(self, words: list[str], pieces: list[str]):
        super().__init__()
        self.size = FIRST + len(words) + len(pieces)
        coded = np.arange(FIRST, self.size).astype("<u2").tobytes()
        coded = [coded[at : at + 2] for at in range(0, len(coded), 2)]
        self.words, self.pieces = dict(zip(words, coded)), dict(zip(pieces, zip(coded[len(words) :], map(len, pieces))))
        self.refill()

    @staticmethod
    def coded(*tokens: int) -> bytes:
        return np.array(tokens, dtype="<u2").tobytes()

    def refill(self):
        self.clear()
        self.update(self.words)
        self[REPEATED] = self.coded(REPEAT)

    def __missing__(self, word: str) -> bytes:
        rest, found, at, get = f" {word}", [], 0, self.pieces.get
        end = len(rest)
        while at < end:
            # At the end slices are shorter than they ask for.
            piece = get(rest[at : at + 4]) or get(rest[at : at + 3]) or get(rest[at : at + 2]) or get(rest[at])
            if piece is None:
                found.append(self.coded(*rest[at].encode("utf-8")))
                at += 1
            else:
                found.append(piece[0])
                at += piece[1]
        if len(self) > REMEMBERED:
            self.refill()
        tokens = b"".join(found)
        if len(word) <= LONGEST_WORD:
            self[word] = tokens
        return tokens

    def tokens(self, text: str | None, training: bool = False) -> tuple[np.ndarray, int]:
        """Tokens between edges (two before, one behind), and the symbols they stand for; none without words."""
        found = parts(text, training)
        if not found:
            return np.zeros(0, dtype=np.uint16), 0
        symbols = sum(map(len, found)) + len(found) - found.count(REPEATED)
        coded = b"".join(map(self.__getitem__, found))
        return np.frombuffer(self.coded(EDGE, EDGE) + coded + self.coded(EDGE), dtype="<u2"), symbols


def _summed(counts_of):
    """Counts by partition, handed on whenever many are held."""

    def rows(batches):
        held: Counter = Counter()

        def emptied():
            names, counts = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["part", "n"])

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                counts_of(held, *row)
                if len(held) > REMEMBERED:
                    yield emptied()
        if held:
            yield emptied()

    return rows


def _words(held: Counter, text: str | None):
    held.update(parts(text, True))
    held.pop(REPEATED, None)


def _pieces(held: Counter, word: str, n: int):
    rest = f" {word}"
    found = [rest[at : at + length] for length in range(1, PIECE + 1) for at in range(len(rest) - length + 1)]
    if n == 1:
        held.update(found)
        return
    for piece in found:
        held[piece] += n


def vocabulary(texts: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Words, pieces and how often each token was counted, from ``text`` of trusted texts."""
    counts = stored(texts.select("text").mapInArrow(_summed(_words), "part string, n long").groupBy("part").agg(F.sum("n").alias("n")), "kn-words")
    frequent = counts.where((F.col("n") > 1) & (F.length("part") <= LONGEST_WORD))
    words = [(row["part"], row["n"]) for row in frequent.orderBy(F.desc("n"), "part").limit(WORDS).collect()]
    chosen = texts.sparkSession.createDataFrame([(word,) for word, _ in words], "part string")
    others = counts.join(F.broadcast(chosen), "part", "left_anti")
    spelled = others.select("part", "n").mapInArrow(_summed(_pieces), "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    pieces = [(row["part"], row["n"]) for row in spelled.orderBy(F.desc(F.col("n") * F.length("part")), "part").limit(PIECES).collect()]
    weights = np.ones(FIRST + len(words) + len(pieces), dtype=np.int64)
    weights[FIRST:] = [n for _, n in words + pieces]
    # Bytes, edges and repetitions aren't counted: as much as the 64th part each.
    weights[:FIRST] = weights.sum() // 64
    return [word for word, _ in words], [piece for piece, _ in pieces], weights
