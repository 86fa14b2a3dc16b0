"""Quality rules judged by an isolation forest.

Every text is reduced to rule statistics (words, symbols, repeated lines and word windows,
capitals, word lengths). A forest of random splits is grown on a bounded, documented sample of
labelled rows, in which rows labelled bad are thinned to a small share, as an isolation forest
isolates what is rare. The average path length over the trees gives each document an anomaly
score, and labelled rows (all of them, as a histogram of scores) calibrate the threshold.

Only the narrow statistics are stored; texts are read once and never shuffled.

Cases: a null or empty text has no words and fails the base rules; repeated rows get equal results;
without labelled rows of both kinds the forest rejects nothing and the base rules decide alone;
an empty table gives an empty result; ``doc_id`` may be null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored, unit_interval

TREES = 128
TREE_ROWS = 256
# Bound of the rows that the forest may be grown on, for each label.
SAMPLE_ROWS = 20_000
# Share of rows labelled bad among the rows of a tree.
ANOMALY_SHARE = 0.04
SCORE_BINS = 2_000
# The threshold must keep this share of the rows labelled good, if any threshold above it can.
KEEP_GOOD = 0.998
SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("symbol_rate", "line_rate", "repeat_rate", "upper_rate", "word_length", "distinct_rate", "top_rate")
STATS = f"{BASE}, {', '.join(f'{name} double' for name in FEATURES)}"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, end = Counter(windows), 0, 0
    for start, window in enumerate(windows):
        if times[window] > 1:
            covered += start + WINDOW - max(start, end)
            end = start + WINDOW
    return covered


def capital_letters(text: str) -> int:
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        return sum(map(str.isupper, text))
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in (text, lower)]
    return int(np.count_nonzero(points[0] != points[1]))


def rule_statistics(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(text.count(space) for space in SPACES)
    n_symbols = sum(text.count(symbol) for symbol in SYMBOLS[1:-1])
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    n_dup_lines = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    capitals = capital_letters(text)
    counts = Counter(words)
    # Shrunk rates: a few odd words weigh little in a short text.
    shrunk = n + 10.0
    return (
        n, word_chars, n_symbols, n_dup_lines, n_repeat,
        n_symbols / shrunk,
        n_dup_lines / (len(lines) + 3.0),
        n_repeat / shrunk,
        capitals / (word_chars + 60.0),
        (word_chars + 50.0) / shrunk,
        (len(counts) + 10.0) / shrunk / (1.0 + math.log1p(n / 50.0)) ** -0.5,
        (max(counts.values(), default=0)) / shrunk,
    )


def _statistics(batches):
    names = [part.split()[0] for part in STATS.split(", ")]
    for batch in batches:
        rows = [rule_statistics(text) for text in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) or [()] * (len(names) - 1)
        arrays = [batch.column("doc_id")] + [
            pa.array(column, pa.int64() if i < 5 else pa.float64()) for i, column in enumerate(columns)
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistics, STATS)


@dataclass
class Forest:
    """Trees in arrays: feature (-1 in leaves), cut, left child (right is the next one), path length at leaves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    height: int

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, cut, left, length in zip(self.feature, self.cut, self.left, self.length):
            node = np.zeros(len(rows), dtype=np.int32)
            for _ in range(self.height):
                split = feature[node]
                goes_right = rows[np.arange(len(rows)), np.maximum(split, 0)] >= cut[node]
                node = np.where(split < 0, node, left[node] + goes_right)
            total += length[node]
        return total / len(self.feature)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.path_lengths(rows) / average_path(TREE_ROWS))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(sample: np.ndarray, rng: np.random.Generator, height: int) -> list[tuple]:
    nodes: list[list] = [[-1, 0.0, 0, 0.0]]
    waiting = [(0, sample, 0)]
    while waiting:
        at, rows, depth = waiting.pop()
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_features = np.flatnonzero(high > low)
        if depth >= height or len(rows) <= 1 or not len(open_features):
            nodes[at][3] = depth + average_path(len(rows))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        cut = cut if cut > low[feature] else float(high[feature])
        left = len(nodes)
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        nodes[at][:3] = [feature, cut, left]
        right_side = rows[:, feature] >= cut
        waiting += [(left, rows[~right_side], depth + 1), (left + 1, rows[right_side], depth + 1)]
    return [tuple(node) for node in nodes]


def grow_forest(good: np.ndarray, bad: np.ndarray, seed: int) -> Forest:
    height = math.ceil(math.log2(TREE_ROWS)) + 4
    rng = np.random.default_rng(seed)
    n_bad = min(len(bad), max(1, round(TREE_ROWS * ANOMALY_SHARE)))
    trees = []
    for _ in range(TREES):
        rows = [good[rng.choice(len(good), min(len(good), TREE_ROWS - n_bad), replace=False)], bad[rng.choice(len(bad), n_bad, replace=False)]]
        trees.append(grow(np.concatenate(rows), rng, height))
    widest = max(map(len, trees))
    padded = [tree + [(-1, 0.0, 0, 0.0)] * (widest - len(tree)) for tree in trees]
    field = lambda i, kind: np.array([[node[i] for node in tree] for tree in padded], dtype=kind)
    return Forest(field(0, np.int32), field(1, float), field(2, np.int32), field(3, float), height)


def labelled_sample(labelled: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE_ROWS rows of each label, the ones with the smallest hash of their id."""
    parts = []
    for quality in (1, 0):
        kept = labelled.where(F.col("quality") == quality).select(*FEATURES, unit_interval(seed, F.col("doc_id")).alias("draw"), "doc_id")
        rows = kept.orderBy("draw", "doc_id", *FEATURES).limit(SAMPLE_ROWS).collect()
        parts.append(np.array([[row[name] for name in FEATURES] for row in rows], dtype=float).reshape(-1, len(FEATURES)))
    return parts[0], parts[1]


def with_scores(stats: DataFrame, forest: Forest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)

    def scored(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(held.value.scores(rows), pa.float64())], names=[*batch.schema.names, "anomaly_score"]
            )

    return stats.mapInArrow(scored, stats.schema.simpleString()[7:-1].replace(":", " ") + ", anomaly_score double")


def calibrated(histogram: dict[int, tuple[int, int]]) -> float:
    """Score from which documents are rejected.

    ``histogram`` has (good, bad) counts by score bin. Of the thresholds that keep KEEP_GOOD of the
    good rows, the one with the most bad rows rejected less good rows lost; above every score if none rejects any.
    """
    all_good = sum(good for good, _ in histogram.values())
    all_bad = sum(bad for _, bad in histogram.values())
    best, threshold, lost, caught = 0.0, 2.0, 0, 0
    bins = sorted(histogram, reverse=True)
    for at, here in enumerate(bins):
        lost += histogram[here][0]
        caught += histogram[here][1]
        if lost > (1.0 - KEEP_GOOD) * all_good:
            break
        gain = caught / max(all_bad, 1) - lost / max(all_good, 1)
        if gain > best:
            below = bins[at + 1] if at + 1 < len(bins) else here - 1
            # Half way to the next occupied bin.
            best, threshold = gain, ((here + below + 1) / 2) / SCORE_BINS
    return threshold


def judge(docs: DataFrame, labels: DataFrame, seed: int = 29) -> DataFrame:
    """Statistics, anomaly score and verdict of every row of ``docs``."""
    stats = stored(statistics(docs), "rule-statistics")
    quality = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stored(stats.join(quality, "doc_id"), "rule-labelled")
    good, bad = labelled_sample(labelled, seed)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    if not len(good) or not len(bad):
        return stats.select(
            "doc_id", *[c for c in stats.columns if c.startswith(("n_", "word_chars"))],
            base_failed.alias("base_failed"), (~base_failed).alias("kept"), F.lit(0.0).alias("anomaly_score"),
        )
    forest = grow_forest(good, bad, seed)
    bins = F.floor(F.col("anomaly_score") * SCORE_BINS).cast("int")
    # Rows that the base rules reject anyway don't shape the threshold.
    counted = with_scores(labelled.where(~base_failed), forest).groupBy(bins.alias("bin")).agg(
        F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")
    )
    threshold = calibrated({row["bin"]: (row["good"], row["n"] - row["good"]) for row in counted.collect()})
    return with_scores(stats, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.col("anomaly_score") < threshold)).alias("kept"),
        "anomaly_score",
    )
