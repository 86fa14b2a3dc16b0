"""Near-duplicates by SimHash fingerprints and BK-trees.

1. A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles.
2. Only different fingerprints go on; exact copies meet in a minimum with map-side partials.
3. Cut into six blocks, two fingerprints that differ in at most four bits agree in two blocks at
   least. Each of the 15 block pairs and its value is a shard. A shard that is too large is dealt
   again by five blocks of the rotated fingerprint, of which one agrees at least.
4. Every shard holds its fingerprints in a BK-tree (children keyed by their distance to the
   parent). A search follows only edges within the radius, and leaves out subtrees whose members
   are all taken: each fingerprint is linked to a neighbour once, so a dense group of n members
   gives n - 1 links instead of n * n.
5. Links are closed by large-star and small-star rounds over written tables.

The trees stay where their shard is instead of being broadcast: broadcast, every tree would be
searched by every fingerprint, which grows with the square of the corpus.

Cases: null, empty and blank texts have fingerprint zero and link to each other like any others;
repeated rows keep their own rows; null ids are kept and never name a class; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import stored

SHINGLE = 4
RADIUS = 4
SEED = 42
# A shard with more different fingerprints is dealt again.
SHARD_LIMIT = 2_000
REDEALS = 3
# Up to this many ids of dropped documents go to every executor; above, documents and ids meet in a shuffle.
BROADCAST_IDS = 2_000_000
PRINTS = "doc_id long, fp long"
WIDTHS = (11, 11, 11, 11, 10, 10)
REDEAL_WIDTHS = (13, 13, 13, 13, 12)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [end - 1 for end in accumulate(len(word) + 1 for word in words)]
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    rows = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def hashed(batches):
        for batch in batches:
            prints = [fingerprint(text, shingle) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, PRINTS)


class BKTree:
    """Fingerprints by their distance to the parent; members can be taken out."""

    def __init__(self, prints: list[int]):
        self.prints = prints
        self.children: list[dict[int, int]] = [{} for _ in prints]
        self.parent = [-1] * len(prints)
        self.below = [0] * len(prints)  # members not taken, the node itself included
        self.free = [True] * len(prints)
        for node in range(len(prints)):
            self._insert(node)

    def _insert(self, node: int) -> None:
        at, own = 0, self.prints[node]
        while node:
            self.below[at] += 1
            distance = (self.prints[at] ^ own).bit_count()
            following = self.children[at].get(distance)
            if following is None:
                self.children[at][distance] = node
                self.parent[node] = at
                break
            at = following
        self.below[node] += 1

    def take(self, node: int) -> None:
        self.free[node] = False
        while node >= 0:
            self.below[node] -= 1
            node = self.parent[node]

    def near(self, own: int, radius: int) -> list[int]:
        """Members not taken within the radius."""
        if not self.below[0]:
            return []
        found, waiting = [], [0]
        while waiting:
            at = waiting.pop()
            distance = (self.prints[at] ^ own).bit_count()
            if distance <= radius and self.free[at]:
                found.append(at)
            children = self.children[at]
            if children:
                for edge in range(max(0, distance - radius), distance + radius + 1):
                    child = children.get(edge)
                    if child is not None and self.below[child]:
                        waiting.append(child)
        return found


def shard_links(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join exactly the (unsigned) fingerprints connected within the shard."""
    if len(prints) == 2:
        return [(prints[0], prints[1])] if (prints[0] ^ prints[1]).bit_count() <= radius else []
    tree, links = BKTree(prints), []
    for start in range(len(prints)):
        if not tree.free[start]:
            continue
        tree.take(start)
        waiting = [start]
        while waiting:
            at = waiting.pop()
            for found in tree.near(prints[at], radius):
                tree.take(found)
                links.append((prints[start], prints[found]))
                waiting.append(found)
    return links


def block(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def shard_keys(fp: Column) -> Column:
    """The 15 shards of a fingerprint."""
    offsets = [0, *accumulate(WIDTHS)][:-1]
    keys = []
    for number, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2)):
        pair = F.shiftleft(block(fp, offsets[i], WIDTHS[i]), 11).bitwiseOR(block(fp, offsets[j], WIDTHS[j]))
        keys.append(F.lit(number << 22).cast("long").bitwiseOR(pair))
    return F.array(*keys)


def redealt_keys(fp: Column, key: Column, level: int) -> Column:
    turn = 7 * level
    turned = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn))
    offsets = [0, *accumulate(REDEAL_WIDTHS)][:-1]
    return F.array(*[F.xxhash64(key, F.lit(number), block(turned, offset, width)) for number, (offset, width) in enumerate(zip(offsets, REDEAL_WIDTHS))])


def _sharded_links(radius: int):
    def links(batches):
        held_key, held = None, []

        def closed(prints):
            return shard_links(prints, radius) if len(prints) > 1 else []

        for batch in batches:
            keys = batch.column("key").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                key = keys[a]
                if held_key is not None and key == held_key:
                    held += prints[a:b].tolist()
                    continue
                found += closed(held)
                held_key, held = key, prints[a:b].tolist() if b - a > 1 or b == len(keys) else []
            yield _link_batch(found)
        yield _link_batch(closed(held))

    return links


def _link_batch(found):
    """Unsigned pairs as signed columns, the larger one first."""
    pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["a", "b"])


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a > b) between different fingerprints; they connect what lies within the radius, step by step.

    ``radius`` may be at most four: the shards guarantee no more.
    """
    if radius > RADIUS:
        raise ValueError("the shards find distances up to four bits")
    spark = prints.sparkSession
    dealt = prints.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    parts = []
    for level in range(1, REDEALS + 1):
        crowded = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_LIMIT).select("key"), "bk-crowded")
        if crowded.isEmpty():
            break
        parts.append(dealt.join(crowded, "key", "left_anti"))
        dealt = stored(
            dealt.join(crowded, "key", "left_semi").select("fp", F.explode(redealt_keys(F.col("fp"), F.col("key"), level)).alias("key")),
            "bk-redealt",
        )
    parts.append(dealt)
    found = None
    for part in parts:
        part = part.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(_sharded_links(radius), "a long, b long")
        found = part if found is None else found.unionByName(part)
    return stored(found.distinct(), "bk-links")


def closure(links: DataFrame) -> DataFrame:
    """(a, b): every node of a component with its smallest node, for nodes that aren't the smallest."""
    edges, seen = links.select("a", "b"), None
    while True:
        both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "star-both")
        lowest = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-low")
        large = stored(
            both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "star-large"
        )
        lowest = stored(large.groupBy("a").agg(F.min("b").alias("m")), "star-low")
        met = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(met.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "star-small")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return edges
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest id reachable over links) of every row."""
    prints = stored(fingerprints(docs, shingle), "simhash")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-first")
    stars = closure(fingerprint_links(firsts.select("fp"), radius))
    members = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    members = stored(members.join(firsts, "fp"), "simhash-members")
    smallest = stored(members.groupBy("root").agg(F.min("first_doc").alias("smallest")), "simhash-smallest")
    linked = stored(members.join(smallest, "root").select("fp", "smallest"), "simhash-linked")
    classes = stored(firsts.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "first_doc").alias("component_id")), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with the document of the smallest id of each group; rows of one id count as copies,
    rows without an id stay."""
    found = near_duplicates(docs, shingle, radius)
    dropped = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct(), "simhash-dropped")
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if few else dropped, F.col("doc_id") == F.col("dropped_id"), "left_anti")
    again = stored(
        found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id"), "simhash-again"
    )
    if again.isEmpty():
        return kept
    same = F.col("doc_id") == F.col("again_id")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
