"""Near-duplicates by five-word shingles: SimHash BK-trees find candidates, whole shingle sets decide.

1. A text's node is the 128-bit digest of its set of shingle hashes; texts of one set are copies and
   go on as one node, with a SimHash fingerprint of the set and BANDS keys of ROWS minima each.
2. Each key is a shard. Two sets at a similarity of 0.8 share none of the 16 keys with a
   probability of 2e-4, and their fingerprints differ in about ten bits, in more than RADIUS with
   one of 2e-4. A shard with more than SHARD_LIMIT nodes is dealt at random into pieces.
3. A piece holds its fingerprints in a BK-tree and links what lies within the radius with n - 1
   candidates; crowded shards are dealt a second time, which connects their pieces.
4. Candidates meet both whole sets in joins, hot nodes in pieces, and count from SIMILARITY on;
   large-star and small-star rounds close them. Sets are made again from the texts of the nodes that are
   candidates, as keeping those of all texts would take more than the texts.
5. A candidate that fails may have stood for others. So in every shard that still holds several
   components, each node outside the largest one is open: its NEAREST neighbours of other components in
   the trees of all pieces are candidates. That tries all pairs of shards up to NEAREST + 1 nodes.
6. Larger shards that still hold several components get the whole sets of their nodes and compare every
   open node with every node of another component, in blocks of SET_NODES by SET_NODES. Near copies differ
   in few shingles from what most of them hold, so a block counts differences from that, and gives back
   links only, one at most for each node that it joins. Rows grow with a shard's blocks; nothing is capped.

Cases: null, empty and blank texts have the empty set and are copies of each other; texts of fewer
words than a shingle have one shingle, their words; rows without an id take part in no group and
stay; repeated rows and rows of one id are copies; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored
from touchline.llm.simhash_bk import BROADCAST_IDS, SEED, BKTree, closure, shard_links

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BANDS, ROWS = 16, 4
SHARD_LIMIT = 2_000
# Nearest neighbours of other components that an open node tries before whole shards are compared.
NEAREST = 4
# Nodes, and shingles of these, on either side of a block of whole sets.
SET_NODES, SET_SHINGLES = 1_000, 4_000_000
# A node in more candidates than this meets them in several tasks.
HOT_NODE = 500

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _random.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = [end - 1 for end in accumulate(len(word) + 1 for word in words)]
    starts = [0, *(end + 1 for end in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set."""
    ones = np.zeros(64, dtype=np.int64)
    rows = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 4096):
        ones += np.unpackbits(rows[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """Signed keys of the set's bands of minima."""
    lowest = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        turned = (hashes[at : at + 1024, None] + _SHIFTS) * _FACTORS
        lowest = np.minimum(lowest, (turned ^ (turned >> np.uint64(31))).min(axis=0))
    digest = xxhash.xxh64_intdigest
    keys = np.array([digest(row.tobytes(), band) for band, row in enumerate(lowest.reshape(BANDS, ROWS))], dtype=np.uint64)
    return keys.view(np.int64).tolist()


def node_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _described(batches):
    for batch in batches:
        sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([node_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_fingerprint(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "node", "n", "fp", "keys"],
        )


def _packed(batches):
    for batch in batches:
        sets = [shingle_set(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]
        )


def with_ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (shingles), fp and keys of every row with an id."""
    return with_ids(docs).mapInArrow(_described, "doc_id long, node binary, n long, fp long, keys array<long>")


def packed_sets(docs: DataFrame, wanted: DataFrame, ids_repeat: bool) -> DataFrame:
    """node and its packed shingles, once per node of ``wanted`` (node, first_doc)."""
    wanted = if_small(stored(wanted, "near-wanted"))
    texts = with_ids(docs).join(wanted.select("first_doc").distinct() if ids_repeat else wanted, F.col("doc_id") == F.col("first_doc"), "left_semi")
    sets = texts.select("text").mapInArrow(_packed, "node binary, shingles binary")
    if ids_repeat:
        sets = sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])
    return stored(sets, "near-sets")


def if_small(df: DataFrame) -> DataFrame:
    """``df``, broadcast up to BROADCAST_IDS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def similar_sizes(a: int, b: int) -> bool:
    """Whether sets of these sizes can reach SIMILARITY."""
    return min(a, b) >= SIMILARITY * max(a, b)


def _pieces(batches, columns):
    """Lists of rows of one (key, piece), from rows sorted by them."""
    held_key, held = None, []
    for batch in batches:
        lists = [batch.column(name).to_pylist() for name in columns]
        for key, piece, *row in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), *lists):
            if (key, piece) != held_key:
                if len(held) > 1:
                    yield held
                held_key, held = (key, piece), []
            held.append(row)
    if len(held) > 1:
        yield held


def _pair_batches(pairs):
    found = []
    for a, b in pairs:
        found.append((max(a, b), min(a, b)))
        if len(found) == 10_000:
            yield _pair_batch(found)
            found = []
    yield _pair_batch(found)


def _pair_batch(found):
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _spanning(batches):
    """n - 1 candidates for n nodes that the piece's tree connects."""

    def pairs():
        for rows in _pieces(batches, ("node", "fp")):
            of_print: dict[int, list[bytes]] = {}
            for node, fp in rows:
                of_print.setdefault(fp & (2**64 - 1), []).append(node)
            for nodes in of_print.values():
                yield from ((nodes[0], node) for node in nodes[1:])
            if len(of_print) > 1:
                yield from ((of_print[a][0], of_print[b][0]) for a, b in shard_links(list(of_print), RADIUS))

    return _pair_batches(pairs())


def _open_pairs(nearest: int | None):
    """Candidates of open nodes with the nearest (None: all) neighbours of other components in the piece."""

    def pairs(batches):
        for rows in _pieces(batches, ("node", "fp", "n", "component", "visits")):
            homes = [row for row in rows if not row[4]]
            searching = [row for row in rows if row[4]]
            if not homes or not searching:
                continue
            tree = BKTree([row[1] & (2**64 - 1) for row in homes])
            for node, fp, n, component, _ in searching:
                own = fp & (2**64 - 1)
                others = [homes[at] for at in tree.near(own, RADIUS)]
                others = [row for row in others if row[3] != component and similar_sizes(n, row[2])]
                if nearest is not None and len(others) > nearest:
                    others = sorted(others, key=lambda row: (((row[1] & (2**64 - 1)) ^ own).bit_count(), row[0]))[:nearest]
                yield from ((node, row[0]) for row in others)

    return lambda batches: _pair_batches(pairs(batches))


def set_links(homes, searching):
    """Links between (node, packed set, component, ...) rows of both lists that join different components, each join once."""
    sets = [np.frombuffer(row[1], np.uint64) for row in homes]
    sizes = np.array([len(own) for own in sets])
    held, times = np.unique(np.concatenate(sets), return_counts=True)
    usual = held[2 * times > len(sets)]
    changes = [np.setxor1d(own, usual, assume_unique=True) for own in sets]
    n_changes = np.array([len(change) for change in changes])
    shingles, owners = np.concatenate(changes), np.repeat(np.arange(len(sets)), n_changes)
    order = np.argsort(shingles)
    shingles, owners = shingles[order], owners[order]
    names = list(dict.fromkeys(row[2] for row in (*homes, *searching)))
    label_of = {name: at for at, name in enumerate(names)}
    labels, root = np.array([label_of[row[2]] for row in homes]), list(range(len(names)))

    def find(label: int) -> int:
        while root[label] != label:
            root[label] = label = root[root[label]]
        return label

    for node, packed, component, *_ in searching:
        own = np.frombuffer(packed, np.uint64)
        change = np.setxor1d(own, usual, assume_unique=True)
        first, last = np.searchsorted(shingles, change, "left"), np.searchsorted(shingles, change, "right")
        found = last - first
        at = np.repeat(first - np.cumsum(found) + found, found) + np.arange(found.sum())
        apart = len(change) + n_changes - 2 * np.bincount(owners[at], minlength=len(sets))
        alike = (len(own) + sizes - apart) / (len(own) + sizes + apart) >= SIMILARITY
        label = label_of[component]
        hits = np.flatnonzero(alike & (labels != label))
        for other, hit in zip(*np.unique(labels[hits], return_index=True)):
            if find(label) != find(int(other)):
                root[find(label)] = find(int(other))
                yield node, homes[hits[hit]][0]


def _set_links(batches):
    def pairs():
        for rows in _pieces(batches, ("node", "shingles", "component", "visits")):
            homes = [row for row in rows if not row[3]]
            if 0 < len(homes) < len(rows):
                yield from set_links(homes, [row for row in rows if row[3]])

    return _pair_batches(pairs())


def in_pieces(shards: DataFrame, salt: int) -> DataFrame:
    """``piece``: nodes of a shard (with ``n_pieces``) dealt at random."""
    return shards.withColumn("piece", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("n_pieces")).cast("int"))


def by_piece(shards: DataFrame, work) -> DataFrame:
    dealt = shards.repartition(F.col("key"), F.col("piece")).sortWithinPartitions("key", "piece", "node")
    return dealt.mapInArrow(work, "a binary, b binary")


def with_sets(pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """The packed set of ``side`` beside every pair; hot nodes meet their pairs in several tasks."""
    other = "b" if side == "a" else "a"
    counts = stored(pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count(F.lit(1)) / HOT_NODE).alias("parts")), "near-counts")
    hot = if_small(counts.where("parts > 1").select(F.col("node").alias("hot"), "parts"))
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(hot, F.col(side) == F.col("hot"), "left").withColumn("part", part).drop("hot", "parts")
    wanted = sets.join(if_small(counts), "node").select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    return dealt.join(wanted, [side, "part"]).drop("part")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - common
    return common / whole if whole else 1.0


def _alike(batches):
    for batch in batches:
        pairs = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        alike = [jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= SIMILARITY for a, b in pairs]
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, ids_repeat: bool) -> DataFrame:
    """The pairs whose whole sets reach SIMILARITY."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = packed_sets(docs, nodes.select("node", "first_doc").join(if_small(met), "node", "left_semi"), ids_repeat)
    beside = with_sets(with_sets(pairs, sets, "b"), sets, "a")
    return stored(beside.select("a", "b", "set_a", "set_b").mapInArrow(_alike, "a binary, b binary"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every linked node."""
    stars = closure(links)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stored(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "near-components")


def with_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def links_between(nodes: DataFrame, docs: DataFrame, ids_repeat: bool) -> DataFrame:
    """Verified links whose closure has the components of all candidates: see the steps above."""
    shards = nodes.where("n > 0").select("node", "fp", "n", F.explode("keys").alias("key"))
    sizes = shards.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    crowded = stored(sizes.where(F.col("size") > SHARD_LIMIT).select("key", F.ceil(F.col("size") / SHARD_LIMIT).alias("pieces")), "near-crowded")
    few = if_small(crowded)
    whole = shards.select("node", "fp", "key").join(few, "key", "left").withColumn("n_pieces", F.coalesce("pieces", F.lit(1))).drop("pieces")
    pairs = by_piece(in_pieces(whole, 0), _spanning)
    if not crowded.isEmpty():
        again = shards.select("node", "fp", "key").join(few, "key").withColumnRenamed("pieces", "n_pieces")
        pairs = pairs.unionByName(by_piece(in_pieces(again, 1), _spanning))
    pairs = stored(pairs.distinct(), "near-candidates")
    links = verified(pairs, nodes, docs, ids_repeat)

    rest = stored(open_candidates(*mixed_shards(nodes, components(links))).distinct().join(pairs, ["a", "b"], "left_anti"), "near-open")
    links = links.unionByName(verified(rest, nodes, docs, ids_repeat))
    return links.unionByName(links_by_sets(*mixed_shards(nodes, components(links)), nodes, docs, ids_repeat))


def mixed_shards(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, fp, n, component and key of every node in every shard; key, largest component, size and shingles of shards with several components."""
    named = stored(with_components(nodes.where("n > 0"), found).select("node", "fp", "n", "component", "keys"), "near-named")
    named = named.withColumn("key", F.explode("keys")).drop("keys")
    per_component = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    mixed = per_component.groupBy("key").agg(
        F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("size"),
        F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("parts"),
    )
    return named, stored(mixed.where("parts > 1").drop("parts"), "near-mixed")


def open_candidates(named: DataFrame, mixed: DataFrame) -> DataFrame:
    """Candidates between components that meet in a shard."""
    pieces = mixed.select("key", "largest", F.ceil(F.col("size") / SHARD_LIMIT).alias("n_pieces"))
    searched = in_pieces(named.join(if_small(pieces), "key"), 0).withColumn("visits", F.lit(False))
    visiting = searched.where("component <> largest").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces").cast("int") - 1)))
    searched = searched.unionByName(visiting.withColumn("visits", F.lit(True))).drop("largest", "n_pieces")
    return by_piece(searched, _open_pairs(NEAREST))


def links_by_sets(named: DataFrame, mixed: DataFrame, nodes: DataFrame, docs: DataFrame, ids_repeat: bool) -> DataFrame:
    """Links between components that meet in a shard of more than NEAREST + 1 nodes, from whole sets."""
    n_blocks = F.ceil(F.greatest(F.col("size") / SET_NODES, F.col("shingles") / SET_SHINGLES))
    wide = mixed.where(F.col("size") > NEAREST + 1).select("key", "largest", n_blocks.cast("int").alias("n_blocks"))
    met = stored(named.join(if_small(wide), "key").select("node", "component", "key", "largest", "n_blocks"), "near-met")
    wanted = nodes.select("node", "first_doc").join(if_small(met.select("node").distinct()), "node", "left_semi")
    beside = met.join(packed_sets(docs, wanted, ids_repeat), "node")
    own, every = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n_blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    homes = beside.withColumn("other", every).withColumn("piece", own * F.col("n_blocks") + F.col("other")).withColumn("visits", F.lit(False))
    visiting = beside.where("component <> largest").withColumn("other", every)
    visiting = visiting.withColumn("piece", F.col("other") * F.col("n_blocks") + own).withColumn("visits", F.lit(True))
    return stored(by_piece(homes.unionByName(visiting).drop("largest", "n_blocks", "other"), _set_links), "near-set-links")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest id of its group) of every row with an id."""
    rows = stored(described(docs), "near-rows")
    keyed = rows.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = stored(keyed, "near-nodes")
    # Rows of one id count as copies: texts of one id are linked through it.
    by_id = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("times"))
    repeated = stored(by_id.where("times > 1"), "near-same-id")
    links = links_between(nodes, docs, not repeated.isEmpty())
    same_id = rows.select("doc_id", F.col("node").alias("a")).join(if_small(repeated), "doc_id").where("a <> b").select("a", "b").distinct()
    found = with_components(nodes.select("node", "first_doc"), components(links.unionByName(same_id)))
    smallest = found.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    classes = stored(found.join(smallest, "component").select("node", "component_id"), "near-classes")
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of the smallest id of each group, and all rows without an id."""
    found = stored(groups(docs), "near-groups")
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    kept = docs.join(if_small(stored(dropped, "near-dropped")), F.col("doc_id").cast("long") == F.col("dropped_id"), "left_anti")
    repeats = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id")
    again = stored(repeats, "near-again")
    if again.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col("again_id")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id"]))
