import itertools
import random

import corpus_pipeline
from touchline.llm import near_shingles

SF = "/root/testdata/sf0.001"


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(docs):
    """{id: smallest id of its group} from all pairs of whole sets."""
    root = {doc: doc for doc, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(doc, plain_set(text)) for doc, text in docs]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if len(a & b) >= 0.8 * len(a | b):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {doc: find(doc) for doc in root}


def found_groups(docs):
    return {row["doc_id"]: row["component_id"] for row in near_shingles.groups(docs).collect()}


def planted(rng, n):
    """Texts of 40 to 300 words, and copies of them with words replaced, at similarities around 0.8 and above."""
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(40, 300))]
        texts.append(" ".join(body))
        for _ in range(rng.randrange(4)):
            near = list(body)
            for _ in range(rng.randrange(1, 2 + len(body) // 40)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near).upper() if rng.random() < 0.2 else "  ".join(near))
    rng.shuffle(texts)
    return texts


def test_groups_match_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(row["doc_id"], row["text"]) for row in documents.collect()]
    assert found_groups(documents) == plain_groups(docs)


def test_planted_pairs_match_brute_force(docs_of):
    docs = list(enumerate(planted(random.Random(3), 120)))
    want = plain_groups(docs)
    assert len(set(want.values())) < 0.7 * len(docs)
    assert found_groups(docs_of([(doc, text, "en", "a") for doc, text in docs])) == want


def test_crowded_shards_lose_no_link(docs_of, monkeypatch):
    """One family whose ends are no longer alike, in pieces far smaller than the family, beside one that is close but not alike."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    body = [rng.choice(words) for _ in range(120)]
    texts = []
    for at in range(60):
        body = list(body)
        body[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(body))
    for at in range(0, 120, 12):
        body[at] = rng.choice(words)
    texts += [" ".join([*body[:60], word, *body[61:]]) for word in words[:30]]
    docs = list(enumerate(texts))
    monkeypatch.setattr(near_shingles, "SHARD_LIMIT", 8)
    monkeypatch.setattr(near_shingles, "HOT_NODE", 3)
    assert found_groups(docs_of([(doc, text, "en", "a") for doc, text in docs])) == plain_groups(docs)


def test_failed_stars_are_searched_again():
    """A star may join nodes that only others link; the open search offers every neighbour of another component."""
    import pyarrow as pa

    columns = {"key": [1] * 5, "piece": [0] * 5, "node": [b"a", b"b", b"c", b"d", b"b"], "fp": [0, 1, 3, -1, 1], "n": [10] * 5}
    columns |= {"component": [b"a", b"b", b"a", b"d", b"b"], "visits": [False] * 4 + [True]}
    found = [tuple(row.values()) for batch in near_shingles._open_pairs(None)([pa.RecordBatch.from_pydict(columns)]) for row in batch.to_pylist()]
    assert sorted(found) == [(b"b", b"a"), (b"c", b"b")]


def test_blocks_of_sets_join_what_pairs_join():
    """Links of a block close to the components of all its pairs, with no join twice."""
    rng = random.Random(4)
    texts = []
    for family in range(3):
        body = [f"w{family}x{at}" for at in range(60)]
        texts += [" ".join(f"r{rng.random()}" if rng.random() < share else word for word in body) for share in (0.01, 0.02, 0.04) for _ in range(25)]
    rows = [(b"%03d" % at, near_shingles.shingle_set(text).tobytes(), b"%03d" % at) for at, text in enumerate(texts)]
    links = list(near_shingles.set_links(rows, rows))
    want = plain_groups(list(enumerate(texts)))
    root = {at: at for at in want}
    for a, b in links:
        low, high = sorted((root[int(a)], root[int(b)]))
        assert low != high
        root = {at: low if top == high else top for at, top in root.items()}
    assert root == want and 3 < len(set(want.values())) < 150


def test_wide_shards_are_compared_in_blocks(docs_of, monkeypatch):
    """A crowd of near copies of which many are too far from all others, in blocks far smaller than the crowd."""
    rng = random.Random(5)
    body = [f"w{at}" for at in range(90)]
    docs = [(at, " ".join(f"r{rng.random()}" if rng.random() < 0.03 else word for word in body), "en", "a") for at in range(150)]
    monkeypatch.setattr(near_shingles, "NEAREST", 1)
    monkeypatch.setattr(near_shingles, "SET_NODES", 20)
    want = plain_groups([(row[0], row[1]) for row in docs])
    assert 5 < len(set(want.values())) < 140
    assert found_groups(docs_of(docs)) == want


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    found = near_shingles.groups(docs).collect()
    assert len(found) == sum(row[0] is not None for row in odd_rows)
    groups = {row["doc_id"]: row["component_id"] for row in found}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert near_shingles.groups(docs.limit(0)).count() == 0
    kept = near_shingles.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(row["doc_id"]) for row in kept.collect()) == ["1", "4", "6", "7", "None"]


def test_texts_of_one_id_are_one_group(docs_of):
    docs = docs_of([(1, "alpha beta", "en", "a"), (2, "gamma delta", "en", "a"), (2, "alpha beta", "en", "a"), (3, "gamma delta", "en", "a")])
    assert found_groups(docs) == {1: 1, 2: 1, 3: 1}
    assert [row["doc_id"] for row in near_shingles.one_of_each(docs).collect()] == [1]


def test_the_stage_keeps_one_of_each(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_groups([(row["doc_id"], row["text"]) for row in documents.collect()])
    kept = corpus_pipeline.near_dedup(spark, documents, SF)
    assert kept.columns == documents.columns
    assert sorted(row["doc_id"] for row in kept.collect()) == sorted(set(want.values()))
