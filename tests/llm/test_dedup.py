import hashlib
import itertools

import xxhash

from touchline.llm import radix_windows, sentence_spans, simhash_bk
from touchline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
            root[find(i)] = find(j)
    smallest = {}
    for at, (doc, _) in enumerate(prints):
        if doc is not None:
            smallest[find(at)] = min(doc, smallest.get(find(at), doc))
    return [smallest.get(find(at)) for at in range(len(prints))]


def test_components_of_the_query_match_brute_force(spark):
    docs = [(row["doc_id"], row["text"]) for row in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(doc, plain_fingerprint(text)) for doc, text in docs]
    want = {(doc, f"{fp:016x}", component) for (doc, fp), component in zip(prints, plain_components(prints))}
    got = {tuple(row) for row in QUERIES["op4_simhash_bk"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == want


def test_shard_links_connect_what_is_near():
    import random

    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for centre in centres for _ in range(60)})
    links = simhash_bk.shard_links(prints, 4)
    assert len(links) < len(prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = plain_components([(at, p) for at, p in enumerate(prints)])
    got = {}
    assert all(got.setdefault(find(p), w) == w for p, w in zip(prints, want))
    assert len(got) == len(set(want))


def test_crowded_shards_are_dealt_again(spark, monkeypatch):
    import random

    rng = random.Random(7)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:  # a chain of near fingerprints and some far ones
        step = rng.choice(sorted(prints)[:50]) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        prints.add(step if rng.random() < 0.8 else rng.getrandbits(64))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    monkeypatch.setattr(simhash_bk, "SHARD_LIMIT", 20)
    links = simhash_bk.closure(simhash_bk.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    label = {p: p for p in signed} | {row["a"]: row["b"] for row in links}
    want = plain_components([(p, q) for p, q in zip(signed, prints)])
    assert [label[p] for p in signed] == want


def test_simhash_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = simhash_bk.near_duplicates(docs).collect()
    assert len(rows) == len(odd_rows)
    components = {row["doc_id"]: row["component_id"] for row in rows}
    assert components[1] == components[2] == components[3] == 1
    assert components[4] == components[5] == 4
    assert simhash_bk.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_bk.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(row["doc_id"]) for row in kept.collect()) == ["1", "4", "6", "7", "None"]


def plain_spans(texts):
    """{id: (kept text, removed sentences, runs)} by a single pass in the order of ids."""
    seen, want = {}, {}
    for doc in sorted(texts):
        gone = []
        for span, first, last in sentence_spans.spans(texts[doc] or ""):
            if span in seen:
                gone.append({"first": first, "last": last})
            seen.setdefault(span, doc)
        want[doc] = sentence_spans.without(texts[doc], gone) if texts[doc] is not None else (None, 0, 0)
    return want


def test_sentence_spans_match_one_pass(spark):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = plain_spans(texts)
    got = {row["doc_id"]: (row["text"], row["n_removed"], row["n_spans"]) for row in QUERIES["op2_sentence_spans"](spark, SF).collect()}
    assert got == want


PASSAGE = (
    "The committee met on a cold morning in March. It heard eleven witnesses before noon. None of them agreed on the "
    "cause of the failure. The engineers blamed the weather, and the weather office blamed the engineers. By evening "
    "the chairman had lost patience with all of them. He adjourned the session and ordered a second inquiry."
)


def test_planted_passages_go_and_clean_texts_stay(spark, docs_of):
    clean = "Short notes stay. They stay. Nothing here repeats anywhere else in the set of documents at hand today."
    docs = docs_of(
        [
            (3, f"Alpha begins differently, so it goes. {PASSAGE} And ends its own way here.", "en", "a"),
            (5, f"Beta has an opening of its own which runs on {PASSAGE}\nBeta closes too.", "en", "a"),
            (9, PASSAGE.upper().replace(" ", "  "), "en", "a"),
            (11, clean, "en", "a"),
            (12, f"{PASSAGE} {PASSAGE}", "en", "a"),
        ]
    )
    rows = {row["doc_id"]: row for row in sentence_spans.dedup(docs).collect()}
    assert rows[3]["text"].count("second inquiry") == 1 and rows[3]["n_removed"] == 0
    assert "witnesses" not in rows[5]["text"] and "patience" not in rows[5]["text"] and "Beta closes too." in rows[5]["text"]
    assert rows[9]["text"].strip() == "" and rows[12]["text"].strip() == ""
    assert rows[11]["text"] == clean and rows[11]["n_removed"] == 0


def test_passages_begun_inside_sentences_are_seen():
    """Passages of 51 to 80 words set between words of two texts, with and without full stops: at most 2 % share no span."""
    import random

    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]

    def running(n, stops):
        held = [rng.choice(words) for _ in range(n)]
        return [w + "." if stops and rng.random() < 1 / 14 else w for w in held]

    missed = total = 0
    for stops in (True, False):
        for _ in range(300):
            passage = running(rng.choice((51, 60, 80)), stops)
            hosts = []
            for _ in range(2):
                host = running(120, stops)
                at = rng.randrange(len(host))
                hosts.append({span for span, _, _ in sentence_spans.spans(" ".join(host[:at] + passage + host[at:]))})
            total += 1
            missed += not hosts[0] & hosts[1]
    assert missed / total <= 0.02


def test_places_and_digests_of_pieces_agree():
    import random

    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["Word ", "über\t", "x. ", "end!\n", "longer words here ", "a\x1cb ", *(["ä。"] if rng.random() < 0.5 else [])]) for _ in range(rng.randrange(60)))
        placed, bare = sentence_spans.sentences(text), sentence_spans.sentences(text, False)
        assert [p[2:] for p in placed] == [p[2:] for p in bare]
        assert all(a[1] <= b[0] for a, b in zip(placed, placed[1:]))
        assert all(len(text[a:b].split()) == n for a, b, n, _ in placed)


def test_spans_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = sentence_spans.dedup(docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(row["n_removed"] == 0 and row["copy"] == "c" for row in rows if row["doc_id"] != 6)
    assert sentence_spans.dedup(docs.limit(0)).count() == 0


def plain_windows(texts, length):
    data = [(text or "").encode() for text in texts]
    times = {}
    for body in data:
        for at in range(len(body) - length + 1):
            times[body[at : at + length]] = times.get(body[at : at + length], 0) + 1
    found = []
    for body in data:
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1):
            if times[body[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        runs = sum(1 for at, x in enumerate(gone) if x and (at == 0 or not gone[at - 1]))
        kept = bytes(x for x, y in zip(body, gone) if not y)
        found.append((len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return found


def test_windows_match_brute_force(spark, docs_of):
    import random

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeäß") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [body(n) for n in (8, 12, 20, 60)]
    texts = [body(rng.randrange(0, 60)) for _ in range(30)]
    texts += [f"{body(9)} {rng.choice(shared)} {body(9)} {rng.choice(shared)}" for _ in range(40)]
    texts += ["ab" * 120, "xx" + "ab" * 90, "a" * 300, None, "", body(50)]
    texts += [texts[-1], texts[-1]]
    docs = docs_of([(at // 2 if at % 7 else None, text, "en", "a") for at, text in enumerate(texts)])
    for length, starts in ((40, 8), (40, 32), (64, 1)):
        rows = radix_windows.dedup(docs, length, starts).collect()
        got = sorted((row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) for row in rows)
        assert got == sorted(plain_windows(texts, length))


def test_windows_of_long_texts_cross_chunks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(radix_windows, "CHUNK", 256)
    cores = radix_windows.Cores(40, 8)
    text = bytes(range(256)) * 5
    places = [place for part in cores.places(text) for place in zip(*(column.tolist() for column in part))]
    assert [first for _, _, first, _ in places][0] == 0 and places[-1][3] == len(text) - 40
    assert all(a[3] + 1 == b[2] for a, b in zip(places, places[1:]))
    assert len({core for core, *_ in places}) < len(places)


def test_windows_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    rows = radix_windows.dedup(docs).collect()
    assert len(rows) == len(odd_rows)
    assert all(row["n_removed"] == row["n_bytes"] for row in rows if row["doc_id"] == 6)
    assert radix_windows.dedup(docs.limit(0)).count() == 0
