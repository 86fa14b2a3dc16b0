import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from touchline.llm import gkl_whitening, reversed_search, toxic_lexicon
from touchline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain_search(docs, items, top):
    bags = [(doc, Counter(plain_terms(text))) for doc, text in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    found = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        scored = []
        for doc, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t, times in asked.items()
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        best = sorted(scored, key=lambda s: s[:3])[:top]
        found += [(item, rank, doc, -negative) for rank, (negative, _, _, doc) in enumerate(best, 1)]
    return found


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_terms_follow_their_pattern():
    for text in ("", "A b_C-9", "Größe ÄRGER x\x7fy", "\U0001f600 ok|é", "İstanbul K"):
        assert [t.decode() for t in reversed_search.terms(text) if t] == plain_terms(text)


def test_search_against_every_pair(spark, docs_of, odd_rows):
    rows = odd_rows + [(i, f"tie tie word{i % 3}", "en", "a") for i in range(20, 60)]
    items = [(1, "word1 TIE few, few"), (1, "word1 TIE few, few"), (2, None), (3, "##"), (None, "turns3. one word"), (4, "nothingknown")]
    asked = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, rank int, doc_id string")
    for top in (3, 20):
        found = reversed_search.search(docs_of(rows), asked, top)
        assert rows_of(found) == sorted(plain_search([(d, t) for d, t, _, _ in rows], items, top), key=str)
    assert reversed_search.search(docs_of([]), asked).count() == 0
    assert reversed_search.search(docs_of(rows), asked.limit(0)).count() == 0


def test_search_in_several_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(reversed_search, "POSTINGS_AT_ONCE", 4)
    monkeypatch.setattr(reversed_search, "CELLS_AT_ONCE", 7)
    monkeypatch.setattr(reversed_search, "EXACT_TERMS", 3)
    rows = [(i, " ".join(f"w{(i * k) % 11}" for k in range(1, 9)), "en", "a") for i in range(50)]
    items = [(i, f"w{i} w{i + 1} w{i} w{i * 2} w{i + 3}") for i in range(6)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = reversed_search.search(docs_of(rows), asked, 5)
    assert rows_of(found) == sorted(plain_search([(d, t) for d, t, _, _ in rows], items, 5), key=str)


def plain_whitening(rows, components):
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, (values > 1e-12 * values[0]).sum())
    return ((n * x - sums) ** 2).sum(1), centred @ vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def held(found, rows, components=32):
    deviation, whitened, explained = plain_whitening(rows, components)
    found = found.toPandas()
    by = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert by.shape == whitened.shape
    assert np.abs(by * np.sign((by * whitened).sum(0)) - whitened).max() < 1e-8
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-9)
    assert (found.groupby("vec_id").deviation.first().to_numpy() == deviation).all()
    assert set(found.n) == {len(rows)} and found.identity_error.max() < 1e-9


def test_whitening_of_the_query(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    held(QUERIES["op11_gkl_whitening"](spark, SF), [v for _, v in rows])


def test_whitening_of_odd_vectors(spark):
    random.seed(4)
    rows = [[random.gauss(0, 1 + k) for k in range(5)] for _ in range(300)] + [[3.0, 1.0, 2.0, 0.5, 9.0]] * 100
    bad = [None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0]]
    frame = lambda vs: spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(vs)], "vec_id long, embedding array<double>, whitened double")
    held(gkl_whitening.whiten(frame(rows + bad)), rows)
    held(gkl_whitening.whiten(frame(rows), components=2), rows, 2)
    # A constant and a doubled dimension leave three; short vectors are extended by zeros.
    thin = [[a, b, a, 7.0, c] for a, b, _, _, c in rows]
    assert gkl_whitening.whiten(frame(thin)).agg({"component": "max"}).first()[0] == 3
    held(gkl_whitening.whiten(frame([v[:3] if i % 2 else v for i, v in enumerate(rows)])), [v[:3] + [0.0, 0.0] if i % 2 else v for i, v in enumerate(rows)])
    # Equal variances in all directions: every one is found again after the space closes.
    cross = [[s * 2.0 if j == k else 0.0 for j in range(4)] for k in range(4) for s in (1, -1)]
    equal = gkl_whitening.whiten(frame(cross)).toPandas()
    assert set(equal.component) == {1, 2, 3, 4} and np.allclose(equal.explained, 0.25) and equal.identity_error.max() < 1e-9
    huge = gkl_whitening.whiten(frame([[1e300, 0.0], [-1e300, 1.0], [0.5, 2.0]])).collect()
    assert [row["deviation"] is None for row in sorted(huge, key=lambda r: r["vec_id"])] == [True, True, False]
    for none in (frame(bad), frame([[1.0, 2.0]] * 4), frame([[]] * 3), frame([])):
        assert gkl_whitening.whiten(none).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    random.seed(2)
    entries = [toxic_lexicon.Entry(f, w, 5.0) for f, w in (("idiot", True), ("worthless", True), ("idol", True), ("low", False), ("ab", True), ("sternbild", False))]
    matcher = toxic_lexicon.Matcher(entries)
    words = ["", "idiot", "idiots", "diot", "wrthles", "worthlesss", "lowest", "lo", "low", "abc", "ab", "sternbilder", "strnbilder", "ideot", "idol", "idolt"]
    words += ["".join(random.choice("idotlwab") for _ in range(random.randrange(1, 9))) for _ in range(3000)]
    for word in words:
        near = []
        for number, entry in enumerate(entries):
            ends = [word] if entry.whole else [word[:n] for n in range(len(word) + 1)]
            distance = min(edits(e, entry.form) for e in ends)
            if distance <= entry.edits:
                near.append((distance, number))
        assert matcher.find(word) == min(near, default=None), word


def test_quotation_and_lookalikes():
    abuse = "you are such an idiot and everyone knows".split()
    quoted = 'he said the word "idiot" was cut from the text'.split()
    assert toxic_lexicon.quotation(abuse, 4) == 0
    assert toxic_lexicon.quotation(quoted, 4) > 0.5
    assert toxic_lexicon.core('"1d1ot!!') == "idiot" and toxic_lexicon.core("1984") == "1984"
    model = toxic_lexicon.Model([toxic_lexicon.Entry("idiot", True, 5.0)], {}, 1.0, -2.0, toxic_lexicon.PRIOR)
    reader = toxic_lexicon.Reader(model)
    score = lambda text: np.dot(reader.features(text), model.coefficients)
    assert score(" ".join(abuse)) > score(" ".join(quoted)) > score("nothing here") == 0
    assert score("you ldiot") == 1.0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = QUERIES["op13_toxic_lexicon"](spark, sf)
    rows = found.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    english = [r["predicted"] for r in toxic if r["lang"] == "en"]
    assert sum(english) / len(english) > 0.85
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.8
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.01
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.limit(500).collect())


def test_toxicity_of_odd_rows(spark, docs_of, odd_rows):
    labelled = [(100 + i, f"plain words number {i} {'you idiot' if i % 2 else 'good day'}", "en", "a") for i in range(200)]
    docs = docs_of(odd_rows + labelled)
    labels = spark.createDataFrame(
        [(100 + i, None, i % 2) for i in range(200)] + [(None, 1, 1), (5, 1, None), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int"
    )
    rows = toxic_lexicon.toxicity(docs, labels).collect()
    assert len(rows) == len(odd_rows) + 200
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows if r["doc_id"] and r["doc_id"] >= 100)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    none = toxic_lexicon.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["predicted"] for r in none)
    assert toxic_lexicon.toxicity(docs.limit(0), labels).count() == 0
