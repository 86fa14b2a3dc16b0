import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from touchline.llm import kneser_ney, subwords

SF = "/root/testdata/sf0.001"


def plain_model(sequences, size):
    """Interpolated modified Kneser-Ney in dictionaries: the probability of r after l, m."""
    three = Counter(gram for tokens in sequences for gram in zip(tokens, tokens[1:], tokens[2:]))
    two = Counter((m, r) for _, m, r in three)
    one = Counter(r for _, r in two)

    def order(counts, lower):
        n = Counter(counts.values())
        n1, n2, n3, n4 = (max(n[k], 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(found, 0.05), most) for found, most in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.9))]
        total, left = Counter(), defaultdict(float)
        for gram, times in counts.items():
            total[gram[:-1]] += times
            left[gram[:-1]] += d[min(times, 3) - 1]

        def probability(gram):
            above, times = gram[:-1], counts.get(gram, 0)
            if not total[above]:
                return lower(gram[1:])
            own = (times - d[min(times, 3) - 1]) / total[above] if times else 0.0
            return own + left[above] / total[above] * lower(gram[1:])

        return probability

    return order(three, order(two, order({(r,): n for r, n in one.items()}, lambda _: 1 / size)))


@pytest.mark.parametrize("shard_bytes", [5_000, 1 << 30])
def test_perplexities_match_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(kneser_ney, "LEAST_TRUSTED", 12)
    monkeypatch.setattr(kneser_ney, "LANGUAGES_AT_ONCE", 2)
    monkeypatch.setattr(kneser_ney, "BATCH_DOCS", 30)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {row["trusted_id"] for row in kneser_ney.trusted_ids(labels).collect()}
    half = {row["doc_id"]: row["half"] for row in docs.select("doc_id", kneser_ney.half_of(docs["doc_id"]).alias("half")).collect()}
    rows = docs.collect()
    words, pieces, _ = subwords.vocabulary(docs.where(docs["doc_id"].isin(list(trusted))))
    coder = subwords.Subwords(words, pieces)
    sequences = {row["doc_id"]: coder.tokens(row["text"]) for row in rows}
    training = [(row["lang"], half[row["doc_id"]], coder.tokens(row["text"], True)[0].tolist()) for row in rows if row["doc_id"] in trusted]
    languages = {lang for lang, n in Counter(lang for lang, _, _ in training).items() if n >= 12}
    assert 0 < len(languages) < len({row["lang"] for row in rows})
    models = {}

    def cost(row, of_half):
        name = row["lang"] if row["lang"] in languages else "*"
        if (name, of_half) not in models:
            models[name, of_half] = plain_model([t for lang, h, t in training if name in (lang, "*") and of_half in (h, None)], coder.size)
        tokens = sequences[row["doc_id"]][0].tolist()
        return -sum(math.log(models[name, of_half](gram)) for gram in zip(tokens, tokens[1:], tokens[2:]))

    found = {row["doc_id"]: row for row in kneser_ney.classify(docs, labels).collect()}
    assert len(found) == len(rows)
    crossed = defaultdict(lambda: [0.0, 0])
    for row in rows:
        n = sequences[row["doc_id"]][1]
        assert found[row["doc_id"]]["n_symbols"] == n
        if n:
            assert found[row["doc_id"]]["perplexity"] == pytest.approx(math.exp(cost(row, None) / n), rel=1e-5)
        if n and row["doc_id"] in trusted:
            for name in (row["lang"] if row["lang"] in languages else "*", "all"):
                crossed[name][0] += cost(row, 1 - half[row["doc_id"]])
                crossed[name][1] += n
    for row in rows:
        n = sequences[row["doc_id"]][1]
        if n:
            mean = np.divide(*crossed[row["lang"] if row["lang"] in languages else "*"])
            if row["lang"] in languages:
                assert found[row["doc_id"]]["score"] == pytest.approx((cost(row, None) + 60 * mean) / (n + 60), rel=1e-5)


def test_the_dense_model_is_the_plain_one():
    cells = kneser_ney.Alphabet().trigrams("to be or not to be, that is the question " * 20)
    table = kneser_ney.model_table(np.bincount(cells, minlength=kneser_ney.CELLS))
    tokens = [*divmod(int(cells[0]) // kneser_ney.SYMBOLS, kneser_ney.SYMBOLS), *(int(cell) % kneser_ney.SYMBOLS for cell in cells)]
    plain = plain_model([tokens], kneser_ney.SYMBOLS)
    for cell in range(0, kneser_ney.CELLS, 97):
        gram = (cell // kneser_ney.SYMBOLS**2, cell // kneser_ney.SYMBOLS % kneser_ney.SYMBOLS, cell % kneser_ney.SYMBOLS)
        assert table[cell] == pytest.approx(-math.log(plain(gram)))


def test_tokens_keep_every_word_of_any_script():
    words, pieces = ["the", "мир", "x" * 41], ["th", " zo", "войн", "a", "中文", "é"]
    coder = subwords.Subwords(words, pieces)
    for text in ("the zoo thea", "мир война мир", "中文中 文字 é é", "the the the cat", "\U0001f600 � |", "x" * 41):
        tokens, n = coder.tokens(text)
        assert tokens[:2].tolist() == [subwords.EDGE] * 2 and tokens[-1] == subwords.EDGE
        spelled = bytearray()
        for token in tokens[2:-1].tolist():
            if token < 256:
                spelled.append(token)
            elif token == subwords.REPEAT:
                spelled += b" " + spelled.split(b" ")[-1]
            elif token < subwords.FIRST + len(words):
                spelled += f" {words[token - subwords.FIRST]}".encode()
            else:
                spelled += pieces[token - subwords.FIRST - len(words)].encode()
        assert spelled.decode() == f" {text}"
        assert n == len(text) + 1 - sum(len(a) for a, b in zip(text.split(), text.split()[1:]) if a == b)


def test_words_decide_in_other_scripts(spark, docs_of):
    """Letters of one class and words of the same letters weren't told apart by character classes."""
    known = "мир и война идут рядом по дороге к дому где ждут старые друзья"
    shifted = "".join(chr(0x430 + (ord(c) - 0x430 + 10) % 32) if "а" <= c <= "я" else c for c in known)
    swapped = " ".join(sorted(known.split(), key=lambda word: word[::-1]))
    chinese, other = "今天天气很好我们去公园散步", "散步公园去我们好很气天天今"
    rows = [(i, f"{known} {i}", "ru", "a") for i in range(60)] + [(100 + i, f"{chinese} {i}", "zh", "a") for i in range(60)]
    rows += [(1000, known, "ru", "a"), (1001, shifted, "ru", "a"), (1002, swapped, "ru", "a"), (1003, chinese, "zh", "a"), (1004, other, "zh", "a")]
    labels = spark.createDataFrame([(row[0], 1, 0) for row in rows if row[0] < 1000], "doc_id long, quality int, toxic int")
    found = {row["doc_id"]: row for row in kneser_ney.classify(docs_of(rows), labels).collect()}
    for good, *bad in ((1000, 1001, 1002), (1003, 1004)):
        for worse in bad:
            assert found[worse]["perplexity"] > 1.5 * found[good]["perplexity"]
            assert not found[worse]["kept"]
        assert found[good]["kept"]


def test_shards_meet_all_of_a_frequent_token():
    weights = np.ones(1000, dtype=np.int64)
    weights[[300, 301]] = 1000, 200
    shards = kneser_ney.Shards(64, weights)
    rng = np.random.default_rng(5)
    keys = kneser_ney.keys_of(3, rng.choice([300, 301, 400, 999], 4000))
    assert len(np.unique(shards.of(keys[keys >> 32 & 0xFFFF == 300]))) > 1
    bigrams = np.unique(kneser_ney.without_left(keys))
    places, to = shards.all_of(bigrams)
    served = set(zip(bigrams[places].tolist(), to.tolist()))
    assert set(zip(kneser_ney.without_left(keys).tolist(), shards.of(keys).tolist())) <= served
    assert len(served) == len(places)
