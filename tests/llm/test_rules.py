import re
from collections import Counter

from touchline.llm import kneser_ney, rule_forest
from touchline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + j for i, window in enumerate(windows) if times[window] > 1 for j in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(covered),
    )


def test_base_rules_match_their_definition(odd_rows):
    texts = [text for _, text, _, _ in odd_rows if text is None or len(text) < 1000]
    texts += ["a b c d e a b c d e f", "x x x x x x x", "l\nl\n\nl \n l", "a b c \x1c d\x85e"]
    for text in texts:
        assert rule_forest.rule_statistics(text)[:5] == plain_statistics(text)


def test_base_columns_of_the_query(spark):
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_rule_forest"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n, chars, symbols, lines, repeats = plain_statistics(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert row["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (row["base_failed"] and row["kept"])


def test_forest_path_lengths_follow_the_trees():
    import numpy as np

    rng = np.random.default_rng(3)
    good, bad = rng.normal(size=(600, 3)), rng.normal(size=(30, 3)) + 8
    forest = rule_forest.grow_forest(good, bad, 1)
    rows = np.concatenate([good[:5], bad[:5]])

    def depth(tree, row):
        node = 0
        while forest.feature[tree, node] >= 0:
            right = row[forest.feature[tree, node]] >= forest.cut[tree, node]
            node = forest.left[tree, node] + right
        return forest.length[tree, node]

    plain = [np.mean([depth(tree, row) for tree in range(rule_forest.TREES)]) for row in rows]
    assert np.allclose(forest.path_lengths(rows), plain)
    assert forest.scores(bad).mean() > forest.scores(good).mean() + 0.1


def held_out(spark, judge, docs, labels):
    """Share of held-out bad rows rejected and of good rows kept."""
    train = labels.where("doc_id % 2 = 0")
    rows = judge(docs, train).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    bad = [row["kept"] for row in rows if row["quality"] == 0]
    good = [row["kept"] for row in rows if row["quality"] == 1 and not row["toxic"]]
    return 1 - sum(bad) / len(bad), sum(good) / len(good)


def test_classifiers_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    caught, kept = held_out(spark, rule_forest.judge, docs, labels)
    assert caught > 0.85 and kept > 0.9  # texts under ten words fail the base rules
    caught, kept = held_out(spark, kneser_ney.classify, docs, labels)
    assert caught > 0.9 and kept > 0.97


def test_odd_rows_and_missing_labels(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for found in (rule_forest.judge(docs, labels), rule_forest.judge(docs, none)):
        rows = found.collect()
        assert len(rows) == len(odd_rows)
        assert not any(row["kept"] for row in rows if row["doc_id"] in (1, 2, 3))
    for found in (kneser_ney.classify(docs, labels), kneser_ney.classify(docs, none)):
        rows = found.collect()
        assert len(rows) == len(odd_rows)
        assert not any(row["kept"] for row in rows if row["doc_id"] in (1, 2, 3))
        assert len({row["kept"] for row in rows if row["doc_id"] == 6}) == 1
    assert rule_forest.judge(docs.limit(0), labels).count() == 0
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    kept = kneser_ney.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in kneser_ney.classify(docs, labels).where("kept").collect())


def test_model_probabilities_sum_to_one():
    import numpy as np

    counts = np.bincount(kneser_ney.Alphabet().trigrams("to be or not to be, that is the question " * 20), minlength=kneser_ney.CELLS)
    table = np.exp(-kneser_ney.model_table(counts)).reshape(kneser_ney.SYMBOLS, kneser_ney.SYMBOLS, -1)
    assert np.allclose(table.sum(-1), 1.0)
    assert table.min() > 0
