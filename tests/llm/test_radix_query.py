import hashlib
from collections import Counter

from touchline.llm import radix_windows
from touchline.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plain_rows(texts):
    """Removal of repeated windows of 400 bytes, window by window."""
    data = {key: (text or "").encode() for key, text in texts}
    digest = lambda window: hashlib.blake2b(window, digest_size=16).digest()
    times = Counter(digest(text[at : at + 400]) for text in data.values() for at in range(len(text) - 399))
    for key, text in data.items():
        gone = bytearray(len(text))
        for at in range(len(text) - 399):
            if times[digest(text[at : at + 400])] > 1:
                gone[at : at + 400] = b"\x01" * 400
        runs = sum(gone[at] and not (at and gone[at - 1]) for at in range(len(gone)))
        yield key, len(text), sum(gone), runs, hashlib.sha256(bytes(b for b, cut in zip(text, gone) if not cut)).hexdigest()


def test_the_query_matches_brute_force_at_its_length(spark):
    texts = [(row["doc_id"], row["text"]) for row in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_radix_windows"](spark, SF).collect()]
    assert sorted(found) == sorted(plain_rows(texts))
    assert any(row[2] for row in found) and not all(row[2] for row in found)


def test_planted_passages_go_from_400_bytes_on(spark, docs_of):
    passage = " ".join(f"planted{i * i}" for i in range(60))
    rows = []
    for i, length in enumerate((399, 400, 401, 500)):
        cut = chr(65 + i) + passage[i * 7 : i * 7 + length - 1]
        rows += [(2 * i, f"first {i} {cut} one end {i}", "en", "a"), (2 * i + 1, f"second {i}: {cut} Two. {i}", "en", "a")]
    # Passages share their bytes with each other too, so each is judged by itself.
    for i, length in enumerate((399, 400, 401, 500)):
        found = radix_windows.dedup(docs_of(rows[2 * i : 2 * i + 2])).collect()
        # A white space before and behind each passage is shared as well.
        assert {row["n_removed"] for row in found} == {length + 2}
        assert {row["n_spans"] for row in found} == {1}
    short = [(1, f"first {passage[:396]}! one", "en", "a"), (2, f"second: {passage[:396]}? two", "en", "a")]
    assert {row["n_removed"] for row in radix_windows.dedup(docs_of(short)).collect()} == {0}
