import base64
import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from touchline.llm import cas_archive, latent_leaks, poisson_mix, tag_paths, transcript_hmm
from touchline.llm.catalog import ORACLES, QUERIES
from touchline.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_archive_round_trip(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (1, "u1", ""), (3, "u3", None), (4, "u\r\n4", "größer  "), (4, "u\r\n4", "größer  ")]
    pages = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, digest string")
    archive = cas_archive.write_archive(pages)
    assert archive.payloads.count() == 3
    got = {}
    for row in cas_archive.read_archive(archive).collect():
        got.setdefault(row["record_id"], row)
    for page, _, html in rows:
        body = (html or "").encode()
        assert got[page]["payload_bytes"] == len(body)
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [got[page]["refers_to"] for page in (5, 2, 9, 1, 3, 4)] == [2, None, 2, None, 1, None]
    assert [got[page]["record_type"] for page in (5, 2, 1, 3)] == ["revisit", "response", "response", "revisit"]
    records = [bytes(row["record"]) for row in cas_archive.records(archive).collect()]
    assert len(records) == len(rows)
    head, body = next(r for r in records if b"<urn:page:5>\r\nWARC-Date" in r).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and body == b"same\r\n\r\n"
    assert cas_archive.read_archive(cas_archive.write_archive(pages.limit(0))).count() == 0


def test_archive_keeps_rows_without_an_id(spark):
    rows = [(None, "a", "alone"), (None, "b", "alone"), (None, "c", "shared"), (7, "d", "shared"), (None, None, None), (None, "e", "größer")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = cas_archive.write_archive(pages)
    assert archive.payloads.count() == 4
    key = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    want = [(page, len((html or "").encode()), key(html), "response" if page == 7 else "revisit", None) for page, _, html in rows]
    got = cas_archive.read_archive(archive).select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    records = [bytes(row["record"]) for row in cas_archive.records(archive).collect()]
    assert sorted(record.split(b"\r\n\r\n", 1)[1] for record in records) == sorted((html or "").encode() + b"\r\n\r\n" for _, _, html in rows)
    assert sum(b"WARC-Record-ID: <urn:page:>\r\n" in record and b"WARC-Refers-To" not in record for record in records) == 5


def test_damaged_payloads_stop_the_job(spark):
    import pytest

    pages = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    archive = cas_archive.write_archive(pages)
    broken = cas_archive.Archive(archive.headers, archive.payloads.selectExpr("digest", "cast('other' as binary) payload"))
    with pytest.raises(Exception, match="damaged payload"):
        cas_archive.read_archive(broken).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies, as everyone does.</div>
<article><header>Section</header><h1>Head &amp; <em>shoulders</em></h1>
<p>First   paragraph, with &lt;b&gt; and
a line break.<br>Second line.<p>Unclosed <b>bold paragraph.
<ul><li>One,<li>two.</ul><div class="ad">Buy, now!</div><aside>Aside, here.</aside>
<form><p>Your mail?</p></form><p></p><blockquote>Quoted.</blockquote></article>
<div id="comments"><p>Nice article, thanks. Really.</p></div><footer>(c)</footer></body></html>"""


def test_main_text_of_a_page():
    assert tag_paths.main_text(PAGE) == (
        "Head & shoulders\nFirst paragraph, with <b> and a line break. Second line.\nUnclosed bold paragraph.\nOne,\ntwo.\nQuoted."
    )
    loose = "<div class='menu'>a</div><div><h2>Title here</h2><p>Some text, long enough.</p><p>More.</p></div><div class='site-footer'>f</div>"
    assert tag_paths.main_text(loose) == "Title here\nSome text, long enough.\nMore."
    for odd in (None, "", "<", "<p", "</p></div>", "<!--", "<p>&#0;&bogus;", "<script>", "<a b='"):
        tag_paths.main_text(odd)
    assert tag_paths.main_text(None) == ""


def test_main_text_without_punctuation_and_in_odd_wrappers():
    text = "<p>A first paragraph, long enough to be one.</p><p>And a second one, as long as it. Really.</p>"
    plain = "A first paragraph, long enough to be one.\nAnd a second one, as long as it. Really."
    page = f"<article><div><h1>Headline</h1></div>{text}<ul><li>one item<li>another</ul><table><tr><td>cell</table><pre>code x</pre></article>"
    assert tag_paths.main_text(page) == f"Headline\n{plain}\none item\nanother\ncell\ncode x"
    menu = "<div><ol><li><a href='/'>Home</a><li><a href='/x'>Other pages</a></ol></div>"
    assert tag_paths.main_text(f"{menu}<section>{text}<ul><li>one item</ul></section>") == f"{plain}\none item"
    for wrapper in ("body class='has-sidebar'", "div id='page' class='with-sidebar'", "div class='search-results'"):
        name = wrapper.split()[0]
        assert tag_paths.main_text(f"<{wrapper}>{text}<div class='sidebar'>Side, ways.</div></{name}>") == plain
    assert tag_paths.main_text(f"<div><div class='article-header'><h1>Headline</h1></div>{text}</div>") == f"Headline\n{plain}"
    teasers = "<div><article>Read this.</article><article>And that.</article></div>"
    assert tag_paths.main_text(f"<div>{text}</div>{teasers}").startswith(plain)
    assert tag_paths.main_text(f"<div><p>Short, but it.</p></div><div id='comments'>{text}</div>") == "Short, but it."


def test_pages_query_keeps_every_block_of_the_article(spark):
    import html
    import re

    pages = {row["page_id"]: row for row in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op9_tag_paths"](spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[row["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", block)).split()) for block in re.split(r"</?(?:p|h1)>", inner)]
        assert row["text"] == "\n".join(filter(None, blocks))
        assert row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_mixture_reaches_its_weights(spark, docs_of):
    docs = docs_of([(i, f"t{i}", "en", "big" if i % 10 else "small") for i in range(4000)] + [(None, None, None, None), (7, "t7", "en", "big")])
    weights = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "mix_source string, weight double")
    rows = poisson_mix.mix(docs, weights=weights).collect()
    small = sum(row["source"] == "small" for row in rows)
    assert abs(small - 2001) < 5 * 2001**0.5 and abs(len(rows) - 4002) < 5 * 4002**0.5
    assert all(row["source"] for row in rows)
    assert {row["copy"] for row in rows} >= {1, 2, 3, 4, 5}
    ids = [row["doc_id"] for row in rows]
    assert ids != sorted(ids)
    again = poisson_mix.mix(docs.repartition(7), weights=weights).collect()
    key = lambda row: (row["doc_id"], row["copy"], row["shuffle_key"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert poisson_mix.mix(docs.limit(0)).count() == 0
    assert poisson_mix.mix(docs.where("source is null")).count() in range(9)


def test_large_means_are_split_into_draws(spark, docs_of):
    docs = docs_of([(i, "t", "en", "a" if i else "rare") for i in range(1000)])
    weights = spark.createDataFrame([("a", 0.9), ("rare", 0.1)], "mix_source string, weight double")
    rare = poisson_mix.mix(docs, weights=weights).where("source = 'rare'").count()
    assert 50 < rare < 150


def test_rows_without_an_id_draw_by_their_text(docs_of, spark):
    docs = docs_of([(None, f"text {at}", "en", "a") for at in range(600)] + [(None, None, "en", "a"), (None, "", "en", "a")])
    weights = spark.createDataFrame([("a", 2.0)], "mix_source string, weight double")
    rows = poisson_mix.mix(docs, weights=weights).collect()
    times = Counter(row["text"] for row in rows)
    drawn = Counter(times.get(f"text {at}", 0) for at in range(600))
    assert 1.8 < sum(times.values()) / 602 < 2.2
    assert 50 < drawn[0] < 115 and 120 < drawn[1] < 205 and 120 < drawn[2] < 205
    assert times[None] == times[""]
    assert len({row["shuffle_key"] for row in rows}) > 1000


def test_leaks_are_found_and_clean_texts_are_not(spark, docs_of, odd_rows):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    body = lambda n: " ".join(rng.choice(words, n))
    items = [(i, body(12) + ". " + body(12) + ".") for i in range(40)] + [(90, None), (91, ""), (92, body(3))]
    benchmark = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    changed = items[2][1].split()
    changed[5], changed[9] = "other", "words"
    rows = [
        (101, f"{body(300)} {items[0][1]} {body(100)}", "en", "a"),
        (102, f"{body(90)} {items[1][1].upper()}", "en", "a"),
        (103, f"{body(90)} {' '.join(changed)} {body(40)}", "en", "a"),
        (104, " ".join(items[3][1].split()[:8]) + " " + body(200), "en", "a"),
        *[(200 + i, body(150), "en", "a") for i in range(40)],
    ]
    docs = docs_of(rows + odd_rows)
    found = {(row["doc_id"], row["item_id"]) for row in latent_leaks.leaks(docs, benchmark).collect()}
    assert found == {(101, 0), (102, 1), (103, 2)}
    kept = latent_leaks.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert latent_leaks.leaks(docs, benchmark.limit(0)).count() == 0
    assert latent_leaks.leaks(docs.limit(0), benchmark).count() == 0


def test_verbatim_items_are_found_in_benchmarks_above_the_rank(spark, docs_of):
    rng = np.random.default_rng(8)
    share = 1 / np.arange(1, 4001)
    words = np.array([f"w{i}" for i in range(4000)])
    body = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    items = [(i, body(int(rng.integers(25, 60)))) for i in range(1100)]
    assert len(items) > 4 * latent_leaks.RANK
    docs = docs_of([(i, f"{body(70)} {text} {body(70)}", "en", "a") for i, text in items])
    found = {(row["doc_id"], row["item_id"]) for row in latent_leaks.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i, _ in items} - found == set()


def test_the_latent_space_is_truncated_and_keeps_every_passage():
    rng = np.random.default_rng(5)
    topics = [rng.choice(900, 40, replace=False) for _ in range(12)]
    rows = np.zeros((120, 900))
    for at, row in enumerate(rows):
        row[rng.choice(topics[at % 12], 25, replace=False)] = rng.random(25) + 0.2
        row[rng.choice(900, 4, replace=False)] = 0.2
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    basis = latent_leaks.leading(rows)
    assert basis.shape[1] < len(rows)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]))
    assert ((rows @ basis) ** 2).sum(axis=1).min() >= latent_leaks.RETAINED
    # Words of the topic count for a passage that lacks them: the space changes cosines.
    plain, image = rows @ rows.T, rows @ basis @ basis.T
    cosines = rows @ (image / np.linalg.norm(image, axis=1, keepdims=True)).T
    same = (np.arange(120)[:, None] % 12 == np.arange(120) % 12) & ~np.eye(120, dtype=bool)
    assert np.abs(cosines - plain)[same].max() > 0.02 and cosines[same].mean() > plain[same].mean()
    assert latent_leaks.leading(rows[:1]).shape[1] == 1 and latent_leaks.leading(np.repeat(rows[:1], 5, axis=0)).shape[1] == 1


def test_subsequence_length():
    a, b = list(b"xabcdyzab"), list(b"aqbcxdzzb")
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert latent_leaks.subsequence(latent_leaks.places_of(a), len(a), b) == best[-1][-1]


def one_pass(model, lines):
    costs = model.costs(lines)
    scores, back = model.start + costs[0], []
    for cost in costs[1:]:
        ways = scores[:, None] + model.move
        back.append(ways.argmax(0))
        scores = ways.max(0) + cost
    states = [int(scores.argmax())]
    for pointers in reversed(back):
        states.append(int(pointers[states[-1]]))
    return states[::-1]


def test_viterbi_in_pieces_is_one_pass_and_roles_are_recovered(spark, monkeypatch):
    monkeypatch.setattr(transcript_hmm, "PIECE", 3)
    monkeypatch.setattr(transcript_hmm, "RUN", 4)
    lines = transcript_hmm.written_down(spark.read.parquet(f"{SF}/conversations.parquet"))
    numbered = stored(transcript_hmm.numbered(lines), "test-lines")
    model = transcript_hmm.fitted(transcript_hmm.state_counts(numbered.where("conv_id % 2 = 0")))
    by_conversation = {}
    for row in sorted(transcript_hmm.decode(numbered.where("conv_id % 2 = 1"), model).collect(), key=lambda row: row["number"]):
        by_conversation.setdefault(row["conv_id"], []).append(row)
    right = total = 0
    for rows in by_conversation.values():
        assert [row["number"] for row in rows] == list(range(len(rows)))
        assert [row["state"] for row in rows] == one_pass(model, [row["line"] for row in rows])
        right += sum(transcript_hmm.STATES[row["state"]][0] == row["role"] for row in rows)
        total += len(rows)
    assert right / total > 0.8


def test_transcript_odd_lines(spark):
    rows = [(None, 0, None), (None, 0, None), (1, 0, ""), (1, 1, "User: hi?"), (1, 2, "[assistant] Hello.\nMore."), (2, 5, "**Human:** Where was it, then?")]
    lines = spark.createDataFrame([(a, b, 0, c, "z") for a, b, c in rows], "conv_id long, place long, part int, line string, state string").drop("state")
    known = transcript_hmm.written_down(spark.read.parquet(f"{SF}/conversations.parquet"))
    found = transcript_hmm.recovered(lines, known).collect()
    assert len(found) == len(rows)
    assert {row["found_role"] for row in found if row["line"] and "assistant" in row["line"]} == {"assistant"}
    blocks = {(row["conv_id"], row["place"]): row["rendered"] for row in transcript_hmm.rendered_blocks(transcript_hmm.recovered(lines, known)).collect()}
    assert blocks[(2, 5)].endswith("user\nWhere was it, then?") and blocks[(1, 2)].startswith("<|im_start|>assistant\nHello.")
    assert transcript_hmm.recovered(lines.limit(0), known).count() == 0
    assert {row["found_role"] for row in transcript_hmm.recovered(lines, known.limit(0)).collect()} <= {"system", "user", "assistant"}


def test_pipeline_stages_keep_columns_and_agree_with_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == names
        counts.append(docs.count())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = ["doc_id", "copy", "text"]
    assert sorted(map(tuple, last.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect()))
    leaked = {row["doc_id"] for row in latent_leaks.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not leaked
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_catalog():
    assert set(ORACLES) <= set(QUERIES)
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}
