"""Toxicity by a learned lexicon whose spellings are met through a Levenshtein automaton.

**Lexicon.** On a bounded sample of labelled rows (``SAMPLE_ROWS`` of each label, by the hash of their id) Spark
counts the toxic and the clean documents of every word and of every word beginning. Near copies would make
the words of one text look like evidence, so of documents with the same smallest hash of a three-word run
one counts. Forms that are far more
frequent in toxic documents (likelihood ratio against the number of forms tried) become entries: whole
words, or stems where the beginning says more than any single word.

**Matching.** The entries form a trie. A state of the matcher is a set of (trie node, edits so far), i.e. the
Levenshtein automaton run over the whole trie at once; states are made when first met and kept, so
a word costs one table look-up a letter and most words end in the dead state after a few. Whole words
of 4 letters allow one edit, of 8 two; stems of 8 letters allow one, shorter ones none.

**Weights.** Every hit has a log likelihood ratio: the entry's own for its exact form, the spelling's own where the
sample knows the spelling (a clean word one letter off isn't a misspelling), and otherwise that of
spellings met once. The window around a hit is scored for quotation (quotation marks around it,
words of reporting) against address (second person), which splits its weight into quoted and direct.
A document's strongest direct and quoted hit and the number of further ones go into a logistic
regression with a prior, fitted on the sample.

Null and empty texts have no hits and get the score of such texts. Very long texts are read whole. Rows without
an id are scored and never learned from; repeated rows are scored alike; a document labelled both ways counts as
toxic. With no usable label the score is 0 for texts without hits and there are no hits. Columns
other than id, text and label are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from touchline.llm.common import stored

# Labelled rows of each label from which lexicon and weights are learned, and entries at most.
SAMPLE_ROWS = 20_000
LEXICON_ROWS = 5_000
SPELLINGS = 50_000
STEM_LETTERS = range(3, 13)
WORD_LETTERS = 24
LEAST_DOCUMENTS = 3
LEAST_LOG_RATIO = 2.0
WINDOW = 6
# Words that a worker remembers the outcome of.
REMEMBERED = 300_000
# States of the automaton that it keeps before it starts anew.
STATES = 100_000
# Words of a run whose smallest hash tells copies of a document.
RUN = 3

# Marks and words of quotation and of address.
PUNCTUATION = ".,;:!?\"'()[]{}<>|*_-~`´“”„«»‘’…¡¿#"
QUOTES = "\"“”„«»"
REPORTING = frozenset(
    "said says wrote writes called quote quoted word term phrase comment slur "
    "sagte schrieb nannte wort zitat dit disait écrit mot terme citation dijo escribió palabra término cita".split()
)
ADDRESS = frozenset("you your you're u ur du dich dir dein deine ihr tu toi ton ta vous votre tú te usted vosotros".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
# Prior of the regression: strongest direct hit, further ones, strongest quoted hit, quoted ones; and its spread.
PRIOR, SPREAD = np.array([1.0, 0.2, 0.3, 0.1]), 0.5


class Entry(NamedTuple):
    form: str
    whole: bool
    weight: float

    @property
    def edits(self) -> int:
        letters = len(self.form)
        return (2 if letters >= 8 else letters >= 4) if self.whole else int(letters >= 8)


def core(token: str) -> str:
    """A token without the marks around it; digits and signs that stand for letters are read as such."""
    if token.isalpha():
        return token
    bare = token.strip(PUNCTUATION)
    if not bare or bare.isalpha() or not any(map(str.isalpha, bare)):
        return bare
    return bare.translate(LOOKALIKES)


class Matcher:
    """The Levenshtein automaton over the trie of the entries, its deterministic states made on demand."""

    def __init__(self, entries: list[Entry]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.reach = [0]  # edits that some entry below a node allows
        self.ends: dict[int, list[int]] = defaultdict(list)
        for number, entry in enumerate(entries):
            node = 0
            self.reach[0] = max(self.reach[0], entry.edits)
            for letter in entry.form:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], entry.edits)
            self.ends[node].append(number)
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str | None, int]] = []
        self.letters: list[set[str]] = []
        self.at_end: list[tuple[int, int] | None] = []
        self.at_once: list[tuple[int, int] | None] = []
        self.dead = self.number(frozenset())
        self.start = self.number(self.closed({0: 0}))

    def closed(self, least: dict[int, int]) -> frozenset:
        """With nodes reached by letters left out of the word; the fewest edits of each node."""
        open_nodes = list(least)
        while open_nodes:
            node = open_nodes.pop()
            for child in self.children[node].values():
                edits = least[node] + 1
                if edits <= self.reach[child] and edits < least.get(child, 99):
                    least[child] = edits
                    open_nodes.append(child)
        return frozenset(least.items())

    def number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.letters.append({letter for node, _ in state for letter in self.children[node]})
            hits = [(e, n) for node, e in state for n in self.ends.get(node, ()) if e <= self.entries[n].edits]
            best = lambda found: min(found, key=lambda x: (x[0], -self.entries[x[1]].weight, x[1]), default=None)
            self.at_end.append(best([h for h in hits if self.entries[h[1]].whole]))
            self.at_once.append(best([h for h in hits if not self.entries[h[1]].whole]))
        return self.numbers[state]

    def step(self, state: int, letter: str) -> int:
        """The state after a letter, made if it's new; ``find`` asks only for steps it doesn't know."""
        known = letter if letter in self.letters[state] else None  # all other letters act alike
        after = self.steps[state].get(known)
        if after is None:
            least: dict[int, int] = {}

            def reach(node, edits):
                if edits <= self.reach[node] and edits < least.get(node, 99):
                    least[node] = edits

            for node, edits in self.states[state]:
                reach(node, edits + 1)
                for label, child in self.children[node].items():
                    reach(child, edits + (label != known))
            after = self.steps[state][known] = self.number(self.closed(least))
        self.steps[state][letter] = after
        return after

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the closest entry of a word, or None."""
        state, stem, steps, at_once = self.start, None, self.steps, self.at_once
        for letter in word:
            after = steps[state].get(letter)
            state = self.step(state, letter) if after is None else after
            if not state:  # the dead state is number 0
                return stem
            once = at_once[state]
            if once and (stem is None or once < stem):
                stem = once
        found = [hit for hit in (self.at_end[state], stem) if hit]
        return min(found, default=None)


class Model(NamedTuple):
    entries: list[Entry]
    spellings: dict[tuple[str, int], float]
    unseen: float
    bias: float
    coefficients: np.ndarray


class Reader:
    """Finds and weighs the hits of texts; remembers words."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.entries)
        self.hits: dict[str, tuple[str, int, int]] = {}
        self.misses: set[str] = set()

    def learn(self, words: set[str]) -> None:
        if len(self.misses) + len(self.hits) > REMEMBERED:
            self.hits, self.misses = {}, set()
        if len(self.matcher.states) > STATES:
            self.matcher = Matcher(self.model.entries)
        for word in words - self.misses - self.hits.keys():
            bare = core(word)
            found = self.matcher.find(bare) if bare else None
            if found:
                self.hits[word] = (bare, *found)
            else:
                self.misses.add(word)

    def found(self, text: str | None) -> tuple[list[str], list[int]]:
        """The words of a text and the places of its hits."""
        words = text.lower().split() if text else []
        distinct = set(words)
        self.learn(distinct)
        if distinct.isdisjoint(self.hits):
            return words, []
        return words, [i for i, word in enumerate(words) if word in self.hits]

    def weight(self, word: str) -> float:
        bare, edits, entry = self.hits[word]
        own = self.model.entries[entry].weight
        if edits == 0:
            return own
        return min(own, self.model.spellings.get((bare, entry), self.model.unseen))

    def features(self, text: str | None) -> list[float]:
        words, places = self.found(text)
        direct, quoted = [], []
        for place in places:
            weight = self.weight(words[place])
            if weight > 0:
                q = quotation(words, place)
                direct.append(weight * (1 - q))
                quoted.append(weight * q)
        rest = lambda w: math.log1p(sum(w) - max(w)) if w else 0.0
        return [max(direct, default=0.0), rest(direct), max(quoted, default=0.0), rest(quoted)]


def quotation(words: list[str], place: int) -> float:
    """How much the window around a word speaks for quotation, from 0 to 1."""
    before, own, after = words[max(0, place - WINDOW) : place], words[place], words[place + 1 : place + 1 + WINDOW]
    marks = lambda tokens: sum(t.count(q) for t in tokens for q in QUOTES)
    bare = own.strip(PUNCTUATION)
    left, _, right = own.partition(bare) if bare else (own, "", "")
    opened = (marks(before) + marks([left])) % 2 == 1
    closed = marks([right]) + marks(after) > 0
    near = {t.strip(PUNCTUATION) for t in (*before, *after)}
    score = 0.6 * (opened and closed) + 0.3 * bool(near & REPORTING) - 0.3 * bool(near & ADDRESS)
    return min(1.0, max(0.0, score))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def signature(text: str | None) -> int:
    """The smallest CRC of all runs of RUN words; copies and most near copies share it."""
    words = text.lower().encode("utf-8").split() if text else []
    return min((crc32(b" ".join(words[i : i + RUN])) for i in range(max(1, len(words) - RUN + 1))), default=0)


def sample_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE_ROWS labelled rows of each label outside the held-out fifth, written down.

    One document stands for those of the same label and signature.
    """
    rated = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rated = rated.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    by_hash = lambda toxic: rated.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    chosen = stored(by_hash(1).unionByName(by_hash(0)), "toxic-sample-ids")  # at most 2 x SAMPLE_ROWS ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")

    def signed(batches):
        for batch in batches:
            signs = [signature(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.int64())], ["text", "toxic", "sign"])

    by_sign = texts.mapInArrow(signed, "text string, toxic int, sign long").groupBy("sign", "toxic")
    return stored(by_sign.agg(F.min("text").alias("text")).select("text", "toxic"), "toxic-sample")


def form_counts(sample: DataFrame) -> DataFrame:
    """(form, whole, toxic, clean): documents of each label with a word, or a beginning of words."""

    def count(batches):
        for batch in batches:
            by_label = (Counter(), Counter())
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words = {w for w in map(core, set((text.as_py() or "").lower().split())) if 3 <= len(w) <= WORD_LETTERS}
                by_label[toxic].update((w, True) for w in words)
                by_label[toxic].update({(w[:n], False) for w in words for n in STEM_LETTERS if n <= len(w)})
            # Only forms of toxic documents can become entries, but their clean documents are in any batch.
            forms = list(by_label[0].keys() | by_label[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f for f, _ in forms], pa.string()),
                    pa.array([w for _, w in forms], pa.bool_()),
                    pa.array([by_label[1][f] for f in forms], pa.int64()),
                    pa.array([by_label[0][f] for f in forms], pa.int64()),
                ],
                ["form", "whole", "toxic", "clean"],
            )

    parts = sample.mapInArrow(count, "form string, whole boolean, toxic long, clean long")
    return parts.groupBy("form", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_ratio(toxic, clean, n_toxic, n_clean):
    """Log of how much more frequent something is in toxic documents, half a document added."""
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def lexicon_of(counts: DataFrame, n_toxic: int, n_clean: int) -> list[Entry]:
    """Entries from the forms whose likelihood ratio stands out of all forms tried."""
    part = lambda k, n: F.when(k > 0, k * F.ln(k / n)).otherwise(0.0)
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    total, n = t + c, float(n_toxic + n_clean)
    ratio = 2 * (
        part(t, F.lit(float(n_toxic))) + part(c, F.lit(float(n_clean)))
        + part(n_toxic - t, F.lit(float(n_toxic))) + part(n_clean - c, F.lit(float(n_clean)))
        - part(total, F.lit(n)) - part(n - total, F.lit(n))
    )
    lead = F.ln((t + 0.5) / (n_toxic + 1)) - F.ln((c + 0.5) / (n_clean + 1))
    written = stored(counts.withColumn("ratio", ratio), "toxic-forms")
    tried = max(1, written.count())
    chosen = written.where((F.col("toxic") >= LEAST_DOCUMENTS) & (lead >= LEAST_LOG_RATIO) & (F.col("ratio") >= 2 * math.log(tried)))
    order = [F.col("ratio").desc(), F.col("whole").desc(), F.length("form").desc(), F.col("form")]
    entries, taken, beginnings, stems = [], set(), set(), set()
    for row in chosen.orderBy(*order).limit(4 * LEXICON_ROWS).collect():
        form = row["form"]
        covered = any(form[:n] in stems for n in STEM_LETTERS if n <= len(form))
        if covered or form in taken or not row["whole"] and form in beginnings:
            continue
        taken.add(form)
        beginnings.update(form[:n] for n in range(1, len(form) + 1))
        if not row["whole"]:
            stems.add(form)
        entries.append(Entry(form, row["whole"], log_ratio(row["toxic"], row["clean"], n_toxic, n_clean)))
    return entries[:LEXICON_ROWS]


def spelling_weights(sample: DataFrame, model: Model, n_toxic: int, n_clean: int) -> tuple[dict, float]:
    """Log ratios of the inexact spellings that the sample knows, and that of spellings met once."""

    def count(batches):
        reader = Reader(model)
        for batch in batches:
            rows = Counter()
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                words, places = reader.found(text.as_py())
                hits = {reader.hits[words[p]] for p in places}
                rows.update((bare, entry, toxic) for bare, edits, entry in hits if edits)
            keys = list(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.int32()),
                    pa.array([rows[k] for k in keys], pa.int64()),
                ],
                ["bare", "entry", "label", "n"],
            )

    each = sample.mapInArrow(count, "bare string, entry int, label int, n long").groupBy("bare", "entry").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    each = stored(each, "toxic-spellings")
    once = each.where("toxic + clean = 1").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    unseen = log_ratio(once["t"] or 0, once["c"] or 0, n_toxic, n_clean)
    rows = each.orderBy((F.col("toxic") + F.col("clean")).desc(), "bare", "entry").limit(SPELLINGS).collect()
    return {(r["bare"], r["entry"]): log_ratio(r["toxic"], r["clean"], n_toxic, n_clean) for r in rows}, unseen


def fitted(features: np.ndarray, toxic: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and coefficients of the most likely regression under the prior."""
    rows = np.column_stack([np.ones(len(features)), features])
    beta = np.append(math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)), PRIOR)
    middle, tight = beta.copy(), np.append(0.01, np.full(len(PRIOR), 1 / SPREAD**2))

    def loss(b):
        z = rows @ b
        return np.logaddexp(0, z).sum() - toxic @ z + tight @ (b - middle) ** 2 / 2

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -500, 500)))
        gradient = rows.T @ (p - toxic) + tight * (beta - middle)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(tight), gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0]), beta[1:]


def feature_rows(reader: Reader, texts) -> np.ndarray:
    return np.array([reader.features(t.as_py()) for t in texts]).reshape(-1, len(PRIOR))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = sample_of(docs, labels)
    sizes = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model([], {}, 0.0, 50.0 if n_toxic else -50.0, PRIOR)
    entries = lexicon_of(form_counts(sample), n_toxic, n_clean)
    plain = Model(entries, {}, 0.0, 0.0, PRIOR)
    spellings, unseen = spelling_weights(sample, plain, n_toxic, n_clean)
    model = Model(entries, spellings, unseen, 0.0, PRIOR)

    def measure(batches):
        reader = Reader(model)
        for batch in batches:
            found = feature_rows(reader, batch.column("text"))
            columns = [pa.array(found[:, i]) for i in range(len(PRIOR))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", "a", "b", "c", "d"])

    rows = sample.mapInArrow(measure, "toxic int, a double, b double, c double, d double").collect()  # the bounded sample
    values = np.array([tuple(row) for row in rows], float)
    bias, coefficients = fitted(values[:, 1:], values[:, 0])
    return model._replace(bias=bias, coefficients=coefficients)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, direct, quoted): one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def judge(batches):
        reader = Reader(model.value)
        for batch in batches:
            found = feature_rows(reader, batch.column("text"))
            z = np.clip(model.value.bias + found @ model.value.coefficients, -700, 700)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z))), pa.array(found[:, 0]), pa.array(found[:, 2])],
                ["doc_id", "score", "direct", "quoted"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {id_type}, score double, direct double, quoted double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "direct",
        "quoted",
    )
