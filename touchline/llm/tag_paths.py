"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and text. Every text node belongs to a path of tags from the
root; characters and punctuation marks are summed per path. A path's two ratios (characters and
punctuation per node) are smoothed with those of its neighbours, the paths that share its parent,
then fused and compared with a threshold relative to the page. Blocks of selected paths are the
main text. A path without punctuation (a list, table, headline or code) takes that of the content
around it, by the share of its text outside links; menus are links. Elements that say what they are
(menus, footers, forms, adverts and the like, by tag name, role, class or id) are no candidates.
Class and id words don't count on html and body, nor do words of layout on wrappers that hold most
of the page's text outside links. Where a page marks an article that holds most of its text outside links, only
paths below it are candidates.

A page is one row and needs nothing of other rows, so the operator is a map without a shuffle.

Cases: null or empty html gives an empty text; unclosed, crossed and stray tags are closed like a
browser closes them, as far as blocks go; a cut page ends its open elements; long pages are read
whole; other columns are ignored, ``page_id`` and ``url`` may be null; equal rows give equal results.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from math import log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
# Closed by the start of a block.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot article section div body main aside nav header footer form select".split())
NEVER = frozenset(
    "script style noscript template head title nav header footer aside form button input select option textarea label fieldset "
    "iframe object embed canvas svg math dialog menu noembed noframes xmp audio video".split()
)
BANNED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names that mark what is not the article.
BANNED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar side aside widget footer header masthead topbar comment comments reply replies respond disqus "
    "discussion cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup login share sharing "
    "social related recommended recommendations pagination pager toolbar search form disclaimer copyright skip".split()
)
# Of these, words of layout, which a wrapper of the article may have too.
LAYOUT_WORDS = frozenset(
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside widget footer header masthead topbar share "
    "sharing social toolbar search form skip".split()
)
# Words of class and id names of the article's parts; its header holds the headline.
ARTICLE_PARTS = frozenset("article entry post story content".split())
ARTICLE = ("article", "main")
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|</?([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PUNCTUATION = ".,;:!?…。、，！？；：·¿¡"
# Share of the page's best fused ratio that a path must reach.
THRESHOLD = 0.05
SMOOTHING = 0.5
FORMS = "page_id long, url string, text string, n_chars long"


# What bans an element: what it is or holds, or only words of layout.
FIRM, WORD = 0, 1


def banned(name: str, attributes: str) -> int | None:
    if name in NEVER:
        return FIRM
    if not attributes.strip():
        return None
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return FIRM
    if set(found.get("role", "").lower().split()) & BANNED_ROLES:
        return FIRM
    if name in ("html", "body"):
        return None
    words = {word.lower() for word in NAME_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if words & ARTICLE_PARTS:
        words.discard("header")
    words &= BANNED_WORDS
    if not words:
        return None
    return WORD if words <= LAYOUT_WORDS else FIRM


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, bool, bool, int]]:
    """(path, text, inside a banned element, inside an article, characters in links) of every block
    with text, in page order."""
    stack: list[tuple[str, tuple[int, ...], bool]] = []  # name, bans here or above, article here or above
    blocks: list[tuple[tuple[str, ...], str, tuple[int, ...], bool, int]] = []
    pieces: list[str] = []
    held = [0]  # characters outside links under each ban by word; the first stands for all firm bans
    linked = at = 0

    def bans(name: str, attributes: str, above: tuple[int, ...]) -> tuple[int, ...]:
        kind = banned(name, attributes)
        if kind is None or FIRM in above:
            return above
        if kind == FIRM:
            return (*above, FIRM)
        held.append(0)
        return (*above, len(held) - 1)

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if any(name == "a" for name, _, _ in stack):
            linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if not pieces:
            return
        text = "".join(pieces)
        pieces.clear()
        in_links, linked = linked, 0
        text = " ".join((references.unescape(text) if "&" in text else text).split())
        if text:
            top = stack[-1] if stack else ("", (), False)
            path = tuple(name for name, _, _ in stack if name not in INLINE)
            in_links = min(in_links, len(text))
            blocks.append((path, text, top[1], top[2], in_links))
            if FIRM not in top[1]:
                for ban in top[1]:
                    held[ban] += len(text) - in_links

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]

    while at < len(page):
        match = TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        name = (match[1] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                pieces.append(references.escape(match[0][9:-3], quote=False))
            continue
        if page[match.start() + 1] == "/":
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if opened is None:
                if name in ("br", "p"):
                    pieces.append(" ") if name == "br" else flush()
            elif name in INLINE and not stack[opened][1]:
                if all(x[0] in INLINE for x in stack[opened:]):
                    del stack[opened]
            else:
                close_to(opened)
            continue
        if name in VOID:
            if name in ("br", "img", "wbr", "input"):
                pieces.append("" if name == "wbr" else " ")
            else:
                flush()
            continue
        above = stack[-1] if stack else ("", (), False)
        if name in INLINE:
            inside = bans(name, match[2], above[1])
            if inside and not above[1]:
                flush()
            stack.append((name, inside, above[2]))
            continue
        flush()
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS:
                    break
        while stack and stack[-1][0] in INLINE and not stack[-1][1]:  # an inline element left open ends with its block
            stack.pop()
        if name in SAME_KIND:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_KIND[name]:
                    del stack[i:]
                    break
                if stack[i][0] in CONTAINERS and not (name == "tr" and stack[i][0] in ("tbody", "thead", "tfoot")):
                    break
        above = stack[-1] if stack else ("", (), False)
        stack.append((name, bans(name, match[2], above[1]), above[2] or name in ARTICLE))
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end is None:
                stack.pop()
    flush()
    total = sum(len(text) - in_links for _, text, found, _, in_links in blocks if FIRM not in found)
    lifted = {ban for ban in range(1, len(held)) if 2 * held[ban] > total}
    return [(path, text, not lifted.issuperset(found), article, in_links) for path, text, found, article, in_links in blocks]


def path_scores(blocks) -> dict[tuple[str, ...], float]:
    """Fused ratio of every path: geometric mean of smoothed characters and punctuation per node.

    Where neither a path nor its neighbours have punctuation, that of the closest enclosing node
    which has some counts, by the share of the path's text outside links (all of it in an article)."""
    nodes, chars, marks, links = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    below: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])  # nodes and marks of a subtree
    for path, text, _, article, in_links in blocks:
        found = sum(map(text.count, PUNCTUATION))
        nodes[path] += 1
        chars[path] += len(text)
        marks[path] += found
        links[path] += 0 if article else in_links
        for depth in range(len(path) + 1):
            below[path[:depth]][0] += 1
            below[path[:depth]][1] += found
    by_parent = defaultdict(list)
    for path in nodes:
        by_parent[path[:-1]].append(path)

    def smooth(totals, path):
        near = by_parent[path[:-1]]
        own = totals[path] / nodes[path]
        around = sum(totals[p] for p in near) / sum(nodes[p] for p in near)
        return (1.0 - SMOOTHING) * own + SMOOTHING * around

    def smooth_marks(path):
        near = smooth(marks, path)
        if near:
            return near
        count, found = next((below[path[:depth]] for depth in range(len(path), -1, -1) if below[path[:depth]][1]), (1, 0))
        return SMOOTHING * found / count * (1.0 - links[path] / chars[path])

    return {path: sqrt(log1p(smooth(chars, path)) * log1p(smooth_marks(path))) for path in nodes}


def main_text(page: str | None) -> str:
    open_blocks = [block for block in blocks_of(page or "") if not block[2]]
    marked = [block for block in open_blocks if block[3]]
    outside_links = lambda blocks: sum(len(block[1]) - block[4] for block in blocks)
    candidates = marked if marked and 2 * outside_links(marked) >= outside_links(open_blocks) else open_blocks
    scores = path_scores(candidates)
    floor = THRESHOLD * max(scores.values(), default=0.0)
    return "\n".join(block[1] for block in candidates if scores[block[0]] >= floor)


def _extracted(batches):
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted, FORMS)
