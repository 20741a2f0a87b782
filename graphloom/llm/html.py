"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each block has its own and its
neighbours' word counts and link densities, and what kind of element holds it;
a decision tree grown from a small labelled table keeps or drops it.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks

# Element names by what they do to text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas title select textarea button datalist".split())
#: Raw text: ends at its own closing tag alone, so at the page's end without one.
RAW = frozenset("script style iframe textarea title".split())
#: Opening tags that end an unclosed svg or math element.
BREAKOUT = BLOCKS | frozenset("b big body br code em embed font i img meta nobr ruby s small span strike strong sub sup tt u var".split())
CHROME = frozenset("nav footer aside header form menu dialog".split())
CONTENT = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_WORDS = frozenset("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments complementary contentinfo consent cookie cookies copyright dialog disclaimer discussion disqus footer form gdpr header menu nav navbar navigation newsletter notice popup promo related reply replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget widgets".split())
#: A name of several parts says what an element is by its last part, or, where that only names a container or its filling, by its first.
CONTAINERS = frozenset("area bar block body box column container content inner info item items left link links list menu panel posts primary right secondary section slot stories text thread title top unit widgets wrap".split())
#: Names of an article that make it something else, and of a paragraph that make it an advert; their other names say nothing.
NO_ARTICLE = frozenset("ad advert advertisement comment comments reply replies related sponsored teaser".split())
ADVERT = frozenset("ad ads advert advertisement adverts promo share sharing social sponsor sponsored".split())
#: First parts of a name that make its header the text's own.
OWN = frozenset("article content entry post story".split())
WHOLE_NAMES = frozenset(["site-info", "skip-link"])
#: An opening tag closes an open element of these when it is one of those.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"[^\s]+")
_PARTS = re.compile(r"[a-z]+")
_MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?(?:main|article)\b", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "chrome", "content", "heading", "item", "stops", "linked_run", "share", "headings_before")
#: Pages of the labelled table and of its held-out part.
TABLE_PAGES, HELD_OUT_PAGES = 600, 300
#: Link density from which a block counts as linked.
LINKED = 0.6


def features(page: list[tuple]) -> list[tuple]:
    """The features of each block ``(words, words in links, chrome, content, heading, item, stops)`` among its neighbours.

    Beside its own and its neighbours' words and link density: whether tags (2)
    or names (1) say that it is no main text, an article element around it, the
    rank of a heading, list items, a full stop at its end, how many linked
    blocks stand together here, the share of the page's words outside links,
    and whether the block before is a heading.
    """
    none = (0, 0)
    density = [min(1.0, links / max(1, n)) for n, links, *_ in page]
    around = [none, *[(n, d) for (n, *_), d in zip(page, density)], none]
    runs, at = [0] * len(page), 0
    while at < len(page):
        end = at
        while end < len(page) and density[end] >= LINKED:
            end += 1
        runs[at:end] = [end - at] * (end - at)
        at = max(end, at + 1)
    plain = max(1, sum(max(0, n - links) for n, links, *_ in page))
    return [(*around[i + 1], *around[i], *around[i + 2], *page[i][2:7], runs[i], max(0, page[i][0] - page[i][1]) / plain, int(i > 0 and page[i - 1][4] > 0)) for i in range(len(page))]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> tuple | int:
    """A CART by Gini impurity with ``least`` rows a leaf: ``(feature, threshold, low, high)`` or a class. Ties go to the earlier feature."""
    if depth == 0 or len(y) < 2 * least or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(n[cut] >= least) & (len(y) - n[cut] >= least)]
        if not len(cut):
            continue
        low, high, k = ones[cut], ones[-1] - ones[cut], n[cut]
        impurity = low * (1 - low / k) + high * (1 - high / (len(y) - k))
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-9:
            best = (impurity[i], f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def silent_end(page: str, name: str, at: int, opened: set[str], unclosed: set[str]) -> int:
    """Where a silent element whose tag ends at ``at`` ends.

    That is its closing tag, or the closing tag of an element of ``opened``
    around it, or for a button or select another one. Without a closing tag of
    its own it also ends at an article, main or body, and svg and math at any
    tag that HTML lets break out of them. An unclosed title, which holds no
    tags, ends at the next one. ``unclosed`` keeps the names that have no
    closing tag further on.
    """
    end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
    if end is None:
        unclosed.add(name)
    if name in RAW:
        if end is None and name == "title":
            m = re.compile(r"</?[a-zA-Z]").search(page, at)
            return m.start() if m else len(page)
        return end.end() if end else len(page)
    stops = () if end else (BREAKOUT | CONTENT if name in ("svg", "math") else CONTENT | {"body"})
    inner: dict[str, int] = {}
    while m := _PIECE.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if inner.get(tag):
                inner[tag] -= 1
            elif tag == name:
                return at
            elif tag in opened:
                return m.start()
        elif tag in stops or (tag == name and name in ("button", "select")):
            return m.start()
        elif not m[3].endswith("/"):
            if tag in ("script", "style"):
                at = silent_end(page, tag, at, opened, unclosed)
            elif tag == name or tag in BLOCKS - VOID:
                inner[tag] = inner.get(tag, 0) + 1
    return len(page)


def chrome_name(attributes: str, content: int, words: frozenset[str] = CHROME_WORDS) -> bool:
    """Whether a class, an id or a role says that an element is no main text."""
    for found in _ATTR.findall(attributes):
        for name in _NAMES.findall("".join(found).lower()):
            parts = _PARTS.findall(name)
            if not parts or parts[0] in ("with", "has", "no", "without") or ("header" in parts and (content or parts[0] in OWN)):
                continue
            if name in WHOLE_NAMES or parts[-1] in words or (parts[0] in words and parts[-1] in CONTAINERS):
                return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """``(text, words, words in links, chrome, content, heading, item, stops)`` of each text block, in page order.

    Words are counted link by link: two links that touch within a word have it both.

    An element whose name says chrome, or a form, is a wrapper instead if it
    holds a first-rank heading, an article or a main element, and half of the
    page's words outside links.
    """
    out: list[tuple] = []
    stack: list[tuple[str, int, int, tuple[int, ...]]] = []  # name, chrome, content, elements around that a name or form marks
    marked: list[bool] = []  # for each of them: whether it holds a heading, an article or main
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n_links = len(html.unescape("".join(linked)).split())
                top = stack[-1] if stack else ("", 0, 0, ())
                n = text.count(" ") + 1
                out.append((text, n, n_links, top[1], top[2], heading, int(top[0] in ("li", "dd", "dt", "td", "th")), int(text[-1] in ".!?:;\u3002\u2026\"\u201d"), top[3]))
            parts.clear()
            linked.clear()

    at = 0
    while True:
        m = _PIECE.search(page, at)
        if m is None:
            text, nxt = page[at:], len(page)
        else:
            text, nxt = page[at : m.start()], m.end()
        if text:
            parts.append(text)
            if in_link:
                linked += [text, " "]
        if m is None:
            break
        at = nxt
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in SILENT:
                # Their content is no text: go to where it ends.
                if not m[3].endswith("/"):
                    at = silent_end(page, name, at, {s[0] for s in stack}, unclosed)
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name == "a":
                in_link += 1
                continue
            if name in BLOCKS:
                flush()
                while stack and name in CLOSES.get(stack[-1][0], ()):
                    stack.pop()
                heading = int(name[1]) if name[0] == "h" and name[1:].isdigit() else 0
                chrome, content, names = (stack[-1][1:]) if stack else (0, 0, ())
                is_content = (name in CONTENT or bool(_MAIN.search(m[3]))) and not (name == "article" and chrome_name(m[3], 0, NO_ARTICLE))
                # Names and forms around an article do not say what it is; a nav, aside or footer does.
                if is_content and not content and not chrome:
                    for x in names:
                        marked[x] = True
                    names = ()
                if name == "h1":
                    for x in names:
                        marked[x] = True
                content = int(content or is_content)
                if (name in CHROME and name != "form" and not (name == "header" and content)) or _HIDDEN.search(m[3]):
                    chrome = 2  # a header inside an article holds its title; elsewhere the site's
                elif name == "form" or (name not in ("body", "html", "main") and not is_content and m[3] and chrome_name(m[3], content, ADVERT if heading or name == "p" else CHROME_WORDS)):
                    names = (*names, len(marked))
                    marked.append(False)
                if name not in VOID and not m[3].endswith("/"):
                    stack.append((name, chrome, content, names))
        elif name == "a":
            in_link = max(0, in_link - 1)
        elif name in BLOCKS:
            flush()
            heading = 0
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                in_link = 0
    flush()
    inside = [0] * len(marked)
    for block in out:
        for x in block[8]:
            inside[x] += max(0, block[1] - block[2])
    plain = sum(max(0, x[1] - x[2]) for x in out)
    named = [not (holds and 2 * n >= plain) for holds, n in zip(marked, inside, strict=True)]
    return [(*x[:3], x[3] or int(any(named[i] for i in x[8])), *x[4:8]) for x in out]


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    return "\n".join(block[0] for block, row in zip(found, features([x[1:] for x in found]), strict=True) if decide(tree, row))


def labelled(first: int, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of all blocks of the labelled table's pages, from seed ``first`` on."""
    from .html_table import page

    x, y = [], []
    for seed in range(first, first + pages):
        source, kept = page(seed)
        found = blocks(source)
        x += features([b[1:] for b in found])
        y += [int(b[0] in kept) for b in found]
    return np.array(x, float), np.array(y, float)


@lru_cache(maxsize=1)
def trained_tree():
    return grow(*labelled(0, TABLE_PAGES))


def held_out() -> tuple[float, int]:
    """Share of blocks of pages outside the table that the tree decides as they are labelled, and their number."""
    x, y = labelled(TABLE_PAGES, HELD_OUT_PAGES)
    tree = trained_tree()
    return float(np.mean([decide(tree, r) for r in x] == y)), len(y)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null or empty html, and pages without main text, give an empty text. Pages
    of any length are read whole, unclosed elements included. Null ids and urls
    pass, other columns are ignored; repeated rows give repeated results and an
    empty table none.
    """

    tree = trained_tree()  # a few hundred nodes, grown once from the labelled table

    def start():
        def step(ids, urls, pages):
            texts = [main_text(p, tree) for p in pages]
            yield {"page_id": ids, "url": urls, "text": texts, "n_chars": list(map(len, texts))}

        return step

    return map_chunks(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), start, "page_id long, url string, text string, n_chars long")
