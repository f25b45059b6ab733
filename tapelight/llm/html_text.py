"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements (inline elements count for the block that holds them; scripts, styles,
templates and the head are no text). Each node has features of itself (tag, words in class, id and role), of its
subtree (text, link share, marks, tags a character), of its place (depth, siblings and their text) and of its
ancestors. The trees give the log odds that a node holds main text. Decoding takes the best set of nodes in which
every kept node's parent is kept too: a node's worth is its own log odds plus its children's worth, and it is
dropped with all below it when that isn't positive. So no part of a menu can stay when the menu goes.

The forest is trained here on generated pages. Rows are independent: no shuffle.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import slices
from .boosting import Forest, train

# Element names by the part they play.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe object canvas audio video".split())
#: Raw elements that swallow the rest of a page where their end is missing; the content of others is then read on.
SWALLOW = frozenset(("script", "style"))
ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
GROUPS = {
    "article": ("article", "main"), "section": ("section",), "div": ("div", "center"), "p": ("p", "blockquote", "pre"), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"), "nav": ("nav", "menu"), "header": ("header", "hgroup"),
    "footer": ("footer", "address"), "aside": ("aside", "dialog", "search"), "form": ("form", "fieldset", "legend", "button", "select", "option", "optgroup"), "list": ("ul", "ol", "dl"), "item": ("li", "dt", "dd"), "table": ("table", "tbody", "thead", "tr", "td", "th", "tfoot"), "figure": ("figure", "figcaption"),
}
WORDS = {
    "main": "article content main post entry story text body page prose", "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc tabs pagination pager topbar toolbar", "head": "header masthead logo branding hero", "foot": "footer copyright legal colophon bottom",
    "side": "sidebar aside related widget rail recommended more trending popular tags", "ad": "ad ads advert advertisement sponsor sponsored banner promo promotion", "notice": "cookie cookies consent notice alert gdpr popup modal overlay message subscribe newsletter signup", "form": "form login search contact poll survey input", "talk": "comment comments reply replies respond discussion disqus thread share social",
}
TAG_GROUP = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags}
TOKEN_GROUP = {word: k for k, words in enumerate(WORDS.values()) for word in words.split()}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
TOKEN = re.compile(r"[A-Za-z]+")
G, T = len(GROUPS), len(WORDS)
CLIP = 4.0


class Page:
    """Nodes in page order (0 is the root) and text pieces."""

    def __init__(self, source: str):
        self.parent, self.group, self.tokens, self.depth, self.own, self.links, self.marks, self.tags = [-1], [-1], [0], [0], [0], [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.parse(source)

    def parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open elements with the node they belong to
        opened: dict[str, int] = {}
        unclosed: set[str] = set()  # raw elements without an end in the rest of the page
        at, block = 0, 0

        def close(to: int) -> None:
            while len(stack) > to:
                opened[stack.pop()[0]] -= 1

        def find(name: str, stops: tuple[str, ...] = ()) -> int:
            if not opened.get(name):
                return 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    return k
                if stack[k][0] in stops:
                    return 0
            return 0

        def text(raw: str) -> None:
            if raw and not raw.isspace():
                shown = html.unescape(raw) if "&" in raw else raw
                node = stack[-1][1]
                self.pieces.append((node, block, shown))
                self.own[node] += len(shown)
                self.marks[node] += shown.count(",") + shown.count(".")
                if opened.get("a"):
                    self.links[node] += len(shown)
            elif raw and self.pieces:
                self.pieces.append((stack[-1][1], block, " "))

        while m := TAG.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            end, name = m[1], m[2]
            if end:
                end = end.lower()
                if end in BLOCKS:
                    block += 1
                    if k := find(end):
                        close(k)
                elif k := find(end, ("p", "div", "li", "td", "article", "section", "body")):
                    close(k)
            elif name:
                name = name.lower()
                if name in RAW:
                    if not m[3].endswith("/") or name in ("script", "style", "title"):
                        over = re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.I).search(source, at) if name not in unclosed else None
                        if over:
                            at = over.end()
                        elif name in SWALLOW:
                            at = len(source)
                        else:
                            unclosed.add(name)
                    continue
                if name == "head":  # its texts stand in raw elements; whatever else follows belongs to the body
                    continue
                node = stack[-1][1]
                self.tags[node] += 1
                if name == "br":
                    self.pieces.append((node, block, " "))
                if name in BLOCKS:
                    block += 1
                    if k := find("p", ("table", "td", "th", "button")):
                        close(k)
                    if name in ENDS and (k := find(name, ENDS[name])):
                        close(k)
                if name in VOID or m[3].endswith("/") and name not in BLOCKS:
                    continue
                if name in BLOCKS:
                    node = self.add(stack[-1][1], name, m[3])
                opened[name] = opened.get(name, 0) + 1
                stack.append((name, node))
        text(source[at:])

    def add(self, parent: int, name: str, attributes: str) -> int:
        bits = 0
        if attributes:
            for found in ATTRIBUTE.finditer(attributes):
                for token in TOKEN.findall(found[2] or found[3] or found[4] or ""):
                    k = TOKEN_GROUP.get(token.lower())
                    if k is not None:
                        bits |= 1 << k
        self.parent.append(parent)
        self.group.append(TAG_GROUP.get(name, -1))
        self.tokens.append(bits)
        self.depth.append(self.depth[parent] + 1)
        for values in (self.own, self.links, self.marks, self.tags):
            values.append(0)
        return len(self.parent) - 1

    def text_of(self, kept: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, shown in self.pieces:
            if kept[node]:
                blocks.setdefault(block, []).append(shown)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The feature rows of all nodes of all pages, each node's parent (-1: a root) and each page's first node (n + 1)."""
    first = np.append(0, np.cumsum([len(p.parent) for p in pages])).astype(np.int64)

    def column(name: str) -> np.ndarray:
        return np.fromiter((x for p in pages for x in getattr(p, name)), np.int64, int(first[-1]))

    page = np.repeat(np.arange(len(pages)), np.diff(first))
    parent = column("parent")
    parent = np.where(parent >= 0, parent + first[page], -1)
    depth, group, tokens = column("depth"), column("group"), column("tokens")
    own = np.stack([column(c) for c in ("own", "links", "marks", "tags")], 1).astype(float)
    n = len(parent)
    subtree, nodes = own.copy(), np.ones(n)
    up_group, up_tokens = np.where(group >= 0, 1 << np.maximum(group, 0), 0), tokens.copy()
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.searchsorted(depth[by_depth], np.arange(1, int(depth.max(initial=0)) + 1)))
    for level in reversed(levels[1:]):
        np.add.at(subtree, parent[level], subtree[level])
        np.add.at(nodes, parent[level], nodes[level])
    above_group, above_tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in levels[1:]:
        above_group[level] = above_group[parent[level]] | up_group[parent[level]]
        above_tokens[level] = above_tokens[parent[level]] | up_tokens[parent[level]]
    siblings, place, around = np.zeros(n), np.zeros(n), np.zeros(n)
    inner = np.flatnonzero(parent >= 0)
    np.add.at(siblings, parent[inner], 1)
    np.add.at(around, parent[inner], subtree[inner, 0])
    order = inner[np.argsort(parent[inner], kind="stable")]
    if len(order):
        starts = np.flatnonzero(np.append(True, parent[order][1:] != parent[order][:-1]))
        place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    mine = np.maximum(parent, 0)
    total = np.maximum(subtree[first[:-1], 0][page], 1)
    chars = np.maximum(subtree[:, 0], 1)
    bit = lambda values, width: ((values[:, None] >> np.arange(width)) & 1).astype(float)
    columns = [
        bit(np.where(group >= 0, 1 << np.maximum(group, 0), 0), G), bit(tokens, T), bit(above_group, G), bit(above_tokens, T), depth[:, None], np.log1p(subtree[:, :1]), np.log1p(own[:, :1]), subtree[:, 1:2] / chars[:, None], 100 * subtree[:, 2:3] / chars[:, None],
        subtree[:, 3:4] / chars[:, None], nodes[:, None] / chars[:, None], (subtree[:, 0] / total)[:, None], np.where(parent >= 0, siblings[mine], 0)[:, None], place[:, None], (chars / np.maximum(around[mine], 1))[:, None], np.log1p(around[mine])[:, None],
    ]
    return np.concatenate(columns, 1), parent, first


def keep_nodes(odds: np.ndarray, parent: np.ndarray, start: int) -> np.ndarray:
    """The best consistent choice for one page: node 0 is kept, and a kept node's parent is kept."""
    worth = np.clip(odds, -CLIP, CLIP).tolist()
    up = (parent - start).tolist()
    for k in range(len(worth) - 1, 0, -1):  # children come after their parents
        if worth[k] > 0:
            worth[up[k]] += worth[k]
    kept = [True] * len(worth)
    for k in range(1, len(worth)):
        kept[k] = worth[k] > 0 and kept[up[k]]
    return np.array(kept)


def sample_page(rng: random.Random) -> tuple[str, str]:
    """A generated page and its main text marks: main pieces are the words that begin with `q`."""
    vowels, others = "aeiou", "bcdfglmnprst"

    def words(n: int, main: bool) -> str:
        out = []
        for k in range(n):
            w = "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
            out.append(("q" + w if main else w) + ("," if rng.random() < 0.06 else "." if rng.random() < 0.08 or k == n - 1 else ""))
        return " ".join(out)

    def links(n: int) -> str:
        inner = "".join(f'<li><a href="/{k}">{words(rng.randint(1, 4), False)}</a></li>' for k in range(n))
        return f"<ul>{inner}</ul>" if rng.random() < 0.7 else re.sub("</?li>", " ", inner)

    def box(kinds: list[tuple[str, str]], inner: str) -> str:
        tag, name = rng.choice(kinds)
        label = f' {rng.choice(["class", "id"])}="{name}"' if name else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def prose(main: bool, n: int) -> str:
        return "".join(f"<p>{words(rng.randint(3, 60), main)}" + "</p>" * (rng.random() < 0.9) for _ in range(n))

    def menu() -> str:
        return box([("nav", ""), ("div", "menu"), ("div", "top-nav"), ("ul", "navigation"), ("div", "breadcrumbs")], links(rng.randint(2, 9)))

    def advert() -> str:
        return box([("div", "ad"), ("div", "ads-box"), ("aside", "sponsored"), ("div", "banner"), ("div", "promo")], rng.choice([words(rng.randint(2, 40), False), prose(False, 1)]))

    def header() -> str:
        return box([("header", ""), ("div", "masthead"), ("header", "site-header"), ("div", "header")], rng.choice(["<h1>", "<h2>", "<div>"]) + words(rng.randint(1, 5), False) + rng.choice(["", links(3)]))

    def side() -> str:
        return box([("aside", ""), ("div", "sidebar"), ("div", "related"), ("aside", "widget")], f"<h3>{words(2, False)}</h3>" + rng.choice([links(rng.randint(2, 7)), prose(False, rng.randint(1, 3)), links(3) + prose(False, 1)]))

    def notice() -> str:
        return box([("div", "cookie-notice"), ("div", "consent"), ("div", "alert"), ("section", "newsletter"), ("div", "popup")], prose(False, 1) + "<button>ok</button>" * rng.randint(0, 1))

    def form() -> str:
        return box([("form", ""), ("form", "search"), ("form", "login"), ("form", "contact")], f"<label>{words(2, False)}</label><input name=a><button>{words(1, False)}</button>" + rng.choice(["", f"<p>{words(9, False)}</p>"]))

    def comments() -> str:
        inner = "".join(box([("div", "comment"), ("li", "reply"), ("div", "")], prose(False, rng.randint(1, 2))) for _ in range(rng.randint(1, 5)))
        return box([("section", "comments"), ("div", "comments"), ("div", "discussion"), ("ol", "comment-list")], f"<h3>{words(1, False)}</h3>" + inner)

    def footer() -> str:
        return box([("footer", ""), ("div", "footer"), ("footer", "site-footer"), ("div", "copyright")], "&copy; " + words(rng.randint(2, 20), False) + rng.choice(["", links(4)]))

    def article() -> str:
        parts = [f"<h1>{words(rng.randint(2, 9), True)}</h1>"] if rng.random() < 0.9 else []
        if rng.random() < 0.4:
            parts.append(f"<p><b>{words(rng.randint(2, 12), True)}<br>")
        for _ in range(rng.randint(0, 8)):
            parts.append(rng.choice([prose(True, 1), prose(True, 2), prose(True, 3), f"<h2>{words(4, True)}</h2>", "<ul>" + "".join(f"<li>{words(rng.randint(1, 12), True)}</li>" for _ in range(3)) + "</ul>", f"<blockquote>{words(12, True)}</blockquote>", f"<table><tr><td>{words(2, True)}</td><td>{words(3, True)}</td></tr></table>", f"<pre>{words(8, True)}</pre>", f'<p>{words(8, True)} <a href="/x">{words(3, True)}</a> {words(9, True)}</p>']))
            if rng.random() < 0.08:
                parts.append(rng.choice([advert, side, form, notice])())
        if rng.random() < 0.15:
            parts.append(box([("div", "share"), ("div", "social")], links(3)))
        if rng.random() < 0.1:
            parts.append(comments())
        return box([("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("section", "entry-content"), ("div", "story"), ("div", "post")], "".join(parts))

    def some(chance: float, *makers) -> str:
        return "".join(m() for m in makers if rng.random() < chance)

    inside = some(0.55, menu, notice, header, menu, advert) + article() + some(0.45, side, comments, advert, form, side)
    for _ in range(rng.randint(0, 2)):
        inside = rng.choice(["<div>%s</div>", '<div id="page">%s</div>', '<div class="container">%s</div>']) % inside
    return f"<html><head><title>{words(3, False)}</title></head><body>{some(0.5, header, menu)}{inside}{some(0.7, footer)}", "q"


@functools.lru_cache(1)
def forest(pages: int = 250, seed: int = 11) -> Forest:
    """Trained on generated pages; always the same. A node is positive if main words stand in its subtree."""
    rng = random.Random(seed)
    parsed = [Page(sample_page(rng)[0]) for _ in range(pages)]
    x, parent, first = features(parsed)
    y = np.zeros(len(x), int)
    for p, start in zip(parsed, first, strict=False):
        for node, _, shown in p.pieces:
            if re.search(r"\bq", shown):
                y[start + node] = 1
    for k in range(len(y) - 1, -1, -1):
        if y[k] and parent[k] >= 0:
            y[parent[k]] = 1
    inner = parent >= 0
    return train(x[inner], y[inner], trees=30, depth=4, rate=0.3, bins=24)


def main_texts(sources: list[str], model: Forest) -> list[str]:
    pages = [Page(source) for source in sources]
    x, parent, first = features(pages)
    odds = model.score(x)
    return [p.text_of(keep_nodes(odds[a:b], parent[a:b], a)) for p, a, b in zip(pages, first[:-1], first[1:], strict=True)]


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row; null or empty html has an empty text.

    White space within a block becomes one space, blocks are joined by one \\n; <br> is white space. Nothing is cut
    off. Repeated rows give repeated results; no rows give none; other columns are ignored.
    """
    model = forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            texts = main_texts(batch.column("html").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind, url = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))
    return pages.selectExpr(f"`{id_column}` AS page_id", f"`{url_column}` AS url", f"coalesce(`{html_column}`, '') AS html").mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long")
