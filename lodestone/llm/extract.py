"""Main text of web pages by gradient-boosted trees over DOM nodes.

Pages become trees of block nodes. Each node has features: its tag, attribute tokens, depth, the density of
text and links below it, its place among siblings and what its ancestors are. Boosted regression
trees, trained in numpy on labelled pages that a generator lays out, give every node the
odds of being main text. Decoding is hierarchical: a node can only be main text if its parent is,
and the labelling of the whole tree with the best total is taken, so no choice contradicts an ancestor's.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Mapper

# fixed values: element names of HTML by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas head title".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul select textarea button label option".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
GROUPS = [{"p"}, {"li"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "select", "textarea", "button", "label", "option"}, {"ul", "ol", "dl"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption", "dd", "dt"}, {"div", "section"}]
# fixed values: attribute tokens that tell what a node is for
FURNITURE = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside widget related share sharing social comment comments disqus reply replies notice cookie consent popup modal newsletter subscribe signup login search form pagination pager copyright legal alert toolbar dialog complementary contentinfo".split())
MAIN = frozenset("article content main post entry story body text prose articlebody".split())

_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>\"']*+(?:\"[^\"<]*+\"[^<>\"']*+|'[^'<]*+'[^<>\"']*+)*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_MARK = re.compile(r"[>\"']")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#[0-9]{8,}")
#: Depth of the tree; what is opened deeper stands beside the node of that depth, as in browsers.
DEEPEST = 512
_ATTR = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "tokens", "hidden", "parent", "kids", "links", "n_text", "at")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.kids, self.links, self.n_text, self.at = tag, parent, [], 0, 0, 0
        self.tokens: set[str] = set()
        self.hidden = False
        for m in _ATTR.finditer(attrs) if "=" in attrs or "hidden" in attrs else ():
            value = m[2] or m[3] or m[4] or ""
            name = m[1].lower()
            if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
                self.hidden = True
            elif name != "style":
                self.tokens.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


class Markup:
    """The tags and comments of a page, in linear time.

    A '<' whose tag never closes is text. What was looked for in vain is remembered, so no stretch is read over and over.
    """

    def __init__(self, page: str):
        self.page = page
        self.missing: dict[str, int] = {}
        self.dead: set[int] = set()  # quotes and ends from which no tag closes

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def _tag_end(self, at: int) -> int:
        """The end of a tag whose name ends at at, quoted values passed over; -1 without one."""
        passed = []
        while m := _MARK.search(self.page, at) if self.find(">", at) >= 0 else None:
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            passed.append(m.start())
            close = self.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, rest) of the next tag, comment or section from at on; kinds are open, close, none and cdata."""
        page = self.page
        while (at := self.find("<", at)) >= 0:
            if m := _PLAIN.match(page, at):
                return at, m.end(), "close" if m[1] else "open", m[2].lower(), m[3]
            end, kind, name, rest = -1, "none", "", ""
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = len(page) if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at) and (end := self.find("]]>", at + 9)) >= 0:
                kind, rest, end = "cdata", page[at + 9 : end], end + 3
            elif page.startswith(("<!", "<?"), at):
                end = self.find(">", at) + 1 or -1
            elif m := _NAME.match(page, at):
                end = self._tag_end(m.end())
                kind, name, rest = "close" if m[1] else "open", m[2].lower(), page[m.end() : max(end - 1, m.end())]
            if end >= 0:
                return at, end, kind, name, rest
            at += 1
        return None

    def raw_end(self, tag: str, at: int) -> int:
        """The end of the tag that closes raw content, or -1."""
        if at >= self.missing.get(f"</{tag}", len(self.page) + 1):
            return -1
        m = re.compile(rf"</{tag}\s*+>", re.I).search(self.page, at)
        if not m:
            self.missing[f"</{tag}"] = at
        return m.end() if m else -1


def plain(text: str) -> str:
    """Text with its references decoded; a reference to a number beyond all characters is the replacement character."""
    if "&#" in text:
        text = _HUGE.sub("&#99999999", _ZEROS.sub("&#", text))
    return _SPACE.sub(" ", html.unescape(text)).strip()


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Nodes in page order, and the text blocks, each with the block node it stands in."""
    root = Node("html", None)
    nodes, blocks, stack = [root], [], [root]
    held: list[str] = []
    opened: Counter[str] = Counter()
    linked = link_depth = 0
    markup = Markup(page)

    def flush() -> None:
        nonlocal linked
        if held:
            text = plain("".join(held))
            held.clear()
            if text:
                blocks.append((stack[-1], text))
                node = stack[-1]
                node.n_text += len(text)
                node.links += min(linked, len(text))
        linked = 0

    def shut_from(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    at = 0
    while True:
        token = markup.after(at)
        text = page[at : token[0] if token else len(page)]
        if text:
            held.append(text)
            if link_depth:
                linked += len(text.strip())
        if not token:
            break
        _, at, kind, tag, rest = token
        if kind in ("none", "cdata"):
            if kind == "cdata":
                held.append(html.escape(rest, quote=False))
            continue
        closing = kind == "close"
        if tag in RAW:
            if not closing and not rest.rstrip().endswith("/"):
                end = markup.raw_end(tag, at)
                if end >= 0:
                    at = end
                elif tag in ("script", "style", "title"):
                    at = len(page)
            continue
        if tag in VOID:
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            link_depth = max(0, link_depth - 1) if closing else 1
            continue
        if tag not in BLOCK or tag == "html":
            continue
        flush()
        if tag == "body":
            continue
        link_depth = 0
        if closing:
            if opened[tag]:
                shut_from(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        shut = CLOSES.get(tag, {"p"} if tag not in ("label", "button", "select") else set())
        for i in range(len(stack) - 1, 0, -1):
            if not any(opened[t] for t in shut):
                break
            if stack[i].tag in shut:
                shut_from(i)
                if tag not in ("tr", "td", "th", "dd", "dt", "li"):
                    break
            elif stack[i].tag in BARRIER.get(tag, ()) or tag not in BARRIER:
                break
        if len(stack) > DEEPEST:
            shut_from(DEEPEST)
        node = Node(tag, stack[-1], rest)
        stack[-1].kids.append(node)
        nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    flush()
    return nodes, blocks


_GROUP_BITS = {tag: 1 << k for k, group in enumerate(GROUPS) for tag in group}


def _parents(nodes: list[Node]) -> np.ndarray:
    for i, x in enumerate(nodes):
        x.at = i
    return np.array([-1 if x.parent is None else x.parent.at for x in nodes])


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node; parents come before their children."""
    n = len(nodes)
    parent = _parents(nodes)
    text, links, size = np.array([x.n_text for x in nodes], float), np.array([x.links for x in nodes], float), np.ones(n)
    for i in range(n - 1, 0, -1):
        text[parent[i]] += text[i]
        links[parent[i]] += links[i]
        size[parent[i]] += size[i]
    depth, bad, good, up_bad, up_good = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    mask, up, place, siblings, alike = [0] * n, [0] * n, [0.0] * n, [0] * n, [0] * n
    for i, x in enumerate(nodes):
        if x.hidden or x.tokens:
            bad[i], good[i] = int(x.hidden or not FURNITURE.isdisjoint(x.tokens)), int(not MAIN.isdisjoint(x.tokens))
        mask[i] = _GROUP_BITS.get(x.tag, 0)
        if i:
            p = x.parent.at
            depth[i], up_bad[i], up_good[i], up[i] = depth[p] + 1, up_bad[p] | bad[p], up_good[p] | good[p], up[p] | mask[p]
        n_kids = len(x.kids)
        if n_kids > 1:
            tags = [kid.tag for kid in x.kids]
            for j, kid in enumerate(x.kids):
                place[kid.at], siblings[kid.at], alike[kid.at] = j / n_kids, n_kids, tags[max(0, j - 3) : j + 4].count(kid.tag)
        elif n_kids:
            siblings[x.kids[0].at] = 1
    bits = np.arange(len(GROUPS))
    in_group, up_group = np.array(mask)[:, None] >> bits & 1, np.array(up)[:, None] >> bits & 1
    whole = max(1.0, text[0])
    share = np.where(parent >= 0, text / np.maximum(1.0, text[parent]), 1.0)
    return np.column_stack((np.log1p(text), links / np.maximum(1, text), text / whole, share, np.log1p(text / size), np.log1p(size), depth, bad, good, up_bad, up_good, place, np.log1p(siblings), alike, in_group, up_group[:, 3:9]))


class Boosted:
    """Gradient-boosted regression trees for a logistic loss; splits on quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)])
        mean = y.mean().clip(0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(code, p - y, p * (1 - p) + 1e-6)
            self.trees.append(tree)
            score += value
        return self

    def _grow(self, code: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """A complete tree as (feature, threshold) by node, leaves as values, and the value of each row."""
        where, inner = np.zeros(len(g), int), []
        for level in range(self.depth):
            nodes = 1 << level
            best = [(0.0, 0, np.inf)] * nodes
            total_g, total_h = np.bincount(where, g, nodes), np.bincount(where, h, nodes)
            for j, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                width = len(edges) + 1
                key = where * width + code[:, j]
                left_g = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
                gain = left_g**2 / (left_h + 1) + (total_g[:, None] - left_g) ** 2 / (total_h[:, None] - left_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                at = gain.argmax(axis=1)
                for k in range(nodes):
                    if gain[k, at[k]] > best[k][0] + 1e-9:
                        best[k] = (float(gain[k, at[k]]), j, float(edges[at[k]]))
            inner.append([(j, t) for _, j, t in best])
            cut = np.array([np.searchsorted(self.edges[j], t) if np.isfinite(t) else 1 << 30 for _, j, t in best])
            feature = np.array([j for _, j, _ in best])
            where = where * 2 + (code[np.arange(len(g)), feature[where]] > cut[where])
        leaves = 1 << self.depth
        value = -self.rate * np.bincount(where, g, leaves) / (np.bincount(where, h, leaves) + 1)
        return [inner, value], value[where]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for inner, value in self.trees:
            where = np.zeros(len(x), int)
            for level in inner:
                feature, threshold = np.array([j for j, _ in level]), np.array([t for _, t in level])
                where = where * 2 + (x[rows, feature[where]] > threshold[where])
            score += value[where]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The best labelling in which only children of main nodes are main; the root is main."""
    parent = _parents(nodes).tolist()
    log_in, log_out = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    out, inside = log_out.tolist(), log_in.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        out[parent[i]] += out[i]
        inside[parent[i]] += max(inside[i], out[i])
    label = np.zeros(len(nodes), bool)
    label[0] = True
    for i in range(1, len(nodes)):
        label[i] = label[parent[i]] and inside[i] > out[i]
    return label


# --- labelled pages ----------------------------------------------------------------------------


def generated(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page, and the marker words of its main blocks; every block starts with a marker word."""
    count = 0
    main: set[str] = set()
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def words(low: int, high: int, good: bool = False) -> str:
        nonlocal count
        count += 1
        mark = f"mk{count}x"
        if good:
            main.add(mark)
        return mark + " " + " ".join("".join(rng.choice(list("etaoinshr"), 4)) for _ in range(int(rng.integers(low, high)))) + pick(".", ".", "", "!")

    def anchor(low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{words(low, high)}</a>'

    def attr(*names: str) -> str:
        return pick("", f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick("l-", "c-", "site-")}{pick(*names)}"')

    def listing(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{anchor()}{pick('</li>', '</li>', '')}" for _ in range(int(rng.integers(3, 9)))) + f"</{tag}>"

    nav = lambda: pick(f"<nav{attr('nav', 'menu')}>{listing()}</nav>", f'<div class="{pick("menu", "navbar", "breadcrumb")}">{listing()}</div>', f"<nav>{anchor()} | {anchor()} | {anchor()}</nav>")
    side = lambda: pick(f"<aside{attr('sidebar')}><h3>{words(1, 3)}</h3>{listing()}<p>{words(4, 20)}</p></aside>", f'<div class="{pick("sidebar", "widget", "related")}"><h3>{words(1, 3)}</h3><p>{words(5, 25)}</p></div>')
    ad = lambda: pick(f'<div class="{pick("ad", "ads", "banner", "sponsored", "promo")}">{pick("", "<p>")}{words(2, 30)}</div>', f'<div id="ad-{int(rng.integers(9))}"><p>{words(3, 20)}</p></div>')
    notice = lambda: pick(f'<div class="{pick("notice", "cookie", "alert", "consent", "popup")}"><p>{words(4, 25)}</p><button>{words(1, 2)}</button></div>', f'<div role="dialog"><p>{words(5, 20)}</p></div>')
    form = lambda: f"<form{attr('search', 'newsletter', 'login')}><label>{words(1, 4)}</label><input type=text><p>{words(2, 10)}</p><button>{words(1, 2)}</button></form>"
    talk = lambda: f'<{pick("div", "section")} {pick("class", "id")}="{pick("comments", "comment-list", "replies", "disqus")}"><h3>{words(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{words(3, 40)}</p></div>' for _ in range(int(rng.integers(1, 5)))) + "</div>"
    foot = lambda: pick(f"<footer{attr('footer')}>&copy; {words(1, 8)}</footer>", f'<div class="footer"><p>{words(2, 20)}</p>{listing()}</div>', f"<footer><p>{words(3, 15)}</p>{anchor()}</footer>")
    head = lambda: f"<header{attr('header', 'masthead')}>{pick(words(1, 4), f'<h1>{words(1, 3)}</h1>')}{pick('', nav())}</header>"

    def block() -> str:
        r = rng.random()
        if r < 0.62:
            body = words(1, int(pick(4, 20, 80)), True)
            return f"<p>{pick('', '<b>', '<em>')}{body}{pick('', '<br>')}{pick('</p>', '</p>', '')}"
        if r < 0.72:
            k = int(rng.integers(2, 5))
            return f"<h{k}>{words(1, 8, True)}</h{k}>"
        if r < 0.8:
            return "<ul>" + "".join(f"<li>{words(2, 15, True)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
        if r < 0.85:
            return f"<blockquote><p>{words(4, 30, True)}</p></blockquote>"
        if r < 0.9:
            return "<table>" + "".join(f"<tr><td>{words(1, 5, True)}<td>{words(1, 5, True)}" for _ in range(int(rng.integers(1, 4)))) + "</table>"
        return pick(ad(), f"<p>{words(5, 40, True)} {pick('', '')}<a href=/y>link text</a></p>", f"<pre>{words(3, 20, True)}</pre>", f'<div class="{pick("share", "social", "related")}">{anchor()}{anchor()}</div>', f"<div>{words(5, 40, True)}</div>")

    body = pick("", f"<h1>{words(1, 10, True)}</h1>", f"<h1>{words(1, 10, True)}</h1>", f"<header><h1>{words(1, 10, True)}</h1></header>") + "".join(block() for _ in range(int(rng.integers(1, 14))))
    r = rng.random()
    opening, closing = ("<article>", "</article>") if r < 0.5 else ("<main>", "</main>") if r < 0.65 else (f'<div class="{pick("content", "post", "entry-content", "article-body", "main")}">', "</div>") if r < 0.9 else ("<div>", "</div>")
    if rng.random() < 0.25:
        opening, closing = "<main>" + opening, closing + "</main>"
    inner = body + (pick(talk(), form()) if rng.random() < 0.15 else "")
    before = "".join(f() for f in (head, nav, notice, ad, side, form) if rng.random() < 0.35)
    after = "".join(f() for f in (talk, side, ad, form, notice, foot, foot) if rng.random() < 0.35)
    if rng.random() < 0.3:
        before, after = f'<div class="{pick("wrap", "page", "container")}">{before}', f"{after}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{before}{opening}{inner}{closing}{after}</body></html>", main


def labelled_nodes(page: str, main: set[str]) -> tuple[np.ndarray, np.ndarray, list[Node]]:
    """Features and labels: a node is main if any main block stands in or below it."""
    nodes, blocks = parse(page)
    label = {id(x): 0 for x in nodes}
    for node, text in blocks:
        if text.split(" ", 1)[0].rstrip(".!") in main:
            up: Node | None = node
            while up is not None:
                label[id(up)] = 1
                up = up.parent
    return features(nodes), np.array([label[id(x)] for x in nodes]), nodes


@lru_cache(maxsize=2)
def model(pages: int = 400, seed: int = 11) -> Boosted:
    """Trees trained on so many generated pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    rows = [labelled_nodes(*generated(rng))[:2] for _ in range(pages)]
    return Boosted().fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def main_texts(pages: list[str | None], trees: Boosted) -> list[str]:
    """The main text of each page; the trees score all nodes together."""
    parsed = [parse(page) if page else ([], []) for page in pages]
    live = [nodes for nodes, blocks in parsed if blocks]
    odds = trees.log_odds(np.concatenate([features(nodes) for nodes in live])) if live else np.zeros(0)
    at, out = 0, []
    for nodes, blocks in parsed:
        if not blocks:
            out.append("")
            continue
        label = decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(text for node, text in blocks if label[node.at]))
    return out


def _extract(trees: Boosted) -> Mapper:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                at = batch.schema.get_field_index("__html")
                texts = main_texts(batch.column(at).to_pylist(), trees)
                yield batch.remove_column(at).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    return run


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (the main blocks, joined by two line ends) and n_chars.

    A null or empty page, and one without main text, gives an empty text. Markup may be broken in any way. Columns of pages
    named text or n_chars are replaced; every row gives a row.
    """
    kept = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars", "__html", html_col)], F.col(html_col).cast("string").alias("__html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "__html")
    return kept.mapInArrow(_extract(model()), schema + "text string, n_chars long")
