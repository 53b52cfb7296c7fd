"""Operator 12, HTML extraction by a tree-structured graphical model.

A page becomes a tree: its block elements, and as leaves its text blocks (runs
of text between block boundaries). Each node is *main* text, *other* text, or
*mixed* (both below it; no leaf is). A node's own potential is a linear function
of what it looks like (tag, words of its class and id, size, share of links,
punctuation, place in the page); each edge has a potential of the two states,
by the child's tag. Messages go from the leaves to the root and back
(sum-product), which gives every leaf its exact marginal; blocks whose marginal
of being main text is over 1/2 are the result. Whole batches of pages pass
messages at once, level by level.

The potentials are trained by maximum likelihood on labelled pages, as a
conditional random field. ``labelled_pages`` makes them from the ``SAMPLE``
pages with the smallest hashes of page_id and url (a documented bound; fewer
pages: all): a page whose markup names its main text (``article``, ``main``) is
labelled by that, and its blocks are laid out anew in ``LAYOUTS`` layouts, drawn
by the page's hash, with menus, headers, footers, sidebars, notices, adverts,
forms and comments labelled as they are placed. They train in one task, a
bounded one; only weights reach the driver. Extraction has no shuffle.

Defined results: null or empty html gives an empty text; markup that is cut off
ends where the text ends; scripts, styles, comments, head, templates and
drawings never give text; character references are decoded once, unknown or
cut-off ones stay as they are; white space is all of Unicode's, no-break spaces
too; ``br`` is white space; table cells and list items are blocks; pages are
read whole, whatever their length; repeated rows are extracted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.session import scratch_table

SAMPLE, LAYOUTS, STEPS, RATE, RIDGE, MIN_SEEN = 200, 6, 160, 0.15, 0.02, 3
TRAIN_CHARS = 60_000  # of a labelled page's text that is laid out
WORDS_HELD = (None, None, 60, 25, 10)  # words kept of a block laid out, drawn for each layout (None: all)
FOREST = 1 << 16  # nodes whose messages pass at once (more for one page that has more)
MAIN, OTHER, MIXED = range(3)
NEVER = -30.0

# --- the fixed words of HTML -------------------------------------------------
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input picture source".split())
_UNREAD = set("script style noscript template title head svg math iframe object video audio canvas xmp noembed noframes textarea select datalist".split())
_RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes", "noscript"}
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}}
_SCOPE = set("ul ol dl table menu select body html article section div td th".split())
# -----------------------------------------------------------------------------
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


@dataclass
class Tree:
    """Nodes in page order (a parent before its children); texts hang on leaves."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters of a leaf inside links

    def add(self, parent: int, tag: str, attrs: str, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def parse(page: str | None) -> Tree:
    """The tree of a page."""
    tree, page = Tree(), page or ""
    open_, links, buffer, linked = [tree.add(-1, "#page", "")], 0, [], 0
    unread: list[str] = []  # open elements that give no text
    at = 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                tree.add(open_[-1], "#text", "", text, linked)
            buffer, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not unread:
            raw = entities.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if links:
                linked += len(raw.strip())

    def close(depth: int) -> None:
        nonlocal links
        del open_[depth:]
        if links > len(open_):  # a link ends with the block it stands in
            links = 0

    while True:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if unread:
                if tag in unread:
                    del unread[max(i for i, t in enumerate(unread) if t == tag) :]
            elif tag == "a":
                links = 0
            elif tag not in _INLINE:
                flush()
                for i in range(len(open_) - 1, 0, -1):
                    if tree.tag[open_[i]] == tag:
                        close(i)
                        break
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
            continue
        alone = tag in _VOID or m[3].endswith("/")
        if unread or tag in _UNREAD:
            if tag == "body" and unread == ["head"]:
                unread = []
            else:
                if not alone and tag in _UNREAD:
                    unread.append(tag)
                continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            links = len(open_)
        elif tag not in _INLINE:
            flush()
            if tag in _ENDS_P:
                for i in range(len(open_) - 1, 0, -1):
                    if tree.tag[open_[i]] == "p":
                        close(i)
                        break
                    if tree.tag[open_[i]] in _SCOPE:
                        break
            ends = _ENDS_SAME.get(tag, ())
            while len(open_) > 1 and tree.tag[open_[-1]] in ends:
                close(len(open_) - 1)
            if tag not in _VOID:
                open_.append(tree.add(open_[-1], tag, m[3]))
    flush()
    return tree


def _scale(n: float) -> int:
    return int(n).bit_length()


def names_of(attrs: str) -> set[str]:
    """Words of an element's class, id, role and label."""
    return {w.lower() for v in _NAMES.findall(attrs) for w in _WORDS(v)} if "=" in attrs else set()


def features(tree: Tree) -> list[list[str]]:
    """What each node looks like."""
    n = len(tree.tag)
    size, linked, leaves, stops, heads = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if tree.text[i] is not None:
            size[i], linked[i], leaves[i] = len(tree.text[i]), min(tree.linked[i], len(tree.text[i])), 1
            stops[i] = sum(tree.text[i].count(c) for c in ".!?。,;")
        heads[i] += tree.tag[i] in ("h1", "h2")
        p = tree.parent[i]
        if p >= 0:
            size[p] += size[i]
            linked[p] += linked[i]
            leaves[p] += leaves[i]
            stops[p] += stops[i]
            heads[p] += heads[i]
    whole, seen, out = max(1, size[0]), 0, []
    for i in range(n):
        kind = "t" if tree.text[i] is not None else "e"
        found = [f"{kind} any", f"tag {tree.tag[i]}", f"{kind} size {_scale(size[i])}", f"{kind} link {10 * linked[i] // max(1, size[i])}",
                 f"{kind} stops {_scale(100 * stops[i] / max(1, size[i]))}", f"{kind} part {_scale(100 * size[i] / whole)}", f"{kind} before {10 * seen // whole}"]
        if kind == "t":
            text = tree.text[i]
            found += [f"t end {text[-1] if not text[-1].isalnum() else 'w'}", f"t words {_scale(text.count(' ') + 1)}", f"t in {tree.tag[tree.parent[i]]}"]
            if text[0] in "©®" or "©" in text[:40]:
                found.append("t rights")
            seen += size[i]
        else:
            found += [f"e leaves {_scale(leaves[i])}", f"e heads {min(2, heads[i])}", f"e in {tree.tag[tree.parent[i]] if i else ''} {tree.tag[i]}"]
            found += [f"name {w}" for w in names_of(tree.attrs[i])]
        out.append(found)
    return out


class Forest:
    """Many pages' trees for message passing: nodes sorted by depth. Nodes
    without text below them are left out."""

    def __init__(self, trees: list[Tree], model: dict[str, int]):
        parents, rows, kinds, self.leaf = [], [], [], []
        base = 0
        for page, tree in enumerate(trees):
            held = [t is not None for t in tree.text]
            for i in range(len(held) - 1, 0, -1):
                held[tree.parent[i]] |= held[i]
            place = np.cumsum(held) - 1 + base
            for i, found in enumerate(features(tree)):
                if held[i]:
                    parents.append(place[tree.parent[i]] if i else -1)
                    rows.append([model[f] for f in found if f in model])
                    kinds.append(tree.tag[i])
                    self.leaf.append((page, i, tree.text[i] is not None))
            base += sum(held)
        self.n = len(parents)
        self.parent = np.array(parents, np.int64)
        self.kind = np.array([model.get(f"edge {k}", model["edge"]) for k in kinds], np.int64)
        self.is_leaf = np.array([leaf for _, _, leaf in self.leaf], bool)
        self.at = np.concatenate([*map(np.array, rows), np.empty(0)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        depth = np.zeros(self.n, np.int64)
        for i, p in enumerate(parents):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if self.n else []

    def own(self, weights: np.ndarray) -> np.ndarray:
        """Log potentials of the nodes."""
        u = np.stack([np.bincount(self.row, weights[self.at, s], self.n) for s in range(3)], axis=1)
        u[self.is_leaf, MIXED] += NEVER
        return u

    def between(self, edges: np.ndarray, common: int) -> np.ndarray:
        """Log potentials of the edges above the nodes, [node, parent's state, own state]."""
        return edges[common] + np.where((self.kind != common)[:, None, None], edges[self.kind], 0.0)

    def marginals(self, u: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Exact marginals of the nodes and of the edges, and the log partition
        sum, by one pass to the roots and one back."""
        below, up = u.copy(), np.zeros_like(u)  # a node with all below it; its message to its parent
        for level in reversed(self.levels[1:]):
            up[level] = logsum(e[level] + below[level][:, None, :], 2)
            np.add.at(below, self.parent[level], up[level])
        belief, pair = below.copy(), np.zeros((self.n, 3, 3))
        roots = self.levels[0] if self.levels else []
        total = float(logsum(below[roots], 1).sum()) if self.n else 0.0
        for level in self.levels[1:]:
            outside = belief[self.parent[level]] - up[level]
            joint = outside[:, :, None] + e[level] + below[level][:, None, :]
            belief[level] = logsum(joint, 1)
            pair[level] = np.exp(joint - logsum(joint.reshape(len(level), 9), 1)[:, None, None])
        return np.exp(belief - logsum(belief, 1)[:, None]), pair, total


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# --- labelled pages ----------------------------------------------------------
#: What the parts of a page are called: tags, and words for class or id.
PARTS = {
    "menu": ("nav div ul header", "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topnav sitenav toc pagination pager tabs links skip"),
    "header": ("header div", "header siteheader masthead top topbar branding logo tagline head banner title"),
    "footer": ("footer div section", "footer sitefooter copyright colophon legal bottom imprint credits foot contentinfo"),
    "sidebar": ("aside div section", "sidebar side aside widget widgets related recommended trending popular rail secondary archive tags latest more teaser complementary"),
    "notice": ("div section p dialog", "cookie cookies consent gdpr notice notification alert popup modal overlay privacy warning announcement message paywall"),
    "advert": ("div aside section ins p", "ad ads advert advertisement adslot sponsored sponsor promo promotion adsbygoogle commercial partner outbrain taboola banner"),
    "form": ("form div section", "form search searchform login signup subscribe subscription newsletter contact register"),
    "comments": ("section div ol ul", "comments comment respond replies reply discussion disqus responses commentlist thread reader readers feedback reviews"),
    "share": ("div ul section", "share social sharing follow buttons tools sharebar shares"),
}
MAIN_PARTS = ("article main div section", "article content main post entry story body text blogpost hentry maincontent copy prose page single articlebody")
WRAPPERS = "wrapper page container site outer inner row col layout wrap app root grid columns"
_OWN_MAIN, _OWN_OTHER = {"article", "main"}, {"nav", "aside", "footer", "form", "header", "dialog"}


def own_labels(tree: Tree) -> list[bool | None] | None:
    """Whether each node is in the main text, where the markup says so."""
    if not _OWN_MAIN & set(tree.tag):
        return None
    out: list[bool] = []
    for i, tag in enumerate(tree.tag):
        above = i > 0 and out[tree.parent[i]]
        apart = bool(names_of(tree.attrs[i]) & set(PARTS["comments"][1].split() + PARTS["advert"][1].split()))
        out.append((above or tag in _OWN_MAIN) and tag not in (_OWN_OTHER - ({"header"} if above else set())) and not apart)
    return out


def main_blocks(tree: Tree) -> list[tuple[str, str]]:
    """(tag, text) of what is taken for the main text of an unlabelled page or
    is that of a labelled one: there, long blocks of few links."""
    own = own_labels(tree)
    out, size = [], 0
    for i, text in enumerate(tree.text):
        if text is not None and (own[i] if own else len(text) >= 80 and 5 * tree.linked[i] < len(text)) and size < TRAIN_CHARS:
            out.append((tree.tag[tree.parent[i]], text))
            size += len(text)
    return out


def laid_out(blocks: list[tuple[str, str]], words: list[str], rnd: random.Random) -> str:
    """A page of ``blocks`` in a layout of its own; ``words`` fill the other
    parts. Elements carry ``data-main`` 1 or 0, which only training reads."""
    esc = entities.escape

    def phrase(lo: int, hi: int) -> str:
        return esc(" ".join(rnd.choice(words) for _ in range(rnd.randint(lo, hi))))

    def prose() -> str:
        return " ".join(phrase(4, 14).capitalize() + rnd.choice("...!?") for _ in range(rnd.randint(1, 4)))

    def named(names: str) -> str:
        a = rnd.choice(names.split())
        a += rnd.choice(["", "", "", f"-{rnd.choice(names.split())}", f"_{rnd.randint(1, 9)}", f" {rnd.choice(WRAPPERS.split())}", "-box"])
        return f' {rnd.choice(["class", "class", "class", "id"])}="{a}"'

    def element(part: tuple[str, str], inside: str, main: int | None = None, bare: float = 0.0) -> str:
        tag = rnd.choice(part[0].split())
        name = "" if rnd.random() < bare and tag not in ("div", "section", "p", "ul", "ol") else named(part[1])
        return f"<{tag}{name}{'' if main is None else f' data-main={main}'}>{inside}</{tag}>"

    def links() -> str:
        items = [f'<a href="/{i}">{phrase(1, 3)}</a>' for i in range(rnd.randint(2, 9))]
        return rnd.choice([" ".join(items), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items)])

    def heading() -> str:
        return "<{0}>{1}</{0}>".format(rnd.choice(["h2", "h2", "h3", "h3", "h4", "b"]), phrase(1, 5))

    def other(kind: str) -> str:
        if kind == "menu":
            inside = links()
        elif kind == "comments":
            one = rnd.choice(["<div class=comment><p>{}</p></div>", "<li class=comment>{}</li>", "<p>{}</p>", "<article class=comment><header>{n}</header><p>{}</p></article>", "<div><b>{n}</b><div>{}</div></div>"])
            inside = rnd.choice(["", heading(), heading()]) + "".join(one.format(prose(), n=phrase(1, 2)) for _ in range(rnd.randint(1, 5)))
        elif kind == "form":
            inside = f"<label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 2)}</button>" + rnd.choice(["", f"<p>{phrase(3, 12)}</p>"])
        elif kind == "footer":
            inside = rnd.choice(["&copy; ", "", "© 2024 "]) + phrase(2, 12) + rnd.choice(["", ".", links()])
        elif kind == "sidebar":
            inside = rnd.choice([heading(), heading(), ""]) + rnd.choice([links(), f"<p>{prose()}</p>", f"<div>{phrase(3, 9)}</div>{links()}"])
        elif kind == "share":
            inside = links()
        elif kind == "header":
            inside = rnd.choice([f"<a href=/>{phrase(1, 3)}</a>", f"<h1>{phrase(1, 4)}</h1>", f"<div>{phrase(1, 5)}</div>"]) + rnd.choice(["", element(PARTS["menu"], links(), 0)])
        else:
            inside = rnd.choice([phrase(3, 12), f"<p>{prose()}</p>", f"<span>{phrase(2, 8)}</span><button>{phrase(1, 2)}</button>", prose()])
        return element(PARTS[kind], inside, 0, bare=0.5)

    def maybe(kind: str, chance: float) -> str:
        return other(kind) if rnd.random() < chance else ""

    style = rnd.choice(["p", "p", "p", "div", "mixed"])
    body = []
    for i, (tag, text) in enumerate(blocks):
        tag = tag if tag in ("h1", "h2", "h3", "li", "pre", "blockquote", "td") else "p" if style == "p" or rnd.random() < 0.6 else "div" if style == "div" else rnd.choice(["p", "blockquote", "h2", "li", "pre", "div"])
        one = f"<{tag}>{esc(text)}</{tag}>"
        if tag == "li":
            one = "<ul>" + "".join(f"<li>{x}</li>" for x in [esc(text), *(phrase(1, 6) for _ in range(rnd.randint(0, 4)))]) + "</ul>"
        if i == 0 and rnd.random() < 0.6:
            one = f"<h1>{esc(text)}</h1>"
            head = rnd.choice(["{}", "{}", "<header>{}</header>", "<header class=entry-header>{}</header>", "<header class=post-header>{}</header>", "<div class=title>{}</div>", "<div class=article-header>{}</div>"])
            one = head.format(one)
        body.append(one)
        if rnd.random() < 0.08:
            body.append(other(rnd.choice(["advert", "advert", "sidebar", "form", "share", "notice"])))
    body = "".join(body)
    main = element(MAIN_PARTS, f"<div{named(MAIN_PARTS[1])}>{body}</div>" if rnd.random() < 0.3 else body + maybe("share", 0.2) + maybe("comments", 0.2), 1, bare=0.6)
    if rnd.random() < 0.08:  # a table for the layout
        cells = [f"<td>{maybe('menu', 0.8)}</td>", f"<td data-main=1>{body}</td>", f"<td>{maybe('sidebar', 0.5)}</td>"]
        main = f"<table><tr>{''.join(cells)}</tr></table>"
    column = main + maybe("comments", 0.35)
    column = rnd.choice([column + maybe("sidebar", 0.5), maybe("sidebar", 0.5) + column])
    if rnd.random() < 0.5:
        column = element(("main div div section", WRAPPERS + " main content primary"), column)
    page = maybe("notice", 0.35) + maybe("header", 0.6) + maybe("menu", 0.7) + maybe("advert", 0.4) + maybe("form", 0.3) + column + maybe("advert", 0.2) + maybe("notice", 0.15) + maybe("footer", 0.8)
    return f"<html><body>{f'<div{named(WRAPPERS)}>{page}</div>' if rnd.random() < 0.4 else page}</body></html>"


_DATA_MAIN = re.compile(r"data-main=([01])")


def placed_labels(tree: Tree) -> list[bool]:
    out: list[bool] = []
    for i in range(len(tree.tag)):
        m = _DATA_MAIN.search(tree.attrs[i])
        out.append(m[1] == "1" if m else i > 0 and out[tree.parent[i]])
    return out


def labelled_pages(pages: list[str], layouts: int = LAYOUTS) -> Iterator[tuple[Tree, list[bool]]]:
    """Trees with whether each node is in the main text, from the given pages."""
    trees = [parse(p) for p in pages]
    words = sorted({w for t in trees for x in t.text if x for w in x.split()[:200]})[:20_000] or ["word"]
    for page, tree in zip(pages, trees, strict=True):
        own = own_labels(tree)
        if own:
            yield tree, own
        blocks = main_blocks(tree)
        if blocks:
            rnd = random.Random(zlib.crc32(page.encode()))
            for _ in range(layouts):
                held, most = blocks, rnd.choice(WORDS_HELD)
                if most:
                    held = [(tag, " ".join(text.split()[: rnd.randint(1, most)])) for tag, text in blocks[: rnd.randint(1, 12)]]
                made = parse(laid_out(held, words, rnd))
                yield made, placed_labels(made)


def states(tree: Tree, is_main: list[bool]) -> np.ndarray:
    """Each node's state, from its leaves' labels."""
    has = np.zeros((len(tree.tag), 2), bool)
    for i in range(len(tree.tag) - 1, -1, -1):
        if tree.text[i] is not None:
            has[i, int(is_main[i])] = True
        if tree.parent[i] >= 0:
            has[tree.parent[i]] |= has[i]
    return np.where(has.all(1), MIXED, np.where(has[:, 1], MAIN, OTHER))


# --- training ----------------------------------------------------------------
def trained_on(pages: list[str], steps: int = STEPS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Feature names, their weights [feature, state], and the edges' weights
    [tag, parent's state, child's state] (the first names are the tags)."""
    trees, labels = zip(*labelled_pages(pages), strict=True)
    pages_with = Counter(f for t in trees for f in {f for fs in features(t) for f in fs})
    tags = ["edge"] + sorted({f"edge {k[4:]}" for k, n in pages_with.items() if k.startswith("tag ") and n >= MIN_SEEN})
    names = tags + sorted(k for k, n in pages_with.items() if n >= MIN_SEEN)
    model = {f: i for i, f in enumerate(names)}
    forest = Forest(list(trees), model)
    per_page = [states(t, y) for t, y in zip(trees, labels, strict=True)]
    y = np.array([per_page[page][i] for page, i, _ in forest.leaf])
    is_child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((forest.n, 3))
    seen[np.arange(forest.n), y] = 1
    seen_pair = np.zeros((forest.n, 3, 3))
    seen_pair[is_child, y[forest.parent[is_child]], y[is_child]] = 1
    w, e = np.zeros((len(names), 3)), np.zeros((len(tags), 3, 3))
    moments = [np.zeros_like(x) for x in (w, w, e, e)]
    scale = max(1, len(trees))
    for step in range(1, steps + 1):  # Adam on the convex likelihood, with a ridge
        marginal, pair, _ = forest.marginals(forest.own(w), forest.between(e, 0))
        gap, gap_pair = marginal - seen, (pair - seen_pair)[is_child]
        gw = np.stack([np.bincount(forest.at, gap[forest.row, s], len(names)) for s in range(3)], axis=1) / scale + RIDGE * w / scale
        ge = np.zeros_like(e)
        np.add.at(ge, forest.kind[is_child], gap_pair)
        ge[0] = gap_pair.sum(0)
        ge = ge / scale + RIDGE * e / scale
        for x, g, a, b in ((w, gw, 0, 1), (e, ge, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            x -= RATE * (1 - 0.8 * step / steps) * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    return names, w, e


class Extractor:
    def __init__(self, names: list[str], weights: np.ndarray, edges: np.ndarray):
        self.model, self.weights, self.edges = {f: i for i, f in enumerate(names)}, weights, edges

    def __call__(self, pages: list[str | None]) -> list[str]:
        """Each page's main text."""
        out: list[str] = []
        held: list[Tree] = []
        size = 0
        for page in pages:
            tree = parse(page)
            if held and size + len(tree.tag) > FOREST:
                out += self.texts(held)
                held, size = [], 0
            held.append(tree)
            size += len(tree.tag)
        return out + self.texts(held)

    def texts(self, trees: list[Tree]) -> list[str]:
        forest, found = Forest(trees, self.model), [[] for _ in trees]
        marginal, _, _ = forest.marginals(forest.own(self.weights), forest.between(self.edges, 0))
        for (page, i, leaf), p in zip(forest.leaf, marginal[:, MAIN].tolist(), strict=True):
            if leaf and p > 0.5:
                found[page].append(trees[page].text[i])
        return ["\n".join(x) for x in found]


def trained(pages: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The model, trained on the ``sample`` pages with the smallest hashes."""
    rows = pages.select(F.xxhash64("page_id", "url").alias("h"), F.col("html").cast("string").alias("html")).filter("length(html) > 0")
    rows = scratch_table(rows.orderBy("h", F.xxhash64("html")).limit(sample), "labelled-pages")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("html", "ascending")])
        names, w, e = trained_on(t.column("html").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([w.ravel().tolist()]), pa.array([e.ravel().tolist()])], names=["names", "w", "e"])

    model = rows.repartition(1).mapInArrow(train, "names array<string>, w array<double>, e array<double>").collect()
    if not model:
        return None
    m = model[0]
    return m["names"], np.array(m["w"]).reshape(-1, 3), np.array(m["e"]).reshape(-1, 3, 3)


def main_text(pages: DataFrame, model: tuple | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or trained(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(*shared.value) if shared.value else lambda pages: [""] * len(pages)
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                texts = extract(batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
