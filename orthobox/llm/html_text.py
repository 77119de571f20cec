"""Main text of HTML pages by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is tokenised once into a tree of its block-level elements (inline elements and formulas belong to the block around them; scripts,
styles, templates, form values, frames, comments and the head never enter; fallbacks of media, noscript and svg texts are nodes). Each node has features: its kind of tag, tokens of its attributes, depth,
sibling statistics, subtree size, text, link, tag and punctuation density, and the kinds of its ancestors. Boosted trees
give each node the log odds that it holds main text. Decoding chooses the set of nodes with the greatest sum of log odds in
which every chosen node's parent is chosen: a bottom-up pass in which a subtree is kept if its sum is positive. So a node
below a dropped ancestor is never kept, and an ancestor of kept text is never dropped.

The trees are fitted here, on the driver, to pages written by a seeded generator (N_PAGES pages of varied layouts whose main
text is known), once a process; the model is a few thousand numbers and is sent with the function.

The text of a kept block has its character references decoded, white space turned into single spaces and trimmed; blocks are
joined in page order by a blank line. Nothing is cut or capped.

Reading is linear in a page's length, whatever it holds: a tag is looked at once, an attribute value is quoted only if the quote
follows its =, an end tag without an open element is passed over.

Cases: null and empty pages give an empty text; text outside any element counts as in the body; unclosed and stray tags are
tolerated; a page without main text gives ''; repeated rows give equal rows; an empty table gives no rows; extra columns are
kept unless they are named text or n_chars, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import orthobox.llm.shared  # noqa: F401  (sends this module's functions with their code)

N_PAGES, TREES, DEPTH, BINS, RATE = 700, 40, 4, 32, 0.3
AT_ONCE = 2_000_000  # characters of pages whose nodes are held at a time

# A usual tag; it never looks beyond the next < or >. Others are read piece by piece.
_USUAL = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:\s++[a-zA-Z][\w:-]*+(?:=\"[^\"<>]*+\")?+)*+)\s*+(/?)>")
_NAME, _SKIP, _KEY, _IS, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*+", r"[\s/]*+", r"=?[^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]*+"))
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML.
RAW = frozenset("script style template iframe textarea select title".split())
TO_THE_END = frozenset(["script", "style"])  # without an end tag these take the rest of the page; the others take nothing
MEDIA = frozenset("noscript object svg canvas audio video".split())
_NO_TEXT = re.compile(r"<(script|style|iframe|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|\s+", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
SCOPE = frozenset("ul ol dl table div section article aside nav body html td th datalist select".split())

KINDS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dd dt", "nav", "header", "footer", "aside", "form fieldset button input legend", "table thead tbody tr td th caption", "blockquote pre figure figcaption address details", "body html"]
KIND = {t: k for k, tags in enumerate(KINDS) for t in tags.split()}
OTHER = len(KINDS)
# Words that name the part of a page an element is.
TOKENS = ["ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs", "sidebar aside rail widget related recommended complementary more trending popular", "footer foot copyright contentinfo legal colophon", "header head masthead topbar logo", "comment comments reply replies respond discussion disqus", "cookie cookies consent notice alert popup modal overlay gdpr dialog warning announcement", "form login signup subscribe subscription newsletter search contact register", "share sharing social follow meta byline tags toolbar", "article content main post entry story text body page prose blog"]
TOKEN = {t: k for k, words in enumerate(TOKENS) for t in words.split()}
AREAS = {KIND["article"]: 0, KIND["nav"]: 1, KIND["header"]: 1, KIND["footer"]: 1, KIND["aside"]: 1, KIND["form"]: 1}


class Node:
    __slots__ = ("tag", "kind", "parent", "children", "tokens", "depth", "pieces", "chars", "links", "tags", "marks", "own", "paragraphs", "hidden")

    def __init__(self, tag: str, parent: "Node | None", attributes: str):
        self.tag, self.kind, self.parent, self.children, self.pieces = tag, KIND.get(tag, OTHER), parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.links = self.tags = self.marks = self.own = self.paragraphs = 0
        self.tokens = [0] * len(TOKENS)
        self.hidden = "hidden" in attributes
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            for t in _TOKEN.findall(m[2] or m[3] or m[4] or ""):
                k = TOKEN.get(t.lower())
                if k is not None:
                    self.tokens[k] += 1


class _Scanner:
    """Reads a page tag by tag, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.limit, self.plain, self.last = page, len(page), False, page.rfind(">")
        self.ends: dict[str, int] = {}
        self.texts: dict[str, tuple[int, bool]] = {}

    def tag(self, n: int) -> tuple | None:
        """What begins at the < at n: (end, name, closing, attributes, self-closing), the name None for comments and
        declarations; None if it is text."""
        page = self.page
        m = _USUAL.match(page, n)
        if m:
            return m.end(), m[2].lower(), bool(m[1]), m[3], bool(m[4])
        if page.startswith("<!--", n):
            end = n + 5 if page.startswith("<!-->", n) else page.find("-->", n + 4) + 3
            return end if end > n + 4 else self.limit, None, False, "", False
        if n > self.last:
            return None
        if page.startswith(("<!", "<?"), n):
            return page.find(">", n) + 1, None, False, "", False
        closing = page.startswith("</", n)
        m = _NAME.match(page, n + 1 + closing)
        if not m:
            return None
        end = None if self.plain else self._end(m.end())
        if end is None:  # the page ends inside: quotes don't count from here on
            self.plain, end = True, page.find(">", m.end()) + 1
        return end, m[0].lower(), closing, page[m.end() : end - 1], page[end - 2] == "/"

    def _end(self, n: int) -> int | None:
        """After the > that ends a tag, from the end of its name on: values may be quoted, a quote elsewhere is a letter."""
        page = self.page
        while True:
            n = _SKIP.match(page, n).end()
            if n >= self.limit:
                return None
            if page[n] == ">":
                return n + 1
            n = _KEY.match(page, n).end()
            m = _IS.match(page, n)
            if m:
                n = m.end()
                close = page.find(page[n], n + 1) if page[n : n + 1] in ('"', "'") else -1
                n = close + 1 if close >= 0 else _BARE.match(page, n).end()

    def end_of(self, tag: str, n: int) -> int:
        """Where the next end tag stands, -1 if there is none."""
        at = self.ends.get(tag, 0)
        if 0 <= at < n or tag not in self.ends:
            m = re.compile(f"</{re.escape(tag)}(?![^\\s/>])", re.I).search(self.page, n)
            self.ends[tag] = at = m.start() if m else -1
        return at

    def holds_text(self, tag: str, n: int, end: int) -> bool:
        """Whether text stands between n and the end tag at `end`; of elements within one another the outermost decides."""
        known = self.texts.get(tag)
        if known is None or known[0] != end:
            self.texts[tag] = known = (end, bool(_NO_TEXT.sub("", self.page[n:end])))
        return known[1]


def parse(page: str, make: Callable[..., Node] = Node) -> list[Node]:
    """Nodes in page order, the root first. A node's pieces are its runs of text, each (order, text)."""
    root = make("body", None, "")
    nodes, at, links, order = [root], root, 0, 0
    run: list[str] = []
    n, limit, scan = 0, len(page), _Scanner(page)
    opened: Counter = Counter()
    head = False

    def leave(up: Node) -> Node:
        """Closes all open nodes up to this one."""
        x = at
        while x is not up.parent:
            opened[x.tag] -= 1
            x = x.parent
        return x

    def close_run():
        nonlocal order
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                at.pieces.append((order, text))
                at.own += len(text)
                order += 1

    while n < limit:
        text = page.find("<", n)
        text = limit if text < 0 else text
        if text > n:
            run.append(page[n:text])
            if links:
                at.links += text - n
        if text == limit:
            break
        found = scan.tag(text)
        if found is None:
            run.append("<")
            n = text + 1
            continue
        n, tag, closing, attributes, alone = found
        if tag is None:
            continue
        at.tags += 1
        if tag in RAW:
            if not closing and not alone:
                stop = scan.end_of(tag, n)
                if stop >= 0:
                    n = page.find(">", stop) + 1 or limit
                elif tag in TO_THE_END:
                    n = limit
            continue
        if tag in MEDIA and not closing:
            if alone:
                continue
            # One without text, like an icon, does not part the text around it.
            stop = scan.end_of(tag, n)
            if stop >= 0 and not scan.holds_text(tag, n, stop):
                n = page.find(">", stop) + 1 or limit
                continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID and tag != "hr" and tag != "input":
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in ("html", "body"):
            continue
        if tag == "head":
            if not closing and not head:
                head = True
                stop = re.compile(r"</head\s*+>|<body[\s>]", re.I).search(page, n)
                if stop:
                    n = stop.start()
            continue
        close_run()
        links = 0
        if closing:
            if opened[tag] > 0:
                up = at
                while up.tag != tag:
                    up = up.parent
                at = leave(up)
            continue
        drop = SAME_CLOSES.get(tag) or ({"p"} if tag in CLOSES_P else ())
        if any(opened[t] > 0 for t in drop):
            up = at
            while up is not root and up.tag not in drop and up.tag not in SCOPE:
                up = up.parent
            if up is not root and up.tag in drop:
                at = leave(up)
        if tag in VOID:
            continue
        node = make(tag, at, attributes)
        at.children.append(node)
        nodes.append(node)
        if not alone:
            at = node
            opened[tag] += 1
    close_run()
    for x in reversed(nodes):
        x.chars += x.own
        x.marks += sum(t.count(",") + t.count(".") for _, t in x.pieces)
        x.paragraphs += x.tag == "p"
        if x.parent:
            p = x.parent
            p.chars += x.chars
            p.links += x.links
            p.tags += x.tags
            p.marks += x.marks
            p.paragraphs += x.paragraphs
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    total, out, before = max(1, nodes[0].chars), [], 0
    above: dict[int, tuple] = {}
    family: dict[int, tuple[float, float]] = {id(nodes[0]): (0.0, 1.0)}  # place among siblings, share of those alike
    for x in nodes:
        n, kinds = len(x.children), Counter(c.kind for c in x.children)
        for k, c in enumerate(x.children):
            family[id(c)] = (k / (n - 1) if n > 1 else 0.0, kinds[c.kind] / n)
        p = x.parent
        good, bad, tokens_above = above[id(p)] if p else (0, 0, [0] * len(TOKENS))
        place, alike = family[id(x)]
        n_siblings = len(p.children) if p else 1
        kind = [0.0] * (OTHER + 1)
        kind[x.kind] = 1.0
        chars = max(1, x.chars)
        out.append(kind + [min(t, 1) for t in x.tokens] + tokens_above + [
            good, bad, x.depth, place, min(n_siblings, 50), alike, min(n, 50), p.kind if p else -1,
            np.log1p(x.chars), np.log1p(x.own), x.links / chars, x.tags / chars, x.marks / chars, min(x.paragraphs, 50), x.chars / total, before / total, float(x.hidden),
        ])
        area = AREAS.get(x.kind)
        above[id(x)] = (good or area == 0, bad or area == 1, [max(a, min(t, 1)) for a, t in zip(tokens_above, x.tokens)])
        before += x.own
    return out


class Forest:
    """Boosted regression trees of fixed depth on binned features, with the logistic loss."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base, self.trees = edges, base, []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> "Forest":
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(x[:, k])) > BINS else (np.unique(x[:, k])[1:] + np.unique(x[:, k])[:-1]) / 2 for k in range(x.shape[1])]
        out = cls(edges, float(np.log(y.mean() / (1 - y.mean()))))
        b, width, n_features = out.binned(x), BINS + 1, x.shape[1]
        flat = b + np.arange(n_features) * width
        score = np.full(len(y), out.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, curve = y - p, p * (1 - p)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width, np.int64)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, count = 2**level - 1, 2**level
                key = ((at - first)[:, None] * (n_features * width) + flat).ravel()
                g = np.bincount(key, np.repeat(grad, n_features), count * n_features * width).reshape(count, n_features, width).cumsum(axis=2)
                h = np.bincount(key, np.repeat(curve, n_features), count * n_features * width).reshape(count, n_features, width).cumsum(axis=2)
                all_g, all_h = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                best = gain.reshape(count, -1).argmax(axis=1)
                useful = gain.reshape(count, -1).max(axis=1) > 1e-9
                feature[first : first + count] = best // width
                cut[first : first + count] = np.where(useful, best % width, width)
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            at -= 2**DEPTH - 1
            leaf = RATE * np.bincount(at, grad, 2**DEPTH) / (np.bincount(at, curve, 2**DEPTH) + 1)
            out.trees.append((feature, cut, leaf))
            score += leaf[at]
        return out


def decode(nodes: list[Node], odds: np.ndarray) -> str:
    """Keeps the ancestor-closed set of nodes with the greatest sum; the root's own score plays no part."""
    index = {id(x): k for k, x in enumerate(nodes)}
    best = odds.astype(float).copy()
    for k in range(len(nodes) - 1, 0, -1):
        if best[k] > 0:
            best[index[id(nodes[k].parent)]] += best[k]
    kept, blocks = [False] * len(nodes), []
    for k, x in enumerate(nodes):
        kept[k] = k == 0 or best[k] > 0 and kept[index[id(x.parent)]]
        # Text that stands in the body itself is judged by the root's own odds.
        if kept[k] and (k or odds[0] > 0):
            blocks += x.pieces
    return "\n\n".join(t for _, t in sorted(blocks))


class _Writer:
    """Pages with known main text. A part is (html, kept); kept parts hold main text."""

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)

    def pick(self, *options):
        return options[self.r.randint(len(options))]

    def words(self, n: int) -> str:
        letters = "etaoinsrhldcumfpgwybvkéüñ"
        made = ["".join(letters[min(int(self.r.exponential(6)), len(letters) - 1)] for _ in range(1 + self.r.poisson(4))) for _ in range(max(1, n))]
        return " ".join(w + self.pick("", "", "", "", "", "", ",", ".") for w in made)

    def sentence(self, n: int) -> str:
        return self.words(n).capitalize() + self.pick(".", ".", ".", "")

    def links(self, n: int) -> str:
        items = [f'<a href="/{self.words(1)}">{self.words(self.pick(1, 1, 2, 3))}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.rand() < 0.7 else " | ".join(items)

    def named(self, names: str, *tags: str) -> tuple[str, str]:
        tag = self.pick(*tags)
        name = self.pick(*names.split())
        attribute = self.pick(f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1)}"', f' class="site-{name}"') if tag in ("div", "section", "span", "ul") or self.r.rand() < 0.4 else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def around(self, kind: str) -> str:
        """A part that is not main text."""
        few = lambda a, b: self.r.randint(a, b)
        if kind == "nav":
            a, z = self.named("nav menu navbar navigation breadcrumb", "nav", "nav", "div")
            return a + self.links(few(2, 9)) + z
        if kind == "ad":
            a, z = self.named("ad ads advert banner sponsored promo", "div", "div", "aside", "section")
            return a + self.pick(self.sentence(few(3, 14)), f"<p>{self.sentence(few(3, 20))}</p>", f"<a href='/x'>{self.sentence(few(3, 10))}</a>") + z
        if kind == "header":
            a, z = self.named("header masthead topbar", "header", "header", "div")
            return a + self.pick(f"<h1>{self.words(few(1, 5))}</h1>", f"<p>{self.words(few(1, 8))}</p>", self.words(few(1, 5)), f"<div>{self.words(3)}</div>") + self.pick("", self.around("nav")) + z
        if kind == "footer":
            a, z = self.named("footer copyright contentinfo legal", "footer", "footer", "div")
            return a + self.pick(f"&copy; {self.words(2)} &middot; {self.sentence(few(2, 16))}", f"<p>{self.sentence(few(3, 12))}</p>" + self.links(few(1, 5)), self.links(few(2, 7))) + z
        if kind == "side":
            a, z = self.named("sidebar related widget trending popular recommended", "aside", "aside", "div", "section")
            return a + self.pick("", f"<h3>{self.words(2)}</h3>") + self.pick(self.links(few(2, 8)), "".join(f"<p>{self.sentence(few(4, 30))}</p>" for _ in range(few(1, 4)))) + z
        if kind == "notice":
            a, z = self.named("cookie notice consent alert popup warning announcement", "div", "div", "section", "p")
            return a + self.sentence(few(4, 25)) + self.pick("", "<button>OK</button>") + z
        if kind == "form":
            a, z = self.pick(("<form>", "</form>"), self.named("subscribe newsletter login search", "form", "div"))
            return a + self.pick(f"<p>{self.sentence(few(3, 12))}</p>", f"<label>{self.words(2)}</label>", f"<div>{self.words(3)}</div>", "") + "<input name='q'><button>" + self.words(1) + "</button>" + z
        if kind == "share":
            a, z = self.named("share social byline meta tags toolbar", "div", "div", "ul", "p")
            return a + self.pick(self.words(few(1, 6)), self.links(few(2, 5))) + z
        a, z = self.named("comments comment replies discussion respond", "section", "div", "div")
        one = lambda: self.pick(f'<div class="comment"><p>{self.sentence(few(2, 40))}</p></div>', f'<li class="comment">{self.sentence(few(2, 30))}</li>', f"<p>{self.sentence(few(3, 30))}</p>", f"<article class='comment'><p>{self.sentence(few(3, 30))}</p></article>")
        return a + self.pick("", f"<h3>{self.words(2)}</h3>") + "".join(one() for _ in range(few(1, 6))) + z

    def page(self) -> tuple[str, list[str]]:
        """The page, with main text marked by an attribute that the features do not see."""
        main, few = [], lambda a, b: self.r.randint(a, b)
        if self.r.rand() < 0.85:
            main.append(self.pick(*[f"<{h} data-m=1>{self.sentence(few(1, 9))}</{h}>" for h in ("h1", "h1", "h2")]))
        for _ in range(few(0, 14)):
            n = self.pick(1, few(1, 5), few(5, 60), few(20, 200))
            body = self.sentence(n)
            kind = self.r.rand()
            if kind < 0.72:
                main.append(self.pick(f"<p data-m=1>{body}</p>", f"<p data-m=1>{body}</p>", f"<p data-m=1><b>{body}<br>", f"<p data-m=1>{body} <a href='/y'>{self.words(2)}</a> {self.words(3)}</p>"))
            elif kind < 0.78:
                main.append(f"<{(h := self.pick('h2', 'h3'))} data-m=1>{self.words(few(1, 6))}</{h}>")
            elif kind < 0.84:
                main.append("<ul data-m=1>" + "".join(f"<li data-m=1>{self.sentence(few(1, 15))}</li>" for _ in range(few(1, 6))) + "</ul>")
            elif kind < 0.88:
                main.append(f"<blockquote data-m=1>{body}</blockquote>")
            elif kind < 0.92:
                main.append(f"<div data-m=1>{body}</div>")
            elif kind < 0.95:
                main.append("<table data-m=1>" + "".join(f"<tr data-m=1><td data-m=1>{self.words(2)}</td><td data-m=1>{self.words(2)}</td></tr>" for _ in range(few(1, 4))) + "</table>")
            else:
                main.append(f"<pre data-m=1>{body}</pre>")
        for kind in ("ad", "share", "side", "form", "notice", "nav"):
            if self.r.rand() < 0.12:
                main.insert(self.r.randint(len(main) + 1), self.around(kind))
        if self.r.rand() < 0.15:
            main.append(self.around("comments"))
        if self.r.rand() < 0.08:
            main.append(self.around("footer"))
        inner = "".join(main)
        holder = self.pick("article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="main"', 'section class="entry-content"', "div", 'div class="article-body"')
        out = f"<{holder} data-m=1>{inner}</{holder.split()[0]}>"
        if self.r.rand() < 0.3:
            wrap = self.pick("main", "div", 'div id="page"', 'div class="container"', 'div class="row"')
            side = [self.around("side")] if self.r.rand() < 0.5 else []
            out = f"<{wrap} data-m=1>" + "".join(self.pick([out, *side], [*side, out])) + f"</{wrap.split()[0]}>"
        before = [self.around(k) for k in ("notice", "header", "nav", "ad", "form") if self.r.rand() < (0.5 if k in ("nav", "header", "ad") else 0.15)]
        after = [self.around(k) for k in ("side", "comments", "ad", "form", "notice", "footer") if self.r.rand() < (0.7 if k == "footer" else 0.25)]
        return "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(before) + out + "".join(after) + self.pick("</body></html>", ""), []


def _marked(page: str) -> tuple[list[Node], list[bool]]:
    """Nodes and whether each holds main text; the generator's mark is an attribute."""
    marks: list[bool] = []

    def make(tag: str, parent: Node | None, attributes: str) -> Node:
        marks.append("data-m" in attributes)
        return Node(tag, parent, attributes)

    nodes = parse(page, make)
    marks[0] = True
    return nodes, marks


@lru_cache(maxsize=1)
def model(seed: int = 20_12) -> Forest:
    writer, x, y = _Writer(seed), [], []
    for _ in range(N_PAGES):
        nodes, marks = _marked(writer.page()[0])
        x += features(nodes)
        y += marks
    return Forest.fit(np.array(x, float), np.array(y, float))


def main_text(pages: list[str | None], forest: Forest) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    rows = [f for nodes in parsed if nodes for f in features(nodes)]
    odds = forest.predict(np.array(rows, float)) if rows else np.empty(0)
    out, at = [], 0
    for nodes in parsed:
        out.append(decode(nodes, odds[at : at + len(nodes)]) if nodes else "")
        at += len(nodes or ())
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points of the text) added."""
    forest = model()

    @F.pandas_udf("string")
    def text(batch):
        import pandas as pd

        out, some, held = [], [], 0
        for page in batch:
            some.append(page)
            held += len(page or "")
            if held > AT_ONCE:
                out += main_text(some, forest)
                some, held = [], 0
        return pd.Series(out + main_text(some, forest))

    out = pages.withColumn("text", text(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
