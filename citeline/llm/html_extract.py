"""Main text of HTML pages by a tree-structured graphical model.

Method. A page becomes a tree of block elements. Every node has a hidden label, content or not, and
observed features (tag, words of class, id and role, text length, link share, sentence end, hidden).
Potentials between parent and child and of features given labels are counted on labelled pages
(``labelled_pages``: a fixed number of generated layouts, so training is bounded); messages passed up
and down the tree (sum-product) give each node's exact content marginal. Text of nodes with a marginal
of one half or more is kept, block by block in page order.

Defined cases: null, empty and textless pages give an empty text; unclosed and stray tags, cut pages and
markup without any block are parsed leniently, a missing end tag of head, button, select, title and the like
loses no text; very long pages take time in proportion to their length, whatever they are made of; a marginal of exactly
one half (a tie) is content; character references are decoded; text of scripts, styles,
comments and head elements never counts; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from citeline.llm.common import small_batches

#: Elements that start a block of text; elements without content; elements whose text is no page text.
BLOCKS = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr dialog menu legend center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select button title head canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Of these, the ones that are ignored where their end tag is missing; and others of which that is so, with whether they nest.
ENDLESS = frozenset("title noscript template".split())
PAIRED = {"button": False, "select": False, "canvas": False, "audio": False, "video": False, "object": True, "svg": True, "math": True}
#: Elements that may stand in a head; any other start tag, and any text, ends an open head.
HEAD = frozenset("head title meta link base basefont bgsound script style noscript noframes template".split())
#: Elements that say what a region of a page is.
REGIONS = frozenset("article main nav aside header footer form".split())
#: Start tags that end an open element of the second set, within the nearest element of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words in class, id and role, by what they tell, and what such a word may end in; longer words that begin alike tell nothing.
STEMS = {
    "menu": "nav navigation menu breadcrumb crumb toc pager pagination skip skiplink",
    "frame": "header masthead footer foot copyright branding topbar banner",
    "side": "side aside widget related recommend recommended recommendation popular trending more teaser promo",
    "advert": "ad advert advertisement advertising sponsor sponsored dfp outbrain taboola",
    "notice": "cookie consent notice gdpr popup modal overlay alert newsletter subscribe subscription signup paywall",
    "reader": "comment reply replies disqus respond discussion feedback review",
    "share": "share sharing social tag byline author meta login search form",
    "body": "article content entry post story main text body prose",
}
ENDINGS = ("", "s", "bar", "box", "list", "area", "section", "wrap", "wrapper", "container", "block", "item", "items", "links", "link", "form", "content", "body", "menu", "nav")
MARKS = {w + e: g for g, stems in STEMS.items() for w in stems.split() for e in ENDINGS}
#: Marks that an article's or main region's own class may bear; and those that so much prose below outweighs.
OF_ARTICLES, OUTWEIGHED, PROSE = frozenset({"body", "reader"}), frozenset({"menu", "frame", "advert", "notice", "share"}), 300


class Node:
    __slots__ = ("tag", "parent", "marks", "hidden", "own", "linked", "blocks", "label", "last")

    def __init__(self, tag: str, parent: int, marks: frozenset, hidden: bool, label: str | None):
        self.tag, self.parent, self.marks, self.hidden, self.label = tag, parent, marks, hidden, label
        self.own = self.linked = 0
        self.last = ""


def marks_of(attributes: dict[str, str]) -> frozenset:
    """What class, id and role tell, as names of groups of words."""
    words = re.findall(r"[a-z]+", " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower())
    return frozenset(MARKS[w] for w in words if w in MARKS)


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, blocks): block elements with parents before children; (node, text) of each block in page order."""
    nodes = [Node("root", -1, frozenset(), False, None)]
    stack: list[tuple[str, bool]] = []  # (tag, starts a node)
    open_nodes = [0]
    depths: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    links = skipped = 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                nodes[open_nodes[-1]].last = text
                blocks.append((open_nodes[-1], text))

    def add(text: str) -> None:
        pieces.append(text)
        size = len(text) if not text.isspace() else 0
        nodes[open_nodes[-1]].own += size
        if links:
            nodes[open_nodes[-1]].linked += size

    def pop(depth: int) -> None:
        nonlocal links, skipped
        while len(stack) > depth:
            tag, own = stack[-1]
            if own:
                flush()
                open_nodes.pop()
            stack.pop()
            depths[tag].pop()
            links -= tag == "a"
            skipped -= tag in SKIPPED

    def place(tags) -> int:
        """The depth of the innermost open element of these tags; -1 for none."""
        return max((depths[t][-1] for t in tags if depths[t]), default=-1)

    def close(tags, until) -> None:
        if (depth := place(tags)) > place(until):
            pop(depth)

    def read(text: str) -> None:
        if stack and stack[-1][0] == "head" and text.strip():
            pop(len(stack) - 1)
        if text and not skipped:
            add(text)

    page, at = page or "", 0
    last, ends = page.rfind(">"), {}

    def ended(tag: str, start: int) -> bool:
        """Whether the element that starts before ``start`` has an end tag of its own."""
        if tag not in ends:
            found = [(m.start(), bool(m[1])) for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", page, re.I)]
            ends[tag] = [x for x, _ in found], [is_end for _, is_end in found]
        places, is_end = ends[tag]
        i = bisect_left(places, start)
        return bool(is_end) and (is_end[-1] and i < len(is_end) if PAIRED[tag] else i < len(is_end) and is_end[i])

    missing: set[str] = set()  # raw elements without an end tag in the rest of the page
    while at <= last and (m := TOKEN.search(page, at)):
        read(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if depths[tag]:
                pop(depths[tag][-1])
            continue
        if skipped and tag not in HEAD:
            close(("head",), ())
        if m[3].endswith("/") and (tag in ("svg", "math") or depths["svg"] or depths["math"]):
            continue  # a foreign element that is closed in its start tag
        block = tag in BLOCKS
        if block:
            close(("p",), ("table", "td", "th", "button", "object")) if tag not in ("html", "body") else None
            flush()
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in RAW:
            end = None if tag in missing else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                missing.add(tag)
            if end or tag not in ENDLESS:
                at = end.end() if end else len(page)
            continue
        if tag in PAIRED and not ended(tag, at):
            continue
        links += tag == "a"
        skipped += tag in SKIPPED
        if block:
            found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            marks = marks_of(found) if found else frozenset()
            nodes.append(Node(tag, open_nodes[-1], marks & OF_ARTICLES if tag in ("article", "main") else marks, hidden, found.get("data-label")))
            open_nodes.append(len(nodes) - 1)
        depths[tag].append(len(stack))
        stack.append((tag, block))
    rest = page[at:]
    read(re.split(r"<[!?]", rest, maxsplit=1)[0])  # no tag ends here any more; an open comment or declaration is none of the text
    pop(0)
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> list[tuple[str, ...]]:
    """The observed features of each node; text below counts for link share."""
    own, linked = [n.own for n in nodes], [n.linked for n in nodes]
    # Prose: blocks of a line or more that end like sentences and are hardly linked.
    prose = [n.own if n.own >= 80 and n.linked < 0.15 * n.own and n.last[-1:] in ".!?…" else 0 for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        own[p] += own[i]
        linked[p] += linked[i]
        prose[p] += prose[i]
    out, under = [], ["none"] * len(nodes)
    for i, n in enumerate(nodes):
        marks = n.marks - OUTWEIGHED if prose[i] >= PROSE else n.marks
        under[i] = "hidden" if n.hidden or under[n.parent] == "hidden" else "+".join(sorted(marks)) or (n.tag if n.tag in REGIONS else under[n.parent] if i else "none")
        size = n.own
        bin_ = "none" if not size else "tiny" if size < 20 else "short" if size < 80 else "line" if size < 200 else "long"
        share = linked[i] / own[i] if own[i] else -1
        f = ["under=" + under[i], "tag=" + (n.tag if n.tag in BLOCKS else "root"), "size=" + bin_, "links=" + ("no" if share < 0 else "few" if share < 0.15 else "some" if share < 0.5 else "most")]
        if size:
            f.append("stop=" + str(n.last[-1:] in ".!?…\"'»”)"))
        f += ["mark=" + m for m in sorted(marks)]
        out.append(tuple(f))
    return out


class Model:
    """Counts of labels of parent and child and of features given labels, as log potentials."""

    def __init__(self, pages: list[str]):
        pairs, seen, label_of = Counter(), defaultdict(Counter), Counter()
        for page in pages:
            nodes, _ = parse(page)
            labels = [0] * len(nodes)
            for i, n in enumerate(nodes):
                labels[i] = int(n.label == "1") if n.label is not None else (labels[n.parent] if i else 1)
            for i, f in enumerate(features(nodes)):
                label_of[labels[i]] += 1
                if i:
                    pairs[labels[nodes[i].parent], labels[i]] += 1
                for x in f:
                    seen[x][labels[i]] += 1
        self.pair = [[math.log((pairs[p, c] + 1) / (pairs[p, 0] + pairs[p, 1] + 2)) for c in (0, 1)] for p in (0, 1)]
        self.prior = [math.log((label_of[c] + 1) / (sum(label_of.values()) + 2)) for c in (0, 1)]
        self.emit = {x: tuple(math.log((n[c] + 0.5) / (label_of[c] + 1)) for c in (0, 1)) for x, n in seen.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by messages up and then down the tree."""
        pair, emit = self.pair, self.emit
        n = len(nodes)
        up = [[0.0, 0.0] for _ in range(n)]
        for i, f in enumerate(features(nodes)):
            for x in f:
                a, b = emit.get(x, (0.0, 0.0))
                up[i][0] += a
                up[i][1] += b

        def add(x: float, y: float) -> float:
            return max(x, y) + math.log1p(math.exp(-abs(x - y)))

        sent = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = up[i]
            sent[i] = (add(pair[0][0] + a, pair[0][1] + b), add(pair[1][0] + a, pair[1][1] + b))
            p = up[nodes[i].parent]
            p[0] += sent[i][0]
            p[1] += sent[i][1]
        belief = [(0.0, 0.0)] * n
        belief[0] = (up[0][0] + self.prior[0], up[0][1] + self.prior[1])
        for i in range(1, n):
            b0, b1 = belief[nodes[i].parent]
            r0, r1 = b0 - sent[i][0], b1 - sent[i][1]
            belief[i] = (up[i][0] + add(pair[0][0] + r0, pair[1][0] + r1), up[i][1] + add(pair[0][1] + r0, pair[1][1] + r1))
        return [1 / (1 + math.exp(max(-700.0, min(700.0, a - b)))) for a, b in belief]

    def extract(self, page: str | None) -> str:
        nodes, blocks = parse(page)
        if not blocks:
            return ""
        content = self.marginals(nodes)
        return "\n".join(text for at, text in blocks if content[at] >= 0.5)


def labelled_pages(count: int = 800, seed: int = 20) -> list[str]:
    """Generated pages whose ``data-label`` attributes say what is content; labels pass on to children."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfglmnprst") for i in range(r.randint(2, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: phrase(3, 18).capitalize() + r.choice(".....!?")
    prose = lambda a, b: " ".join(sentence() for _ in range(r.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{phrase(a, b)}</a>'
    listing = lambda n=8: "<ul>" + "".join(f"<li>{link(1, 5)}</li>" for _ in range(r.randint(2, n))) + "</ul>"
    name = lambda *x: f'{r.choice(("class", "id"))}="{r.choice(x)}{r.choice(("", "", "-" + word(), " " + word()))}"'

    def off(tag: str, attributes: str, inner: str) -> str:
        return f'<{tag} data-label="0" {attributes}>{inner}</{tag}>'

    def clutter() -> str:
        return r.choice((
            lambda: off("nav", "", listing()), lambda: off("div", name("menu", "nav", "navbar", "breadcrumbs", "pagination"), listing()),
            lambda: off("div", name("ad", "ads", "advert", "sponsored"), r.choice((prose(1, 3), f"<p>{prose(1, 2)}</p>", link()))),
            lambda: off("aside", r.choice(("", name("sidebar", "widget"))), f"<h3>{phrase(1, 4)}</h3>" + r.choice((listing(), f"<p>{prose(1, 2)}</p>"))),
            lambda: off("div", name("sidebar", "related", "recommended", "popular", "widget"), f"<h3>{phrase(1, 3)}</h3>" + listing()),
            lambda: off("div", name("cookie", "cookie-notice", "consent", "popup", "newsletter", "alert", "notice"), f"<p>{prose(1, 3)} {link()}</p>"),
            lambda: off("form", "", f"<p>{phrase(2, 8)}</p><label>{word()}</label><input name=q>"),
            lambda: off("div", name("share", "social", "tags", "author", "byline", "meta"), r.choice((listing(4), phrase(2, 5)))),
            lambda: off("div", 'style="display: none"', f"<p>{prose(1, 3)}</p>"), lambda: off("p", "hidden", prose(1, 3)),
            lambda: off("div", name("search", "login", "signup", "subscribe"), f"<p>{prose(1, 1)}</p>"),
        ))()

    def comments() -> str:
        one = lambda: f'<{(t := r.choice(("div", "li", "article")))} {name("comment", "reply", "comment-body")}><p>{prose(1, 5)}</p></{t}>'
        return off(r.choice(("section", "div")), name("comments", "discussion", "respond", "reviews"), f"<h3>{phrase(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def body() -> str:
        parts = [f"<h1>{phrase(2, 10)}{r.choice(('', '.'))}</h1>"]
        for _ in range(r.randint(1, 10)):
            k = r.random()
            parts.append(
                f"<p>{prose(1, 8)}{r.choice(('', '', ' ' + link() + ' ' + sentence()))}</p>" if k < 0.62 else f"<p><b>{prose(1, 2)}<br>" if k < 0.72
                else f"<h2>{phrase(1, 7)}</h2>" if k < 0.8 else f"<blockquote><p>{prose(1, 3)}</p></blockquote>" if k < 0.84
                else "<ul>" + "".join(f"<li>{prose(1, 1)}</li>" for _ in range(r.randint(2, 5))) + "</ul>" if k < 0.89
                else f"<p>{phrase(1, r.choice((4, 25)))}{r.choice(('.', '', ',', ' |', '***'))}</p>" if k < 0.94 else f"<table><tr><td>{word()}</td><td>{phrase(1, 3)}</td></tr></table>" if k < 0.96 else clutter()
            )
        return "".join(parts)

    pages = []
    for _ in range(count):
        head = r.choice((lambda: off("header", r.choice(("", name("header", "masthead"))), r.choice((f"<p>{phrase(1, 4)}</p>", link())) + r.choice(("", listing()))), lambda: off("nav", "", listing()), lambda: off("div", name("header", "topbar", "banner"), phrase(1, 5) + listing(4)), lambda: ""))()
        foot = r.choice((lambda: off("footer", "", f"&copy; {phrase(1, 6)} &middot; {prose(1, 1)}"), lambda: off("footer", name("footer"), f"<p>&copy; {phrase(1, 5)}</p>" + listing(5)), lambda: off("div", name("footer", "copyright"), f"<p>{phrase(2, 8)}</p>")))()
        tag, attributes = r.choice((("article", ""), ("article", ""), ("article", name("post", "story")), ("main", ""), ("div", name("content", "article", "entry", "post-body", "story")), ("div", "")))
        inside = body() + r.choice(("", "", comments()))
        main = f'<{tag} data-label="1" {attributes}>{inside}</{tag}>'
        if r.random() < 0.4:
            main = f'<div data-label="1" {r.choice((name("wrapper", "container", "page"), name("main", "content")))}>{clutter() if r.random() < 0.3 else ""}{main}</div>'
        sides = [clutter() for _ in range(r.randint(0, 3))]
        cut_at = r.randint(0, len(sides))
        pages.append(f'<html><body data-label="1">{head}{"".join(sides[:cut_at])}{main}{comments() if r.random() < 0.25 else ""}{"".join(sides[cut_at:])}{foot}</body></html>')
    return pages


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", model: Model | None = None) -> DataFrame:
    """Per row: key, url, text and its length in code points. The trained model is a few hundred numbers."""
    model = model or Model(labelled_pages())

    def run(batches):
        for batch in batches:
            texts = [model.extract(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    small_batches(df.sparkSession)
    return df.select(key, url, page).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {url} string, text string, n_chars long")
