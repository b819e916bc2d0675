"""Main-text extraction by minimum-cut labelling of page blocks.

A page is cut into blocks at block-level tags. A logistic classifier gives each block its
log-odds of being content, CLIP at most either way; they become terminal capacities. Neighbouring blocks and
consecutive children of one element (DOM proximity) are joined by smoothness edges, which together outweigh a single block's
capacity: no mark of a page decides alone. The minimum cut, found by max-flow, separates content from boilerplate.

The classifier is fitted on blocks of EXAMPLES labelled pages that ``example`` makes by rule and from a seed, of several layouts. Its evidence are a block's length, links, end and tag, and the marks of the elements around it,
nearest first: tags and the share of class, id and role words that speak of content or boilerplate. A boilerplate mark counts for less the more of the page's
text its element holds, so that a page-wide wrapper named after its sidebar tells little.

Null and empty html give an empty text. Scripts, styles, markup, comments and
the head never become blocks. Character references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line. Unclosed and stray tags are tolerated; time is linear in tags and nesting. Repeated pages give repeated
results, an empty table none. Extra columns stay; one named ``_main`` is replaced.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import struct, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S
)
MARK = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")

# HTML element names by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg annotation textarea select title canvas audio video".split())
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s
samp small span strike strong sub sup time tt u var wbr
math mfenced mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics""".split())  # fmt: skip
BOILER = set("nav header footer aside form menu dialog button head".split())
MAIN = set("article main".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role names that mark boilerplate.
NAMES = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer
header masthead share sharing social related recommended newsletter subscribe subscription signup login comment
comments disqus reply replies respond widget toolbar search pagination pager copyright disclaimer complementary contentinfo""".split())  # fmt: skip
CONTENT_NAMES = set("article content main post entry story body text".split())

PROSE, LISTED = set("p blockquote pre".split()), set("li td th dd dt figcaption".split())

#: Smoothness of neighbours and of consecutive children, and what part of it stays across the bounds of marked elements.
ADJACENT, SIBLING, APART = 0.7, 0.9, 0.3
CLIP = 2.5
#: An element with this part of a page's text outside, or more, is no wrapper of the page.
WRAPPED = 0.25
#: Labelled pages that the classifier is fitted on, and the marked elements around a block that it sees.
EXAMPLES, LEVELS = 400, 3
CONTENT_SIGN = "\x01"


def _closes(tag: str, top: str) -> bool:
    """Whether an opening ``tag`` implies the end of the open element ``top``."""
    return (
        (top == "p" and tag not in INLINE) or (top == tag and tag in ("li", "option", "tr", "td", "th"))
        or (top in ("dt", "dd") and tag in ("dt", "dd")) or (top in ("td", "th") and tag in ("td", "th", "tr"))
        or (top == "head" and tag == "body")
    )


class Element:
    """An open block-level element: its number, its marks (nearest first) and the inline elements open in it.

    A mark is (good tag, good names, bad tag, bad names, number of the element).
    """

    def __init__(self, tag: str, number: int, attributes: str = "", above: Element | None = None):
        self.tag, self.number, self.parent = tag, number, above.number if above else 0
        self.inline: list[str] = []
        self.marks: tuple = above.marks if above else ()
        names = [w for g in MARK.findall(attributes) for w in re.split(r"[^a-z]+", "".join(g).lower()) if w]
        good = sum(w in CONTENT_NAMES for w in names) / max(1, len(names))
        bad = 0.0 if tag in ("html", "body") else sum(w in NAMES for w in names) / max(1, len(names))
        self.main = tag in MAIN or bool(above and above.main)
        boiler = tag in BOILER and not (tag == "header" and self.main)  # an article's own header holds its title
        if good or bad or tag in MAIN or boiler:
            self.marks = ((float(tag in MAIN), good, float(boiler), bad, number), *self.marks[: LEVELS - 1])


def blocks(page: str) -> list[dict]:
    """Text blocks in page order with the facts the classifier needs."""
    out: list[dict] = []
    stack = [Element("", 0)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = anchors = number = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            parts.append(raw)
            if anchors:
                links += len(raw.strip())

    def flush() -> None:
        nonlocal links
        s = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if s:
            own = stack[-1]
            out.append({"text": s, "tag": own.tag, "marks": own.marks, "parent": own.parent, "links": min(1.0, links / len(s))})
        parts.clear()
        links = 0

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        text(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        closing = bool(m.group(1) or m.group(4))
        if tag in RAW and not closing:
            if tag != "svg" or not m.group(0).endswith("/>"):
                end = _end(tag).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in INLINE:
            own = stack[-1].inline
            if tag in VOID:
                continue
            if not closing:
                own.append(tag)
                anchors += tag == "a"
            elif tag in own[-64:]:  # deeper ones end with their block
                while own.pop() != tag:
                    pass
                anchors = own.count("a") if tag == "a" else anchors
            continue
        flush()
        anchors = 0
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and _closes(tag, stack[-1].tag):
            pop()
        number += 1
        stack.append(Element(tag, number, m.group(3) or m.group(6) or "", stack[-1]))
        opened[tag] += 1
    if at < len(page):
        text(page[at:])
    flush()
    return out


@lru_cache(64)
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


def evidence(found: list[dict]) -> np.ndarray:
    """One row of numbers per block."""
    inside: Counter[int] = Counter()
    holds = set()  # marked elements around other marked ones
    for b in found:
        inner = False
        for mark in b["marks"]:
            inside[mark[4]] += len(b["text"])
            if inner:
                holds.add(mark[4])
            inner = True
    whole = max(1, sum(len(b["text"]) for b in found))
    rows = []
    for b in found:
        t, tag = b["text"], b["tag"]
        row = [1.0, math.log1p(len(t) / 40), b["links"], float(t[-1] in ".!?:;\u2026\u3002\"'\u201d"), float(tag in PROSE), float(tag in HEADING), float(tag in LISTED)]
        for k in range(LEVELS):
            main, good, tagged, bad, number = b["marks"][k] if k < len(b["marks"]) else (0.0, 0.0, 0.0, 0.0, -1)
            # A mark of boilerplate tells little on a wrapper: an element around nearly the whole page, or around other marked ones.
            apart = 0.0 if number < 0 else 1 - inside[number] / whole
            if number not in holds:
                apart = 1.0 if tagged or bad == 1 else min(1.0, apart / WRAPPED)
            row += [main, good, tagged * apart, bad * apart]
        rows.append(row)
    return np.array(rows, float).reshape(len(rows), 7 + 4 * LEVELS)


def example(r: random.Random) -> str:
    """A labelled page: blocks of content start with CONTENT_SIGN."""

    def words(n: int) -> str:
        return " ".join("".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9))) for _ in range(n))

    def prose(sign: str = "") -> str:
        n = r.choice((2, 3, 6, 12, 25, 60, 120))
        return sign + words(n) + r.choice(("", ".", ".", ".", "!", "?"))

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=x>{words(r.randint(1, 3))}</a></li>" for _ in range(n)) + "</ul>"

    def box(name: str, inner: str, tag: str = "div") -> str:
        return f'<{tag} {r.choice(("class", "id"))}="{name}">{inner}</{tag}>'

    def aside() -> str:
        name = r.choice(("ad", "advert", "share", "related", "newsletter", "promo", "cookie notice", "social-links", "sponsored"))
        return r.choice((box(name, prose()), box(name, f"<p>{prose()}</p>"), f"<aside><p>{prose()}</p></aside>", box(name, links(3)), f"<form><label>{words(2)}</label><p>{words(4)}</p></form>"))

    def comments() -> str:
        inner = "".join(box(r.choice(("comment-body", "reply text", "content")), f"<p>{prose()}</p>") for _ in range(r.randint(1, 4)))
        return box(r.choice(("comments", "disqus", "replies")), f"<h3>{words(2)}</h3>" + inner, r.choice(("div", "section")))

    def content(bare: bool) -> str:
        title = f"<h1>{CONTENT_SIGN}{words(r.randint(2, 9))}</h1>"
        own = [r.choice((title, title, f"<header>{title}</header>", f"<div class=header>{title}</div>"))]
        for _ in range(r.randint(2, 9)):
            name = r.choice(("", "", "", "", ' class="share-price"', ' class="lead"', ' class="intro promo-code"'))
            own.append(r.choice((f"<p{name}>{prose(CONTENT_SIGN)}</p>", f"<p>{prose(CONTENT_SIGN)}</p>", f"<p>{prose(CONTENT_SIGN)}", f"<h2>{CONTENT_SIGN}{words(3)}</h2>", f"<div>{prose(CONTENT_SIGN)}</div>",
                                 "<ul>" + "".join(f"<li>{CONTENT_SIGN}{words(r.randint(1, 12))}" for _ in range(r.randint(2, 4))) + "</ul>")))
            if not bare and r.random() < 0.15:
                own.append(aside())
        return "".join(own) + (comments() if not bare and r.random() < 0.3 else "")

    bare = r.random() < 0.15
    inner = content(bare)
    kind = r.choice(("article", "main", "post", "content", "entry-content", "story-body", "article-text", "", ""))
    if kind in ("article", "main"):
        inner = f"<{kind}>{inner}</{kind}>"
    elif kind or r.random() < 0.5:
        inner = f'<div class="{kind}">{inner}</div>' if kind else f"<div>{inner}</div>"
    if bare:
        return inner
    side = r.choice(("", box("sidebar", f"<p>{prose()}</p>" * r.randint(1, 6)), box("sidebar", links(4) + box("content", f"<p>{prose()}</p>"), r.choice(("div", "aside")))))
    wrapper = r.choice(("", "", "page with-sidebar", "layout sidebar-left", "wrapper", "container", "site has-menu"))
    inner = inner + side if r.random() < 0.5 else side + inner
    if wrapper:
        inner = box(wrapper, inner)
    top = r.choice((f"<nav>{links(5)}</nav>", f"<header><div>{words(2)}</div>{links(4)}</header>", box("menu", links(5)), box("nav", links(3)), links(5)))
    end = r.choice((f"<footer>&copy; {prose()}</footer>", f"<footer><p>{prose()}</p>{links(2)}</footer>", box("footer", prose()), box("copyright", words(4))))
    return f"<body>{top}{aside() if r.random() < 0.7 else ''}{inner}{aside() if r.random() < 0.3 else ''}{comments() if r.random() < 0.2 else ''}{end}</body>"


@lru_cache(1)
def weights() -> np.ndarray:
    """Logistic regression on the example pages, by Newton steps with a small ridge."""
    r, rows, labels = random.Random(11), [], []
    for _ in range(EXAMPLES):
        found = blocks(example(r))
        labels += [CONTENT_SIGN in b["text"] for b in found]
        for b in found:
            b["text"] = b["text"].replace(CONTENT_SIGN, "") or "x"
        rows.append(evidence(found))
    x, y = np.concatenate(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - w)
    return w


def leanings(found: list[dict], w: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of content, CLIP at most either way."""
    return np.clip(evidence(found) @ (weights() if w is None else w), -CLIP, CLIP)


def max_flow_side(n: int, cap: list[dict[int, float]], s: int, t: int) -> set[int]:
    """Nodes on the source side of a minimum cut: shortest augmenting paths in blocking phases."""
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return set(level)
        todo = [[v for v, c in cap[u].items() if c > 1e-9 and level.get(v) == level.get(u, -9) + 1] for u in range(n)]
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0.0) + push
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-9)
                del path[cut + 1 :]
                continue
            while todo[u] and cap[u][todo[u][-1]] <= 1e-9:
                todo[u].pop()
            if todo[u]:
                path.append(todo[u][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def label(found: list[dict], w: np.ndarray | None = None) -> list[bool]:
    """Content or not for each block, by minimum cut."""
    n = len(found)
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, x in enumerate(leanings(found, w)):
        a, b = (s, i) if x > 0 else (i, t)
        cap[a][b], cap[b][a] = abs(float(x)), 0.0
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        for j, w in ((i - 1, ADJACENT), (last.get(b["parent"], -1), SIBLING)):
            if j >= 0:
                near = w if found[j]["marks"][:1] == b["marks"][:1] else w * APART
                cap[i][j] = cap[j][i] = cap[i].get(j, 0.0) + near
        last[b["parent"]] = i
    content = max_flow_side(n + 2, cap, s, t)
    return [i in content for i in range(n)]


def main_text(page: str | None, w: np.ndarray | None = None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b["text"] for b, keep in zip(found, label(found, w)) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with a struct ``_main`` of text and n_chars; the classifier is fitted once, on the driver."""
    w = weights()

    @F.pandas_udf(struct("text string, n_chars long"))
    def go(pages: pd.Series) -> pd.DataFrame:
        texts = [main_text(p, w) for p in pages]
        return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return pages.withColumn("_main", go(F.col(html)))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "_main.text", "_main.n_chars")
