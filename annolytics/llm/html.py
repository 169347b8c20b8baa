"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded so that choices along the tree agree.

A page is parsed into a tree of elements whose leaves are runs of inline text. Every node is scored from its subtree's text and link
density, its tag and attribute tokens, its ancestors', its depth and its place among its siblings. The most likely labelling in which
a node is kept exactly if something below it is kept is found bottom-up; kept leaves in page order are the text. The trees are fitted
on the driver from seeded pages of many layouts, as the tables have no labelled ones.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from annolytics.llm import boosting

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of a page.
HIDDEN = frozenset("script style noscript template iframe svg math object head title textarea select option datalist canvas audio video button".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What can stand in a head; another start tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())
#: An open element of these ends where one of the second set starts.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]),
}
#: Attributes of a tag: up to 200 runs of quoted or other characters, each taken whole, or what stands before the first >.
INSIDE = r"(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'){0,200}+(?=>)|[^>]*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>|<(?P<raw>" + "|".join(RAW) + rf")\b{INSIDE}>.*?(?:</(?P=raw)\s*>|$)"
    rf"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>{INSIDE})>",
    re.S | re.I,
)
NEVER_ENDS = re.compile(r"<!--|<!\[CDATA\[")
UNCLOSED = re.compile(r"(?:<!--(?!.*-->$)|<!\[CDATA\[(?!.*\]\]>$)|<(?!!)(?!.*</[a-z]+\s*>$)).*", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of attributes that speak for or against main text.
FOR = frozenset("article articlebody body content entry main maincontent page post story text".split())
AGAINST = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus dialog feedback footer form gdpr head header hidden legal login masthead menu meta modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar top widget".split()
)
TAGS = ("p", "h", "li", "td", "div", "nav", "footer", "header", "aside", "article", "main", "section", "form", "text")
GROUPS = {"nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "dialog": "aside", "article": "article", "main": "main", "form": "form", "fieldset": "form"}

FEATURES = (
    "length", "words", "word_length", "marks", "link_share", "density", "page_share", "depth", "place", "siblings", "sibling_share", "leaves", "links",
    "own_for", "own_against", "up_for", "up_against", "down_for", "down_against", "start", *(f"is_{t}" for t in TAGS), *(f"in_{g}" for g in ("nav", "footer", "header", "aside", "article", "main", "form")),
)


class Node:
    __slots__ = ("tag", "words", "up", "down", "text", "chars", "linked", "tags", "leaves", "links", "start", "depth")

    def __init__(self, tag: str, words: frozenset, up: Node | None):
        self.tag, self.words, self.up = tag, words, up
        self.down: list[Node] = []
        self.text = ""
        self.chars = self.linked = self.tags = self.leaves = self.links = 0
        self.start = 0
        self.depth = up.depth + 1 if up else 0


NOTHING: frozenset = frozenset()


def attribute_words(attrs: str) -> frozenset:
    found = ATTRIBUTE.findall(attrs) if "=" in attrs else ()
    return frozenset(w.lower() for v in found for w in PART.findall(v)) if found else NOTHING


def parse(page: str) -> Node:
    """The tree of block elements and text leaves. Unclosed and misnested tags are closed as browsers would, or ignored."""
    root = Node("html", NOTHING, None)
    stack: list[tuple[str, Node | None]] = []  # open elements; inline ones have no node
    held: Counter[str] = Counter()  # open elements by name
    block, hidden, linked = root, 0, 0
    run: list[str] = []
    run_linked = 0
    total = 0

    def flush() -> None:
        nonlocal run, run_linked, total
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                leaf = Node("text", NOTHING, block)
                leaf.text, leaf.chars, leaf.linked, leaf.leaves, leaf.start = text, len(text), min(run_linked, len(text)), 1, total
                total += len(text)
                block.down.append(leaf)
            run, run_linked = [], 0

    def push(tag: str, node: Node | None) -> None:
        stack.append((tag, node))
        held[tag] += 1

    def pop() -> None:
        nonlocal block, hidden, linked
        tag, node = stack.pop()
        held[tag] -= 1
        if node is not None:
            flush()
            block = node.up
        if tag in HIDDEN:
            hidden -= 1
        if tag == "a":
            linked -= 1

    def leave_head() -> None:
        while held["head"]:
            pop()

    at = 0
    closed = page.rfind(">") + 1  # beyond it no tag ends
    for m in TOKEN.finditer(page, 0, closed):
        if m.start() > at and stack and stack[-1][0] == "head" and page[at : m.start()].strip():
            leave_head()
        if m.start() > at and not hidden:
            piece = page[at : m.start()]
            run.append(piece)
            if linked:
                run_linked += len(piece.strip())
        at = m.end()
        if at == closed and (m["raw"] or m[0].startswith(("<!--", "<![CDATA["))) and UNCLOSED.fullmatch(m[0]):
            at = len(page)  # a comment, script or the like that never ends
        tag = m["start"]
        if tag:
            tag = tag.lower()
            if stack and stack[-1][0] == "head" and tag not in IN_HEAD and tag not in ("html", "head"):
                leave_head()
            if tag == "body":
                leave_head()
            if tag in INLINE:
                if tag in ("br", "img", "wbr"):
                    if tag == "br" and not hidden:
                        run.append(" ")
                    continue
                if tag == "a":
                    linked += 1
                    block.links += 1
                push(tag, None)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in ("html", "body"):
                if m["attrs"]:
                    root.words |= attribute_words(m["attrs"])
                continue
            # a block ends an open paragraph with all that is open in it, and an item of a list or table its like
            for depth in range(len(stack) - 1, -1, -1):
                open_tag, node = stack[depth]
                if open_tag == "p" or tag in CLOSES.get(open_tag, ()):
                    while len(stack) > depth:
                        pop()
                    break
                if node is not None and open_tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    break
            flush()
            if tag in HIDDEN:
                hidden += 1
                push(tag, Node(tag, NOTHING, block))
                block = stack[-1][1]
                # of these only foreign elements can close themselves
                if tag in ("svg", "math") and m["attrs"].endswith("/"):
                    pop()
                continue
            node = Node(tag, attribute_words(m["attrs"]), block)
            node.start = total
            block.down.append(node)
            push(tag, node)
            block = node
            if m["attrs"].endswith("/") and tag not in ("p", "div", "li", "td"):
                pop()
        elif m["end"]:
            tag = m["end"].lower()
            for depth in range(len(stack) - 1, -1, -1) if held[tag] else ():
                if stack[depth][0] == tag:
                    while len(stack) > depth:
                        pop()
                    break
                # an inline end tag doesn't reach beyond its block
                if tag in INLINE and stack[depth][1] is not None:
                    break
    tail = NEVER_ENDS.split(page[at:], maxsplit=1)[0]
    if tail.strip() and stack and stack[-1][0] == "head":
        leave_head()
    if tail and not hidden:
        run.append(tail)
    while stack:
        pop()
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """Nodes, each before what is below it, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.down))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES for each of ordered()'s nodes."""
    for node in reversed(nodes):
        node.tags += 1
        if node.up is not None:
            for k in ("chars", "linked", "tags", "leaves", "links"):
                setattr(node.up, k, getattr(node.up, k) + getattr(node, k))
    total = max(1, nodes[0].chars)
    out = np.zeros((len(nodes), len(FEATURES)))
    where = {id(n): i for i, n in enumerate(nodes)}
    places = {id(c): k for n in nodes for k, c in enumerate(n.down)}
    first_tag = FEATURES.index("is_p")
    first_in = FEATURES.index("in_nav")
    tag_at = {t: first_tag + i for i, t in enumerate(TAGS)}
    in_at = {g: first_in + i for i, g in enumerate(("nav", "footer", "header", "aside", "article", "main", "form"))}
    down_for, down_against = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        u, n = where[id(nodes[i].up)], nodes[i]
        if n.chars * 2 >= nodes[u].chars and n.tag != "text":
            down_for[u] = max(down_for[u], down_for[i], float(bool(n.words & FOR) or n.tag in ("article", "main")))
            down_against[u] = max(down_against[u], down_against[i], float(bool(n.words & AGAINST)))
    for i, n in enumerate(nodes):
        row = out[i]
        u = where[id(n.up)] if n.up is not None else None
        own = n if n.tag != "text" or n.up is None else n.up
        siblings = n.up.down if n.up is not None else [n]
        text = n.text
        spaces = text.count(" ") + 1 if text else 0
        row[:20] = (
            np.log1p(n.chars), np.log1p(spaces), n.chars / spaces if spaces else 0, sum(map(text.count, ".,;:!?")) / spaces if spaces else 0, n.linked / n.chars if n.chars else 0,
            n.chars / n.tags, n.chars / total, n.depth, places.get(id(n), 0) / len(siblings), min(len(siblings), 50),
            n.chars / max(1, n.up.chars) if n.up is not None else 1, min(n.leaves, 50), min(n.links, 50),
            float(bool(own.words & FOR)), float(bool(own.words & AGAINST)),
            0, 0, down_for[i], down_against[i], n.start / total,
        )
        if u is not None:
            up = nodes[u]
            row[15] = max(out[u, 15], float(bool(up.words & FOR) and up.depth > 0))
            row[16] = max(out[u, 16], float(bool(up.words & AGAINST) and up.depth > 0))
            row[first_in:] = out[u, first_in:]
        tag = "h" if re.fullmatch("h[1-6]", n.tag) else n.tag
        if tag in tag_at:
            row[tag_at[tag]] = 1
        if n.tag in GROUPS:
            row[in_at[GROUPS[n.tag]]] = 1
    return out


def decoded(nodes: list[Node], margin: np.ndarray) -> list[str]:
    """Texts of kept leaves under the most likely labelling in which a node is kept exactly if something below it is."""
    where = {id(n): i for i, n in enumerate(nodes)}
    keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)  # log probabilities
    best_keep, none = np.full(len(nodes), -np.inf), drop.copy()  # subtree with something kept; with nothing kept
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.tag == "text":
            best_keep[i] = keep[i]
            continue
        if n.down:
            at = [where[id(c)] for c in n.down]
            none[i] = drop[i] + none[at].sum()
            gain = np.maximum(best_keep[at], none[at]).sum()
            if not (best_keep[at] > none[at]).any():  # something must be kept: what costs least
                gain += (best_keep[at] - none[at]).max()
            best_keep[i] = keep[i] + gain
    kept = np.zeros(len(nodes), dtype=bool)
    kept[0] = best_keep[0] > none[0]
    for i, n in enumerate(nodes):
        if kept[i] and n.down:
            at = np.array([where[id(c)] for c in n.down])
            chosen = best_keep[at] > none[at]
            if not chosen.any():
                chosen[int((best_keep[at] - none[at]).argmax())] = True
            kept[at] = chosen
    return [n.text for i, n in enumerate(nodes) if kept[i] and n.tag == "text"]


def seed_pages(n: int = 500, seed: int = 7) -> Iterator[tuple[str, set[str]]]:
    """Seeded pages of many layouts, each with the set of its main blocks."""
    rng = random.Random(seed)
    syllables = "an ar be ca der el fi gu ho in jo ka lo mi ne on pe qua ri so tu ur ve wi za é ü ó ß".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 2, 3, 4))))

    def words(a: int, b: int) -> str:
        out = [word() for _ in range(rng.randint(a, b))]
        for i in range(len(out)):
            if rng.random() < 0.12:
                out[i] += rng.choice((".", ",", ".", ";"))
        return " ".join(out)

    def link(a: int = 1, b: int = 3) -> str:
        return f'<a href="/{word()}">{words(a, b)}</a>'

    def links(k: int) -> str:
        items = [link() for _ in range(k)]
        return rng.choice((lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{x}</div>" for x in items)))()

    def wrap(tags: str, names: str, inner: str) -> str:
        tag = rng.choice(tags.split())
        name = rng.choice(names.split()) if tag in ("div", "section", "ul", "p") or rng.random() < 0.4 else ""
        attr = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def box(kind: str) -> str:
        if kind == "nav":
            return wrap("nav nav div", "nav menu navbar main-nav navigation top-menu breadcrumbs", links(rng.randint(3, 9)))
        if kind == "header":
            return wrap("header header div", "header masthead top site-header", rng.choice((f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 8)}</p>", "")) + links(rng.randint(1, 5)))
        if kind == "ad":
            return wrap("div div aside section", "ad ads advert banner sponsored promo ad-slot", rng.choice((words(3, 40), f"<p>{words(5, 40)}</p>", f"{words(2, 8)} {link()}")))
        if kind == "aside":
            return wrap("aside aside div", "sidebar related widget recommended aside", f"<h3>{words(1, 3)}</h3>" + rng.choice((links(5), f"<p>{words(5, 50)}</p>", links(2) + f"<p>{words(8, 60)}</p>")))
        if kind == "notice":
            return wrap("div div section p", "cookie-notice cookie consent notice gdpr-banner popup alert-notice", f"{rng.choice(('', '<p>'))}{words(6, 50)} <button>{word()}</button>")
        if kind == "form":
            return "<form>" + rng.choice((f"<label>{words(1, 4)}</label><input name=q>", f"<p>{words(3, 20)}</p><input type=email><button>{word()}</button>", f"<fieldset><legend>{words(1, 3)}</legend>{words(2, 9)}</fieldset>")) + "</form>"
        if kind == "comments":
            each = lambda: wrap("div li article section", "comment reply comment-body", f"<p>{words(4, 70)}</p>" + rng.choice(("", f"<span>{words(1, 3)}</span>")))
            return wrap("section div div", "comments comment-list disqus replies", f"<h3>{words(1, 3)}</h3>" + "".join(each() for _ in range(rng.randint(1, 5))))
        if kind == "share":
            return wrap("div ul div", "share social tags sharing", " ".join(link(1, 1) for _ in range(rng.randint(2, 5))))
        return wrap("footer footer div", "footer site-footer copyright contentinfo", rng.choice(("&copy; ", "")) + rng.choice((words(4, 40), links(4) + f"<p>{words(3, 30)}</p>", f"{word()}.example &middot; {words(3, 30)}\n{words(1, 12)}")))

    for _ in range(n):
        main: set[str] = set()

        def own(a: int, b: int) -> str:
            text = words(a, b)
            main.add(" ".join(text.split()))
            return text

        body = []
        if rng.random() < 0.8:
            body.append(f"<h{rng.choice('1112')}>{own(2, 14)}</h1>" if rng.random() < 0.1 else f"<h1>{own(2, 14)}</h1>")
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12, 25))):
            kind = rng.random()
            size = rng.choice(((1, 3), (5, 40), (20, 120), (60, 300)))
            if kind < 0.6:
                body.append(f"<p>{own(*size)}</p>")
            elif kind < 0.68:
                body.append(f"<p><b>{own(*size)}<br>")  # never closed
            elif kind < 0.74:
                body.append("<ul>" + "".join(f"<li>{own(2, 25)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.8:
                body.append(f"<h{rng.choice('23')}>{own(1, 7)}</h3>" if rng.random() < 0.2 else f"<h2>{own(1, 7)}</h2>")
            elif kind < 0.84:
                body.append(f"<blockquote>{own(4, 50)}</blockquote>")
            elif kind < 0.88:
                body.append("<table>" + "".join(f"<tr><td>{own(1, 6)}</td><td>{own(1, 6)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.92:
                body.append(f"<div>{own(*size)}</div>")
            else:
                body.append(box(rng.choice(("ad", "share", "aside", "form", "ad"))))
        if not main or rng.random() < 0.3:
            body.append(f"<p>{own(1, 200)}</p>")
        if rng.random() < 0.15:
            body.append(box("comments"))
        inner = "".join(body)
        article = rng.choice((
            lambda: f"<article>{inner}</article>", lambda: f"<article>{inner}</article>", lambda: f"<main><article>{inner}</article></main>", lambda: f"<main>{inner}</main>",
            lambda: wrap("div div section", "content article post entry-content main-content story article-body post-body text", inner), lambda: f'<div id="wrap"><div class="col">{inner}</div></div>',
        ))()
        before = [box(k) for k in rng.sample(("header", "nav", "ad", "notice", "aside", "form"), rng.randint(0, 4))]
        after = [box(k) for k in rng.sample(("aside", "comments", "ad", "share", "form", "nav", "notice"), rng.randint(0, 3))] + [box("footer")] * (rng.random() < 0.85)
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        yield head + "".join(before) + article + "".join(after) + rng.choice(("</body></html>", "</body></html>", "")), main


@lru_cache(maxsize=1)
def default_model() -> boosting.Boosted:
    rows, labels = [], []
    for page, main in seed_pages():
        nodes = ordered(parse(page))
        where = {id(n): i for i, n in enumerate(nodes)}
        rows.append(features(nodes))
        y = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].tag == "text" and nodes[i].text in main:
                y[i] = 1
            if y[i] and nodes[i].up is not None:
                y[where[id(nodes[i].up)]] = 1
        labels.append(y)
    x, y = np.concatenate(rows), np.concatenate(labels)
    return boosting.fit(x[: boosting.MAX_ROWS], y[: boosting.MAX_ROWS], rounds=60, depth=5, rate=0.2)


def extract(pages: list[str | None], model: boosting.Boosted) -> list[str]:
    """Main text of each page; its blocks joined by line feeds."""
    trees = [ordered(parse(p)) if p else None for p in pages]
    found = [features(t) for t in trees if t is not None]
    if not found:
        return [""] * len(pages)
    margins = iter(np.split(model.margin(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1]))
    return ["\n".join(decoded(t, next(margins))) if t is not None else "" for t in trees]


def main_text(pages: DataFrame, *, model: boosting.Boosted | None = None, together: int = 64) -> DataFrame:
    """pages with text (empty if there is none, or html is null or empty) and n_chars, its code points.

    The whole html counts. Equal pages have equal texts; white space inside a block is one space, blocks are joined by one line feed
    in page order. Columns of the input named text or n_chars are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            rows = [h if isinstance(h, str) else None for h in s]
            yield pd.Series([t for i in range(0, len(rows), together) for t in extract(rows[i : i + together], shared.value)], dtype=object)

    out = pages.drop("text", "n_chars").withColumn("text", run(F.col("html").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
