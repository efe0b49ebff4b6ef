"""HTML extraction by minimum-cut labelling.

A page becomes a sequence of blocks of text. Costs of calling a block content or boilerplate are its
terminal capacities: a logistic regression on the shape of the text, its place in the page and in the
tree, and on what its elements and their names say, fitted on blocks of pages whose elements leave no
doubt, half of them without what the elements say, so that text and place have weights of their own.
Neighbours in the page and siblings in the DOM are joined by smoothness edges, and a minimum cut
separates content from boilerplate.
"""

from __future__ import annotations

import html as _html
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.columns import free

# a quote opens a value only after an equals sign, as in HTML
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|aria-label|hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARTS = re.compile(r"[^a-z]+")
_WORDS = re.compile(r"\S+")

# fixed values: HTML element names by role
RAW = frozenset("script style noscript template textarea iframe object svg canvas audio video select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head"}
BAD_TAGS = frozenset("nav footer aside form header menu button dialog head fieldset option".split())
GOOD_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead sidebar side aside widget widgets ad ads advert adverts advertisement advertising banner promo "
    "promoted promotion sponsor sponsored cookie cookies consent notice alert gdpr popup modal overlay comment comments commentlist discussion disqus reply replies respond "
    "share sharing social related recommended recommendations login signin signup subscribe newsletter search form copyright legal pagination pager toolbar".split()
)
GOOD_NAMES = frozenset("article content post entry story maincontent articlebody posttext".split())
#: Parts of names that say where or what shape something is.
NEUTRAL = frozenset("site page post posts entry article list area box block section wrap wrapper container left right top bottom inner outer item items link links bar primary secondary global text message panel group row".split())
#: Names and elements that an article within doesn't lift: comments, teasers and advertisements are often articles, too.
FIRM = BAD_TAGS - {"form", "header"} | frozenset(
    "navbar navigation ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored cookie cookies consent popup modal comment comments commentlist "
    "discussion disqus reply replies respond related recommended recommendations".split()
)
#: Elements whose names say what they hold; those of headings are often made from their text.
HOLDERS = BLOCK - frozenset("html body head main article h1 h2 h3 h4 h5 h6 p td th tr tbody thead pre blockquote figure figcaption caption dt dd hr".split())


class Element:
    __slots__ = ("tag", "parent", "bad", "firm", "good", "hidden", "size", "has_main", "state")

    def __init__(self, tag, parent, bad=False, firm=False, good=False, hidden=False):
        self.tag, self.parent, self.bad, self.firm, self.good, self.hidden = tag, parent, bad, firm, good, hidden
        self.size, self.has_main, self.state = 0.0, False, (0, 0, False, False)


class Block:
    """Text with the share of it in links, its tag, parent and depth, and what its elements say: `said` 1 for content, -1 for boilerplate, else 0; `hidden` is never content."""

    __slots__ = ("text", "linked", "tag", "parent", "depth", "element", "said", "hidden", "place")

    def __init__(self, text, linked, tag, parent, depth, element):
        self.text, self.linked, self.tag, self.parent, self.depth, self.element = text, linked, tag, parent, depth, element
        self.said, self.hidden, self.place = 0, False, 0.0


def _bad_name(name: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and firmly: all its parts do, but for those that say nothing; has-sidebar and no-comments don't."""
    whole = _PARTS.sub("", name.lower())
    parts = {whole} if whole in BAD_NAMES else {x for x in _PARTS.split(_HUMP.sub("-", name).lower()) if x and x not in NEUTRAL}
    return bool(parts) and parts <= BAD_NAMES, bool(parts & FIRM) and parts <= BAD_NAMES


def _element(tag: str, attrs: str, parent: int, in_good: bool) -> Element:
    e = Element(tag, parent)
    for key, value in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            e.hidden = True
        elif key != "style" and tag not in ("html", "body", "main", "article"):
            for name in [value] if key == "aria-label" else value.split():
                bad, firm = _bad_name(name)
                # an id within an article is a place to link to; a paragraph's class counts where it is firm
                if bad and (tag in HOLDERS and (key != "id" or firm or not in_good) or tag in ("p", "blockquote", "figure") and firm and key == "class"):
                    e.bad, e.firm = True, e.firm or firm
                elif tag in HOLDERS and _PARTS.sub("", name.lower()) in GOOD_NAMES:
                    e.good = True
    if tag in BAD_TAGS and not (tag == "header" and in_good):
        e.bad, e.firm = True, e.firm or tag in FIRM
    return e


def blocks(source: str) -> list[Block]:
    """The page's blocks of text in order. Unclosed and crossed tags are closed as browsers do; scripts, styles, comments and hidden elements have no text."""
    out: list[Block] = []
    elements = [Element("", -1)]
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked, in_link, at, in_article = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            tag, number = stack[-1]
            up = stack[-2][1] if len(stack) > 1 and tag in ("p", "li", "h1", "h2", "h3", "h4", "td", "th", "dd", "dt") else number
            out.append(Block(text, min(1.0, linked / len(text)), tag, up, len(stack), number))
        parts.clear()
        linked = 0

    def text(chunk):
        nonlocal linked
        if chunk:
            parts.append(chunk)
            if in_link:
                linked += len(chunk.strip())

    def leave(k):
        nonlocal in_article
        in_article -= sum(t in GOOD_TAGS for t, _ in stack[k:])
        del stack[k:]

    while True:
        m = _TAG.search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        closing, name, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if name in RAW and not closing and not attrs.endswith("/"):
            raw_until = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = raw_until.end() if raw_until else len(source)
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        flush()
                        leave(k)
                        in_link = 0
                        break
                else:
                    flush()
            elif len(stack) > 1 and stack[-1][0] == name:
                flush()
                leave(len(stack) - 1)
            continue
        element = _element(name, attrs, 0, in_article > 0)
        if name not in BLOCK and not element.hidden or name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        if name in CLOSES_P and stack[-1][0] == "p":
            leave(len(stack) - 1)
        if name in ("li", "dt", "dd", "td", "th", "tr", "option"):
            same = ("li",) if name == "li" else ("dt", "dd") if name in ("dt", "dd") else ("option",) if name == "option" else ("td", "th") if name != "tr" else ("td", "th", "tr")
            while stack[-1][0] in same:
                leave(len(stack) - 1)
        element.parent = stack[-1][1]
        elements.append(element)
        stack.append((name, len(elements) - 1))
        in_article += name in GOOD_TAGS
    flush()
    _say(out, elements)
    return out


def _say(found: list[Block], elements: list[Element]) -> None:
    """What the elements say of each block: the innermost of them that says anything, but for wrappers of the page."""
    for b in found:
        elements[b.element].size += len(b.text) * (1 - b.linked)
    for e in reversed(elements[1:]):
        up = elements[e.parent]
        up.size += e.size
        up.has_main |= e.has_main or e.tag in ("article", "main", "h1")
    total = elements[0].size
    for e in elements[1:]:
        said, held, firm, hidden = elements[e.parent].state
        # what holds the article or most of the page's text is no sidebar, whatever its name
        wrapper = not e.firm and (e.has_main or 2 * e.size > total)
        if e.hidden:
            hidden = True
        elif e.bad and not wrapper:
            said, firm = -1, firm or e.firm
        elif (e.tag in GOOD_TAGS or e.good and said == 0) and not firm:
            said = 1
        e.state = said, held, firm, hidden
    for k, b in enumerate(found):
        b.said, _, _, b.hidden = elements[b.element].state
        b.place = k / len(found)


#: What the costs are made of, and the weight of each before any page is seen.
PRIOR = {
    "any": -0.5, "log words": 0.3, "in links": -3.0, "words that end a clause": 1.0, "ends a sentence": 0.7, "heading": 1.0, "paragraph": 1.0, "list item": -0.5,
    "copyright or bars": -1.0, "log depth": 0.0, "near an end of the page": 0.0, "elements say boilerplate": -6.0, "elements say content": 3.0,
}
_SAID = 2  # the last features, which half of the fitted rows don't have


def shape(b: Block) -> list[float]:
    """Features of a block's text, of its place, and of what its elements say."""
    words = _WORDS.findall(b.text)
    n = len(words)
    ends = sum(w[-1] in ".!?:;," for w in words)
    return [
        1.0, math.log1p(n), b.linked, min(1.0, 5 * ends / n), float(b.text[-1] in ".!?:"), float(b.tag in ("h1", "h2", "h3", "h4")), float(b.tag in ("p", "pre", "blockquote")), float(b.tag == "li"), float("©" in b.text or "|" in b.text),
        math.log1p(b.depth), abs(2 * b.place - 1), float(b.said < 0), float(b.said > 0),
    ]


def fit_shape(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR by a ridge, each class weighing the same; PRIOR where a class is missing.

    Every row comes twice, once without what its elements say, as that is what made its label.
    """
    prior = np.array(list(PRIOR.values()))
    if len(y) == 0 or y.min() == y.max():
        return prior
    bare = x.copy()
    bare[:, -_SAID:] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    w, weight = prior.copy(), np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean()) * min(1.0, 400 / len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 2 * (w - prior)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 2 * np.eye(len(w)), grad)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return w


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores of the other label plus the weights of cut edges; ties go to content.

    A node whose score outweighs its edges keeps its own label, which settles most; maximum flow
    (Dinic's algorithm) settles the rest.
    """
    n = len(score)
    score, near = list(score), [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    pull = [sum(w for _, w in x) for x in near]
    queue = [i for i in range(n) if abs(score[i]) >= pull[i]]
    while queue:
        i = queue.pop()
        if label[i] is not None:
            continue
        label[i] = score[i] >= 0
        for j, w in near[i]:
            if label[j] is None:
                score[j] += w if label[i] else -w
                pull[j] -= w
                if abs(score[j]) >= pull[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        source, sink = len(rest), len(rest) + 1
        to, cap, out = [], [], [[] for _ in range(len(rest) + 2)]

        def link(a, b, forth, back):
            out[a].append(len(to))
            to.append(b)
            cap.append(forth)
            out[b].append(len(to))
            to.append(a)
            cap.append(back)

        for i in rest:
            link(source, place[i], max(0.0, score[i]), 0.0)
            link(place[i], sink, max(0.0, -score[i]), 0.0)
            for j, w in near[i]:
                if j > i and label[j] is None:
                    link(place[i], place[j], w, w)
        reached = _max_flow(source, sink, to, cap, out)
        for i in rest:
            label[i] = not reached[place[i]]
    return [bool(x) for x in label]


def _max_flow(source, sink, to, cap, out) -> list[bool]:
    """Saturate the graph; True for nodes that can still reach the sink, which are boilerplate."""
    while True:
        level = [-1] * len(out)
        level[source], line = 0, [source]
        for v in line:
            for e in out[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    line.append(to[e])
        if level[sink] < 0:
            break
        turn, path, v = [0] * len(out), [], source
        while True:
            if v == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[v] < len(out[v]):
                e = out[v][turn[v]]
                if cap[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    break
                turn[v] += 1
            if turn[v] < len(out[v]):
                path.append(out[v][turn[v]])
                v = to[path[-1]]
            elif path:
                level[v] = -1
                v = to[path.pop() ^ 1]
            else:
                break
    reach, line = [False] * len(out), [sink]
    reach[sink] = True
    for v in line:
        for e in out[v]:
            if cap[e ^ 1] > 1e-12 and not reach[to[e]]:
                reach[to[e]] = True
                line.append(to[e])
    return reach


def costs(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Each block's score, positive for content, and the smoothness edges between neighbours in the page and siblings in the tree."""
    score = np.clip(np.array([shape(b) for b in found]) @ weights, -4, 4)
    score = [-24.0 if b.hidden else float(v) for b, v in zip(found, score, strict=True)]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, 1.2 if found[i - 1].parent == b.parent else 0.3))
        if last.get(b.parent, i - 1) != i - 1:
            edges.append((last[b.parent], i, 0.9))
        last[b.parent] = i
    return score, edges


def main_blocks(source: str | None, weights: np.ndarray) -> list[str]:
    """The texts of the page's content blocks, in order."""
    found = blocks(source or "")
    if not found:
        return []
    keep = min_cut(*costs(found, weights))
    return [b.text for b, k in zip(found, keep, strict=True) if k]


def cut_changes(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """(blocks, changed): how many blocks there are, and how many the cut labels otherwise than their own cost would."""

    def count(batches):
        for pdf in batches:
            n = changed = 0
            for source in pdf["html"]:
                found = blocks(source if isinstance(source, str) else "")
                if found:
                    score, edges = costs(found, weights)
                    n, changed = n + len(found), changed + sum(k != (v >= 0) for k, v in zip(min_cut(score, edges), score, strict=True))
            yield pd.DataFrame({"blocks": [n], "changed": [changed]})

    return pages.select(F.col(html_col).alias("html")).mapInPandas(count, "blocks long, changed long").agg(F.sum("blocks").alias("blocks"), F.sum("changed").alias("changed"))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 400, most: int = 50) -> np.ndarray:
    """Weights of the shape model, from the blocks of at most `sample` pages (taken by a hash of the id), `most` a page, whose elements leave no doubt. What comes to the driver is bounded by sample * most rows of 14 floats."""
    span = 1 << 40
    n = pages.count()
    share = int(min(1.0, 2 * sample / max(n, 1)) * span)
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(span))
    rows = pages.where(h < share).orderBy(h, F.col(id_col)).limit(sample).select(F.col(html_col).alias("html"))

    def shapes(batches):
        for pdf in batches:
            x = [np.array([float(b.said > 0), *shape(b)]).tobytes() for s in pdf["html"] for b in blocks(s if isinstance(s, str) else "")[:most] if b.said and not b.hidden]
            yield pd.DataFrame({"x": pd.Series(x, dtype=object)})

    got = sorted(bytes(r["x"]) for r in rows.mapInPandas(shapes, "x binary").collect())
    x = np.array([np.frombuffer(b) for b in got]).reshape(-1, len(PRIOR) + 1)
    return fit_shape(x[:, 1:], x[:, 0])


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """Every row of `pages` with text and n_chars appended (columns of those names are replaced, html_col kept).

    Null or empty html, and pages without content, give an empty text. Blocks are joined by two line
    feeds; white space within a block, decoded no-break spaces included, is one space. Repeated rows
    get equal texts; an empty table gives an empty result.
    """

    @F.pandas_udf(T.StringType())
    def content(source: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(main_blocks(s if isinstance(s, str) else "", weights)) for s in source], dtype=object)

    (got,) = free(pages, "content")
    own = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.withColumn(got, content(F.col(html_col))).select(*own, F.col(got).alias("text"), F.char_length(F.col(got)).cast("long").alias("n_chars"))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages)).select("page_id", "url", "text", "n_chars")
