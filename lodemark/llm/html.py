"""Main text of web pages by tag-path ratios.

A page is read as a stream of tags and texts. Every text node has a tag path (element names from the
root). For each path of a page the text length per node and the punctuation per node are summed up,
spread over the node sequence, smoothed with a Gaussian kernel, multiplied (fused) and cut at a share
of their standard deviation: the paths above it hold the prose. The deepest element that holds most of
the scores of these paths' nodes, and nearly all of each path that it has, is the article; an article or
main element around it is taken with it. All its text is returned, short lines and headings too.

What markup says (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers, by element,
class, id and role) only decides on parts with a small share of the scores: an element named "has-sidebar"
that holds the article is a wrapper and stays. Only scripts, styles, controls and embedded objects never count.

Paths are numbers and sums run once over the elements, so deep nesting costs no more than its length.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|=)*)(>|$)|[^<]+|<", re.S)
ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {n: re.compile(rf"</{n}(?=[\t\n\f\r />])", re.I | re.A) for n in RAW}
#: What moves a script in and out of the escaped states, in which an inner script's end tag is not its own.
SCRIPT = re.compile(r"<!--(-?>)?|-->|<(/?)script(?=[\t\n\f\r />])", re.I | re.A)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text of a page.
DROP = frozenset("head script style noscript template button select option textarea title iframe object svg math canvas audio video xmp noembed noframes".split())
#: Elements that are something other than the article at any share of the scores.
ASIDE = frozenset("nav footer aside menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: Names in class, id and role that mark something other than the article. Fixed list.
OTHER = frozenset(
    "ad ads adv advert advertisement advertisements advertising adsense adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "sidebar side-bar aside rail widget widgets footer site-footer page-footer colophon site-header page-header masthead topbar header complementary contentinfo search searchbox toolbar "
    "cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments comment-list commentlist replies respond disqus discussion share sharing social related recommended recommendations trending popular hidden skip-link form".split()
)
EDGE = re.compile(r"(?:^|[-_])(ad|ads|advert|advertisement|sponsored|promo|nav|navbar|menu|breadcrumbs?|sidebar|footer|cookies?|consent|newsletter|comments?|share|social|related|banner|popup|modal|notice)(?:$|[-_])")
#: Of these the parts that readers write, which may be longer than the article.
READERS = re.compile(r"(?:^|[-_])(comments?|commentlist|replies|respond|disqus|discussion)(?:$|[-_])")
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
PUNCT = frozenset(".,;:!?…。，、；：！？")


class Element:
    """``number`` counts the elements of a page, ``path`` its tag paths; ``body`` is whether an article or main is around it.

    ``named``: the share of the scores from which on an element is not what its markup says, a menu, say; 0 if it says nothing.
    """

    __slots__ = ("body", "drop", "name", "named", "number", "path", "up")

    def __init__(self, name: str, up: Element | None, drop: bool, named: float, path: int, number: int):
        self.name, self.up, self.drop, self.named, self.path, self.number = name, up, drop, named, path, number
        self.body = up is not None and (up.body or up.name in ("article", "main"))


#: Shares of the scores above which an element counts as a wrapper of the article, whatever its markup says.
WRAPS, WRAPS_SURELY, NEVER = 0.6, 0.9, 2.0


def _named(name: str, attrs: str, up: Element) -> float:
    """Whether the markup says that an element is not article text: the share of the scores that speaks against it, or 0."""
    if name in ASIDE:
        return NEVER
    out = 0.0
    if name in ("form", "fieldset"):
        out = WRAPS
    if name == "header" and not (up.body or up.name in ("article", "main")):  # that of an article holds its title
        out = WRAPS
    if name in ("html", "body", "main", "article") or not attrs.strip():
        return out
    for m in ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out = max(out, WRAPS)
        if key == "role" and value in ROLES:
            out = max(out, WRAPS)
        if key in ("class", "id"):
            for t in value.split():
                if READERS.search(t):
                    return WRAPS_SURELY
                if t in OTHER or EDGE.search(t):
                    out = max(out, WRAPS)
    return out


def _raw_end(page: str, start: int, name: str) -> int:
    """Where the end tag of a raw element stands whose content begins at ``start``; the page's end if there is none."""
    if name != "script":
        m = RAW_END[name].search(page, start)
        return m.start() if m else len(page)
    escaped = inner = False
    for m in SCRIPT.finditer(page, start):
        if m[0].startswith("<!--"):
            escaped, inner = m[1] is None, inner and m[1] is None
        elif m[0] == "-->":
            escaped = inner = False
        elif m[2]:
            if not inner:
                return m.start()
            inner = False
        else:
            inner = escaped
    return len(page)


def text_nodes(page: str) -> tuple[list[tuple[Element, int, str]], list[Element]]:
    """(element, block number, text) of each text node outside dropped elements, in page order, and all elements."""
    root = Element("", None, False, 0.0, 0, 0)
    stack, block, out, elements = [root], 0, [], [root]
    paths: dict[tuple[int, str], int] = {}
    is_open: dict[str, int] = defaultdict(int)  # how many of a name are on the stack

    def shut_from(i: int) -> None:
        for e in stack[i:]:
            is_open[e.name] -= 1
        del stack[i:]

    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        name = m[2]
        if name is None:
            text = m[0]
            if text.startswith("<![CDATA["):
                text = text[9:].removesuffix("]]>")
            elif text.startswith("<") and text != "<":
                continue
            if not stack[-1].drop:
                out.append((stack[-1], block, text))
            continue
        name = name.lower()
        if m[4] != ">":  # cut off inside a tag
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                if stack[i].name == name:
                    shut_from(i)
                    break
                if name in INLINE and stack[i].name not in INLINE:  # an inline end does not close blocks
                    break
            continue
        if name == "br" and not stack[-1].drop:
            out.append((stack[-1], block, " "))
        if name in VOID:
            continue
        if name in CLOSES_P and is_open["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    shut_from(i)
                    break
                if stack[i].name not in INLINE:
                    break
        if name in IMPLIED:
            shut, stop = IMPLIED[name]
            for i in range(len(stack) - 1, 0, -1) if any(is_open[x] for x in shut) else ():
                if stack[i].name in stop:
                    break
                if stack[i].name in shut:
                    shut_from(i)
                    break
        up = stack[-1]
        path = paths.setdefault((up.path, name), len(paths) + 1)
        stack.append(Element(name, up, up.drop or name in DROP, _named(name, m[3], up), path, len(elements)))
        elements.append(stack[-1])
        is_open[name] += 1
        if m[3].endswith("/") and name in ("svg", "path", "use"):
            shut_from(len(stack) - 1)
        elif name in RAW:  # inside script and the like only its end counts
            tokens = TOKEN.finditer(page, _raw_end(page, m.end(), name))
    return out, elements


def _smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-2, 3) / sigma) ** 2)
    return np.convolve(np.pad(x, 2), k, mode="valid") / np.convolve(np.pad(np.ones(len(x)), 2), k, mode="valid")


def path_scores(nodes: list[tuple[int, str]]) -> np.ndarray:
    """Fused and smoothed tag-path ratios, one for each node."""
    length, punct, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in nodes:
        length[path] += len(text)
        punct[path] += sum(c in PUNCT for c in text)
        count[path] += 1
    by_length = np.array([length[p] / count[p] for p, _ in nodes], float)
    by_punct = np.array([(1 + punct[p]) / count[p] for p, _ in nodes], float)
    return _smooth(by_length) * _smooth(by_punct)


HOLDS, LEAVES = 0.5, 0.05  # shares of the chosen paths' scores: more than the first is in the article, at most the second of its paths outside


def main_text(page: str | None, share: float = 0.8) -> str:
    """The article of a page; empty if there is none."""
    if not page:
        return ""
    found, elements = text_nodes(page)
    nodes = [(e, b, _html.unescape(t)) for e, b, t in found]
    outer: list[Element] = []  # for each element the block around it, whose path stands for its inline parts
    for e in elements:
        outer.append(outer[e.up.number] if e.name in INLINE and e.up is not None else e)
    blocks = [(outer[e.number], t) for e, _, t in nodes if t.strip()]
    if not blocks:
        return ""
    scores = path_scores([(e.path, t) for e, t in blocks])
    cut = share * scores.std()
    best: dict[int, float] = defaultdict(float)
    for (e, _), s in zip(blocks, scores.tolist(), strict=True):
        best[e.path] = max(best[e.path], s)
    mass = [0.0] * len(elements)
    for (e, _), s in zip(blocks, scores.tolist(), strict=True):
        if best[e.path] >= cut:
            mass[e.number] += s
    out = _outside(elements, mass)
    top = _article(elements, [0.0 if o else m for o, m in zip(out, mass, strict=True)])
    inside = [False] * len(elements)
    for e in elements:
        inside[e.number] = (e is top or e.up is not None and inside[e.up.number]) and not out[e.number]
    parts: dict[int, list[str]] = defaultdict(list)
    for e, b, t in nodes:
        if inside[e.number]:
            parts[b].append(t)
    lines = (" ".join("".join(p).split()) for p in parts.values())
    return "\n".join(x for x in lines if x)


def _sums(elements: list[Element], mass: list[float]) -> list[float]:
    """Mass of each element with all below it."""
    mass = list(mass)
    for e in reversed(elements[1:]):
        mass[e.up.number] += mass[e.number]
    return mass


def _outside(elements: list[Element], mass: list[float]) -> list[bool]:
    """For each element whether it, or one around it, is what its markup says: something other than the article.

    The surest names go first, so that what is left shows which elements hold the article.
    """
    out = [False] * len(elements)
    for level in (NEVER, WRAPS_SURELY, WRAPS):
        held = _sums(elements, [0.0 if o else m for o, m in zip(out, mass, strict=True)])
        for e in elements[1:]:
            out[e.number] = out[e.number] or out[e.up.number] or e.named >= level and held[e.number] < e.named * held[0]
    return out


def _article(elements: list[Element], mass: list[float]) -> Element:
    """The deepest element with most of the mass (summed up from the leaves) that leaves out next to nothing of the paths
    in it: an advert beside the article has a path of its own, a second half of the article has that of the first. Of
    text-level elements the one around them; if an article or main is around it, or inside it holds most of the mass, that one."""
    held = _sums(elements, mass)
    # those with more than half of the mass are one chain, outer ones first; each element lies at some depth of it
    depth, chain = [0] * len(elements), [elements[0]]
    for e in elements[1:]:
        depth[e.number] = depth[e.up.number]
        if held[e.number] > HOLDS * held[0]:
            depth[e.number] = len(chain)
            chain.append(e)
    deepest: dict[int, int] = defaultdict(int)
    for e in elements:
        if mass[e.number]:
            deepest[e.path] = max(deepest[e.path], depth[e.number])
    left = [0.0] * (len(chain) + 1)  # mass outside a chain's element whose path is also inside it
    for e in elements:
        if mass[e.number]:
            left[depth[e.number] + 1] += mass[e.number]
            left[deepest[e.path] + 1] -= mass[e.number]
    left = np.cumsum(left)
    top = max((k for k in range(len(chain)) if left[k] <= LEAVES * held[0]), default=0)
    top = chain[top]
    around = top
    while around is not None:
        if around.name in ("article", "main"):
            return around
        around = around.up
    inner = [e for e in elements if e.name in ("article", "main") and held[e.number] > 0.5 * held[0]]
    if inner:
        return inner[-1]
    while top.name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td") and top.up is not None:
        top = top.up
    return top


def _runner(share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, 500):
                part = batch.slice(p, 500)
                texts = [main_text(h.as_py(), share) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, share: float = 0.8) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    A null or empty html, or one without text, has the empty text. Null ids and urls pass through;
    repeated rows give repeated results. Broken markup is read as browsers do in the common cases:
    open elements end with the page, a cut-off tag is dropped. What never counts as text is in ``DROP``, what
    does not unless most of the scores are in it in ``ASIDE``, ``OTHER``, ``EDGE`` and ``ROLES``. Other columns are ignored.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_runner(share), "page_id long, url string, text string, n_chars long")
