"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each with its path of elements from the root. Text length and punctuation are
averaged over the blocks of a path, so short paragraphs share the ratios of the long ones beside them. Both ratios are
smoothed along the page, fused, and added up with weights for where a path lies (in the element that holds the content),
for the links in it and for elements whose tag or class speaks against it. Paths near enough to the page's best one are
content. No class word decides alone: where nothing but poor text is without one, classes do not count, but for those of
comments and cookie notices. Links below a heading that names sources do not count either. A header that stands beside the
content, with a heading and no menu, is the article's own. Each table cell is a block, whether or not its end is written.
Drawings have no text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import small_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = frozenset("script style noscript template iframe textarea title svg object annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form button select option dialog menu label fieldset".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mtable mtr mtd".split())
#: Tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark an element as no article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer form gdpr header hidden login menu modal nav navbar navigation newsletter notice notification popup promo "
    "promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription widget".split()
)
#: Words that stand beside those and say nothing of the content.
NEUTRAL = frozenset("area bar block box container item items list panel reader readers section thread user users wrap wrapper".split())
#: Words of which one makes a class that has only words of the two sets above no article, whatever else the page holds.
NEVER = frozenset("comments consent cookie cookies disqus gdpr".split())
#: Headings of lists of sources.
SOURCES = frozenset(
    "bibliography;citations;external links;footnotes;further reading;literature;notes;references;sources;works cited;"
    "anmerkungen;belege;einzelnachweise;literatur;quellen;weblinks;bibliographie;liens externes;notes et références;références;sources et références;"
    "bibliografía;enlaces externos;fuentes;notas;referencias".split(";")
)
#: Elements whose running text a label belongs to, and those of a table that end each other.
TEXTUAL = frozenset("p li td th dd dt blockquote h1 h2 h3 h4 h5 h6".split())
CELLS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")


#: Marks of an element: a class that has a word of NOT_ARTICLE among others; one that consists of such words; a
#: tag that is no article; and hidden. Their weights, with those for a place in the content, for links, and the threshold.
WEAK, STRONG, TAG, HIDDEN = 1, 2, 3, 4
WEIGHTS = (0.0, -0.4, -4.0, -4.0)
INSIDE, LINKED, REACH = 2.0, -4.0, 1.9
#: Where text without marks has less than this part of the best ratio of marked text, and is in no article, classes do not count.
POOR = 0.3
#: First parts of a class or id, as in sidebar-left, that make a whole mark.
HEADS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comments cookie cookies disqus footer gdpr nav navbar navigation newsletter popup promo sidebar sponsored".split())
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)


def _mark(tag: str, attributes: str, in_article: bool) -> int:
    mark = TAG if tag in DROPPED and not (tag == "header" and in_article) else 0
    for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "aria-hidden" and value == "true" or key == "hidden":
            return HIDDEN
        if key in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z]+", token) if x]
                said = [x for x in parts if x not in NEUTRAL]
                known = bool(said) and NOT_ARTICLE.issuperset(said) and (len(said) == len(parts) or said != ["header"])  # a box-header may be a title
                if known and (not NEVER.isdisjoint(parts) or "comment" in parts and len(parts) > 1):
                    mark = TAG
                elif known or parts and parts[0] in HEADS:
                    mark = max(mark, STRONG)
                elif not NOT_ARTICLE.isdisjoint(parts):
                    mark = max(mark, WEAK)
    return mark


class Page:
    """Elements (parent, path, mark) and text blocks (text, element, characters in links) of a page. Work is linear in
    its length, however deep it nests."""

    def __init__(self, page: str):
        self.parent, self.path, self.mark, self.article, self.holds = [0], [0], [0], [0], [False]
        self.tags = [""]
        self.paths: dict[tuple[int, str, int], int] = {}
        self.blocks: list[tuple[str, int, int]] = []
        self._read(page)

    def _open(self, tag: str, attributes: str, top: int) -> int:
        n, article = len(self.parent), self.article[top]
        mark = _mark(tag, attributes, article > 0)
        if tag in ("article", "main"):
            at = top
            while at and not self.holds[at]:  # each element is told once
                self.holds[at] = True
                at = self.parent[at]
            article = article or n
        self.parent.append(top)
        self.path.append(self.paths.setdefault((self.path[top], tag, mark), len(self.paths) + 1))
        self.mark.append(mark)
        self.article.append(article)
        self.holds.append(False)
        self.tags.append(tag)
        return n

    def _read(self, page: str) -> None:
        stack, count, lists, cells = [0], dict.fromkeys(ENDS_P, 0), [0], [0]
        parts: list[str] = []
        linked, links = 0, 0

        def flush() -> None:
            nonlocal linked
            text = "".join(parts)
            parts.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                self.blocks.append((text, stack[-1], min(linked, len(text))))
            linked = 0

        def pop_to(tag: str) -> None:
            while True:
                gone = self.tags[stack.pop()]
                count[gone] -= 1
                if gone in ("li", "ul", "ol"):
                    lists.pop()
                if gone in CELLS or gone == "table":
                    cells.pop()
                if gone == tag:
                    return

        at, end, last = 0, len(page), page.rfind(">") + 1  # no tag ends behind
        while at < end:
            m = TOKEN.search(page, at, last) if at < last else None
            piece = page[at : m.start() if m else end]
            if piece:
                parts.append(piece)
                linked += len(piece) if links else 0
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "a":
                    links = 0
                if tag not in INLINE and tag not in VOID and count.get(tag):
                    flush()
                    pop_to(tag)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else end
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    parts.append(" ")
                continue
            if tag in INLINE or tag == "label" and self.tags[stack[-1]] in TEXTUAL:
                links = tag == "a" or links
                continue
            if m[3].endswith("/"):
                continue
            flush()
            while self.tags[cells[-1]] in CELLS.get(tag, ()):
                pop_to(self.tags[cells[-1]])
            if tag in ENDS_P and count.get("p"):
                pop_to("p")
            elif tag == "li" and self.tags[lists[-1]] == "li":
                pop_to("li")
            n = self._open(tag, m[3], stack[-1])
            stack.append(n)
            count[tag] = count.get(tag, 0) + 1
            if tag in ("li", "ul", "ol"):
                lists.append(n)
            if tag in CELLS or tag == "table":
                cells.append(n)
        flush()

    def marks(self) -> list[int]:
        """The strongest mark on or above each element. One around an article, outside of any, does not count, unless hidden."""
        out = [0]
        for i in range(1, len(self.parent)):
            own = self.mark[i]
            spared = own < HIDDEN and self.holds[i] and not self.article[i]
            out.append(max(out[self.parent[i]], 0 if spared else own))
        return out

    def container(self, node: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """For each element whether it lies in the lowest one that has four fifths of ``mass`` in it, which ``node`` has, by block."""
        held = np.bincount(node, mass, len(self.parent))
        for i in range(len(self.parent) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        lowest = int(np.flatnonzero(held >= 0.8 * mass.sum())[-1])
        inside = np.zeros(len(self.parent), bool)
        for i in range(len(self.parent)):
            inside[i] = i == lowest or (i > 0 and inside[self.parent[i]])
        return inside


    def own_headers(self) -> np.ndarray:
        """For each element whether it lies in a header of the content: one that has a heading and no menu, and whose parent is, or lies in,
        the lowest element with most of the text that has no mark, but not the body. Their marks are lifted."""
        out = np.zeros(len(self.parent), bool)
        headers = [i for i, t in enumerate(self.tags) if t == "header" and self.mark[i] == TAG and self.tags[self.parent[i]] not in ("", "html", "body")]
        if not headers:
            return out
        marks = self.marks()
        plain = [(self.parent[b[1]], len(b[0])) for b in self.blocks if not marks[b[1]]]
        if not plain:
            return out
        inside = self.container(*(np.array(x) for x in zip(*plain)))
        held: dict[int, set[str]] = {}  # tags in a header
        for i in headers:
            if inside[self.parent[i]]:
                out[i] = True
        top = [0] * len(self.tags)  # the header that an element lies in
        for i in range(1, len(self.tags)):
            top[i] = top[self.parent[i]] or (i if out[i] else 0)
            if top[i]:
                held.setdefault(top[i], set()).add(self.tags[i])
        for i in np.flatnonzero(out).tolist():
            out[i] = not HEADINGS.isdisjoint(held[i]) and held[i].isdisjoint(("nav", "menu", "form"))
            self.mark[i] = 0 if out[i] else TAG
        for i in range(1, len(self.tags)):
            out[i] |= out[self.parent[i]]
        return out


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(x, KERNEL, "same") / np.convolve(np.ones(len(x)), KERNEL, "same") if len(x) > 4 else x


def main_text(page: str | None) -> str:
    """The blocks of the content paths, in page order, joined by an empty line. Null, and a page without text: empty."""
    read = Page(page or "")
    own_header = read.own_headers()
    marks = read.marks()
    blocks = [b for b in read.blocks if marks[b[1]] < HIDDEN]
    if not blocks:
        return ""
    node = np.array([b[1] for b in blocks])
    size = np.array([len(b[0]) for b in blocks], float)
    own = np.array([b[2] for b in blocks]) / size
    parent = np.array(read.parent)[node]
    beside = np.bincount(parent, own * size) / np.maximum(np.bincount(parent, size), 1)
    link = own * np.sqrt(beside[parent])
    heading = np.array([read.tags[i] in HEADINGS for i in node.tolist()])
    source = np.array([h and b[0].strip(" .:0123456789").lower() in SOURCES for b, h in zip(blocks, heading)])
    latest = np.maximum.accumulate(np.where(heading, np.arange(len(blocks)), -1))  # the heading above
    link[(latest >= 0) & source[latest]] = 0
    mark = np.array([marks[i] for i in node.tolist()])
    _, path = np.unique(np.array(read.path)[node] * HIDDEN + mark, return_inverse=True)
    mean = lambda x: (np.bincount(path, x) / np.bincount(path))[path]
    points = np.array([len(PUNCTUATION.findall(b[0])) for b in blocks], float)
    fused = mean(np.sqrt(_smooth(mean(size)) * (_smooth(mean(points)) + 0.5)))
    article = np.array(read.article)[node] > 0
    bare = mark < STRONG
    free = fused * (1 - link)
    if not (article & bare).any() and free[bare].max(initial=0.0) < POOR * free[mark < TAG].max(initial=0.0):
        mark = np.where(mark < TAG, 0, mark)
    weight = np.array(WEIGHTS)[mark] + LINKED * link
    plain = size * np.exp(weight)  # text that nothing speaks against
    ratio = np.log(fused / ((fused * plain).sum() / plain.sum()))
    if not (article & (mark < STRONG)).any():  # no such element: around most of the text of good paths
        good = ratio + weight >= (ratio + weight).max() - REACH
        inside = read.container(parent, plain * good)[parent]
        first, last = np.flatnonzero(good & inside)[[0, -1]] if (good & inside).any() else (0, len(blocks) - 1)
        place = np.arange(len(blocks))
        article = inside & ((place >= first) & (place <= last) | heading & (place >= first - 2) & (place <= last))
        article |= own_header[node]
    score = np.clip(ratio, np.where(article, -1.0, -6.0), 0.5) + INSIDE * article + weight
    keep = score >= score.max() - REACH
    return "\n\n".join(b[0] for b, ok in zip(blocks, keep) if ok)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with its main text as column ``into``, which replaces one of that name; every other column stays. Null and
    empty pages, and pages without text, give an empty text; repeated rows are answered one by one, whole pages of any length."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return small_batches(pages).withColumn(into, texts(F.col(html)))


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; repeated rows are answered one by one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
