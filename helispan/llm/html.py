"""Main text of web pages by minimum-cut labelling of their blocks.

A page is a sequence of text blocks. A linear classifier gives the log-odds that a block is content,
the capacity of its edge to one of two terminals; blocks that follow each other or share a parent are
joined by smoothness edges, stronger the more ancestors they share. The minimum cut, found by
max-flow, is the labelling of least cost, in which clear neighbours overrule a doubtful block.

The log-odds have two parts. That of the text (tag, length, sentence ends, links) is fitted to pages
that mark their own parts: blocks of ``article`` or ``main`` against those of ``nav``, ``footer`` and
the like, over a bounded sample of the table, with fixed weights as the prior. That of the marks
themselves (such elements, names of classes, hidden parts) has fixed weights.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helispan.llm.arrow import bound_batches

#: Elements whose start and end divide blocks.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
SPACES = set("br td th img input wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
UNSEEN = set("script style noscript template title svg math iframe object select option textarea button canvas audio video".split())
#: An open element that the start of another closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in names (class, id, role) of parts that are not the article,
_ASIDE = set(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices notification
    notifications alert alerts popup popups modal modals overlay overlays sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead
    header footer copyright legal comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations trending newsletter subscribe signup login
    search tags complementary contentinfo toc""".split()
)
#: those of them whose parts hold links and fields, so that a text of full sentences speaks against them,
_CONTROLS = set("menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar share sharing signup login search tags toc".split())
#: words that go with them and name a part of any kind,
_PARTS = set(
    """area bar block body bottom box btn button buttons card cards center col column container content end feed fixed form global group head inner inline item items large left line link links list
    listing main mobile module more my news outer page panel post posts primary right row section sections side site slot small stories sticky story strip tab text thread top unit user users view wrap wrapper
    articles article media policy""".split()
)
#: and words before them that mean their absence.
_WITHOUT = {"no", "has", "with"}
_MAIN = {"article", "articlebody", "main", "content", "post", "entry", "story"}
_WORD = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_LEGAL = re.compile(r"©|all rights reserved|copyright|cookies?\b", re.IGNORECASE)

#: Weights of the text, before they are fitted, and of the marks; positive for content.
TEXT = {"bias": 0.2, "paragraph": 1.0, "heading": 0.6, "item": -0.3, "length": 2.0, "sentence": 0.5, "links": -4.0, "legal": -0.8}
MARKS = {"article": 2.5, "outside": -3.0, "main_name": 1.5, "apart": -10.0, "aside": -8.0, "aside_word": -2.0, "hidden": -12.0}
#: Most that the text alone can say, in log-odds.
CLEAR = 4.0
#: Weight of TEXT in the fit, in blocks; steps of the features that are shares; pages of the sample.
PRIOR, STEPS, SAMPLE = 20.0, 8, 500
#: Capacity between neighbours, and more of it for each share of common ancestors; between blocks of one parent.
SMOOTH, NEAR, SIBLINGS = 0.4, 0.8, 0.4
#: Characters and sentence ends of a block of prose at least, and its share of links at most.
PROSE = (100, 2, 0.2)
_SENTENCE = re.compile(r"[.!?…][\"'”»)]*(?=\s|$)")
APART_TAGS = set("nav aside footer form menu dialog".split())
_LISTS = {"ul", "ol", "dl", "table", "select", "menu"}


def _name_flags(names: str) -> tuple[int, int, int]:
    """Whether a part's names call it aside (1 if by controls only, else 2), hold such a word among others, and call it the main part.

    A name is aside if besides such a word it has only words for parts of any kind.
    """
    aside = word = main = 0
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        found = [i for i, w in enumerate(words) if w in _ASIDE and not (i and words[i - 1] in _WITHOUT)]
        if found and all(w in _ASIDE or w in _PARTS for w in words):
            aside = max(aside, 1 if all(words[i] in _CONTROLS for i in found) else 2)
        elif found:
            word = 1
        main |= any(w in _MAIN for w in words) and not found
    return aside, word, int(main)


#: Ends of comments, and of marked sections, of any kind.
_COMMENT_END, _SECTION_END = re.compile(r"-->|--\s*>|--!>"), re.compile(r"\]\s*>")


class _Element:
    """An open or closed element that is a block or has a flag: what its blocks need to know of its ancestors."""

    __slots__ = ("above", "apart", "aside", "depth", "hidden", "inside", "main", "tag", "word")

    def __init__(self, above: "_Element | None", tag: str, flags: tuple[int, int, int, int]) -> None:
        self.above, self.depth = above, above.depth + 1 if above else 0
        inside = above.inside if above else False
        aside, word, main, hidden = flags
        own = tag in APART_TAGS or (tag == "header" and not inside)
        heading = tag in ("header", "hgroup") and inside
        self.apart, self.word = (((getattr(above, k) if above else 0) or v) for k, v in (("apart", own), ("word", word and not heading)))
        self.aside = max(above.aside if above else 0, 0 if heading else aside)
        self.hidden = hidden or (above.hidden if above else 0)
        self.inside = inside or tag in ("article", "main")
        self.main = (main and not self.inside) or (above.main if above else 0)
        self.tag = tag if tag in BLOCKS else above.tag if above else ""


class _Blocks(HTMLParser):
    """Blocks of a page in order: [texts, characters in links, element]. Each step takes constant time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.stack: list[tuple[str, _Element | None]] = []
        #: Places in the stack of open elements, by tag, and of open blocks other than paragraphs.
        self.open: defaultdict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = []
        self.unseen = self.links = 0
        self.fresh = True
        #: The text whose last matches are held, and these.
        self.looked: str | None = None
        self.last: dict[re.Pattern, int] = {}

    def _ends(self, pattern: re.Pattern) -> int:
        """Where the last match of a pattern in the text to parse begins, looked for once."""
        if self.looked is not self.rawdata:
            self.looked, self.last = self.rawdata, {}
        if pattern not in self.last:
            self.last[pattern] = max((m.start() for m in pattern.finditer(self.rawdata)), default=-1)
        return self.last[pattern]

    def parse_comment(self, i: int, report: bool = True) -> int:
        # Without an end beyond, each unclosed comment would be searched to the end of the page.
        return super().parse_comment(i, report) if self._ends(_COMMENT_END) > i else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        if self._ends(_SECTION_END) <= i:
            return -1
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            # A section of no known kind ends at the next bracket, as a comment that is none.
            return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SPACES:
            self._text(" ")
        elif tag in BLOCKS:
            self.fresh = True
            if self.open["p"] and self.open["p"][-1] > (self.bounds[-1] if self.bounds else -1):
                self._cut(self.open["p"][-1])
        if tag in VOID:
            return
        if tag in CLOSES:
            last = max((self.open[t][-1] for t in CLOSES[tag] if self.open[t]), default=-1)
            if last > max((self.open[t][-1] for t in _LISTS if self.open[t]), default=-1):
                self._cut(last)
        flags = (0, 0, 0, 0)
        if attrs:
            names = "" if tag in ("html", "body") else " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop"))
            hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and _HIDDEN.search(v)) for k, v in attrs)
            flags = (*_name_flags(names), int(hidden))
        above = self.stack[-1][1] if self.stack else None
        element = _Element(above, tag, flags) if tag in BLOCKS or any(flags) else above
        self.open[tag].append(len(self.stack))
        if tag in BLOCKS and tag != "p":
            self.bounds.append(len(self.stack))
        self.stack.append((tag, element))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        elif tag in SPACES:
            self._text(" ")
        if self.open[tag]:
            self._cut(self.open[tag][-1])

    def _cut(self, place: int) -> None:
        """Close all elements from a place of the stack on."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag in BLOCKS and tag != "p":
                self.bounds.pop()
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self._text(data)

    def _text(self, data: str) -> None:
        if self.fresh:
            if not data or data.isspace():
                return
            self.blocks.append([[], 0, self.stack[-1][1] if self.stack else None])
            self.fresh = False
        block = self.blocks[-1]
        block[0].append(data)
        if self.links:
            block[1] += len(data)


_PAGE = _Element(None, "", (0, 0, 0, 0))


def blocks_of(html: str) -> list[tuple[str, int, _Element]]:
    """Text, characters in links and element of each block that has text."""
    parser = _Blocks()
    # Beyond the last bracket nothing is a tag: what begins there would be searched to the end of the page each time.
    end = html.rfind(">") + 1
    parser.feed(html[:end])
    parser.close()
    if not parser.cdata_elem:
        parser.handle_data(unescape(html[end:]))
    out = []
    for texts, linked, element in parser.blocks:
        text = " ".join("".join(texts).split())
        if text:
            out.append((text, linked, element or _PAGE))
    return out


def text_features(block: tuple[str, int, _Element]) -> tuple[float, ...]:
    """What the fitted weights are for, in the order of TEXT; shares in steps."""
    text, linked, element = block
    tag = element.tag
    return (
        1.0,
        float(tag in ("p", "blockquote", "pre")),
        float(tag[:1] == "h" and tag[1:].isdigit()),
        float(tag == "li"),
        round(min(len(text) / 200, 1) * STEPS) / STEPS,
        float(text[-1] in ".!?:;\"'”»…"),
        round(min(linked / len(text), 1) * STEPS) / STEPS,
        float(len(text) < 200 and bool(_LEGAL.search(text))),
    )


def mark(element: _Element, has_article: bool, is_prose: bool = False) -> float:
    """Log-odds of content by an element's marks; where prose stands, names of controls only count as a word among others."""
    m = MARKS
    s = m["article"] if element.inside else m["outside"] * has_article
    s += m["main_name"] * element.main + m["apart"] * element.apart + m["hidden"] * bool(element.hidden)
    named = element.aside == 2 or (element.aside and not is_prose)
    return s + (m["aside"] if named else m["aside_word"] * bool(element.word or element.aside))


def marked_blocks(html: str | None) -> Counter:
    """Counts of (label, features) of the blocks of a page whose marks leave no doubt."""
    blocks = blocks_of(html) if html else []
    found: Counter = Counter()
    if any(e.inside for _, _, e in blocks):
        for block in blocks:
            e = block[2]
            apart = bool(e.apart or e.aside or e.hidden)
            if apart or (e.inside and not e.word):
                found[(int(not apart), *text_features(block))] += 1
    return found


def fit_text(found: list[tuple[int, tuple[float, ...], int]]) -> tuple[float, ...]:
    """Weights of a logistic regression on (label, features, count), with TEXT as the mean of their prior; both labels weigh the same."""
    mean = np.array(list(TEXT.values()))
    if {y for y, _, _ in found} != {0, 1}:
        return tuple(mean)
    y = np.array([r[0] for r in found], float)
    x = np.array([r[1] for r in found], float)
    n = np.array([r[2] for r in found], float)
    n *= np.where(y == 1, n.sum() / 2 / n[y == 1].sum(), n.sum() / 2 / n[y == 0].sum())
    w = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(len(w)), x.T @ (n * (y - p)) - PRIOR * (w - mean))
        w += step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def content_cost(block: tuple[str, int, _Element], has_article: bool, weights: tuple[float, ...]) -> float:
    """How much better it is to call a block content than boilerplate, in log-odds."""
    said = sum(a * b for a, b in zip(weights, text_features(block), strict=True))
    return max(-CLEAR, min(CLEAR, said)) + mark(block[2], has_article, prose(block))


def prose(block: tuple[str, int, _Element]) -> bool:
    """Whether a block is a text of some full sentences with few links."""
    text, linked, _ = block
    return len(text) >= PROSE[0] and len(_SENTENCE.findall(text)) >= PROSE[1] and linked < PROSE[2] * len(text)


def edges_of(elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Smoothness edges: of each block to the one before, by common ancestors, and to the last of the same parent.

    The page itself is an ancestor of all. Climbing from one block to the next passes each element once in all.
    """
    edges, last = [], {}
    for i, e in enumerate(elements):
        if i:
            a, b = e, elements[i - 1]
            deepest = max(a.depth, b.depth)
            while a is not b and a and b:
                a, b = (a.above, b) if a.depth > b.depth else (a, b.above) if b.depth > a.depth else (a.above, b.above)
            edges.append((i - 1, i, SMOOTH + NEAR * ((a.depth + 2 if a is b and a else 1) / (deepest + 2))))
        parent = id(e.above) if e.above else 0
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, SIBLINGS))
        last[parent] = i
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, where ``gain`` is a node's capacity from it (or, below 0, to the sink).

    Flow is pushed along shortest residual paths, level by level, until no deficit can be reached.
    """
    n = len(gain)
    excess = list(gain)
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        head.append(b)
        room.append(c)
        to[b].append(len(head))
        head.append(a)
        room.append(c)
    tiny = 1e-12
    while True:
        level = [0 if e > tiny else -1 for e in excess]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            for e in to[i]:
                j = head[e]
                if room[e] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    reached |= excess[j] < -tiny
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        at = [0] * n
        for start in range(n):
            while excess[start] > tiny and level[start] == 0:
                path, i = [], start
                while excess[i] >= -tiny:
                    while at[i] < len(to[i]):
                        e = to[i][at[i]]
                        if room[e] > tiny and level[head[e]] == level[i] + 1:
                            break
                        at[i] += 1
                    else:
                        if not path:
                            break
                        i = head[path.pop() ^ 1]
                        at[i] += 1
                        continue
                    path.append(e)
                    i = head[e]
                if not path:
                    break
                push = min(excess[start], -excess[i], *(room[e] for e in path))
                excess[start] -= push
                excess[i] += push
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push


def labelled(blocks: list[tuple[str, int, _Element]], weights: tuple[float, ...], marks: bool = True) -> tuple[list[float], list[bool]]:
    """Costs of a page's blocks and their labels by the minimum cut; without ``marks``, by text alone."""
    has_article = any(e.inside for _, _, e in blocks)
    costs = [content_cost(b, has_article, weights) - (0 if marks else mark(b[2], has_article)) for b in blocks]
    return costs, minimum_cut(costs, edges_of([b[2] for b in blocks]))


def main_text(html: str | None, weights: tuple[float, ...] = tuple(TEXT.values())) -> str:
    """The content blocks of a page, joined by empty lines."""
    blocks = blocks_of(html) if html else []
    return "\n\n".join(b[0] for b, keep in zip(blocks, labelled(blocks, weights)[1], strict=True) if keep)


def train(pages: DataFrame) -> tuple[float, ...]:
    """Text weights fitted to the marked blocks of about SAMPLE pages, those whose hash of id and url falls in a share of that size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for html in batch.column(0).to_pylist():
                found += marked_blocks(html)
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())], names=["kind", "n"])

    share = max(1, pages.count() // SAMPLE)
    taken = pages.where(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(share)) == 0).select("html")
    # Features are flags and shares in steps, so kinds of blocks are few, whatever the input.
    kinds = taken.mapInArrow(rows, "kind array<double>, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    return fit_text(sorted((int(r["kind"][0]), tuple(r["kind"][1:]), r["n"]) for r in kinds))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars. A null or empty page has an empty text; no page is shuffled.

    Repeated rows repeat; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    weights = train(pages)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(rows, "page_id long, url string, text string, n_chars long")
