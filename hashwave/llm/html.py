"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root. Article text sits under few
paths with long, punctuated nodes; menus and notices under paths with short ones. The mean length and
the mean punctuation of each path, taken over the nodes in page order, are smoothed and
multiplied; the nodes of paths above a threshold are content, and so are blocks of prose on other paths, as long as those
in the same part of the page. Where elements are named as articles and hold content, the rest is none. The smallest
element with all content is the article, and its blocks are the text, with the headline above it and
without links that stand alone and parts that are marked as something else. Marks (tags, and words in class, id
and role) are hints: those that would take more content from the page than they leave are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
_WORDED = re.compile(r"\w")
#: How many times what is left without them elements must hold that only marking words name; content outside
#: articles must hold more than so many times theirs to count; and prose on other paths must have one so many-th of the
#: characters of the shortest block of content.
_PURE = 4

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg title select".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
#: An opening tag ends these open elements, as their end tags may be left out.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Blocks that are parts of an article and not the article.
_NO_CONTAINER = frozenset(
    "p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre table caption colgroup thead tbody tfoot tr td th figure figcaption header hgroup address details summary".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOT_ARTICLE = frozenset("nav footer aside form button menu dialog".split())
_NOT_ARTICLE_NAMES = frozenset(
    "ad ads advert advertisement advertisements banner sidebar comment comments reply replies nav navbar navigation menu footer cookie cookies consent notice notices promo promoted share sharing social related newsletter popup modal breadcrumb breadcrumbs sponsor sponsored subscribe respond discussion disqus gdpr".split()
)


#: A tag with its names, and whether nothing but marking words is among the names.
_Mark = tuple[str, frozenset[str], bool]


@dataclass
class _Node:
    """A text node: its element path (tag and serial number of each), text, block, and the marks of no article around it."""

    path: tuple[tuple[str, int], ...]
    tags: tuple[str, ...]
    text: str
    block: int
    marks: frozenset[_Mark]


def _mark(tag: str, attributes: str) -> _Mark | None:
    if tag in _NOT_ARTICLE:
        return tag, frozenset(), True
    if tag in ("html", "body") or "=" not in attributes:
        return None
    names = " ".join("".join(found) for found in _NAMES.findall(attributes)).lower()
    words = frozenset(re.split(r"[\s_-]+", names.strip()))
    return None if _NOT_ARTICLE_NAMES.isdisjoint(words) else (tag, words, words <= _NOT_ARTICLE_NAMES)


def _nodes(html: str) -> list[_Node]:
    """The text nodes in page order. Open and unmatched tags are closed as browsers do, roughly."""
    nodes, path, marks, block, at, serial = [], [], [], 0, 0, 0

    def add(text: str) -> None:
        if text and not text.isspace():
            tags = tuple([tag for tag, _ in path])
            nodes.append(_Node(tuple(path), tags, unescape(text), block, frozenset(filter(None, marks))))
        elif text and nodes and nodes[-1].block == block:
            nodes[-1].text += " "

    def close(tags: set[str], upto: set[str] = frozenset()) -> None:
        for depth in range(len(path) - 1, -1, -1):
            if path[depth][0] in tags:
                del path[depth:], marks[depth:]
                return
            if path[depth][0] in upto:
                return

    while (start := html.find("<", seen := at)) >= 0:
        while start >= 0 and not (found := _MARKUP.match(html, start)):
            start = html.find("<", start + 1)  # a bracket that begins no markup is text
        if start < 0:
            break
        add(html[seen:start])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if tag not in _INLINE:
            block += 1
        if found[1]:
            close({tag})
        elif tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag in _VOID:
            if tag == "br" and nodes and nodes[-1].block == block:
                nodes[-1].text += " "
        else:
            if tag not in _INLINE and tag not in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close({"p"}, {"table", "td", "li", "div", "section", "article", "body"})
            if tag in _ENDS:
                close(_ENDS[tag], {"ul", "ol", "dl", "table", "select"})
            if not found[3].endswith("/"):
                serial += 1
                path.append((tag, serial))
                marks.append(_mark(tag, found[3]))
    add(html[at:])
    return nodes


@dataclass
class _Paths:
    """The tag paths whose smoothed, fused ratios are not below the threshold, and those whose own ratios are not either."""

    smoothed: set[tuple[str, ...]]
    own: set[tuple[str, ...]]


def _content_paths(nodes: list[_Node], width: float) -> _Paths:
    numbers: dict[tuple[str, ...], int] = {}
    of = np.array([numbers.setdefault(node.tags, len(numbers)) for node in nodes])
    held = np.bincount(of)
    lengths = np.array([len(node.text) for node in nodes], float)
    points = np.array([len(_PUNCTUATION.findall(node.text)) for node in nodes], float)
    steps = np.arange(-int(3 * width), int(3 * width) + 1)
    kernel = np.exp(-(steps**2) / (2 * width * width))
    smooth = lambda values: np.convolve(values, kernel)[len(steps) // 2 :][: len(nodes)]
    weight = smooth(np.ones(len(nodes)))
    ratios = [np.bincount(of, values) / held for values in (lengths, points + 1)]
    fused = np.prod([smooth(ratio[of]) / weight for ratio in ratios], axis=0)
    # A page with one kind of node has no spread: then everything is content.
    threshold = min(fused.std(), fused.max())
    means = np.bincount(of, fused) / held
    chosen = lambda scores: {tags for tags, number in numbers.items() if scores[number] >= threshold}
    return _Paths(chosen(means), chosen(ratios[0] * ratios[1]))


def _unmarked(nodes: list[_Node], width: float) -> list[_Node]:
    """The nodes outside marked elements; marks that hold most of the page's content are no marks.

    Elements with like names stand or fall together, by what they hold against the text that is left outside links.
    Where nothing but marking words names an element, it must hold several times that, and no article or
    main element may be left beside it: long comments and footers do not make an article.
    """
    if not any(node.marks for node in nodes):
        return nodes
    content = [node for node in _content(nodes, _content_paths(nodes, width)) if node.marks]
    ignored: set[_Mark] = set()
    while True:
        left = [node for node in nodes if node.marks <= ignored]
        size = sum(len(node.text) for node in left if "a" not in node.tags)
        held, around = defaultdict(int), defaultdict(set)
        for node in content:
            for mark in node.marks - ignored:
                held[mark] += len(node.text)
                around[mark].update(node.path)
        articles = {element for node in left for element in node.path if element[0] in ("article", "main")}
        weights = {mark: n / (_PURE if mark[2] else 1) for mark, n in held.items() if not (mark[2] and articles - around[mark])}
        most = max(weights, key=lambda mark: (weights[mark], sorted(mark[1]), mark[0]), default=None)
        if most is None or weights[most] < size:
            return left or nodes
        ignored.add(most)


def _part(node: _Node) -> tuple[str, int] | None:
    """The part of the page's body that a node is in."""
    return next((element for element in node.path if element[0] not in ("html", "body")), None)


def _content(nodes: list[_Node], paths: _Paths) -> list[_Node]:
    """The nodes on content paths, and those of prose on other paths: punctuated blocks, most of each no link, in a part of the
    page with content, and not much shorter than the shortest block of that."""
    texts: dict[int, list[str]] = defaultdict(list)
    linked = defaultdict(int)
    for node in nodes:
        if "a" in node.tags:
            linked[node.block] += len(node.text)
        else:
            texts[node.block].append(node.text)
    written = {block: "".join(part) for block, part in texts.items()}
    on_paths = {node.block: _part(node) for node in nodes if node.tags in paths.smoothed}
    least = min((len(written[b]) for b in on_paths if _PUNCTUATION.search(written.get(b, ""))), default=0)
    prose = {b for b, text in written.items() if _PURE * len(text) >= least and len(text) >= linked[b] and _PUNCTUATION.search(text)}
    parts = set(on_paths.values())
    return [n for n in nodes if n.tags in paths.smoothed or (n.block in prose and _part(n) in parts)]


def _in_articles(content: list[_Node]) -> list[_Node]:
    """The content in elements named as articles, where that is no small share of all."""
    named = [node for node in content if any(tag in ("article", "main") for tag in node.tags)]
    size = lambda nodes: sum(len(node.text) for node in nodes)
    return named if _PURE * size(named) >= size(content) - size(named) and named else content


def _article(content: list[_Node]) -> tuple[tuple[str, int], ...]:
    """The path of the smallest container that holds all content, or of the article or main element around it."""
    shared = content[0].path
    for node in content:
        same = next((i for i, (x, y) in enumerate(zip(shared, node.path)) if x != y), min(len(shared), len(node.path)))
        shared = shared[:same]
    outer = next((i for i, (tag, _) in enumerate(shared) if tag in ("article", "main")), len(shared))
    shared = shared[: outer + 1]
    while shared and (shared[-1][0] in _INLINE or shared[-1][0] in _NO_CONTAINER):
        shared = shared[:-1]
    return shared


def main_text(html: str | None, width: float = 1.0) -> str:
    """The article's blocks joined by line ends; empty for null, empty and textless pages. Pages of any length are read whole.

    The article is the smallest container with all of the page's content, and all of it is text, but for blocks of nothing
    but links that are neither headings nor as long and punctuated as content. A headline above the article comes with what
    stands between the two. White space within a block, line breaks included, becomes one space; character
    references are decoded.
    """
    nodes = _nodes(html or "")
    if not nodes:
        return ""
    plain = _unmarked(nodes, width)
    paths = _content_paths(plain, width)
    content = _content(plain, paths)
    named = _in_articles(content)
    article = _article(named)
    within = [node.path[: len(article)] == article for node in plain]
    if len(named) < len(content):
        within = [inside and any(tag in ("article", "main") for tag in node.tags) for inside, node in zip(within, plain)]
    first = begin = within.index(True)
    if not any(inside and "h1" in node.tags for inside, node in zip(within, plain)):
        begin = max((i for i in range(first) if "h1" in plain[i].tags), default=first)
        begin = next(i for i in range(begin + 1) if plain[i].block == plain[begin].block)
    # Blocks with words outside links, headings, and links that are content by their own ratios.
    worded = {
        node.block
        for node in plain
        if node.tags in paths.own or not _HEADINGS.isdisjoint(node.tags) or ("a" not in node.tags and _WORDED.search(node.text))
    }
    links = {node.block for node in plain if "a" in node.tags}
    blocks: dict[int, list[str]] = {}
    for i, node in enumerate(plain):
        if (within[i] or begin <= i < first) and (node.block in worded or node.block not in links):
            blocks.setdefault(node.block, []).append(node.text)
    lines = (_SPACE.sub(" ", "".join(texts)).strip() for texts in blocks.values())
    return "\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Replaces the html of each page by its main text; a column named ``out`` is replaced.

    Null, empty and textless pages give the empty string, an empty table gives no rows, and other columns pass as they are.
    Pages are independent: no shuffle, and repeated pages give equal texts.
    """
    others = [f for f in pages.schema if f.name not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(html).to_pylist()], pa.string())
            names = [f.name for f in others]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), texts], [*names, out])

    return pages.mapInArrow(run, T.StructType([*others, T.StructField(out, T.StringType())]))
