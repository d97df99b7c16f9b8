"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text between block-level tags. A linear classifier scores every block from its ancestors, class
names, links, length and punctuation; the scores are capacities to source (content) and sink (boilerplate). Blocks that are
neighbours, or share a container, are tied by smoothness edges, and the minimum cut labels the page as a whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from brickloom.llm.common import batched
from brickloom.llm.mincut import source_side

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())  # their content is no markup
HIDDEN = frozenset("noscript template iframe object svg math noembed noframes canvas audio video".split())  # left out with what they hold
CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())
WHOLE = frozenset("html body main article".split())  # their names speak of the page, not of a part of it
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What an ancestor element says about a block, in hundredths.
TAG_SCORES = {
    "article": 500, "main": 400, "p": 80, "blockquote": 60, "pre": 60, "figcaption": 20, "td": -10, "li": -30, "nav": -900, "footer": -900,
    "aside": -900, "header": -500, "form": -900, "button": -900, "select": -900, "menu": -900, "dialog": -700, "address": -200, "label": -200,
}
GOOD = re.compile(r"(?:^|[_-])(?:article|content|main|post|story|entry|body|text)(?:$|[_-])", re.I)
BAD = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|"
    r"gdpr|popup|modal|overlay|recommended|recommendations|comments?|replies|disqus|newsletter|subscribe|signup|login|pagination|pager|toolbar|copyright)(?:$|[_-])",
    re.I,
)
#: Words that name boilerplate alone or beside words of LISTING only: related-posts does, related-work does not.
UNSURE = frozenset("side notice share sharing social related recommend widget search tag tags legal hidden skip".split())
LISTING = frozenset(
    "area articles article bar block box button buttons by cloud col column container content entry footer form group icons inner items left link "
    "links list media meta nav network networks page panel post posts results right row section site stories story text to top widget widgets wrap wrapper".split()
)
# state of the page or the layout, or the article's own subjects, not what an element is
STATE = re.compile(r"(?:has|no|not|with|without|is|js|can|supports?)[_-]|(?:.*[_-])?(?:has|with|without|no)[_-]|(?:.*[_-])?(?:layout|open|closed|enabled|disabled)$", re.I)
SUBJECT = re.compile(r"(?:tag|category|topic|status|type|format)-(.+)", re.I)
NEXT_TO, SAME_PARENT = 60, 40  # capacities of the smoothness edges, the first divided by the steps between the containers

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S
)
_HIDES = re.compile(rf"<(?:{'|'.join(sorted(HIDDEN))})(?![^\s/>])", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class _Node:
    """An open element: what it and its ancestors say about the blocks inside."""

    __slots__ = ("tag", "block", "parent", "depth", "score", "link", "number", "article")

    def __init__(self, tag: str, parent: _Node | None, score: int, link: bool, number: int):
        self.tag, self.parent, self.score, self.link, self.number = tag, parent, score, link, number
        self.block = tag in BLOCKS
        self.article = tag == "article" or (parent is not None and parent.article)
        self.depth = parent.depth + 1 if parent else 0

    def container(self) -> _Node:
        node = self
        while node.parent and not node.block:
            node = node.parent
        return node


class Block:
    __slots__ = ("text", "links", "node")

    def __init__(self, text: str, links: int, node: _Node):
        self.text, self.links, self.node = text, links, node


def _name_score(names: str) -> int:
    """What class names, id and role say about an element, name by name. A BEM modifier (after ``--``) is no part of a name."""
    good = False
    for name in names.split():
        name = name.partition("--")[0]
        subject = SUBJECT.fullmatch(name)
        if STATE.match(name) or (subject and subject[1].lower() not in LISTING):
            continue
        words = {w for w in re.split(r"[_-]+", name.lower()) if w and not w.isdigit()}
        if BAD.search(name) or (words & UNSURE and words <= UNSURE | LISTING):
            return -900
        good = good or GOOD.search(name) is not None
    return 200 if good else 0


def _open(tag: str, attributes: str, parent: _Node, number: int) -> _Node:
    inner = tag == "article" and parent.article  # articles in an article are comments or teasers
    score = parent.score + (0 if inner else TAG_SCORES.get(tag, 0))
    if tag == "main":
        score = max(parent.score, 0) + TAG_SCORES[tag]  # a page has one; layouts and forms around it say nothing about it
    elif attributes and (inner or tag not in WHOLE):
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
        if names:
            score += _name_score(names)
    return _Node(tag, parent, score, parent.link or tag == "a", number)


def _raw_end(page: str, at: int, m: re.Match, tag: str) -> int:
    """Where the content of a RAW element ends; without an end tag at the page's end, or at once when written as closed."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
    return end.end() if end else at if (m[3] or m[6] or "").endswith("/") else len(page)


def _hidden(page: str) -> dict[int, int]:
    """Start and end of the HIDDEN elements that their own end tag closes. Others (void, or closed by a surrounding one) hide nothing."""
    ends: dict[int, int] = {}
    if not _HIDES.search(page):
        return ends
    stack: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if m[1] or m[4]:
            while count[tag]:
                last, start = stack.pop()
                count[last] -= 1
                if last == tag:
                    if tag in HIDDEN:
                        ends[start] = at
                    break
        elif tag and tag not in VOID:
            foreign = count["svg"] or count["math"]
            if (tag in HIDDEN or foreign) and (m[3] or m[6] or "").endswith("/"):
                continue
            if tag in RAW and not foreign:
                at = _raw_end(page, at, m, tag)
                continue
            stack.append((tag, m.start()))
            count[tag] += 1
    return ends


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order. Unclosed and misnested tags are closed as soon as a surrounding one closes."""
    root = here = _Node("", None, 0, False, 0)
    found: list[Block] = []
    parts: list[str] = []
    links = at = number = 0
    hidden = _hidden(page)

    def say(raw: str) -> None:
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if here.link:
                links += len(text)

    def close_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, links, here.container()))
            parts.clear()
        links = 0

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            close_block()
            return found
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            close_block()
        if m[1] or m[4]:
            node: _Node | None = here
            while node and node.tag != tag:
                node = node.parent
            if node and node is not root:
                here = node.parent or root
            continue
        if tag in RAW:
            at = _raw_end(page, at, m, tag)
            continue
        if tag in HIDDEN:
            at = hidden.get(m.start(), at)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            node = here
            while node.parent and not node.block:
                node = node.parent
            if node.tag == "p" or (node.tag == tag and tag in CLOSED_BY_SAME):
                here = node.parent or root
        number += 1
        here = _open(tag, m[3] or m[6] or "", here, number)


def score(block: Block) -> int:
    """Positive for content: ancestors, length and sentence marks speak for a block, the share of link text against it."""
    n = len(block.text)
    marks = sum(block.text.count(c) for c in ".!?;:")
    linked = min(1.0, block.links / n)
    own = min(200, 2 * n) + 15 * min(marks, 10) - int(500 * linked) - (60 if n < 25 and block.node.tag not in TITLES else 0)
    return block.node.score + own - 120


def _apart(a: _Node, b: _Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def main_text(page: str | None) -> str:
    """The blocks on the content side of the cut, joined by one space; empty for a null or empty page or one without content."""
    found = blocks(page or "")
    scores = [score(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        box = b.node if b.node.tag in ("article", "section", "div", "main", "body", "ul", "ol", "table") or not b.node.parent else b.node.parent
        if i:
            edges.append((i - 1, i, NEXT_TO // max(1, _apart(found[i - 1].node, b.node))))
        if box.number in last and last[box.number] != i - 1:
            edges.append((last[box.number], i, SAME_PARENT))
        last[box.number] = i
    keep = source_side(scores, edges)
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; page by page, without a shuffle.

    A null or empty page has an empty text. Repeated rows give repeated results, null ids and urls stay null, further columns
    are not used, and an empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            rows = zip(batch["html"].to_pylist(), batch["page_id"].to_pylist(), batch["url"].to_pylist(), strict=True)
            for group in batched(rows, 1000):
                texts = [main_text(r[0]) for r in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[1] for r in group], pa.int64()), pa.array([r[2] for r in group], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
