"""Main text of HTML pages by composite text density.

Every element of the page's tree gets the number of its characters, of characters inside links, of tags and
of link tags.  Its density is ``chars/tags * log_b((chars/link_chars) * (tags/link_tags))`` with the base
``b = ln(chars/plain_chars * link_chars + body_link_chars/body_chars * chars + e)``: long plain text scores high, lists
of links low.  The density sum of an element is the sum of its children's densities (text that stands in it directly
is a child of one tag).  Starting at the element with the greatest sum, the least density on the path up to the body is
the threshold: the content is the highest element on that path beside which stands other text that reaches the
threshold, less the blocks in it that do not reach the threshold and are lists of links or marked as no article.

Elements that the page itself marks as something else (``nav``, ``footer``, a class ``ad`` and the like) are not removed
by name: their densities, and those of all that they hold, are multiplied by ``DOUBT``.  A mark on an element around a
headline, an article or a main element is no sign of that.  Only elements that never show text are left out at once.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, slices

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "html", "body"}
#: An opening tag ends these open elements, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements whose content is not shown as text.
NO_TEXT = frozenset("script style noscript template head title textarea select option datalist button iframe object embed audio video canvas svg math input".split())
#: Elements and words (a class, an id or a role, or its beginning up to a hyphen) that mark what is beside an article, and what such a mark makes of densities.
BESIDE = frozenset("nav footer aside form dialog menu".split())
MARKS = frozenset("ad ads advert advertisement banner sponsored promo cookie cookies consent notice alert popup modal nav navigation menu breadcrumb breadcrumbs sidebar footer toolbar comment comments replies share social related newsletter subscribe pagination complementary contentinfo search".split())
DOUBT = 0.02
#: Links that make a block a list of links, and the share of its characters that they must hold.
LINKS, LINK_SHARE = 3, 0.7
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/>]|$)", re.I | re.S)
_SPACE = re.compile(r"\s+")


class _Node:
    __slots__ = ("tag", "parent", "children", "skip", "doubt", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, skip: bool = False, doubt: bool = False) -> None:
        self.tag, self.parent, self.skip, self.doubt = tag, parent, skip, doubt
        self.children: list[_Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _hidden(attributes: str) -> bool:
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def _marked(attributes: str) -> bool:
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role") and any(re.split("[-_]", w, maxsplit=1)[0] in MARKS for w in (a or b or c).lower().split()):
            return True
    return False


def parse(page: str) -> _Node:
    """The page's tree; tags that are never closed end where the standard has them end, or with their parent."""
    root = node = _Node("#root", None)
    at, n = 0, len(page)
    find = _TAG.search
    while at < n:
        m = find(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(entities.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        if at == n and not m[0].endswith(">") and (loose := _LOOSE.match(page, m.start())) and loose.end() < n:
            m, at = loose, loose.end()  # a quote in the tag that is never closed
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            up = node
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                node = up.parent
            elif tag == "p":
                node.children.append(_Node("p", node))
            elif tag == "br":
                node.children.append(_Node("br", node))
            continue
        if tag in CLOSES_P or tag in ENDS:
            ended, until = ENDS.get(tag, (set(), set()))
            up = node
            while up.parent is not None and up.tag not in until and up.tag not in ("article", "section", "main", "body", "div", "td", "th", "button", "table"):
                if up.tag in ended or (up.tag == "p" and tag in CLOSES_P):
                    node = up.parent
                    break
                up = up.parent
            if tag in ("td", "th") and node.tag in ("td", "th"):
                node = node.parent
        new = _Node(tag, node, tag in NO_TEXT or bool(attributes) and tag not in ("html", "body") and _hidden(attributes), tag in BESIDE or tag == "header" or bool(attributes) and _marked(attributes))
        if tag in ("h1", "article", "main"):
            # what holds these is not beside the article, whatever its class says; a header is part of it inside an article only
            ancestors = []
            while (up := ancestors[-1].parent if ancestors else node) is not None:
                ancestors.append(up)
            inside = False
            for up in reversed(ancestors):
                up.doubt = up.doubt and (up.tag in BESIDE or up.tag == "header" and not inside)
                inside = inside or up.tag in ("article", "main")
        if tag in ("article", "main", "html", "body"):
            new.doubt = False
        node.children.append(new)
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag in ("textarea", "title"):
                new.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        node = new
    return root


def _walk(root: _Node) -> list[_Node]:
    """All nodes that may hold article text, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if type(c) is _Node and not c.skip)
    return out


def _composite(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is that of the body's characters which stand in links."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    # a base of 1 (no link on the page) would make the logarithm endless
    scale = math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)) / math.log(base) if base > 1.0 + 1e-9 else math.log(chars + 1.0)
    return chars / max(tags, 1) * max(scale, 0.0)


def _measure(nodes: list[_Node], body: _Node) -> None:
    """Counts, densities and density sums of ``nodes`` (parents first)."""
    direct = {}
    for node in reversed(nodes):
        own = 0
        for c in node.children:
            if type(c) is str:
                own += len(c) - c.count(" ") - c.count("\n")
            elif not c.skip:
                node.chars += c.chars
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.tags += 1 + c.tags
                node.link_tags += (c.tag == "a") + c.link_tags
        node.chars += own
        direct[node] = own
    share = body.link_chars / max(body.chars, 1)
    weight = {None: 1.0}
    for node in nodes:
        weight[node] = weight.get(node.parent, 1.0) * (DOUBT if node.doubt else 1.0)
        node.density = weight[node] * _composite(node.chars, node.link_chars, node.tags, node.link_tags, share)
    for node in nodes:
        node.total = sum(c.density for c in node.children if type(c) is _Node and not c.skip) + weight[node] * _composite(direct[node], 0, 1, 0, share)


def content_of(root: _Node) -> tuple[_Node, float]:
    """The subtree that holds the article, and the threshold."""
    nodes = _walk(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    _measure(nodes, body)
    inside, at = [], [body]
    while at:
        inside.append(x := at.pop())
        at.extend(c for c in x.children if type(c) is _Node and not c.skip)
    best = max(inside, key=lambda x: x.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    top = best
    for k, parent in enumerate(path[1:], 1):
        beside = [c for c in parent.children if c is not path[k - 1] and type(c) is _Node and not c.skip and c.chars and not c.doubt]
        # text as dense as the sparsest element of the path, a headline, or nothing but the path itself
        if any(c.density >= threshold and not _links(c) or c.tag in ("h1", "h2") for c in beside) or parent.chars == path[k - 1].chars:
            top = parent
    return top, threshold


def _links(node: _Node) -> bool:
    """Whether a block is a list of links."""
    return node.tag in BLOCKS and node.tag != "p" and node.link_tags >= LINKS and node.link_chars >= LINK_SHARE * node.chars


def blocks_of(node: _Node, threshold: float = 0.0) -> list[str]:
    """Texts of the blocks in page order, white space inside each made one space; without what is sparser than ``threshold`` and marked, or a list of links."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if text := _SPACE.sub(" ", entities.unescape("".join(run))).strip():
                out.append(text)
            run.clear()

    stack: list[_Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif type(x) is str:
            run.append(x)
        elif x is node or not x.skip and not (x.density < threshold and (x.doubt or _links(x))):
            block = x.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def extract(page: str | None) -> str:
    """The main text; empty if there is none."""
    if not page or not page.strip():
        return ""
    return " ".join(blocks_of(*content_of(parse(page))))


def main_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points).

    Defined cases: null, empty and tag-free-white-space pages have an empty text; a page without tags is its own text;
    of elements of equal density sums the first in page order counts; repeated rows are treated alike; columns of the new
    names that exist push underscores before the new ones; an empty table gives an empty result.  A page is one tree in
    memory, however long it is.
    """
    text, n = free_name(pages, "text"), free_name(pages, "n_chars")
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType()), T.StructField(n, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_col, 8_000_000):
            found = [extract(x) for x in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*part.schema.names, text, n])

    return pages.mapInArrow(run, schema)
