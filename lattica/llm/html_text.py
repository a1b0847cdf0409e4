"""Main text of web pages by tree scoring.

A tolerant parser builds a tree from the whole page. Boilerplate goes: by element, by role, and by
class names that say so plainly. Each paragraph has points for its length and its commas; it passes
them to its parent, and ever smaller shares to further ancestors. A container's score is the sum of
what it got, plus a bonus for its kind, times one less its link density; what is merely named like
boilerplate ("legal", "tags", "related") has no part in this. Where the best container lies in an
article (or else in a main element), that element is kept; else the best container. With it
go those of its siblings that score well or are long prose. Of what is kept everything stays but the
plain boilerplate: lists of links, formulas and parts of any other name included. Only where the
page has no container below its body are lists of links and parts with doubtful names left out. The
text blocks, in page order, are the result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form iframe object embed button select option textarea input label fieldset "
    "svg canvas audio video dialog menu title xmp noembed noframes annotation annotation-xml".split()
)
#: A start tag ends an open element of these kinds, unless one of ``SCOPE`` stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div article section main td th blockquote select aside header footer nav form".split())
PARAGRAPH = frozenset("p pre td blockquote li dd details figcaption h1 h2 h3 h4 h5 h6 div section article main".split())
CONTAINER_BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 3.0, "blockquote": 1.0, "td": 1.0, "pre": 1.0}
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
_WORD = r"(?:^|[\s_-])(?:%s)(?:$|[\s_\d-])"
#: Class names of boilerplate wherever it stands.
PLAIN = (
    r"ads?|adverts?|advertisements?|advertising|adsense|sponsored|promos?|cookies?|consent|gdpr|notices?|popups?|modals?|overlays?|comments?|commentlist|respond|replies|disqus|"
    r"menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|sidebars?|footers?|masthead|share|sharing|subscribe|newsletters?|signup|taboola|outbrain|shoutbox"
)
#: Names by which a part outside of the article is doubted.
DOUBTED = (
    r"sponsors?|promotion|banners?|alerts?|reply|discussion|remarks?|rail|widgets?|headers?|topbar|colophon|copyright|legal|social|subscription|login|search|forms?|"
    r"related|recommend(?:ed|ations?)?|popular|trending|skip|toolbar|tools|tags?"
)
BOILERPLATE, UNLIKELY = re.compile(_WORD % PLAIN, re.I), re.compile(_WORD % f"{PLAIN}|{DOUBTED}", re.I)
#: An id made up of such words alone.
BOILERPLATE_ID = re.compile(rf"(?:(?:{PLAIN}|{DOUBTED}|thread|area|section|list|box|wrapper|container|site|page|main|top|bottom|left|right)(?:[\s_\d-]+|$))+", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text)(?:$|[\s_\d-])", re.I)
SHARES = (1.0, 0.5, 1 / 3, 1 / 6, 1 / 9)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")


class Node:
    __slots__ = ("doubted", "gone", "length", "link", "names", "parent", "parts", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, names: str = "", gone: bool = False, doubted: bool = False):
        self.tag, self.parent, self.names, self.gone, self.doubted = tag, parent, names, gone, doubted
        self.parts: list[Node | str] = []
        self.points, self.length, self.link = 0.0, 0, 0


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /") else {}


def _above(node: Node | None, tags: frozenset[str]) -> bool:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node is not None


_ARTICLE, _QUOTE, _HEADER = frozenset(("article", "main")), frozenset(("blockquote",)), frozenset(("header",))


def _is_gone(tag: str, attrs: dict[str, str], parent: Node) -> bool:
    """Whether the element is boilerplate wherever it stands."""
    if tag in ("html", "body"):
        return False
    if tag == "header" and _above(parent, _ARTICLE):
        return False  # the article's own: its headings stay
    if tag == "footer" and _above(parent, _QUOTE):
        return False  # whom the quotation is from
    if tag in DROPPED:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    names, name = attrs.get("class", ""), attrs.get("id", "")
    if tag in _ARTICLE and LIKELY.search(names) and not re.search(r"comment|repl", names, re.I):
        return False
    return bool(names and BOILERPLATE.search(names) or name and tag not in HEADINGS and BOILERPLATE.search(name) and BOILERPLATE_ID.fullmatch(name))


def parse(page: str) -> Node:
    """Tree of the page. Unclosed and stray tags, comments and references are tolerated."""
    root = Node("html", None)
    at, size, top = 0, len(page), root
    lower, last, tag_at = None, page.rfind(">"), _TAG.match
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            top.parts.append(html.unescape(page[at:]))
            break
        if lt > at:
            top.parts.append(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        if lt > last:
            top.parts.append(html.unescape(page[lt:]))
            break
        m = tag_at(page, lt)
        if not m and tag_at == _TAG.match and _LOOSE_TAG.match(page, lt):
            tag_at = _LOOSE_TAG.match  # a quotation that never ends: from here on quotes mean nothing
            m = tag_at(page, lt)
        if not m:
            top.parts.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            node: Node | None = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            closes = ENDS.get(tag, frozenset())
            node = top
            while node is not None and node.tag not in SCOPE | closes and node.tag != "p":
                node = node.parent
            if node is not None and node.parent is not None and (node.tag == "p" or node.tag in closes):
                top = node.parent
                if tag == "tr" and node.tag != "tr" and top.tag == "tr" and top.parent is not None:
                    top = top.parent
        attrs = _attributes(m[3])
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        doubted = bool(names and tag not in ("body", "article", "main") and UNLIKELY.search(names) and not _above(top, _ARTICLE))
        node = Node(tag, top, names, _is_gone(tag, attrs, top), doubted)
        top.parts.append(node)
        if tag in _ARTICLE and not node.gone:
            above = top  # what holds an article is no mere part
            while above is not None:
                above.doubted = False
                above = above.parent
        if tag in RAW:
            lower = lower or page.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == size else page.find(f"</{tag}", at)
            if end < 0:
                at = size
            else:
                close = page.find(">", end)
                at = size if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            top = node
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that are neither gone nor doubted, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.gone and not x.doubted)
    return out


def _own_text(node: Node) -> str:
    """Text of the node's own block: what stands in inline elements counts, inner blocks don't."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not x.gone and x.tag not in BLOCK:
            todo.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def _density(node: Node) -> float:
    return node.link / node.length if node.length else 0.0


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        node.length = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
    for node in reversed(nodes):
        if node.tag == "a":
            node.link = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.link += node.link
    for node in nodes:
        if node.tag not in PARAGRAPH:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - min(1.0, _density(node)))
        if node.tag in ("div", "section", "article", "main"):
            node.points += points / 2
        above = node.parent
        for share in SHARES:
            if above is None:
                break
            above.points += points * share
            above = above.parent


def _value(node: Node) -> float:
    bonus = CONTAINER_BONUS.get(node.tag, 0.0) + (10.0 if node.names and LIKELY.search(node.names) else 0.0)
    return (node.points + bonus) * (1 - _density(node)) if node.points else 0.0


def _is_link_list(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and _density(node) > 0.6


def _article(node: Node) -> Node | None:
    """The outermost article about the node or, without one, the outermost main element."""
    found: dict[str, Node] = {}
    x: Node | None = node
    while x is not None:
        found[x.tag] = x
        x = x.parent
    return found.get("article") or found.get("main")


def _blocks(node: Node, out: list[str], whole: bool) -> None:
    """Adds the node's text blocks in page order; those of lists of links and of doubted parts only
    if it is ``whole``. Of a header no more than the headings count."""
    line: list[str] = []

    def close() -> None:
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    todo: list = [(node, False)]
    while todo:
        x, bare = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if not bare:
                line.append(x)
        elif x is node or not x.gone and (whole or not x.doubted and not _is_link_list(x)):
            if x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                close()
                todo.append((None, False))
            bare = x.tag not in HEADINGS and (bare or x.tag == "header" and x is not node)
            todo.extend((y, bare) for y in reversed(x.parts))
    close()


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by line feeds; empty for null, empty or textless pages."""
    if not page:
        return ""
    nodes = _walk(parse(page))
    _score(nodes)
    order = {id(x): i for i, x in enumerate(nodes)}
    inner = [x for x in nodes if x.tag in CONTAINER_BONUS or x.tag in ("body", "html", "center", "table", "tr", "ul", "ol", "dl")]
    best = max(inner, key=lambda x: (_value(x), -order[id(x)]))
    out: list[str] = []
    if not _value(best):
        longest = max((x for x in nodes if x.tag in _ARTICLE), key=lambda x: x.length, default=nodes[0])
        best = longest if longest.length else nodes[0]
        _blocks(best, out, best is not nodes[0])
        return "\n".join(out)
    value = _value(best)
    best = _article(best) or best
    above = best.parent
    if above is None or best.tag == "body":
        _blocks(best, out, False)
        return "\n".join(out)
    for x in above.parts:
        if x is best:
            _blocks(x, out, True)
        elif isinstance(x, Node) and not x.gone and not x.doubted and x.tag in BLOCK and not _is_link_list(x):
            text = _own_text(x) if x.tag == "p" else ""
            same = x.tag == best.tag and x.names == best.names and x.tag == "article"
            if same or _value(x) >= max(30.0, 0.4 * value) or len(text) > 80 and _density(x) < 0.25:
                _blocks(x, out, True)
    return "\n".join(out)


def _extract_partition(batches):
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars in code points.

    A null html counts as empty. Rows repeat as they do in ``pages``; other columns are not
    carried. The whole page is parsed, whatever its length or depth. An empty table gives no rows.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        _extract_partition, "page_id long, url string, text string, n_chars long"
    )
