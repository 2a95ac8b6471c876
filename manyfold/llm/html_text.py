"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by the
share of text in links; the container with the most points and the siblings that look
like it are kept, without the parts that are no article by their tag, role or name. Points decide about names as
well: a part with a name that may mean anything, as header does, stays if it holds half of all points.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyfold.llm.common import slices, table

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas audio video select".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: What an opening tag ends, up to the elements that stop the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("html body table td th caption button".split())

DROPPED_TAGS = frozenset("nav header footer aside form button fieldset head dialog menu".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAME = r"(?:^|[\s_-])(?:%s)(?=$|[\s_\d-])"
#: Names of what is no article wherever it stands.
FOREIGN = re.compile(_NAME % r"ads?|adverts?|advertisements?|advertising|adsense|adsbygoogle|sponsor(?:ed|s)?|promo(?:tion)?s?|nav(?:bar|igation)?|breadcrumbs?|side-?bars?|cookies?|consent|gdpr|newsletter|subscribe|signup|comments?|commentlist|disqus|shar(?:e|ing)|social|pagination|pager|login", re.I)
#: Names that can also mean a part of the article: they count on containers only, and only if these don't hold half of all points.
DOUBTFUL = re.compile(_NAME % r"banners?|menus?|header|masthead|footer|aside|notices?|notifications?|popups?|modals?|overlay|respond|repl(?:y|ies)|related|recommend(?:ed|ations)?|widgets?|toolbar|search", re.I)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody caption figcaption".split())
#: Names that say how a page is laid out, not what an element is: with-sidebar is no sidebar.
MODIFIER = re.compile(r"^(?:has|with|no|is|layout)[_-]", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
GOOD_NAMES = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
PARAGRAPHS = frozenset("p pre td blockquote section h2 h3 h4 h5 h6 div li".split())
LEAST_PARAGRAPH = 25
#: Ancestors that a paragraph's points go to, with their shares, and points for what a container is.
SHARES = (1.0, 1 / 2, 1 / 6)
NAMED, ARTICLE, BLOCK = 25, 25, 5
#: Of the best score, what a sibling must reach, and what a name in common counts; texts in links that a lone paragraph may hold.
ALIKE, SAME_NAME, LINKED = 0.2, 0.2, 0.25


class Node:
    __slots__ = ("tag", "names", "role", "parent", "children", "dropped", "score", "earned", "chars", "linked", "commas", "direct", "points")

    def __init__(self, tag: str, names: str, role: str, parent: Node | None):
        self.tag, self.names, self.role, self.parent, self.children, self.dropped = tag, names, role, parent, [], False
        self.score, self.earned, self.points = 0.0, 0.0, 0.0
        self.chars = self.linked = self.commas = self.direct = 0


def _foreign(node: Node) -> bool:
    if node.tag in DROPPED_TAGS or node.role in DROPPED_ROLES:
        return True
    return node.tag not in ("html", "body", "article", "main") and bool(node.names and FOREIGN.search(node.names))


def _doubtful(node: Node) -> bool:
    return bool(node.names) and node.tag not in TEXTUAL and node.tag in BLOCKS and node.tag not in ("html", "body", "article", "main") and bool(DOUBTFUL.search(node.names))


class _Ends:
    """Where tags end, in time that grows with the page whatever it holds."""

    def __init__(self, source: str):
        self.source, self.known, self.missing, self.plain = source, {}, set(), -2

    def find(self, what: str, at: int) -> int:
        """As str.find, but what isn't there is looked for once."""
        if what in self.missing:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, at: int) -> int:
        """The place of the tag's >, quoted ones left out if that leaves any; -1 if there is none."""
        if self.plain != -1 and self.plain < at:
            self.plain = self.source.find(">", at)
        if self.plain < 0:
            return -1
        path, here = [], at
        while True:
            m = QUOTE_OR_END.search(self.source, here)
            place = m.start() if m else -1
            if place < 0 or place in self.known or m.group() == ">":
                end = self.known.get(place, place)
                break
            path.append(place)
            close = self.find(m.group(), place + 1)
            here = close + 1 if close >= 0 else place + 1
        for place in path:
            self.known[place] = end
        return end if end >= 0 else self.plain


def parse(source: str) -> Node:
    """A tree of elements and strings; what isn't closed ends where its parent or its like begins."""
    root = Node("html", "", "", None)
    stack, ends, raw_missing = [root], _Ends(source), set()
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag
    blocks = [0]  # places of the open elements that aren't inline
    places["html"].append(0)

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            places[node.tag].pop()
            if node.tag in BLOCKS:
                blocks.pop()

    def close_like(tags: Iterable[str], stops: Iterable[str]) -> None:
        own = max((places[t][-1] for t in tags if places[t]), default=-1)
        if own > max((places[t][-1] for t in stops if places[t]), default=0):
            close(own)

    at, n, begun = 0, len(source), 0
    while at < n:
        here = source.find("<", at)
        if here < 0 or here + 1 >= n:
            break
        sign = source[here + 1]
        closing = sign == "/"
        name = TAG_NAME.match(source, here + 1 + closing)
        if name is None and sign not in "!?/":
            at = here + 1
            continue
        if source.startswith("<!--", here):
            end = ends.find("-->", here + 4)
            end = n if end < 0 else end + 2
        elif name is None:
            end = ends.find(">", here)
        else:
            end = ends.tag(name.end())
        if end < 0:  # no tag ends from here on
            break
        if here > begun:
            stack[-1].children.append(source[begun:here])
        at = begun = end + 1
        if name is None:
            continue
        tag = name.group().lower()
        if closing:
            if tag == "br":
                stack[-1].children.append(Node("br", "", "", stack[-1]))
            elif places[tag] and places[tag][-1] and not (tag not in BLOCKS and blocks[-1] > places[tag][-1]):
                close(places[tag][-1])
            continue
        if places["head"] and tag not in HEAD:
            close(places["head"][-1])
        if tag in ("html", "body"):
            if tag == "html" or len(stack) > 1:
                continue
        elif tag in BLOCKS:
            close_like(("p",), SCOPE)
        if tag in ENDS:
            close_like(*ENDS[tag])
        attributes = source[name.end() : end]
        node = _open(stack[-1], tag, attributes)
        if tag in RAW:
            if tag == "svg" and attributes.rstrip().endswith("/"):
                continue
            found = None if tag in raw_missing else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if found:
                at = begun = found.end()
                continue
            raw_missing.add(tag)
            if tag in ("script", "style"):
                begun = n
                break
        if tag not in VOID:
            places[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
    if begun < n:
        stack[-1].children.append(source[begun:])
    return root


def _open(parent: Node, tag: str, attributes: str) -> Node:
    names, role, hidden = [], "", False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names.append(value)
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    names = [HUMP.sub("-", x) for n in names for x in n.split() if not MODIFIER.match(x)]
    node = Node(tag, " ".join(names), "dialog" if hidden else role, parent)
    parent.children.append(node)
    return node


def _blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks under ``tops`` in page order, references decoded, white space made one space."""
    out, now = [], []

    def flush() -> None:
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            now.clear()
            if text:
                out.append(text)

    for top in tops:
        stack: list = [top]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                now.append(node)
            elif node.tag == "br":
                now.append("\n")
            elif node is top or not node.dropped:
                if node.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack.extend(reversed(node.children))
        flush()
    return out


def _kept(root: Node, dropped) -> list[Node]:
    """The elements that ``dropped`` leaves, in page order; marks the others."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        for c in reversed(node.children):
            if not isinstance(c, str):
                c.dropped = dropped(c)
                if not c.dropped:
                    stack.append(c)
    return order


def _measure(order: list[Node]) -> None:
    """Characters, those in links, commas, those in no inner block, and paragraphs' points, bottom up."""
    for node in reversed(order):
        node.chars = node.linked = node.commas = node.direct = 0
        node.points = 0.0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                node.chars += n
                node.direct += n
                node.commas += c.count(",")
            elif not c.dropped:
                node.chars += c.chars
                node.linked += c.chars if c.tag == "a" else c.linked
                node.commas += c.commas
                node.direct += c.direct if c.tag not in BLOCKS else 0
                node.points += c.points
        if _is_paragraph(node):
            node.points += _points(node)


def _is_paragraph(node: Node) -> bool:
    return node.tag in PARAGRAPHS and node.direct >= LEAST_PARAGRAPH


def _points(node: Node) -> float:
    return 1 + node.commas + min(node.chars / 100, 3)


def _score(order: list[Node]) -> list[Node]:
    """Gives points to the containers and returns them in page order."""
    scored = set()
    for node in order:
        if not _is_paragraph(node):
            continue
        up, level = node.parent, 0
        while up is not None and level < len(SHARES):
            if up.tag in BLOCKS:
                if up not in scored:
                    scored.add(up)
                    up.score = NAMED * bool(up.names and GOOD_NAMES.search(up.names)) + ARTICLE * (up.tag in ("article", "main") or up.role == "main") + BLOCK * (up.tag in ("div", "section"))
                up.earned += _points(node) * SHARES[level]
                level += 1
            up = up.parent
    found = [n for n in order if n in scored]
    for node in found:
        text = 1 - node.linked / max(node.chars, 1)
        node.earned *= text
        node.score = node.score * text + node.earned
    return found


def scored_tree(source: str) -> tuple[Node, list[Node]]:
    """The page's tree and its containers with scores, in page order."""
    root = parse(source)
    _measure(_kept(root, _foreign))
    half = root.points / 2
    held = {}  # points before the doubtful parts go

    def dropped(node: Node) -> bool:
        return _foreign(node) or (_doubtful(node) and not held[node] >= half > 0)

    stack = [root]
    while stack:
        node = stack.pop()
        held[node] = 0.0 if node.dropped else node.points
        stack.extend(c for c in node.children if not isinstance(c, str))
    order = _kept(root, dropped)
    _measure(order)
    return root, _score(order)


def main_text(source: str | None) -> str:
    """The article's blocks joined by one space; empty if there is none.

    Of equal scores the outermost container, first in the page, wins. Without a paragraph that scores, the
    first article or main element is taken, else the whole page.
    """
    if not source:
        return ""
    root, found = scored_tree(source)
    best = max(found, key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        stack = [root]
        while stack:
            node = stack.pop()
            if node.tag in ("article", "main"):
                return " ".join(_blocks([node]))
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
        return " ".join(_blocks([root]))
    if best.parent is None:
        return " ".join(_blocks([best]))
    return " ".join(_blocks([c for c in best.parent.children if not isinstance(c, str) and (c is best or not c.dropped and _alike(c, best))]))


def _alike(node: Node, best: Node) -> bool:
    """A sibling of the best container that belongs to it: by its paragraphs' points and its name, or as a heading, paragraph or list that isn't mostly links."""
    if node.earned + (SAME_NAME * best.score if node.names and node.names == best.names else 0) >= max(10.0, ALIKE * best.score):
        return True
    return node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure") and 0 < node.chars and node.linked / node.chars < LINKED


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) per row. Null and empty pages have an empty text; repeated rows and ids
    give a row each; other columns are ignored; whole pages are read, whatever their length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pages in slices(_as_pairs(batches), 4_000_000):
            ids, urls = [r["page_id"] for r in rows], [r["url"] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([main_text(p) for p in pages], pa.string())], ["page_id", "url", "text"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string")


def _as_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([b.column(0), b.column(1)], ["page_id", "url"]), b.column(2)], ["row", "html"])


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
