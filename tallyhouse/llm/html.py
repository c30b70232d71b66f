"""Main text of web pages by tree scoring.

The markup is read into a tree with the end tags that authors leave out. Every paragraph
gives points for its length and its commas to its parent, half of them to the grandparent and
a third to the one above; a container's points are then discounted by the share of its text
that lies in links, and moved by the kind of element it is. The best container is the article;
siblings with enough points of their own, or that are long paragraphs of few links, join it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are taken out beforehand, by element or by the words of class, id and role. The text
is that of the blocks in page order: character references decoded, white space inside a block
turned into one blank, blocks joined by a line feed.

On a page without an article, what stands beside the best container stays as well (headings,
lists, quotes, short sections), unless links make up a third of it. Inside an article an id is
an anchor, not a role, and only words that cannot mean a subject take an element out.

Null and empty pages give an empty text, pages without markup their text as one block; repeated
rows give repeated results. Reading takes time in proportion to the page, whatever the markup:
a tag whose quotes never close ends at the next ``>``, as do all tags after it; a ``<`` without
any ``>`` after it is text; an element that ends itself holds nothing, as does one of raw
content without an end tag (but script and style, which then run to the end of the page).
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import append_array, row_slices, with_field

BATCH_CHARS = 4_000_000
# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp noembed noframes".split())
UNWANTED = RAW | frozenset(
    "nav footer header aside form button select option input label dialog menu head object canvas audio video map fieldset annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
CONTAINER_POINTS = {
    "article": 25, "main": 15, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
    "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "th": -5,
}
# An open element of the first name ends where one of the others begins, within its scope.
ENDS = {
    "p": BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "optgroup"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
# The same by the element that begins.
ENDED_BY = {name: frozenset(k for k, v in ENDS.items() if name in v) for name in frozenset().union(*ENDS.values())}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# Words of class, id and role that mark what is not the article, and what may be it all the same.
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|breadcrumbs?|combx|comments?|commentlist|replies|respond|disqus|discuss\w*|"
    r"reader-?comments?|community|contact|cookies?|consent|gdpr|notices?|alert|dialog|popup|modal|overlay|footer|foot|masthead|site-?header|header|"
    r"legal|copyright|menu|menubar|nav\w*|pager|pagination|related|recommend\w*|remark|rss|share\w*|sharing|shoutbox|sidebar|side|widget|social|"
    r"skyscraper|subscribe|newsletter|signup|login|tags?|tool\w*|toc|topbar|search|complementary|contentinfo|form)(?=$|[\s_-])",
    re.I,
)
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|story|post|text|blog|column)(?=$|[\s_-])", re.I)
# Inside an article: words that no subject is named by, anywhere in a class, ...
SURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isements?|ising)?|adsense|sponsor(?:ed|s)?|promo|breadcrumbs?|comments?|commentlist|disqus|shoutbox|cookies?|"
    r"popup|modal|masthead|menubar|navbar|pagination|share|sharing|sidebar|subscribe|newsletter|signup|login|complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
# ... and words that say it only as the whole class or the last part of one.
LAST_WORDS = re.compile(
    r"(?:^|[\s_-])(?:banner|replies|respond|consent|notices?|alert|dialog|overlay|footer|copyright|menu|nav|navigation|pager|related|recommended|"
    r"rss|widget|social|tags|toolbar|toc|topbar|search|form)(?=$|\s)"
    r"|(?:^|\s)(?:related|recommended)[_-](?:articles|posts|stories|links|items|content)(?=$|\s)|(?:^|\s)social[_-](?:links|icons|media|buttons)(?=$|\s)",
    re.I,
)
NAME_END = re.compile(r"[\s/>]")
# What matters while a tag is read: its end, and a value in quotes.
IN_TAG = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("name", "attrs", "parent", "above", "marks", "kids", "chars", "links", "points", "scored")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        # Blocks and elements that end without a tag; the nearest such above, never the page itself.
        self.marks = parent is not None and (name in BLOCK or name in ENDS)
        self.above: Node | None = parent and (parent if parent.marks else parent.above)
        self.kids: list[Node | str] = []
        self.chars = self.links = 0
        self.points, self.scored = 0.0, False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


class Reader:
    """Places in a page; no search is made twice over the same stretch."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.plain = False
        self.found: dict[str, int] = {}

    def next(self, what: str, pos: int) -> int:
        """Next place of a fixed string, or -1; remembered until it is passed."""
        at = self.found.get(what, -2)
        if at == -1 or at >= pos:
            return at
        self.found[what] = at = self.page.find(what, pos)
        return at

    def tag_end(self, pos: int) -> int:
        """Place of the ``>`` that ends a tag, or -1. Values in quotes may hold one."""
        if pos > self.last:
            return -1
        at = pos
        while not self.plain:
            m = IN_TAG.search(self.page, at)
            if m is None:
                # The quotes take in all that is left: from here on they do not count.
                self.plain = True
            elif not m[1]:
                return m.start()
            else:
                at = m.end()
                if at <= self.quotes[m[1]]:
                    at = self.page.find(m[1], at) + 1
        return self.next(">", pos)

    def raw_end(self, name: str, pos: int) -> int:
        """Place after the end tag of a raw element, or -1."""
        at = self.found.get("</" + name, -2)
        if at == -1 or at >= pos:
            return at
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, pos, self.last + 1)
        self.found["</" + name] = at = self.page.find(">", m.end()) + 1 if m else -1
        return at


def parse(page: str) -> Node:
    """Element tree of a page; comments, declarations and the insides of raw elements are left out."""
    root = Node("html", {}, None)
    at, pos, n, reader = root, 0, len(page), Reader(page)
    # Elements that are open, by name.
    opened: dict[str, int] = {}

    def leave(node: Node) -> Node:
        opened[node.name] -= 1
        return node.parent

    begun = 0
    while pos < n:
        lt = page.find("<", pos)
        if lt < 0 or lt > reader.last:
            # No tag is left, but a comment may take in the rest.
            comment = page.find("<!--", max(lt, pos))
            n = comment if lt >= 0 and comment >= 0 else n
            break
        mark, end = page[lt + 1 : lt + 2], -1
        if mark == "!" or mark == "?":
            for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(start, lt):
                    end = reader.next(stop, lt + len(start))
                    end = end + 3 if end >= 0 else n if start == "<!--" else -1
            if end < 0:
                end = reader.next(">", lt) + 1
        elif mark.isascii() and mark.isalpha():
            end = reader.tag_end(lt + 1) + 1
        elif mark == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha():
            end = reader.next(">", lt) + 1
        if end <= 0:
            pos = lt + 1
            continue
        if lt > begun:
            at.kids.append(html.unescape(page[begun:lt]))
        pos = begun = end
        if mark in "!?":
            continue
        source = page[lt + 1 : end - 1]
        if mark == "/":
            name = NAME_END.split(source[1:], maxsplit=1)[0].lower()
            # An end tag without an open element is ignored; body and html stay open to the end.
            if opened.get(name):
                while at.name != name:
                    at = leave(at)
                at = leave(at)
            continue
        name = NAME_END.split(source, maxsplit=1)[0].lower()
        rest = source[len(name) :]
        if name in ("html", "body"):
            root.attrs |= _attributes(rest)
            while at is not root:
                at = leave(at)
            continue
        if name in RAW:
            lasts = name in ("script", "style")
            if lasts or not rest.endswith("/"):
                after = reader.raw_end(name, pos)
                pos = begun = after if after >= 0 else n if lasts else pos
            continue
        ended = _close_open(at, name, opened)
        while at is not ended:
            at = leave(at)
        node = Node(name, _attributes(rest) if rest.strip() else {}, at)
        at.kids.append(node)
        if name not in VOID and not rest.endswith("/"):
            opened[name] = opened.get(name, 0) + 1
            at = node
    if begun < n:
        at.kids.append(html.unescape(page[begun:n]))
    return root


def _close_open(at: Node, name: str, opened: dict[str, int]) -> Node:
    """Where an element begins, once those that it ends are closed."""
    if not any(opened.get(x) for x in ENDED_BY.get(name, ())):
        return at
    node = at if at.marks else at.above
    while node is not None:
        if name in ENDS.get(node.name, ()):
            at = node.parent
        elif name in SCOPE and node.name in SCOPE[name] or (node.name in BLOCK and node.name not in ENDS):
            break
        node = node.above
    return at


def _unwanted(node: Node, inside: bool) -> bool:
    """Whether an element is not the article, by its name or its words."""
    if node.name in UNWANTED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", node.attrs.get("style", ""), re.I):
        return True
    if inside:
        words = f"{node.attrs.get('class', '')} {node.attrs.get('role', '')}".strip()
        return bool(SURE_WORDS.search(words) or LAST_WORDS.search(words))
    words = " ".join([node.attrs.get(k, "") for k in ("class", "id", "role")]).strip()
    if not words or node.name in ("article", "main") and not node.attrs.get("role"):
        return bool(words) and bool(SIDE_WORDS.search(words)) and not MAIN_WORDS.search(words)
    return bool(SIDE_WORDS.search(words)) and not (MAIN_WORDS.search(words) and not re.search(r"comment|sidebar|footer|nav|menu|ad\b", words, re.I))


def prune(root: Node) -> None:
    """Take out what is not the article by its element or its words, from the top down."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.name in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _unwanted(k, inside)]
        stack.extend([(k, inside) for k in node.kids if not isinstance(k, str)])


def _nodes(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend([k for k in reversed(node.kids) if not isinstance(k, str)])
    return out


def _own_text(node: Node) -> str:
    """Text of a paragraph without the blocks inside it."""
    parts, stack = [], [*reversed(node.kids)]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif k.name not in BLOCK:
            stack.extend(reversed(k.kids))
    return SPACE.sub(" ", "".join(parts)).strip()


def score(root: Node) -> Node:
    """The container with the most points."""
    nodes = _nodes(root)
    for node in reversed(nodes):
        node.chars = sum([len(k.strip()) if isinstance(k, str) else k.chars for k in node.kids])
        node.links = node.chars if node.name == "a" else sum([k.links for k in node.kids if not isinstance(k, str)])
    for node in nodes:
        paragraph = node.name in PARAGRAPH or node.name in ("div", "section", "article", "main", "html")
        text = _own_text(node) if paragraph else ""
        if not text:
            continue
        points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)
        above, share = (node if node.name not in PARAGRAPH else node.parent or node), 1.0
        for step in (1.0, 0.5, 1 / 3):
            if above is None:
                break
            if not above.scored:
                above.scored = True
                above.points += CONTAINER_POINTS.get(above.name, 0)
            share = step
            above.points += points * share
            above = above.parent
    best = root
    for node in nodes:
        if node.scored and _final(node) > _final(best):
            best = node
    # The article is the outermost element that says it is one, around the best container.
    above = best
    while above is not None:
        if above.name in ("article", "main"):
            best = above
        above = above.parent
    return best


def _final(node: Node) -> float:
    """Points, discounted by link density."""
    return node.points * (1 - node.links / node.chars) if node.chars else node.points


def _belongs(run: list[Node | str]) -> bool:
    """Whether there is text, and links are less than a third of it."""
    chars = sum([len(k.strip()) if isinstance(k, str) else k.chars for k in run])
    return 3 * sum([0 if isinstance(k, str) else k.links for k in run]) < chars


def _beside(inner: Node) -> list[list[Node | str]]:
    """The children around an element: blocks alone, text and inline elements in runs."""
    runs: list[list[Node | str]] = []
    open_run = False
    for k in inner.parent.kids:
        inline = k is not inner and (isinstance(k, str) or k.name not in BLOCK)
        if inline and open_run:
            runs[-1].append(k)
        else:
            runs.append([k])
        open_run = inline
    return runs


def _members(best: Node) -> list[Node | str]:
    """The article and the siblings that belong to it, in page order.

    Beside the best container all that has text and few links belongs to it; beside the
    containers around it, and beside an element that says it is the article, only what has
    points enough of its own, or is a paragraph of few links.
    """
    least, chosen, inner = max(10.0, 0.2 * _final(best)), [best], best
    said = best.name in ("article", "main")
    while inner.parent is not None and not (said and inner is not best):
        around: list[Node | str] = []
        for run in _beside(inner):
            k = run[0]
            if k is inner:
                around += chosen
            elif inner is best and not said:
                around += run if _belongs(run) else []
            elif not isinstance(k, str):
                paragraph = k.name == "p" and _belongs(run) and (k.chars > 80 or not k.links and "." in _own_text(k))
                around += [k] if k.scored and _final(k) >= least or paragraph else []
        inner, chosen = inner.parent, around
    return chosen


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks below some elements, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [(top, False)]
        while stack:
            k, left = stack.pop()
            if isinstance(k, str):
                parts.append(k)
            elif left or k.name == "hr":
                flush()
            elif k.name == "br":
                parts.append(" ")
            else:
                if k.name in BLOCK:
                    flush()
                    stack.append((k, True))
                stack.extend([(x, False) for x in reversed(k.kids)])
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as text."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(_members(score(root))))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col``, in map tasks."""
    pages = pages.drop(out_col) if out_col in pages.columns else pages
    schema = with_field(pages, out_col, T.StringType())
    keep = schema.names[:-1]

    def run(batches):
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index(html_col)).to_pylist()
            for a, b in row_slices([len(s or "") for s in sources], BATCH_CHARS):
                texts = pa.array([main_text(s) for s in sources[a:b]], pa.string())
                yield append_array(batch.slice(a, b - a), keep, out_col, texts)

    return pages.mapInArrow(run, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page its main text and the number of its code points."""
    rows = extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
