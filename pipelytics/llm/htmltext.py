"""Main text of web pages by removal of site templates.

Pages are read into a light tree. The subtrees of a page are hashed, and Spark
counts on how many pages of a host, with different main texts, each occurs. A
subtree that many of them share is template and goes, along with elements whose
tag, role, class or id says that they are no article text. What a page declares
as its article is read; other pages are read as a whole, and so are those whose
only articles stand in a comment section, a side bar or the like. Paragraphs and
headings of a declared article are never taken for template, nor are elements
around them, since articles quote one another.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import add_columns

# Element names of the HTML standard, by how they behave here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
DROPPED = RAW | {
    "head", "nav", "footer", "aside", "form", "svg", "math", "canvas", "object", "audio", "video", "button", "select",
    "datalist", "template", "dialog", "menu",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements of running text, safe from template removal inside a declared article.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "figcaption"}
#: Elements whose text is a link or a control; an ``a`` is one if it leads somewhere.
CONTROLS = {"a", "label", "option", "summary"}
#: An open element that a start tag closes, and the elements at which the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
#: Words in a class or id that mark what is no article text.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "footer", "comment", "comments", "disqus", "share", "sharing", "social", "related", "newsletter",
    "subscribe", "subscription", "signup", "popup", "modal", "overlay", "widget", "toolbar", "pagination", "pager", "skip",
    "login", "masthead",
}
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>?|<[!?/][^>]*+>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|href|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_LETTER = re.compile(r"[^\W_]")
_MARK = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


#: How a subtree is judged, see ``Page.subtrees`` and ``templates``.
BULK, LINE, BOX = 0, 1, 2


class Node:
    #: ``size``: characters of text that no marked element holds; ``words``: has text of its own or below that is neither marked nor a link or control; ``prose``: in running text.
    __slots__ = ("tag", "attributes", "children", "hash", "main", "marked", "size", "words", "prose")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hash, self.main = b"", False
        self.marked = self.words = self.prose = False
        self.size = 0


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and "hidden" not in raw:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def parse(source: str) -> Node:
    """The tree of a page. Anything is accepted; missing end tags are supplied as browsers would for common cases."""
    root = Node("", {})
    stack = [root]
    # Where the open elements of a name stand in the stack, and where those that are not inline do:
    # a tag then costs what it closes, however many elements are open.
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []

    def close(length: int) -> None:
        while len(stack) > length:
            places[stack.pop().tag].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    at, end = 0, len(source)
    lowered = None
    while at < end:
        tag = _TAG.search(source, at)
        if tag is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if tag.start() > at:
            stack[-1].children.append(html.unescape(source[at : tag.start()]))
        at = max(tag.end(), tag.start() + 1)
        closing, name, raw = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            opened = last([name])
            # An inline element's end tag does not reach beyond the block that it stands in.
            if opened and not (name in INLINE and blocks and blocks[-1] > opened):
                close(opened)
            continue
        if name not in INLINE and blocks and stack[blocks[-1]].tag == "p":
            close(blocks[-1])
        if name in CLOSES:
            closed, border = CLOSES[name]
            edge = last(border)
            if name == "tr":  # all rows and cells of the table
                beyond = [bisect_right(places[n], edge) for n in closed]
                firsts = [places[n][k] for n, k in zip(closed, beyond, strict=True) if k < len(places[n])]
                if firsts:
                    close(min(firsts))
            elif (opened := last(closed)) > edge:
                close(opened)
        if name == "body" and stack[-1].tag == "head":
            close(len(stack) - 1)
        node = Node(name, _attributes(raw))
        stack[-1].children.append(node)
        if name in VOID or raw.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            lowered = lowered or source.lower()
            if len(lowered) != end:  # a letter whose lower case is longer: look without it
                lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), source)
            tail = lowered.find(f"</{name}", at)
            at = end if tail < 0 else tail
            if tail >= 0:
                finish = source.find(">", tail)
                at = end if finish < 0 else finish + 1
            continue
        places[name].append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append(node)
    return root


def _declared(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("role", "").lower() in ("main", "article")


def _by_attribute(node: Node) -> bool:
    a = node.attributes
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES


def _marked(node: Node) -> bool:
    """Whether the element itself says that it is no article text."""
    if node.tag in DROPPED:
        return True
    a = node.attributes
    if not a:
        return False
    if _by_attribute(node):
        return True
    words = _MARK.findall(a.get("class", "") + " " + a.get("id", ""))
    return any(w.lower() in MARKS for w in words)


class Page:
    """A page's tree, with hashes of its subtrees and the places of its article."""

    def __init__(self, source: str | None):
        self.root = parse(source or "")
        order, todo = [], [self.root]
        while todo:  # parents before children, without recursion: pages may nest deeply
            node = todo.pop()
            order.append(node)
            todo.extend(c for c in node.children if isinstance(c, Node))
        self.nodes = order
        # What stands in a comment section or a side bar declares no article. A <main> is the page's own wherever a class
        # or id marks a wrapper of it, as in "with-sidebar".
        clean, mains, any_ = [], [], []
        above = {id(self.root): (False, False)}
        for node in order:
            under, strictly = above[id(node)]
            marked = node.marked = _marked(node)
            below = under or marked, strictly or marked and (node.tag in DROPPED or _by_attribute(node))
            for child in node.children:
                if isinstance(child, Node):
                    above[id(child)] = below
            if _declared(node) and not marked:
                any_.append(node)
                if not under:
                    clean.append(node)
                elif not strictly and (node.tag == "main" or node.attributes.get("role", "").lower() == "main"):
                    mains.append(node)
        for node in reversed(order):
            digest = blake2b(node.tag.encode(), digest_size=8)
            for child in node.children:
                if isinstance(child, Node):
                    digest.update(b"\1" + child.hash)
                    if not child.marked:
                        node.size += child.size
                        node.words |= child.words
                        node.prose |= child.prose
                elif text := " ".join(child.split()):
                    digest.update(b"\2" + text.encode())
                    node.size += len(text)
                    node.words = node.words or _LETTER.search(text) is not None
            node.hash = digest.digest()
            if node.tag in CONTROLS and (node.tag != "a" or "href" in node.attributes):
                node.words = node.prose = False
            elif node.tag in RUNNING:
                node.prose |= node.words
        self.declared = False
        self._declare(clean or mains)
        if any_ and not self.declared and not self.blocks():
            self._declare(any_)

    def _declare(self, articles: list[Node]) -> None:
        for node in articles:
            node.main = True
        for node in reversed(self.nodes):
            for child in node.children:
                if isinstance(child, Node):
                    node.main |= child.main
        self.declared = self.root.main

    def _walk(self, template: frozenset[bytes] | set[bytes]):
        """Yield (node, inside a declared article, dropped by itself, dropped as template), parents first, whole subtrees dropped."""
        todo = [(self.root, False, False)]
        while todo:
            node, inside, running = todo.pop()
            marked = node.marked and (inside or not node.main) or node.tag == "header" and not inside and not node.main
            safe = inside and (node.tag in RUNNING or node.prose or running and node.words)
            eligible = node is not self.root and node.tag not in INLINE and not node.main and not safe
            yield node, inside, marked, eligible and node.hash in template, eligible
            if not marked and not (eligible and node.hash in template):
                within = inside or _declared(node)
                below = within and (running or node.tag in RUNNING)
                todo.extend((c, within, below) for c in reversed(node.children) if isinstance(c, Node))

    def subtrees(self) -> list[tuple[bytes, int, bool]]:
        """Hashes of the subtrees that may be template, how they are judged, and whether only that would remove them.

        ``BULK`` holds nine tenths of the page's text, ``LINE`` is an element of running text, ``BOX`` any other.
        """
        walk = list(self._walk(set()))
        articles = [n for n, inside, *_ in walk if not inside and n.main and _declared(n)]
        total = sum(n.size for n in articles or [self.root])
        return list({
            (n.hash, BULK if 10 * n.size >= 9 * total else LINE if n.tag in RUNNING else BOX, not marked)
            for n, _, marked, _, eligible in walk if eligible or marked
        })

    def blocks(self, template: set[bytes] = frozenset()) -> list[str]:
        """The blocks of text that remain, in page order."""
        gone = {id(n) for n, _, marked, shared, _ in self._walk(template) if marked or shared}
        out: list[str] = []
        parts: list[str] = []

        def flush() -> None:
            if text := " ".join("".join(parts).split()):
                out.append(text)
            parts.clear()

        todo: list = [(self.root, not self.declared, False)]
        while todo:
            node, reading, leaving = todo.pop()
            if isinstance(node, str):
                if reading:
                    parts.append(node)
                continue
            if node.tag in INLINE:
                if node.tag in ("br", "img"):
                    parts.append(" ")
            elif node.tag in ("td", "th"):
                parts.append(" ")
            else:
                flush()
            if leaving or id(node) in gone:
                continue
            inner = reading or _declared(node) and node.main
            if node.tag not in VOID:
                todo.append((node, reading, True))
            todo.extend((c, inner, False) for c in reversed(node.children))
        flush()
        return out


def host(url: Column) -> Column:
    """The host of an address, in lower case; the empty text without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _read(pages: DataFrame, source: str, text: str) -> DataFrame:
    """The pages without their source, but with the text that is left before templates go, and their subtrees."""

    def build():
        def run(sources):
            found = [Page(t) for t in sources]
            marks = [[f"{h.hex()}{kind}{alone:d}" for h, kind, alone in page.subtrees()] for page in found]
            return ["\n\n".join(page.blocks()) for page in found], marks

        return run

    return materialise(add_columns(pages, [source], [(text, "string"), ("_marks", "array<string>")], build).drop(source), "subtrees")


def templates(read: DataFrame, text: str, min_pages: int, min_share: float, line_pages: int) -> DataFrame:
    """``(_page, _cut)``: for pages that hold template nothing else would remove, the hashes of those subtrees.

    A subtree is template of a host if it stands on at least ``min_pages`` pages
    of it with different main texts, however many the host has. Two kinds need
    more, since large hosts repeat them without being template. One line of
    running text: ``min_share`` of all different main texts, or ``line_pages``.
    Whatever holds nine tenths of its page's text, as in variants of one article:
    ``min_share``. Copies of a page count once, so a copied article is no template.
    """
    seen = read.select("_page", "_host", F.xxhash64(F.col(text)).alias("_main"), "_marks")
    each = seen.select("_page", "_host", "_main", F.explode("_marks").alias("_mark")).select(
        "_page", "_host", "_main", F.substring("_mark", 1, 16).alias("_hash"),
        F.substring("_mark", 17, 1).cast("int").alias("_kind"), F.col("_mark").endswith("1").alias("_alone"),
    )
    # Two steps of partial sums: a template of a huge host shrinks before it is shuffled.
    once = each.groupBy("_host", "_hash", "_main").agg(F.max("_kind").alias("_kind"))
    on = once.groupBy("_host", "_hash").agg(
        F.count(F.lit(1)).alias("_on"), F.count_if(F.col("_kind") == LINE).alias("_lines"),
        F.count_if(F.col("_kind") == BOX).alias("_boxes"),
    )
    sizes = seen.select("_host", "_main").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_of"))
    many = (F.col("_boxes") >= min_pages) | (F.col("_lines") >= line_pages) | (F.col("_on") >= min_share * F.col("_of"))
    shared = materialise(
        on.where(F.col("_on") >= min_pages).join(sizes, "_host").where(many).select("_host", "_hash"), "templates"
    )
    found = each.where("_alone").select("_page", "_host", "_hash").join(shared, ["_host", "_hash"])
    return materialise(found.groupBy("_page").agg(F.collect_set("_hash").alias("_cut")), "page-templates")


def extract(
    pages: DataFrame, url: str = "url", source: str = "html", text: str = "text", min_pages: int = 5, min_share: float = 0.05,
    line_pages: int = 50,
) -> DataFrame:
    """The pages with their main text in place of the source: blocks in page order, two line feeds between.

    White space within a block is one space. Null and empty pages have empty
    text. A null address counts as a host of its own. A column of ``pages``
    named like the text is replaced; all others stay, whatever their names. Each
    page is read once; only those with template that nothing else removes are
    read again.
    """
    held = [c for c in pages.columns if c not in (text, source)]
    # The caller's columns travel in a struct, so that none can clash with a helper column.
    keyed = pages.select(
        F.struct(*(F.col(f"`{c}`") for c in held)).alias("_row"), F.col(source).alias("_source"),
        F.xxhash64(F.col(url), F.col(source)).alias("_page"), host(F.col(url)).alias("_host"),
    )
    read = _read(keyed, "_source", "_text")
    cut = templates(read, "_text", min_pages, min_share, line_pages)
    done = read.join(cut.select("_page"), "_page", "left_anti").select("_row", "_text")

    def build():
        def run(sources, cuts):
            sets = [{bytes.fromhex(h) for h in c.split(",")} for c in cuts]
            return [["\n\n".join(Page(t).blocks(c)) for t, c in zip(sources, sets, strict=True)]]

        return run

    again = keyed.join(cut, "_page").select("_row", "_source", F.array_join("_cut", ",").alias("_cuts"))
    found = done.unionByName(add_columns(again, ["_source", "_cuts"], [("_text", "string")], build).select("_row", "_text"))
    return found.select(*(F.col("_row").getField(c).alias(c) for c in held), F.col("_text").alias(text))
