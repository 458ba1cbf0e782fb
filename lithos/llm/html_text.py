"""Main text of web pages by composite text density.

A page becomes a tree in which every element is a node. A node's density is its characters per tag, adjusted by the share of
them that stands in links; its sum is that of the densities of its block children. The node with the largest sum holds the
article. The least density on the path from it to the body is the threshold by which other parts of the page are added:
those at least as dense whose own sum reaches the threshold, too, or that are paragraphs or headings.

What an element says of itself (a menu, form, notice, advert, reader comment by its kind, role or names) is a prior: its
density, and that of all in it, counts FAINT times. Such an element stays out if that leaves it below the threshold. The prior
is lifted where most of the page's plain text stands inside. Lists of links alone are held to be menus by their density only.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import by_batches, for_python, held, quoted

# Elements of HTML by how they are parsed and what they are.
RAW = ("script", "style", "iframe", "noframes", "noembed", "textarea", "title", "xmp")
GONE = {"noscript", "template", "svg", "math", "canvas", "object", "select", "datalist", "video", "audio", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote", "td", "th"}
PROSE = {"p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
OUT = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "address", "input"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# end of fixed values

#: This project's own prior: words of classes and ids that speak of boilerplate.
OUT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager",
    "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "responses", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget", "widgets",
}
#: Names that leave no doubt, however much text they hold; and words that say nothing beside another name.
READERS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr"}
PLAIN_WORDS = {"area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "entry", "form", "global", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "thread", "title", "top", "wrap", "wrapper"}
PAGE_HEADERS = {"header", "site-header", "page-header", "top-header", "main-header", "global-header", "siteheader", "pageheader"}

#: How much the density of an element counts that says that it is boilerplate; links that a list has at least to be a menu;
#: the least base of the logarithm.
FAINT, MENU, LEAST_BASE = 0.01, 3, math.log(1 + math.e)

#: What stands in a tag behind its name; quotes count behind an equals sign only. It always ends, at the page's end at last.
INNER = r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*"
#: A comment, a self-closed element of raw text, one with its content (which ends with the page at last), a tag, or another
#: declaration.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:{'|'.join(RAW)})(?=[\s/>]){INNER}+(?<=/)>|<({'|'.join(RAW)})(?=[\s/>]){INNER}(?:>|\Z).*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({INNER})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
HEADING = re.compile(r"h[1-6]")
#: A name that speaks of other elements, as has-sidebar.
OF_OTHERS = re.compile(r"(?:has|with|no|without|hide|show)[_-]", re.I)


class Node:
    __slots__ = ("tag", "up", "parts", "out", "post", "block", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total", "opened", "outer", "left")

    def __init__(self, tag: str, up: "Node | None"):
        self.tag, self.up, self.parts, self.out, self.left = tag, up, [], "", False
        self.post = tag == "article" or up is not None and up.post
        self.block, self.weight, self.opened, self.outer = tag not in INLINE, 1.0, None, None
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def children(self) -> list["Node"]:
        return [x for x in self.parts if x.__class__ is Node and x.tag not in GONE]


def named(token: str) -> str:
    """What a class or id says by all of its words: nothing if one of them may belong to an article."""
    words = {w.lower() for w in WORDS.findall(token)}
    if words & OUT_NAMES and words <= OUT_NAMES | PLAIN_WORDS and not OF_OTHERS.match(token):
        return "readers" if words & READERS else "name"
    return ""


def unwanted(tag: str, attributes: str, up: Node) -> str:
    """Why an element is no part of an article, by its kind, role or names; empty if it may be one."""
    if tag in OUT:
        return "form" if tag == "form" else "kind"
    if tag == "header":  # of the page; an article's own holds its title
        return "" if up.post else "kind"
    if attributes and tag not in ("body", "html", "article", "main"):
        why = ""
        for m in NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return "kind"
            if name == "role" and value.lower() in OUT_ROLES:
                why = why or "name"
            if name == "class" or name == "id" and not HEADING.fullmatch(tag):  # a heading's id repeats its text
                for token in value.split():
                    said = named(token) or ("name" if token.lower() in PAGE_HEADERS and not up.post else "")
                    why = said if said == "readers" else why or said
        return why
    return ""


def spare(root: Node) -> None:
    """Take back what is held against elements with the page's text in them: those with its main element or most of its
    plain paragraphs (of its plain text, where it has none), and by name or as a form those with its only articles.
    Reader comments and consent notices are spared only where no plain paragraph stands outside."""
    order, todo = [], [(root, False, False, False)]
    paragraphs, plain, mains, posts = {}, {}, {}, {}
    free = False  # whether an article or main element stands outside of all unwanted ones
    while todo:
        node, in_p, in_a, in_out = todo.pop()
        in_p, in_a, in_out = in_p or node.tag == "p", in_a or node.tag == "a", in_out or bool(node.out)
        own = 0 if in_a else sum(len(x.strip()) for x in node.parts if x.__class__ is str)
        key = id(node)
        plain[key], paragraphs[key], mains[key], posts[key] = own, own if in_p else 0, node.tag == "main", node.tag == "article"
        free = free or not in_out and node.tag in ("article", "main")
        order.append(node)
        todo.extend((x, in_p, in_a, in_out) for x in node.parts if x.__class__ is Node)
    for node in reversed(order[1:]):
        for counts in (plain, paragraphs, mains, posts):
            counts[id(node.up)] += counts[id(node)]
    all_plain, all_paragraphs = plain[id(root)], paragraphs[id(root)]
    for node in order:
        if not node.out:
            continue
        key = id(node)
        text, whole = (paragraphs[key], all_paragraphs) if all_paragraphs else (plain[key], all_plain)
        if node.out == "readers":
            node.out = "" if text == whole else node.out
        elif mains[key] or 2 * text > whole or node.out == "form" and 2 * plain[key] > all_plain or node.out != "kind" and posts[key] and not free:
            node.out = ""


def tree(page: str, judge=unwanted) -> Node:
    """The body of a page. Unclosed elements end where HTML says that they do; what isn't closed ends with the page. An end
    tag inside a block ends none of the inline elements around that block."""
    root = at = around = Node("body", None)  # where the parse stands, and the nearest block there
    root.opened, blocks_open, place = {}, {}, 0

    def leave(node: Node) -> None:
        nonlocal at, around
        while at is not node.up:
            counts = blocks_open if at.opened is not None else around.opened
            counts[at.tag] -= 1
            at = at.up
            if counts is blocks_open:
                around = around.outer

    def end(tags: set, scopes: set) -> None:
        """End the open blocks of these kinds, out to the nearest of `scopes`."""
        while any(blocks_open.get(t) for t in tags):
            node = around
            while node is not root and node.tag not in scopes and node.tag not in tags:
                node = node.outer
            if node is root or node.tag not in tags:
                return
            leave(node)

    for m in TOKEN.finditer(page):
        if m.start() > place:
            at.parts.append(page[place : m.start()])
        place = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        inline = tag in INLINE
        if m[2]:
            if inline:
                if around.opened.get(tag):
                    node = at
                    while node.tag != tag:
                        node = node.up
                    leave(node)
            elif tag in ("p", "li"):
                end({tag}, SCOPES)
            elif blocks_open.get(tag):
                node = around
                while node.tag != tag:
                    node = node.outer
                leave(node)
            continue
        if tag in CLOSES_P:
            end({"p"}, SCOPES)
        if tag in SAME:
            end(SAME[tag], SCOPES)
        if tag == "a" and around.opened.get("a"):
            node = at
            while node.tag != "a":
                node = node.up
            leave(node)
        node = Node(tag, at)
        node.out = judge(tag, m[4], at)
        at.parts.append(node)
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            if inline:
                around.opened[tag] = around.opened.get(tag, 0) + 1
            else:
                node.opened, node.outer = {}, around
                blocks_open[tag] = blocks_open.get(tag, 0) + 1
                around = node
            at = node
    if place < len(page):
        at.parts.append(page[place:])
    spare(root)
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes that may hold text, parents first; by a list, so that no depth of nesting is too much."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children()))
    return out


def measure(nodes: list[Node]) -> None:
    """Densities and sums of a page's nodes, parents first. Inline elements are tags of their block; those that hold blocks
    are blocks themselves."""
    for node in nodes:
        above = node.up.weight if node.up is not None else 1.0
        node.weight = FAINT if node.out else above
    for node in reversed(nodes):
        own = sum(len(SPACE.sub(" ", html.unescape(x)).strip()) for x in node.parts if x.__class__ is str)
        kids = node.children()
        node.chars = own + sum(k.chars for k in kids)
        node.tags = sum(k.tags + 1 for k in kids)
        node.link_chars = node.chars if node.tag == "a" else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        node.block = node.block and node.tag != "br" or any(k.block for k in kids)
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        node.density = node.weight * density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total = sum(k.density for k in node.children() if k.block)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag times log(characters per link character * tags per link tag), to a base that grows with the links
    of the node and with `share`, the body's share of characters in links; without any link it would be 1, so LEAST_BASE
    bounds it. Counts of 0 below a line are taken for 1."""
    if not chars:
        return 0.0
    base = max(LEAST_BASE, math.log(chars * link_chars / max(1, chars - link_chars) + share * chars + math.e))
    ratio = chars * max(1, tags) / (max(1, link_chars) * max(1, link_tags))
    return max(0.0, chars / max(1, tags) * math.log(ratio) / math.log(base))


def articles(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order; nodes inside that are left out are marked."""
    nodes = in_order(root)
    measure(nodes)
    best: dict[int, Node] = {}
    for node in reversed(nodes):  # of each subtree the node with the largest sum; of equals the outermost
        top = node
        for k in node.children():
            if best[id(k)].total > top.total:
                top = best[id(k)]
        best[id(node)] = top
    main = best[id(root)]
    threshold, path, node = main.density, set(), main
    while node is not None:
        threshold = min(threshold, node.density)
        path.add(id(node))
        node = node.up
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        top = best[id(node)]
        if node is main or id(node) not in path and node.block and node.density >= threshold and (top.total >= threshold or node.tag in PROSE):
            found.append(main if node is main else top)
        else:
            todo.extend(reversed(node.children()))
    for node in nodes:
        if id(node) in path or node.density >= threshold:
            continue
        said = node.out  # by itself: what stands in it goes with it
        menu = node.block and node.link_tags >= MENU and node.link_chars == node.chars and not node.post
        node.left = bool(said) or menu
    return found


def blocks(node: Node) -> list[str]:
    """Texts of a subtree's blocks in page order, white space folded; inline elements belong to the block that they are in."""
    out, now, todo = [], [], [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append("".join(now))
            now = []
        elif x.__class__ is str:
            now.append(x)
        elif x.tag == "br":
            now.append("\n")
        elif not x.left and x.tag not in GONE:
            if x.tag not in INLINE:
                todo.append(None)
            todo.extend(reversed(x.parts))
            if x.tag not in INLINE:
                todo.append(None)
    out.append("".join(now))
    return [t for t in (SPACE.sub(" ", html.unescape(x)).strip() for x in out) if t]


def by_kind(tag: str, attributes: str, up: Node) -> str:
    """The prior without names: an element's kind only."""
    return ("form" if tag == "form" else "kind") if tag in OUT else ""


def main_text(page: str, judges=(unwanted, by_kind)) -> str:
    """The main text of one page; empty if it has none. Each prior is asked in turn until there is a text: where all of a
    page's text stands in elements with such names, these are not held against them."""
    for judge in judges:
        text = " ".join(b for n in articles(tree(page, judge)) for b in blocks(n))
        if text:
            break
    return text


def html_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with the column `text_col`, in place of one of that name: the main text of the whole page.

    Null pages, empty ones and those without text give an empty text. Rows may repeat; an empty table gives an empty
    result; all other columns are kept, whatever their names. Of equal sums the outermost node is the article. A script,
    frame or other element of raw text that is closed in its own tag ends there; one that is never closed holds the rest of
    the page, as in HTML. Drawings, formulas, objects and choices are no text, whatever is nested in them.
    """
    for_python(pages.sparkSession)
    carried = [c for c in pages.columns if c != text_col]

    def run(pages):
        held("html", object)
        return [pa.array([main_text(x or "") for x in pages.to_pylist()], pa.string())]

    return by_batches(pages, carried, [F.col(quoted(html_col))], [T.StructField(text_col, T.StringType())], run)
