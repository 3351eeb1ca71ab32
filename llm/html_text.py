"""Main-text extraction by composite text density.

Boilerplate elements go first (scripts, menus, forms, comments and the like, by tag, role, whole class
or id; blocks of ambiguous names only when mostly links).  In the remaining tree every block node gets
its characters per tag, adjusted for links against the whole body; a node's density sum adds up its
children's densities.  The subtree of the largest sum is the content, and the least density on the path
from the body to it is the threshold at which its neighbours belong to it too; a neighbouring container
must also carry as much as the content's average block (its own density sum, or its density if it has
no blocks), as a single short line is dense by itself.  Article and main elements only widen that choice: a subtree inside
an article stands for the outermost one and the articles beside it, one inside a main element for the
whole element.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, col, free_names, map_arrow

# Fixed values of HTML: elements without content, elements that stay inside a line, elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark math object output q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtext munder munderover semantics".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Boilerplate by tag, by role, and by class or id.
DROP = frozenset("head title script style noscript template svg annotation annotation-xml iframe audio video nav footer aside button select option input textarea datalist menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
# A class or id counts as a whole: a name of its own, or a compound of nothing but names and parts of a page.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments"
    " commentlist disqus newsletter popup modal widget toolbar pagination pager".split()
)
# Common words: alone they say too little, and the links of the block decide.
AMBIGUOUS = frozenset("side form search share sharing social related recommended header notice notices notification alert reply replies respond promotion banner cookie cookies consent gdpr subscribe signup login overlay".split())
PARTS = frozenset("site page main top bottom left right primary secondary global mobile container wrapper wrap box block bar area list item items link links button buttons icon icons inner outer section body unit slot group google".split())
COMPOUNDS = frozenset("related-posts related-articles related-stories related-links recommended-posts recommended-articles share-buttons share-links share-bar share-icons social-links social-icons social-buttons social-bar search-box search-bar cookie-bar cookie-box site-header login-box side-bar comment-content comment-entry".split())
# Elements that are text by themselves, not containers of it.
TEXT = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
# Elements whose ids are made from titles or number passages.
TITLED = HEADINGS | frozenset("section article p li dt dd blockquote figure tr td th details".split())


@lru_cache(10000)
def _named(token: str) -> str:
    """boilerplate, ambiguous or nothing, for one class or id."""
    words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower()) if w]
    if "-".join(words) in COMPOUNDS:
        return "boilerplate"
    known = [w for w in words if w in NAMES or w in AMBIGUOUS]
    if not known or any(w not in PARTS for w in words if w not in known):
        return ""
    return "boilerplate" if len(known) > 1 or known[0] in NAMES else "ambiguous"


class Node:
    """An element; ``measure`` adds what is below: characters, those in links, headings or main parts, live articles; and whether it is inside a part."""

    __slots__ = ("attrs", "chars", "children", "core", "drop", "inside", "linked", "live", "parent", "tag")

    def __init__(self, tag: str, attrs=(), parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children, self.drop = tag, attrs, parent, [], False
        self.chars = self.linked = 0
        self.core = self.live = self.inside = False

    def walk(self):
        """This node and all below, parents first."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(x for x in reversed(node.children) if isinstance(x, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.open: dict[str, int] = {}

    def _up(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _close(self, tags, stop) -> None:
        """Ends the nearest open element of ``tags`` unless one of ``stop`` lies between."""
        if not any(self.open.get(t) for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self._up(node.parent)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, {"table", "button"})
        if tag in SAME:
            self._close(SAME[tag], SCOPE[tag])
            if tag in ("tr", "thead", "tbody", "tfoot"):
                for t in SAME[tag]:
                    self._close({t}, SCOPE[tag])
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style") and self.at.tag == tag and tag in ("svg", "path", "g", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._up(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)


def _measure(root: Node) -> None:
    """One pass down and one up, so that no question about a node walks its subtree."""
    order = list(root.walk())
    for node in order:
        up = node.parent
        node.inside = up is not None and (up.inside or up.tag in ("article", "main", "section"))
    for node in reversed(order):
        node.core = node.tag in ("article", "main", "h1")
        node.live = node.tag == "main" or node.tag == "article" and not _is_boilerplate(node)
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.core, node.live = node.core or x.core, node.live or x.live
                if x.tag not in DROP:
                    node.chars, node.linked = node.chars + x.chars, node.linked + x.linked
        if node.tag == "a":
            node.linked = node.chars


def _is_boilerplate(node: Node) -> bool:
    """Whether a measured node is boilerplate by its tag, role or names; of an article its attributes alone tell."""
    tag = node.tag
    if tag in ("html", "body", "main", "#root"):
        return False
    if tag == "article":
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "class" and value and any("comment" in x.lower() and _named(x) == "boilerplate" for x in value.split()) for name, value in node.attrs)
    if tag in DROP:
        return True
    if tag == "header":
        return not node.inside
    if tag == "form":
        return not node.core
    for name, value in node.attrs:
        if name == "role" and (value or "").strip().lower() in ROLES or name in ("hidden",) or name == "aria-hidden" and value == "true":
            return True
    if tag in INLINE:
        return False
    classes = [x for name, value in node.attrs if name == "class" and value for x in value.split()]
    ids = [] if tag in TITLED or "section" in classes else [x for name, value in node.attrs if name == "id" and value for x in value.split()]
    kinds = {_named(x) for x in (*classes, *ids)}
    return ("boilerplate" in kinds or "ambiguous" in kinds and node.linked * 2 >= node.chars) and not node.live


def _mostly_links(node: Node) -> bool:
    """Whether at least half of the node's characters are in links."""
    chars, linked, todo = 0, 0, [(node, False)]
    while todo:
        at, link = todo.pop()
        if isinstance(at, str):
            n = len("".join(at.split()))
            chars, linked = chars + n, linked + link * n
        elif not at.drop and at.tag not in DROP:
            todo.extend((x, link or at.tag == "a") for x in at.children)
    return linked * 2 >= chars


def _densities(body: Node) -> tuple[dict[int, float], dict[int, float], list[Node]]:
    """Composite density and density sum of each block node below ``body``, and those nodes, parents first."""
    nodes, order, todo = [], [], [(body, False, None)]
    while todo:
        node, linked, block = todo.pop()
        if node.drop:
            continue
        order.append((node, linked or node.tag == "a", block))
        block = block if node.tag in INLINE or node.tag == "br" else node
        todo.extend((x, linked or node.tag == "a", block) for x in node.children if isinstance(x, Node))
    stats: dict[int, list[int]] = {}
    for node, linked, _ in reversed(order):
        chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        own = [chars, chars if linked else 0, 0, 0]
        for x in node.children:
            if isinstance(x, Node) and not x.drop:
                below = stats[id(x)]
                counts = x.tag not in INLINE and x.tag != "br" or x.tag == "a"
                own = [own[0] + below[0], own[1] + below[1], own[2] + below[2] + counts, own[3] + below[3] + (x.tag == "a")]
        stats[id(node)] = own
    chars_of_body, links_of_body = stats[id(body)][:2]
    share = links_of_body / chars_of_body if chars_of_body else 0.0
    density, sums = {}, {}
    for node, _, block in order:
        if node.tag in INLINE or node.tag == "br":
            continue
        nodes.append(node)
        c, lc, t, lt = stats[id(node)]
        t, value = max(t, 1), 0.0
        if c:
            base = log(log(c / max(c - lc, 1) * lc + share * c + e) + 1e-9)
            arg = c / max(lc, 1) * t / max(lt, 1)
            value = c / t * max(log(max(arg, 1.0)) / max(base, 0.05), 0.0)
        density[id(node)] = value
        sums[id(node)] = 0.0
        if block is not None:
            sums[id(block)] += value
    return density, sums, nodes


def _text(nodes: list[Node]) -> str:
    out, todo = [], [x for n in reversed(nodes) for x in (" ", n, " ")]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.drop:
            edge = "" if node.tag in INLINE else " "
            out.append(edge)
            todo.append(edge)
            todo.extend(reversed(node.children))
    return " ".join("".join(out).split())


def main_text(html: str) -> str:
    """The main text of one page; blocks in page order are joined by one space."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _measure(builder.root)
    for node in builder.root.walk():
        node.drop = _is_boilerplate(node)
    body = next((n for n in builder.root.walk() if n.tag == "body"), builder.root)
    density, sums, nodes = _densities(body)
    best = max(nodes, key=lambda n: sums[id(n)], default=body)
    if best is body:
        beside = [x for x in body.children if isinstance(x, Node) and not x.drop]
        if any(x.tag == "article" for x in beside):  # a block of links beside articles is a menu
            for x in beside:
                x.drop = x.tag not in INLINE and x.tag not in ("article", "main", "p") and x.tag not in HEADINGS and _mostly_links(x)
        return _text([body])
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(density[id(n)] for n in path if id(n) in density)
    average = sums[id(best)] / max(1, sum(1 for x in best.children if isinstance(x, Node) and not x.drop and id(x) in density and density[id(x)] > 0))

    def belongs(x: Node) -> bool:
        if density.get(id(x), 0.0) < least:
            return False
        return x.tag in TEXT or (sums.get(id(x), 0.0) or density[id(x)]) >= average

    wide = max((i for i, n in enumerate(path) if n.tag == "article"), default=None)
    if wide is None:
        wide = max((i for i, n in enumerate(path) if n.tag == "main"), default=0)
    top = path[wide]
    articles = top.tag == "article"
    for up in path[wide + 1 :]:
        near = [x for x in up.children if isinstance(x, Node) and not x.drop and x is not top]
        keep = {id(x) for x in near if belongs(x) or articles and x.tag == "article" and not _mostly_links(x)}
        articles = False
        if keep:
            for x in near:
                x.drop = id(x) not in keep and x.tag not in INLINE
            top = up
        elif up is not body:
            for x in near:
                x.drop = x.drop or x.tag not in INLINE
    return _text([top])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each page.

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined by one space.  A null or empty page, and one without text, gives the empty string.  Pages
    are independent: nulls, repeated rows and other columns are carried as they are; an empty table
    gives an empty result.  Where ``keep`` has a text or n_chars column already, the new one is text_1 or n_chars_1.
    """
    text, size = free_names(keep, ("text", "n_chars"))
    base = pages.select(*[col(c) for c in keep], col(html_col).cast("string").alias("_source_html"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema[:-1])

    def run(batches):
        for b in batches:
            texts = [main_text(h) if h else "" for h in b.column(b.num_columns - 1).to_pylist()]
            yield batch([(n, b.column(i)) for i, n in enumerate(b.schema.names[:-1])] + [(text, pa.array(texts, pa.string())), (size, pa.array([len(t) for t in texts], pa.int64()))])

    return map_arrow(base, run, schema + f"{text} string, {size} long")
