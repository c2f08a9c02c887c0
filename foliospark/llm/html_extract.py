"""Main text of web pages by tree scoring.

A page becomes a small tree. What is never article text (scripts, menus, forms, notices, adverts, reader
comments ...) is cut first, by element, role, and words of class and id. Each paragraph passes points to its
parent, and half of them to the grandparent: one, one for each comma, and up to three for its length. Points
are discounted by the container's link density. Where the best container lies in an article or main element,
all blocks of that element are kept. Else it grows to ancestors of few links of which it is the larger part,
and is kept with those siblings that score at least a fifth of it, are running text, or are the headings of
what is kept. Blocks of what is kept are joined in page order. A form, or a class or id word alone, does not cut an
element that holds most of the page's text outside links; one named after comments must hold its h1 or main too. Of an
article's own header the headings stay.

Null and empty pages, and pages without text, give an empty text. Truncated pages are read as far as they go. Each row
is read by itself: repeated rows give repeated results, and other columns are left out. Time grows with the page's
length, however deep it nests.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CUT = {"script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "iframe", "object", "svg", "canvas", "dialog", "menu"}
BLOCK = {"html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "hr", "center"} | CUT
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "dt", "dd", "li", "summary", "figcaption"}
PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertisements|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|widget|footer|header|masthead|comment|comments|commentlist|disqus|replies|share|sharing|social|related|recommended|login|signup)(?:$|[\s_-])"
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|replies)(?:$|[\s_-])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "cut", "heads", "named", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, named: str | None = None):
        """`named` holds class and id where only their words, or its being a form, cut the node; of a cut node with `heads` the headings stay."""
        self.tag, self.parent, self.cut, self.named, self.heads, self.children = tag, parent, cut, named, False, []


class _Tree(HTMLParser):
    """Builds nodes, closing what HTML lets stay open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.path = [self.root]
        self.open: dict[str, list[int]] = {}  # places in path by tag, so that no tag walks the whole path

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=0)

    def _leave(self, place: int) -> None:
        while len(self.path) > place:
            self.open[self.path.pop().tag].pop()

    def _close(self, tags: set[str], stop: set[str]) -> None:
        if (place := self._last(tags)) > self._last(stop):
            self._leave(place)

    def _enter(self, node: Node) -> None:
        self.path[-1].children.append(node)
        self.open.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P or tag == "li":
            self._close({"p"}, {"td", "th", "article", "section", "div", "blockquote", "li"} - {tag})
        if tag == "li":
            self._close({"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            self._close({"td", "th"}, {"tr", "table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        if tag in VOID:
            self.path[-1].children.append(Node(tag, self.path[-1]))
            return
        a = dict(attrs)
        role = (a.get("role") or "").lower()
        form = tag == "form" or role == "form"
        sure = not form and (tag in CUT or role in ROLES or "hidden" in a)
        name = f"{a.get('class') or ''} {a.get('id') or ''}".lower()
        cut = (sure or form or bool(_UNWANTED.search(name))) and tag not in ("article", "main")
        node = Node(tag, self.path[-1], cut, name if cut and not sure else None)
        node.heads = tag == "header" and self._last(("article", "main")) > 0
        self._enter(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.path[-1].tag == tag and len(self.path) > 1:
            self._leave(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        place = self._last((tag,))
        if place and (tag in BLOCK or self._last(("article", "main", "table")) <= place):
            self._leave(place)

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _spare(tree.root)
    return tree.root


def _headings(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag in HEADINGS:
            out.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return out


def _spare(root: Node) -> None:
    """Elements cut by their names only, and forms, come back where they hold most of the page's text outside links."""
    own: dict[Node, int] = {}
    tops: set[Node] = set()
    stack: list = [(root, False)]
    while stack:
        x, done = stack.pop()
        if not done:
            if x.heads:
                x.children, x.cut, x.heads = _headings(x), False, False
            own[x] = sum(len(c.strip()) for c in x.children if isinstance(c, str))
            stack.append((x, True))
            stack.extend((c, False) for c in x.children if not isinstance(c, str) and (not c.cut or c.heads or c.named is not None))
        elif x is not root:
            own[x.parent] += 0 if x.tag == "a" else own[x]
            if x in tops or x.tag in ("h1", "main"):
                tops |= {x, x.parent}
    for x in own:
        if x.named is not None and 2 * own[x] > own[root] and (x in tops or not _COMMENTS.search(x.named)):
            x.cut = False


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node, in page order, without what is cut."""
    out, run = [], []

    def flush() -> None:
        if text := _SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:  # no recursion: pages may nest deeply
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.cut:
            edge = x.tag in BLOCK
            if edge:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def _measures(root: Node) -> dict[Node, tuple[int, int, int]]:
    """(characters, characters inside links, commas) of every node that isn't cut."""
    size: dict[Node, list[int]] = {}
    stack: list = [(root, False)]
    while stack:
        x, done = stack.pop()
        if not done:
            texts = [c.strip() for c in x.children if isinstance(c, str)]
            size[x] = [sum(map(len, texts)), 0, sum(t.count(",") for t in texts)]
            stack.append((x, True))
            stack.extend((c, False) for c in x.children if not isinstance(c, str) and not c.cut)
        else:
            if x.tag == "a":
                size[x][1] = size[x][0]
            if x is not root:
                size[x.parent] = [m + n for m, n in zip(size[x.parent], size[x], strict=True)]
    return {k: tuple(v) for k, v in size.items()}


def main_text(html: str | None) -> str:
    root = parse(html or "")
    size = _measures(root)
    points: dict[Node, float] = {}
    for x, (chars, _, commas) in size.items():
        if x.tag not in PARAGRAPH or chars == 0:
            continue
        worth = (1 + commas + min(chars / 100, 3)) * min(1, chars / 25)
        up = x.parent
        for share in (1, 0.5):
            if up is None:
                break
            points[up] = points.get(up, 0) + worth * share
            up = up.parent
    bonus = {"article": 5, "main": 5}
    for x in size:
        if x.tag in bonus:
            points[x] = points.get(x, 0) + bonus[x.tag]
    density = lambda x: size[x][1] / max(1, size[x][0])
    order = {x: i for i, x in enumerate(size)}
    scored = {x: p * (1 - density(x)) for x, p in points.items() if x in size}
    if not scored:
        return "\n".join(blocks(root))
    best = max(scored, key=lambda x: (scored[x], -order[x]))
    home = best
    while home is not None and home.tag not in ("article", "main"):
        home = home.parent
    if home is not None:
        return "\n".join(blocks(home))
    while best.parent not in (None, root) and density(best.parent) < 0.25 and 2 * size[best][0] >= size[best.parent][0]:
        best = best.parent
    if best is root or best.parent is None:
        return "\n".join(blocks(best))
    beside = [x for x in best.parent.children if isinstance(x, Node) and not x.cut and x in size and size[x][0]]
    kept, follows = [], False
    for x in reversed(beside):
        running = x.tag == "p" and density(x) < 0.25
        heading = follows and x.tag in HEADINGS
        follows = x is best or running or heading or scored.get(x, 0) >= max(10, scored.get(best, 0) / 5)
        if follows:
            kept.append(x)
    return "\n".join(t for x in reversed(kept) for t in blocks(x))


@F.arrow_udf(T.StringType())
def main_text_col(htmls: pa.Array) -> pa.Array:
    return pa.array([main_text(h.as_py()) for h in htmls], pa.string())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url (null where the table has none), text, n_chars."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    out = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), main_text_col(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
