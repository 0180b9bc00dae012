"""Main text of web pages by tree scoring.

A paragraph earns points for its length and commas; its ancestors receive them, ever less with distance. Scores are discounted
by link density, the best container wins, and siblings that look like it are kept with it. Pages are parsed one by one in Arrow batches:
no shuffle, and time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PARAGRAPH = {"p", "pre", "td", "blockquote"}
START = {"div": 5, "article": 5, "section": 3, "main": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "header": -1, "ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5}
OUT = {"nav", "footer", "aside", "button", "select", "head"}
#: May hold the content or be about the page: kept by score and link density.
DOUBTFUL = {"form", "header"}
BAD, GOOD = re.compile(r"\b(ads?|advert\w*|banner|comments?|footer|menu|nav\w*|promo|share|sidebar|social|sponsor\w*)\b", re.I), re.compile(r"\b(article|body|content|entry|main|page|post|story|text)\b", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?|[/\s=]+|["']""")
NAMED = re.compile(r"""\b(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPACE = re.compile(r"\s+")
LEVELS, LEAST = 5, 25


class Node:
    __slots__ = ("tag", "parent", "items", "length", "commas", "links", "weight", "points", "most")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.length = self.commas = self.links = 0
        self.points: float | None = None
        self.most = 0.0
        self.weight = (-25 if BAD.search(names) else 0) + (25 if GOOD.search(names) else 0) if names else 0

    def density(self) -> float:
        return self.links / self.length if self.length else 0.0


def parse(text: str) -> tuple[Node, str]:
    """The tree, with lengths, commas and link lengths of whole subtrees, and the title. Unclosed tags end with their parents."""
    root, title = Node("#root", None), ""
    stack, at, n = [root], 0, len(text)
    open_tags: dict[str, list[int]] = {}  # where on the stack each tag is open: no search is as long as the page is deep

    def close(upto: int) -> None:
        while len(stack) > upto:
            node = stack.pop()
            open_tags[node.tag].pop()
            parent = stack[-1]
            parent.length += node.length
            parent.commas += node.commas
            parent.links += node.length if node.tag == "a" else node.links

    def innermost(tags: set[str]) -> int:
        return max((open_tags[t][-1] for t in tags if open_tags.get(t)), default=0)

    def find_open(tags: set[str], fence: set[str]) -> int:
        """The innermost open one of tags, 0 if a fence lies further in."""
        k = innermost(tags)
        return k if k > innermost(fence - tags) else 0

    def add(piece: str) -> None:
        if piece and not piece.isspace():
            piece = SPACE.sub(" ", entities.unescape(piece))
            top = stack[-1]
            top.items.append(piece)
            top.length += len(piece.strip())
            top.commas += piece.count(",") + piece.count("，") + piece.count("、")

    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            add(text[at:])
            break
        add(text[at:lt])
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(text, lt)
        if not m:
            if text[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = text.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        tag, end = m[2].lower(), m.end()
        while end < n and text[end] != ">":
            a = ATTRIBUTE.match(text, end)
            end = a.end() if a else end + 1
        names = " ".join(NAMED.findall(text[m.end() : end])) if not m[1] and end > m.end() else ""
        at = end + 1
        if m[1]:
            if open_tags.get(tag):
                close(find_open({tag}, set()))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(text, at)
            if tag == "title" and not title:
                title = SPACE.sub(" ", entities.unescape(text[at : end.start() if end else n])).strip()
            at = end.end() if end else n
            continue
        if tag in BLOCK and open_tags.get("p") and (k := find_open({"p"}, {"td", "th", "table", "button"})):
            close(k)
        if tag in CLOSED_BY and any(open_tags.get(t) for t in CLOSED_BY[tag]) and (k := find_open(CLOSED_BY[tag], FENCE[tag])):
            close(k)
        node = Node(tag, stack[-1], names)
        stack[-1].items.append(node)
        if tag not in VOID and not text.startswith("/>", end - 1):
            stack.append(node)
            open_tags.setdefault(tag, []).append(len(stack) - 1)
    close(1)
    return root, title


def nodes_of(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(x for x in reversed(node.items) if not isinstance(x, str))


def paragraphs(root: Node) -> list[Node]:
    """Elements that hold running text: paragraph tags, and blocks with text of their own."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in OUT:
            continue
        own = node.tag in BLOCK and sum(len(x.strip()) for x in node.items if isinstance(x, str)) >= LEAST
        if (node.tag in PARAGRAPH or own) and node.length >= LEAST:
            found.append(node)
        todo.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return found


def paragraph_points(node: Node) -> float:
    return 1 + node.commas + min(node.length / 100, 3)


def best(root: Node) -> tuple[Node | None, float, list[Node]]:
    """The container, its score after the discount, and all scored nodes."""
    scored: list[Node] = []
    for p in paragraphs(root):
        points, up = paragraph_points(p), p.parent
        for level in range(LEVELS):
            if up is None or up.tag == "#root":
                break
            if up.points is None:
                up.points = START.get(up.tag, 0) + up.weight
                scored.append(up)
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up = up.parent
    for node in scored:
        node.points *= 1 - node.density()
    top = max(scored, key=lambda x: x.points, default=None)  # the first of equals: the one whose paragraph came first
    return top, top.points if top else 0.0, scored


def kept_siblings(top: Node, score: float) -> list[Node]:
    if top.parent is None:
        return [top]
    out = []
    for x in top.parent.items:
        if isinstance(x, str):
            continue
        likely = x.points is not None and x.points >= max(10.0, 0.2 * score) and x.tag not in OUT
        prose = x.tag == "p" and (x.length > 80 and x.density() < 0.25 or 0 < x.length <= 80 and not x.links and x.weight >= 0)
        if x is top or likely or prose:
            out.append(x)
    return out


def note_most(root: Node) -> None:
    """most of every form and header: the greatest score in its subtree, 0 at least."""
    order = list(nodes_of(root))
    for x in reversed(order):  # children come after their parents
        if x.points is not None:
            x.most = max(x.most, x.points)
        if x.parent is not None:
            x.parent.most = max(x.parent.most, x.most)


def worthless(node: Node) -> bool:
    """A form or header that is mostly links, or whose score (where it lies too far above its paragraphs to have one, those of all nodes in it) isn't positive."""
    if node.tag not in DOUBTFUL:
        return False
    return node.density() >= 0.5 or (node.most if node.points is None else node.points) <= 0


def text_of(nodes: list[Node], doubtful: bool = False) -> str:
    """Lines of the nodes' blocks, without navigation and blocks marked as advertising; without worthless forms and headers, unless doubtful."""
    out: list[str] = []
    line: list[str] = []

    def end_line() -> None:
        s = SPACE.sub(" ", "".join(line)).strip()
        if s:
            out.append(s)
        line.clear()

    todo: list = list(reversed(nodes))
    chosen = {id(x) for x in nodes}
    while todo:
        x = todo.pop()
        if x is None:
            end_line()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag in OUT or id(x) not in chosen and (x.weight < 0 or not doubtful and worthless(x)):
            continue
        elif x.tag == "br":
            end_line()
        else:
            block = x.tag in BLOCK
            if block:
                end_line()
                todo.append(None)
            todo.extend(reversed(x.items))
    end_line()
    return "\n".join(out)


def extract(text: str | None) -> tuple[str | None, str | None, float | None]:
    """(title, text, score). A page without scored paragraphs gives all text outside navigation, that of forms and headers if there is no other, with score 0."""
    if text is None:
        return None, None, None
    root, title = parse(text)
    top, score, _ = best(root)
    note_most(root)
    nodes = kept_siblings(top, score) if top else [root]
    return title, text_of(nodes) or text_of(nodes, doubtful=True), round(float(score), 6)


def _pages(batches):
    for b in batches:
        rows = [extract(x.as_py()) for x in b.column(2)]
        cols = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.float64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["page_id", "url", "title", "text", "score"])


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, score) of every page.

    Null html gives nulls, empty html empty text and score 0; repeated rows repeat; rows with null ids are rows like others; other columns are ignored. Long and deep pages are read whole, in
    time that grows as their length. Of containers with equal scores the one whose first paragraph comes first wins.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_pages, "page_id bigint, url string, title string, text string, score double")
