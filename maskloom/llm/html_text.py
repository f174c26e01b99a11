"""HTML extraction by tree scoring.

A page becomes a tree. Its paragraphs pass points for length and commas to their `LEVELS` nearest ancestors, less for each
level, and a container's points are discounted by the share of its text that is in links. The best container is kept with
those siblings that score or read like it; in an article or main element, with its other parts. What is kept is
looked through once more: a part of it that is a list of links goes. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments give no points and no text. Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noframes noembed svg annotation annotation-xml canvas object audio video select datalist".split())
DROPPED = frozenset("nav footer aside form button dialog menu head fieldset label input".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split()
)
#: Blocks that end an open paragraph where they start.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An element of a key's kind ends an open one of its value's, up to the scope's own element.
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Containers that are passed over where they are lists of links: so many links, and so much of the text in them.
LISTS, LIST_LINKS, LIST_SHARE = frozenset("ul ol dl div section table p center details".split()), 3, 0.8
#: How many ancestors a paragraph gives points to.
LEVELS = 8
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu nav navbar navigation navigationbar breadcrumb breadcrumbs masthead footer complementary contentinfo comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations subscribe newsletter widget toolbar pagination pager login signup search skip".split()
)
#: Of these, reader comments: often long, and in article elements of their own.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())

#: Of the marks, those that say of a paragraph or heading what it is about, not that it is none of the article.
SOFT = frozenset("related recommended recommendations notice notices alert banner search overlay widget header footer".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a heading, or of a list's class or id, over the sources of an article: links, but part of it.
SOURCES = frozenset("references reference sources source notes footnotes endnotes citations bibliography literature works further external weblinks einzelnachweise quellen literatur références sources notes bibliographie referencias fuentes notas bibliografía".split())
#: Characters that a part beside the best container has at least, where it is its own neighbour and further out.
BESIDE, OUTSIDE = 25, 140

_TAG = re.compile(r"""<(?:!--(?:.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S)
_MARKED = re.compile(r"""(?i)(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_QUOTED = re.compile(r"""(?<==)"[^"]*"|(?<==)'[^']*'""")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:[\s=/]|$)")
_UNSEEN = re.compile(r"""(?i)aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
#: has-sidebar, noSidebar: what a wrapper has or lacks isn't what it is.
_ABOUT = re.compile(r"(?<![A-Za-z])(?:has|no|with|without)(?:[-_]\S+|[A-Z]\S*)")
_WORD = re.compile("[a-z]+")
_RIGHTS = re.compile(r"(?i)©|\(c\) ?[0-9]{4}|\bcopyright\b|all rights reserved")
_ANY_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "unsure", "cites", "points", "chars", "linked", "links", "in_article", "blocks", "depth")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, unsure: bool = False, cites: bool = False):
        self.tag, self.parent, self.dropped, self.unsure, self.cites = tag, parent, dropped, unsure, cites
        self.depth = parent.depth + 1 if parent is not None else 0
        self.parts: list[Node | str] = []
        self.points, self.chars, self.linked, self.links = 0.0, 0, 0, 0
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.blocks = (parent.blocks if parent is not None else 0) + (tag in BLOCK)


def _depth(n: Node) -> int:
    return n.depth


def _not_article(tag: str, attrs: str, within: Node) -> tuple[bool, bool, bool]:
    """Whether an element is dropped, whether that is unsure, as it may yet hold the article, and whether it is marked as a list of sources."""
    if tag in DROPPED and tag != "form":
        return True, False, False
    in_article = within.in_article
    if tag == "header" and not in_article:
        return True, False, False
    if not attrs or tag in ("article", "main", "body", "html"):
        return tag == "form", tag == "form", False
    if _UNSEEN.search(attrs) or "hidden" in attrs.lower() and _HIDDEN.search(_QUOTED.sub("", attrs)):
        return True, False, False
    words = {w for m in _MARKED.finditer(attrs) for w in _WORD.findall(_CAMEL.sub(" ", _ABOUT.sub(" ", m[1] or m[2] or m[3] or "")).lower())}
    marks = words & MARKS - SOFT if tag in TEXT_TAGS and in_article else words & MARKS
    marked = tag == "form" or bool(marks) or ("header" in words and not in_article)
    return marked, marked and not words & COMMENTS, bool(words & SOURCES)


def _settle(root: Node) -> None:
    """Elements that are dropped but unsure stay if they hold most of the page's paragraph text, or an article or main
    element where none stands elsewhere; then what is within dropped elements is dropped too."""
    order, at = [root], 0
    while at < len(order):
        order += [x for x in order[at].parts if isinstance(x, Node)]
        at += 1
    if any(n.unsure for n in order):
        # By node: surely dropped, at all dropped, within a paragraph; and from below: characters in paragraphs, articles.
        state = {id(root): (False, False, False)}
        chars, articles, free = dict.fromkeys(map(id, order), 0), dict.fromkeys(map(id, order), 0), False
        for n in order[1:]:
            sure, dropped, p = state[id(n.parent)]
            state[id(n)] = sure, dropped, p = sure or n.dropped and not n.unsure, dropped or n.dropped, p or n.tag == "p"
            if not sure:
                chars[id(n)] = sum(len(x.strip()) for x in n.parts if isinstance(x, str)) if p else 0
                articles[id(n)] = n.tag in ("article", "main")
                free = free or not dropped and n.tag in ("article", "main")
        for n in reversed(order[1:]):
            chars[id(n.parent)] += chars[id(n)]
            articles[id(n.parent)] += articles[id(n)]
        for n in order:
            if n.unsure and (2 * chars[id(n)] > chars[id(root)] or articles[id(n)] and not free):
                n.dropped = False
    for n in order[1:]:
        n.dropped = n.dropped or n.parent.dropped
    _sources(order)


def _sources(order: list[Node]) -> None:
    """What stands in or right after a heading over sources, or in what is marked so, cites. order: from the top down."""
    for n in order:
        heading = None
        for x in n.parts:
            if not isinstance(x, Node):
                continue
            if n.cites:
                x.cites = True
            if x.tag in HEADINGS:
                told, todo = [], [x]
                while todo:
                    y = todo.pop()
                    told += [z for z in y.parts if isinstance(z, str)]
                    todo += [z for z in y.parts if isinstance(z, Node)]
                heading = bool(SOURCES & set(_ANY_WORD.findall(html.unescape(" ".join(told)).lower())))
            elif heading and x.tag in LISTS:  # the first list below it
                x.cites, heading = True, False


def parse(page: str) -> Node:
    """The page's tree, as tolerant of unclosed and stray tags as it needs to be."""
    root = here = Node("", None, False)
    at, size = 0, len(page)
    open_: dict[str, list[Node]] = {}  # the open elements of each kind, outermost first

    def close(upto: Node) -> None:
        nonlocal here
        while True:
            n, here = here, here.parent
            open_[n.tag].pop()
            if n is upto:
                return

    def opened(names: tuple[str, ...], scope: tuple[str, ...]) -> Node | None:
        """The outermost open element of the names within the innermost of the scope."""
        limit = max((open_[x][-1].depth for x in scope if open_.get(x)), default=-1)
        found = None
        for own in (open_.get(x) for x in names):
            k = bisect_right(own, limit, key=_depth) if own else 0
            if own and k < len(own) and (found is None or own[k].depth < found.depth):
                found = own[k]
        return found

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["end"]:
            own = open_.get(tag)
            # An inline element's end doesn't reach over blocks that opened within it.
            if own and (tag in BLOCK or here.blocks == own[-1].blocks):
                close(own[-1])
            continue
        if tag in RAW:
            if not m["attrs"].endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in ENDS_P and (p := opened(("p",), ("td", "th", "table", "blockquote", "div", "section", "article", "li"))) is not None:
            close(p)
        if tag in ENDS_OWN and (p := opened(ENDS_OWN[tag], SCOPE[tag])) is not None:
            close(p)
        node = Node(tag, here, *_not_article(tag, m["attrs"], here))
        here.parts.append(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            here = node
            open_.setdefault(tag, []).append(node)
    _settle(root)
    return root


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(owner, text, characters in links) for each block in page order; dropped elements are left out. Counts each element's links."""
    out: list[tuple[Node, str, int]] = []
    text: list[str] = []
    linked = 0
    owners = [root]

    def flush() -> None:
        nonlocal text, linked
        if text:
            s = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if s:
                out.append((owners[-1], s, min(linked, len(s))))
        text, linked = [], 0

    links = 0
    stack: list[tuple[Node, Iterator]] = [(root, iter(root.parts))]
    while stack:
        node, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            stack.pop()
            if node.tag == "a":
                links -= 1
                node.links += 1
            if node.parent is not None:
                node.parent.links += node.links
            if node.tag in BLOCK:
                flush()
                owners.pop()
        elif isinstance(part, str):
            text.append(part)
            if links:
                linked += len(part.strip())
        elif not part.dropped:
            if part.tag in BLOCK:
                flush()
                owners.append(part)
            elif part.tag == "br":
                text.append(" ")
            if part.tag == "a":
                links += 1
            stack.append((part, iter(part.parts)))
        elif part.tag in BLOCK or part.tag in DROPPED:
            flush()
    flush()
    return out


def _weighed(found: list[tuple[Node, str, int]], root: Node) -> list[Node]:
    """The containers that have points, in page order, with their points, and the characters of all elements, in all and in links."""
    scored: list[Node] = []
    for owner, text, linked in found:
        owner.chars += len(text)
        owner.linked += linked
        points = (1 + text.count(",") + min(3.0, len(text) / 100)) * (1 - linked / len(text))
        # Text that stands in the container itself counts for it; a paragraph's goes to what holds it.
        n = owner.parent if owner.tag not in ("div", "section", "article", "main", "body", "td", "") and owner.parent else owner
        for level in range(1, LEVELS + 1):
            if not n.points:
                scored.append(n)
            n.points += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            n = n.parent
            if n is None:
                break
    order, at = [root], 0
    while at < len(order):
        order += [x for x in order[at].parts if isinstance(x, Node) and not x.dropped]
        at += 1
    for n in reversed(order[1:]):
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    return [n for n in scored if n.points]


def _reads(x: Node, least: int, scores: bool) -> bool:
    """Whether a part beside the best container reads like it: a heading, or enough text, little of it in links."""
    if not x.chars or 4 * x.linked >= x.chars:
        return False
    return scores or (x.tag in TEXT_TAGS or x.tag in ("ul", "ol", "dl", "table", "figure")) and least == BESIDE or x.chars >= least


def main_text(page: str) -> str:
    """The text of the best container, its blocks joined by newlines; empty where there is none."""
    root = parse(page)
    found = blocks(root)
    nodes = _weighed(found, root)
    if not found:
        return ""
    worth = lambda n: n.points * (1 - n.linked / max(1, n.chars))
    best = max(nodes, key=worth) if nodes else root  # the first of equals in page order
    holds, n = {id(best)}, best
    while n is not None and n.tag not in ("article", "main"):
        n = n.parent
        holds.add(id(n))
    if n is not None:
        own = n
        while n is not None and n.tag != "main":  # an article may be one of several parts of a main element
            n = n.parent
        n = own if n is None else n
        kept, up = {id(n)}, own
        while up is not n:
            up = up.parent
            holds.add(id(up))
    else:
        rights = {id(y) for owner, text, _ in found if _RIGHTS.search(text) for y in (owner, owner.parent)}
        kept, x, least = {id(best)}, best, BESIDE
        while x.parent is not None:
            kept |= {id(y) for y in x.parent.parts if isinstance(y, Node) and y is not x and not y.dropped and not (y.chars < 200 and id(y) in rights) and _reads(y, least, worth(y) >= max(10.0, 0.2 * worth(best)))}
            x, least = x.parent, OUTSIDE

    # From the top down: within what is kept, and not within a list of links beside or in it.
    state: dict[int, bool] = {}

    def shown(n: Node | None) -> bool:
        path = []
        while n is not None and id(n) not in state:
            path.append(n)
            n = n.parent
        on = n is not None and state[id(n)]
        for x in reversed(path):
            on = on or id(x) in kept
            if on and x.tag in LISTS and id(x) not in holds and not x.cites and x.links >= LIST_LINKS and x.linked >= LIST_SHARE * x.chars:
                on = False
            if on and x.tag == "article" and id(x) not in holds and 4 * x.linked >= x.chars:  # a teaser of another page
                on = False
            state[id(x)] = on
        return on

    return "\n".join(text for owner, text, _ in found if shown(owner))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text (empty if none), n_chars. Null html counts as empty; other columns are not read."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_url")}
    return rows.mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
