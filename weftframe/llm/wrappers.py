"""Main text of web pages by wrappers inferred per host.

A page's tag stream becomes nested groups of block tags with text slots between
them. The streams of one host are aligned one after another: where they agree a
tag or slot stays, where one has what the other lacks the group becomes optional,
and neighbouring groups of the same form become one repeated group. The result is
a regular expression without unions for all pages of the host, which also counts
the text and link characters of every group; these choose the group that holds
the article. Pages are then read along their host's expression.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by how they are read.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements and name parts that hold no article text.
DROPPED_TAGS = {
    "head", "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "svg", "dialog", "menu", "object",
    "canvas", "audio", "video", "input", "fieldset",
}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "newsletter", "subscribe", "subscription",
    "signup", "paywall", "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "masthead", "footer", "copyright", "comment", "comments", "commentlist", "disqus", "respond", "replies",
    "discussion", "social", "share", "sharing", "related", "recommended", "recommendations", "popup", "modal", "overlay", "skip",
    "toolbar", "contentinfo", "complementary", "search", "login", "hidden",
}
# Names that a container of the article may carry as well, as in "with-sidebar".
LAYOUT_NAMES = {"sidebar", "nav", "navbar", "navigation", "menu", "masthead", "banner", "search", "social", "widget", "widgets", "notice", "overlay"}
HEADER_NAMES = {"header", "topbar", "siteheader"}
MAIN_NAMES = {"article", "articlebody", "main", "post", "entry", "content", "story"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ROLE_ATTRIBUTES = {"class", "id", "role", "itemprop"}
# hosts a task keeps wrappers of before it passes them on
_HELD_HOSTS = 2_000
_SALTS = 32
SLOT = "#"
# when an element holds no article text
NEVER, WITHOUT_MAIN, ALWAYS = range(3)
# elements nested deeper count as part of the one at this depth
_DEEPEST = 200
# longer lists of groups keep one group per form
_LONGEST = 300


class Node:
    """A block element: its form, and in order its texts and the elements inside it."""

    __slots__ = ("tag", "form", "drop", "dropped", "parts")

    def __init__(self, tag: str, form: str, drop: int):
        self.tag, self.form, self.drop, self.dropped, self.parts = tag, form, drop, False, []


def _form(tag: str, attributes: str, inside_main: bool) -> tuple[str, int]:
    """What an element counts as when streams are aligned, and whether it holds no article text.

    Of its names only those with a meaning are kept, so pages that number or
    shuffle their class names still align and the set of forms is finite.
    """
    names: set[str] = set()
    hidden = False
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in _ROLE_ATTRIBUTES:
                value = a or b or c
                for word in value.split():
                    parts = [p.lower() for p in _PARTS.findall(word)]
                    names.update(parts)
                    names.add("".join(parts))
            elif key == "hidden" or (key == "aria-hidden" and "true" in (a, b, c)):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none", a or b or c, re.I):
                hidden = True
    drop = names & DROPPED_NAMES
    main = names & MAIN_NAMES
    head = tag == "header" or names & HEADER_NAMES
    dropped = NEVER
    if hidden or tag in DROPPED_TAGS or (tag not in ("html", "body", "main") and drop - LAYOUT_NAMES):
        dropped = ALWAYS
    elif tag not in ("html", "body", "main", "article") and (drop or (head and not inside_main)):
        dropped = WITHOUT_MAIN
    form = ".".join([tag, *sorted(drop | main | (names & HEADER_NAMES)), *(["-"] if hidden else [])])
    return form, dropped


def parse(page: str) -> Node:
    """The block elements of a page, with unclosed and stray tags settled."""
    root = Node("", "", NEVER)
    stack = [root]
    link = 0
    inner = 0  # open elements like a dropped inline element, inside it
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].parts.append((page[at:], link > 0))
            break
        if m.start() > at:
            stack[-1].parts.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        top = stack[-1]
        if m.group(1):
            if tag == "a":
                link = 0
            if top.tag in INLINE and tag == top.tag:
                inner -= 1
                if inner < 0:
                    stack.pop()
                    inner = 0
            elif tag not in INLINE and tag not in VOID:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        link = 0
                        break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            top.parts.append(Node("hr", "hr", NEVER) if tag == "hr" else (" ", link > 0))
            continue
        if tag in INLINE:
            if tag == "a":
                link = 1
            if top.tag in INLINE:
                inner += tag == top.tag
            elif m.group(3) and len(stack) < _DEEPEST and _form(tag, m.group(3), True)[1] == ALWAYS:
                # an inline advert or hidden text
                stack.append(Node(tag, tag + ".-", ALWAYS))
                top.parts.append(stack[-1])
                inner = 0
            continue
        if top.tag == "p" or top.tag in INLINE:
            stack.pop()
        link = 0
        closes = CLOSED_BY.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes[1]:
                    break
                if stack[i].tag in closes[0]:
                    del stack[i:]
                    break
        if len(stack) >= _DEEPEST:
            stack[-1].parts.append((" ", False))
            continue
        inside = any(n.tag in ("article", "main") for n in stack)
        node = Node(tag, *_form(tag, m.group(3), inside))
        stack[-1].parts.append(node)
        if not m.group(0).endswith("/>"):
            stack.append(node)
    _settle(root, False)
    return root


def _holds_main(node: Node) -> bool:
    return any(
        isinstance(p, Node) and p.drop != ALWAYS and (p.tag in ("article", "main") or _holds_main(p)) for p in node.parts
    )


def _settle(node: Node, dropped: bool) -> None:
    """Decide what is dropped: all inside what is, and containers by name unless they hold the article."""
    node.dropped = dropped or node.drop == ALWAYS or (node.drop == WITHOUT_MAIN and not _holds_main(node))
    for part in node.parts:
        if isinstance(part, Node):
            _settle(part, node.dropped)


# A group of a wrapper: [form, pages, chars, link chars, optional, repeated, dropped, groups].
FORM, PAGES, CHARS, LINKS, OPTIONAL, REPEATED, DROPPED, GROUPS = range(8)


def groups_of(node: Node) -> list:
    """The wrapper of a single page."""
    inner: list = []
    chars = links = 0
    for part in node.parts:
        if isinstance(part, Node):
            inner.append(groups_of(part))
            continue
        n = len(part[0].strip())
        if n:
            chars += n
            links += n if part[1] else 0
            if not inner or inner[-1][FORM] != SLOT:
                inner.append([SLOT, 1, 0, 0, False, False, node.dropped, []])
            inner[-1][CHARS] += n
            inner[-1][LINKS] += n if part[1] else 0
    inner = _repeated(inner)
    chars, links = sum(g[CHARS] for g in inner), sum(g[LINKS] for g in inner)
    return [node.form, 1, chars, links, False, False, node.dropped, inner]


def _joined(a: list, b: list, same_page: bool) -> list:
    """One group for two of the same form."""
    pages = max(a[PAGES], b[PAGES]) if same_page else a[PAGES] + b[PAGES]
    inner = aligned(a[GROUPS], b[GROUPS], same_page)
    return [
        a[FORM], pages, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], a[OPTIONAL] or b[OPTIONAL],
        a[REPEATED] or b[REPEATED] or same_page, a[DROPPED] and b[DROPPED], inner,
    ]


def _repeated(groups: list) -> list:
    """Neighbouring runs of one to three groups of the same forms become one run, repeated."""
    for width in (1, 2, 3):
        out: list = []
        at = 0
        while at < len(groups):
            if len(out) >= width and [g[FORM] for g in out[-width:]] == [g[FORM] for g in groups[at : at + width]]:
                if width > 1 or groups[at][FORM] != SLOT:
                    out[-width:] = [_joined(a, b, True) for a, b in zip(out[-width:], groups[at : at + width])]
                    at += width
                    continue
            out.append(groups[at])
            at += 1
        groups = out
    return _by_form(groups) if len(groups) > _LONGEST else groups


def _by_form(groups: list) -> list:
    """One repeated, optional group per form, in the order they first occur."""
    first: dict[str, list] = {}
    for group in groups:
        known = first.get(group[FORM])
        first[group[FORM]] = _joined(known, group, True) if known else group
    return [[*g[:OPTIONAL], True, True, *g[REPEATED + 1 :]] for g in first.values()]


def aligned(a: list, b: list, same_page: bool = False) -> list:
    """Two group lists as one: common groups in order, the others optional."""
    if [g[FORM] for g in a] == [g[FORM] for g in b]:
        return [_joined(x, y, same_page) if not same_page else _within(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        form = a[i][FORM]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if form == b[j][FORM] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][FORM] == b[j][FORM]:
            out.append(_within(a[i], b[j]) if same_page else _joined(a[i], b[j], False))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([*a[i][:OPTIONAL], True, *a[i][OPTIONAL + 1 :]])
            i += 1
        else:
            out.append([*b[j][:OPTIONAL], True, *b[j][OPTIONAL + 1 :]])
            j += 1
    return _repeated(out)


def _within(a: list, b: list) -> list:
    """As ``_joined``, for the insides of repeated groups: not repeated by themselves."""
    joined = _joined(a, b, True)
    joined[REPEATED] = a[REPEATED] or b[REPEATED]
    return joined


def expression(group: list) -> str:
    """A wrapper as text: <form>...</form>, # for text, ( )+ repeated, ( )? optional."""
    inner = "".join(expression(g) for g in group[GROUPS])
    text = SLOT if group[FORM] == SLOT else f"<{group[FORM]}>{inner}</{group[FORM].partition('.')[0]}>"
    mark = ("*" if group[OPTIONAL] else "+") if group[REPEATED] else ("?" if group[OPTIONAL] else "")
    return f"({text}){mark}" if mark else text


def _own_text(group: list) -> int:
    """Characters outside links in the parts that may hold article text."""
    if group[DROPPED]:
        return 0
    if group[FORM] == SLOT:
        return group[CHARS] - group[LINKS]
    return sum(_own_text(g) for g in group[GROUPS])


def main_path(wrapper: list) -> list[str]:
    """Forms from the outermost group down to the one that holds the article.

    An article element (or main, or one so named) with a fair share of the text is
    taken; else one goes down as long as one group holds most of what is left.
    """
    total = _own_text(wrapper)
    found: list[tuple[int, int, list[str]]] = []

    def seek(group: list, path: list[str]) -> None:
        if group[DROPPED] or group[FORM] == SLOT:
            return
        path = [*path, group[FORM]]
        tag, *names = group[FORM].split(".")
        rank = 3 if tag == "article" or "articlebody" in names else 2 if tag == "main" or "main" in names else 1 if set(names) & MAIN_NAMES else 0
        if rank and tag not in ("html", "body"):
            text = _own_text(group)
            if text * (3 if rank > 1 else 2) >= total and text:
                found.append((rank, text, path))
        for g in group[GROUPS]:
            seek(g, path)

    seek(wrapper, [])
    if found:
        return max(found, key=lambda f: (f[0], f[1], -len(f[2])))[2]
    path, group = [wrapper[FORM]], wrapper
    while True:
        inner = [g for g in group[GROUPS] if g[FORM] != SLOT and not g[DROPPED] and g[FORM].partition(".")[0] not in HEADINGS | {"p", "ul", "ol", "table", "blockquote", "pre", "dl"}]
        richest = max(inner, key=_own_text, default=None)
        if richest is None or richest[REPEATED] or _own_text(richest) * 10 < _own_text(group) * 6:
            return path
        group = richest
        path = [*path, group[FORM]]


def _follow(root: Node, path: list[str]) -> list[Node]:
    """The elements of a page at a path of forms."""
    level = [root] if root.form == path[0] else []
    for form in path[1:]:
        level = [p for n in level for p in n.parts if isinstance(p, Node) and p.form == form]
    return level


def blocks(node: Node, headings_only: bool = False) -> Iterable[str]:
    """Texts of an element's blocks in order, without what holds no article text."""
    run: list[str] = []
    for part in node.parts:
        if not isinstance(part, Node):
            run.append(part[0])
            continue
        if part.tag in INLINE:
            continue  # dropped; the text around it is one block
        yield from _block(run, headings_only and node.tag not in HEADINGS)
        run = []
        if not part.dropped:
            yield from blocks(part, headings_only or part.tag == "header")
    yield from _block(run, headings_only and node.tag not in HEADINGS)


def _block(run: list[str], skipped: bool) -> Iterable[str]:
    if run and not skipped:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            yield text


def main_text(page: str | None, path: list[str] | None) -> str:
    """The article of a page at its host's path; by the page's own structure where the path leads nowhere."""
    if not page:
        return ""
    root = parse(page)
    nodes = _follow(root, path) if path else []
    if not any(not n.dropped and any(True for _ in blocks(n)) for n in nodes):
        nodes = _follow(root, main_path(groups_of(root)))
    return "\n".join(text for n in nodes if not n.dropped for text in blocks(n))


def host_of(url):
    """Host of a URL in lower case, without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def infer_wrappers(pages: DataFrame, url: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper) for every host of ``pages``, from all its pages.

    ``wrapper`` is JSON. Every task aligns its own pages per host; the partial
    wrappers, one per task and host, are aligned by host and salt and then by host,
    each as a stream, so a host with a third of all pages needs no more memory than
    any other. Pages without html take no part.
    """
    rows = pages.where(F.length(html_column) > 0).select(host_of(F.col(url)).alias("host"), F.col(html_column).alias("html"))

    def local(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = groups_of(parse(page))
                held[host] = _joined(held[host], group, False) if host in held else group
                if len(held) > _HELD_HOSTS:
                    yield _listed(held)
                    held = {}
        yield _listed(held)

    def merged(batches):
        host, wrapper = None, None
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                group = json.loads(text)
                if name == host:
                    wrapper = _joined(wrapper, group, False)
                else:
                    if wrapper is not None:
                        yield _listed({host: wrapper})
                    host, wrapper = name, group
        if wrapper is not None:
            yield _listed({host: wrapper})

    schema = "host string, wrapper string"
    partial = rows.mapInArrow(local, schema).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS)))
    partial = partial.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper")
    partial = partial.mapInArrow(merged, schema)
    return partial.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merged, schema)


def _listed(held: dict[str, list]) -> pa.RecordBatch:
    texts = [json.dumps(w, separators=(",", ":")) for w in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(texts, pa.string())], names=["host", "wrapper"])


def wrapper_paths(wrappers: DataFrame) -> DataFrame:
    """(host, path, expression): where each host's article lies, and the wrapper as text."""

    def run(batches):
        for batch in batches:
            groups = [json.loads(w) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([main_path(g) for g in groups], pa.list_(pa.string())), pa.array([expression(g) for g in groups], pa.string())],
                names=["host", "path", "expression"],
            )

    return wrappers.select("host", "wrapper").mapInArrow(run, "host string, path array<string>, expression string")


def extract_text(pages: DataFrame, paths: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``pages``, each read along its host's path.

    Null and empty html, and pages without article text, give an empty text. Rows
    repeat as given, null keys and urls included; other columns are not read.
    """
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.col(html_column).cast("string").alias("h"))
    joined = rows.withColumn("host", host_of(F.col("u"))).join(paths.select("host", "path"), "host", "left").select("k", "u", "h", "path")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["k", "u", "text", "n_chars"],
            )

    return joined.mapInArrow(run, "k long, u string, text string, n_chars long").withColumnsRenamed({"k": key, "u": url})
