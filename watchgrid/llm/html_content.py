"""Main text of web pages by wrapper induction.

Pages become trees of block elements. The pages of a host fall into layouts by the outline of their containers, and one page
of each layout (by hash) is its reference; layouts of too few pages are aligned with the commonest one of their host. Every
page is aligned with its reference by simple tree matching: two nodes match if their labels agree, and the best
order-preserving matching of their children is found by dynamic programming, after equal subtrees at both ends have been
matched outright. A text that stands at one reference node in most pages of the layout becomes template there; other texts
of that node, and nodes whose text varies, are content. A template text needs the support of many different pages, so copies
of one article do not make it template. What the slots cannot tell apart (menus and adverts vary too) is decided by the
element: its tag, its role and the whole words of its class and id; inside an article, much running text that varies
overrules most names, and marks that lie below named elements and hold most of the page free those. Where a page marks its
content, only slots inside the marks count; all outermost marks do, in page order, unless they hold less than half of the
page's text.

Only one small row per (host, layout, node, text, page) is shuffled to find the template. Reference trees, one per layout, go
to every executor if they measure less than a fixed number of bytes; beyond it pages and trees are shuffled by host and layout,
with the same result, and adaptive execution splits the pages of a large host.

Defined results: null, empty and tag-free inputs give their own text or none; a null URL is a host of its own; a truncated
tag at the end is markup; repeated pages are extracted one by one; columns other than those named are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.llm.common import sent_if_small
from watchgrid.session import cut_lineage

#: A template text is seen in so many different pages at least, and in this share of its layout's pages.
LEAST_PAGES = 5
LEAST_SHARE = 0.8

#: Elements by what they do to text.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "noscript", "template", "svg", "head", "dialog", "menu", "object", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Whole words of class and id. What carries a FIRM word is never main text; of the others, running text inside an article decides.
FIRM = {
    "ad", "adbox", "ads", "adsbygoogle", "adsense", "adslot", "adunit", "advert", "advertisement", "advertisements", "advertising", "adverts",
    "comment", "commentform", "commentlist", "comments", "disqus", "replies",
}
WORDS = FIRM | {
    "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "login", "menu", "modal", "nav", "navbar", "navigation",
    "navmenu", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "promotion", "promotions", "related", "reply",
    "search", "share", "sharing", "sidebar", "sidebars", "sidenav", "signup", "sitefooter", "social", "subfooter", "submenu", "subnav",
    "alert", "disclaimer", "gdpr", "paywall", "sponsor", "sponsored", "sponsors", "subscribe", "toast", "toolbar", "topbar", "topnav",
}
#: Running text: blocks of so many words without links; so many of them inside an article overrule a name.
LEAST_BLOCK = 10
MUCH_TEXT = 40
#: Kinds of furniture.
BY_NAME, FIRMLY = 1, 2
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z][^>]*\Z", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What outlines a layout: opening and closing tags of containers, with their classes.
_CONTAINER = r"(?i)</?(?:div|section|article|main|header|footer|nav|aside|form|table|center|body)\b[^>]*>"
_CLASS = r"(?i)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)"
_YEARS = re.compile(r"((?:©|\(c\)|\bcopyright\b)\D{0,20})(?:19|20)\d\d(?:\s*[-–]\s*(?:19|20)\d\d)?", re.IGNORECASE)
#: In place of the hash of a text: a block of nothing but links.
LINKS = -2
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}


class Node:
    __slots__ = ("tag", "label", "parts", "children", "furniture", "shape", "size", "linked")

    def __init__(self, tag: str, label: str, furniture: int):
        self.tag, self.label, self.furniture = tag, label, furniture
        self.parts: list = []
        self.children: list[Node] = []
        self.linked = 0

    def own_text(self) -> str:
        return " ".join(html.unescape("".join(p if isinstance(p, str) else " " for p in self.parts)).split())


def _furniture(tag: str, attributes: dict[str, str], inside: bool, in_article: bool) -> int:
    if tag in FURNITURE or (tag == "header" and not inside) or attributes.get("role", "").lower() in ROLES:
        return FIRMLY
    if not attributes or tag in ("html", "body"):
        return 0
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    words = {w.lower() for w in _NAME.findall(names)}
    if tag in ("article", "main"):  # a mark of content, but readers' comments are articles inside the article
        return FIRMLY if in_article and words & {"comment", "comments"} else 0
    if words & FIRM:
        return FIRMLY
    # Page builders wrap all content in "builder-widget"; sidebars say "widget" or "widget_name".
    if words & WORDS or ("header" in words and not inside) or any(n.lower().startswith("widget") for n in names.split()):
        return BY_NAME
    return 0


def parse(page: str | None) -> Node:
    """The tree of block elements; inline elements only add to their block's text."""
    root = Node("#", "#", 0)
    stack, page, at, links, landmarks = [root], page or "", 0, 0, 0
    while match := _TOKEN.search(page, at):
        if match.start() > at:
            text = page[at : match.start()]
            stack[-1].parts.append(text)
            if links:
                stack[-1].linked += len(text.split())
        at = match.end()
        tag = match[2]
        if not tag:
            continue
        tag = tag.lower()
        if match[1]:
            if tag == "a":
                links = 0
            if tag == "br":
                stack[-1].parts.append(" ")
            elif any(n.tag == tag for n in stack[1:]):
                while (closed := stack.pop()).tag != tag:
                    landmarks -= closed.tag in ("article", "main")
                landmarks -= tag in ("article", "main")
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "hr") else "")
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(match[3])} if match[3] else {}
        in_article = landmarks > 0 and bool(attributes) and any(n.tag == "article" for n in stack)
        furniture = _furniture(tag, attributes, landmarks > 0, in_article)
        if tag in INLINE and not furniture:
            links = links or int(tag == "a")
            continue
        closes = CLOSES.get(tag)
        while len(stack) > 1 and ((stack[-1].tag == "p" and tag not in INLINE) or (closes and stack[-1].tag in closes)):
            stack.pop()
        node = Node(tag, f"{tag}.{attributes['class']}" if attributes.get("class") else tag, furniture)
        stack[-1].parts.append(node)
        stack[-1].children.append(node)
        if not match[3].endswith("/") or tag not in INLINE:
            stack.append(node)
            landmarks += tag in ("article", "main")
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += node.children[::-1]
    return out


def _shape(root: Node) -> None:
    for node in reversed(in_order(root)):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = hash((node.label, *[c.shape for c in node.children]))


def outline(root: Node) -> str:
    """The labels with their depths, from which ``from_outline`` makes the same tree without texts."""
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        label = node.label.replace("\n", " ")
        lines.append(f"{depth}\t{label}")
        todo += [(c, depth + 1) for c in reversed(node.children)]
    return "\n".join(lines)


def from_outline(text: str) -> Node:
    stack: list[Node] = []
    for line in text.split("\n"):
        depth, label = line.split("\t", 1)
        node = Node(label.split(".")[0], label, 0)
        del stack[int(depth) :]
        if stack:
            stack[-1].children.append(node)
        stack.append(node)
    return stack[0]


def align(one: Node, other: Node) -> list[tuple[Node, Node]]:
    """Matched nodes of two shaped trees, by simple tree matching."""
    weights: dict[tuple[int, int], int] = {}

    def ends(a: Node, b: Node) -> tuple[int, int]:
        x, y, head, tail = a.children, b.children, 0, 0
        most = min(len(x), len(y))
        while head < most and x[head].shape == y[head].shape:
            head += 1
        while tail < most - head and x[-1 - tail].shape == y[-1 - tail].shape:
            tail += 1
        return head, tail

    def table(a: Node, b: Node, head: int, tail: int) -> list[list[int]]:
        x, y = a.children[head : len(a.children) - tail], b.children[head : len(b.children) - tail]
        rows = [[0] * (len(y) + 1)]
        for i, p in enumerate(x):
            row, last = [0], rows[-1]
            for j, q in enumerate(y):
                row.append(max(row[j], last[j + 1], last[j] + weigh(p, q)))
            rows.append(row)
        return rows

    def weigh(a: Node, b: Node) -> int:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        key = (id(a), id(b))
        if key not in weights:
            head, tail = ends(a, b)
            outer = sum(c.size for c in a.children[:head]) + sum(c.size for c in a.children[len(a.children) - tail :])
            inner = 0
            if len(a.children) > head + tail and len(b.children) > head + tail:
                inner = table(a, b, head, tail)[-1][-1]
            weights[key] = 1 + outer + inner
        return weights[key]

    matched, todo = [], [(one, other)]
    while todo:
        a, b = todo.pop()
        if a.label != b.label:
            continue
        matched.append((a, b))
        if a.shape == b.shape:
            todo += zip(a.children, b.children)
            continue
        head, tail = ends(a, b)
        todo += zip(a.children[:head], b.children[:head])
        if tail:
            todo += zip(a.children[-tail:], b.children[-tail:])
        x, y = a.children[head : len(a.children) - tail], b.children[head : len(b.children) - tail]
        if x and y:
            rows = table(a, b, head, tail)
            i, j = len(x), len(y)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x[i], y[j]))
    return matched


def _blocks(node: Node, template: set[int], out: list[str]) -> None:
    """Texts below a node in page order, without furniture and template."""
    todo: list = [node]
    text: list[str] = []

    def flush() -> None:
        if block := " ".join(html.unescape("".join(text)).split()):
            out.append(block)
        text.clear()

    while todo:
        item = todo.pop()
        if isinstance(item, Node):
            flush()
            if not item.furniture:
                parts = [p for p in item.parts if not isinstance(p, str)] if id(item) in template else item.parts
                todo += [None, *reversed(parts)]
        elif item is None:
            flush()
        else:
            text.append(item)
    flush()


def _running(node: Node, template: set[int]) -> int:
    """Words of running text below a node that are neither template nor firm furniture nor links."""
    total, todo = 0, [node]
    while todo:
        item = todo.pop()
        if item.furniture < FIRMLY:
            words = 0 if id(item) in template else len(item.own_text().split()) - item.linked
            total += words if words >= LEAST_BLOCK else 0
            todo += item.children
    return total


def _overrule(root: Node, template: set[int]) -> None:
    """Clear names that running text contradicts: inside a mark by how much varies, around the marks if all are below names."""
    named, clear, todo = [], 0, [(root, False, ())]
    while todo:
        node, inside, above = todo.pop()
        if node.furniture == FIRMLY:
            continue
        if node.furniture:
            if inside and _running(node, template) >= MUCH_TEXT:
                node.furniture = 0
            elif not inside:
                above = (*above, node)
            else:
                continue
        if node.tag in ("article", "main"):
            inside = True
            clear += not above
            named += above
        todo += [(c, inside, above) for c in node.children]
    if named and not clear:
        counts = []
        for furniture in (BY_NAME, 0):
            for node in named:
                node.furniture = furniture
            blocks: list[str] = []
            _blocks(root, template, blocks)
            counts.append(_words(blocks))
        if counts[1] < 2 * counts[0]:
            for node in named:
                node.furniture = BY_NAME


def _words(blocks: list[str]) -> int:
    return sum(len(b.split()) for b in blocks)


def _only_links(node: Node) -> bool:
    return node.linked > 0 and node.linked == len(node.own_text().split())


def _text_key(text: str) -> int:
    """A hash of a block's text that ignores the year of a copyright line."""
    return xxhash.xxh64_intdigest(_YEARS.sub(r"\1", text)) >> 1


def main_text(root: Node, template: set[int], navigation: set[int] | None = None) -> str:
    """The text of all content marks, or of the whole page where the marks hold less than the rest of it.

    ``navigation`` has the nodes that alignment shows to be lists of links; they go from pages without marks. None says that
    the page was aligned with nothing; then bare containers of nothing but links go.
    """
    _overrule(root, template)
    marked, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.furniture:
            continue
        if node.tag in ("article", "main"):
            marked.append(node)
        else:
            todo += node.children[::-1]
    out: list[str] = []
    for node in marked:
        _blocks(node, template, out)
    if navigation is None:
        navigation = {id(n) for n in in_order(root) if n.tag == "div" and _only_links(n)}
    whole: list[str] = []
    _blocks(root, template | navigation, whole)
    return " ".join(out if 2 * _words(out) >= _words(whole) and out else whole)


def _host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def _outline_hash(html: Column) -> Column:
    """A hash of the set of neighbouring container tags, so how often one is repeated in a row does not matter."""

    def name(tag: Column) -> Column:
        return F.concat_ws(" ", F.regexp_extract(tag, r"^</?\w+", 0), F.regexp_replace(F.regexp_extract(tag, _CLASS, 1), r"[\"'\d]+", ""))

    names = F.transform(F.regexp_extract_all(html, F.lit(_CONTAINER), F.lit(0)), lambda tag: F.lower(name(tag)))
    # After a closing tag comes its own kind again when a container is repeated; closing tags carry no class.
    pairs = F.zip_with(names, F.slice(names, 2, 1 << 30), lambda a, b: F.concat_ws(">", a, b))
    once = F.filter(pairs, lambda pair: ~pair.rlike(r"^</(\w+) ?><\1\b"))
    return F.xxhash64(F.array_sort(F.array_distinct(once)))


def layouts(pages: DataFrame) -> DataFrame:
    """Add ``layout``, ``own`` (the page has that very outline) and ``votes`` (it helps to find the layout's template)."""
    outlined = pages.withColumn("outline", _outline_hash(F.col("html")))
    different = outlined.select("host", "outline", F.xxhash64("html").alias("page")).distinct()
    sizes = cut_lineage(different.groupBy("host", "outline").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") >= LEAST_PAGES).select(F.col("host").alias("large_host"), F.col("outline").alias("large"))
    most = F.max(F.struct("n", "outline"))
    usual = sizes.groupBy(F.col("host").alias("usual_host")).agg(most.alias("usual"))
    known = outlined.join(sent_if_small(cut_lineage(usual)), F.col("host") == F.col("usual_host"))
    known = known.join(sent_if_small(cut_lineage(large)), (F.col("host") == F.col("large_host")) & (F.col("outline") == F.col("large")), "left")
    layout = F.coalesce("large", "usual.outline")
    votes = F.col("large").isNotNull() | (F.col("usual.n") < LEAST_PAGES)
    return known.select("page_id", "url", "html", "host", layout.alias("layout"), (F.col("outline") == layout).alias("own"), votes.alias("votes"))


def _same_layout() -> Column:
    return (F.col("host") == F.col("of_host")) & (F.col("layout") == F.col("of_layout"))


def references(pages: DataFrame) -> DataFrame:
    """``of_host``, ``of_layout``, ``reference``: the outline of one page of each layout, chosen by hash."""
    marked = pages.where("own").withColumn("mark", F.xxhash64("page_id", "url"))
    first = marked.groupBy(F.col("host").alias("of_host"), F.col("layout").alias("of_layout")).agg(F.min("mark").alias("of_mark"))
    first = sent_if_small(cut_lineage(first))
    chosen = marked.join(first, _same_layout() & (F.col("mark") == F.col("of_mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [outline(parse(page)) for page in batch.column(2).to_pylist()]
            names = ["of_host", "of_layout", "reference"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=names)

    outlines = chosen.select("of_host", "of_layout", "html").mapInArrow(run, "of_host string, of_layout long, reference string")
    return outlines.groupBy("of_host", "of_layout").agg(F.min("reference").alias("reference"))  # pages may be repeated


class Wrapper:
    """Reference trees by layout, parsed once each and kept while few."""

    def __init__(self) -> None:
        self._trees: dict[str, tuple[Node, dict[int, int]]] = {}

    def matched(self, reference: str, root: Node) -> list[tuple[Node, int]]:
        if reference not in self._trees:
            if len(self._trees) > 200:
                self._trees.clear()
            tree = from_outline(reference)
            _shape(tree)
            self._trees[reference] = tree, {id(n): i for i, n in enumerate(in_order(tree))}
        tree, numbers = self._trees[reference]
        _shape(root)
        return [(node, numbers[id(other)]) for node, other in align(root, tree)]


def _hidden(root: Node) -> set[int]:
    """Nodes that no rule makes main text: firm furniture and all below it."""
    out, todo = set(), [(root, False)]
    while todo:
        node, below = todo.pop()
        below = below or node.furniture == FIRMLY
        if below:
            out.add(id(node))
        todo += [(c, below) for c in node.children]
    return out


def constants(pages: DataFrame) -> DataFrame:
    """``of_host``, ``of_layout``, ``template`` of layouts with enough pages to judge: reference nodes with their constant texts
    (or LINKS, where nearly all pages have nothing but links). ``pages`` carry ``reference``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = Wrapper()
        for batch in batches:
            seen: set[tuple[str, int, int, int, int]] = set()
            for host, layout, page, reference in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                root = parse(page)
                texts = {id(n): n.own_text() for n in in_order(root)}
                whole = xxhash.xxh64_intdigest(" ".join(texts.values())) >> 1
                seen.add((host, layout, -1, 0, whole))
                hidden = _hidden(root)
                for node, number in wrapper.matched(reference, root):
                    if id(node) not in hidden and (text := texts[id(node)]):
                        seen.add((host, layout, number, _text_key(text), whole))
                        if node.linked == len(text.split()):
                            seen.add((host, layout, number, LINKS, whole))
            keys = list(seen)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["of_host", "of_layout", "node", "text", "page"])

    kinds = "of_host string, of_layout long, node int, text long, page long"
    seen = pages.where("votes").select("host", "layout", "html", "reference").mapInArrow(run, kinds)
    # Copies of one page count once: their whole texts agree.
    texts = cut_lineage(seen.distinct().groupBy("of_host", "of_layout", "node", "text").agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}"))
    judged = texts.where("node = -1").select(F.col("of_host").alias("host"), F.col("of_layout").alias("layout"), F.col("n").alias("all_pages"))
    judged = sent_if_small(cut_lineage(judged))
    met = texts.join(judged, _same_layout()).where(F.col("n") >= LEAST_SHARE * F.col("all_pages"))
    # collect_list leaves out nulls, so a layout without constants has an empty list.
    constant = F.when(F.col("node") >= 0, F.struct("node", "text"))
    return met.groupBy("of_host", "of_layout").agg(F.sort_array(F.collect_list(constant)).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (main text) and ``n_chars`` (its code points)."""
    pages = layouts(_host(pages))
    found = cut_lineage(references(pages))
    template = cut_lineage(constants(pages.join(sent_if_small(found), _same_layout())))
    # Only layouts with constants need alignment.
    needed = F.when(F.size("template") > 0, F.col("reference")).alias("reference")
    judged = found.join(template, ["of_host", "of_layout"])
    known = sent_if_small(cut_lineage(judged.select("of_host", "of_layout", needed, F.col("template.node").alias("nodes"), F.col("template.text").alias("texts"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrapper = Wrapper()
        for batch in batches:
            found = []
            for page, reference, nodes, texts in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                root, constant = parse(page), set()
                navigation: set[int] | None = None if nodes is None else set()
                if reference is not None:
                    numbers, fixed = set(nodes), set(zip(nodes, texts))
                    for node, number in wrapper.matched(reference, root):
                        if number in numbers:
                            if (number, _text_key(node.own_text())) in fixed:
                                constant.add(id(node))
                            if (number, LINKS) in fixed and _only_links(node):
                                navigation.add(id(node))
                found.append(main_text(root, constant, navigation))
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    met = pages.join(known, _same_layout(), "left").select("page_id", "url", "html", "reference", "nodes", "texts")
    kind = pages.schema["page_id"].dataType.simpleString()
    return met.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
