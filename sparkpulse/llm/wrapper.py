"""Main-text extraction by wrapper induction.

Pages of a host are aligned with reference pages of the same host by simple tree matching: the largest top-down mapping
of two DOM trees that keeps tags, order and parents.  A text node whose mapped node holds the same text in every usable
reference, two at least, is template; varying ones are content.  References are the host's pages of smallest and
largest content hash under two seeds, joined by host.  A reference is usable if it isn't the page itself nor a near copy (most of the page's text constant).
What every page fills differently without being content (menus, adverts, footers, forms, comments) is known by element
name and by class, id or role; of the rest the article elements count, else main, else the body.

Null or empty html gives an empty text.  White space, no-break spaces too, becomes one space inside a block; blocks are
joined by one newline.  Pages without a host are aligned with one another.  Repeated rows give equal texts.  Markup may be nested
to any depth.  An empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROP = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe svg math canvas object embed audio video dialog menu title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open p element.
ENDS_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot li dd dt".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("ul ol dl table body html article section div main aside nav footer header form".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|rail|widget|footer|header|masthead|topbar|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|skip|toolbar|banner|complementary|contentinfo|dialog|form)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: References that are sent to every executor at most, in bytes of html; beyond, pages and references are shuffled by host.
BROADCAST_BYTES = 32 << 20
SALTS = 16
#: Hosts whose parsed references a worker remembers.
HOSTS = 100


class Node:
    __slots__ = ("tag", "noise", "kids", "text", "shape", "size", "template", "holds")

    def __init__(self, tag: str, noise: bool = False, text: str = ""):
        self.tag, self.noise, self.text, self.kids, self.template = tag, noise, text, [], False
        self.shape, self.size, self.holds = None, 1, False


def tree(source: str) -> Node:
    """A forgiving DOM: unknown end tags are ignored, open elements end where HTML lets them."""
    root = Node("#root")
    stack, at = [root], 0
    for m in iter(lambda: TOKEN.match(source, at), None):
        at = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            if text.strip():
                stack[-1].kids.append(Node("#text", text=" ".join(_html.unescape(text).split())))
                if text[0].isspace():
                    stack[-1].kids[-1].text = " " + stack[-1].kids[-1].text
                if text[-1].isspace():
                    stack[-1].kids[-1].text += " "
            elif stack[-1].kids:
                stack[-1].kids.append(Node("#blank", text=" "))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDS and tag not in BOUNDS:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDS:
                    break
        elif tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDS:
                    break
        attrs = " ".join(a or b or c for _, a, b, c in ATTR.findall(m[3])) if m[3] else ""
        node = Node(tag, bool(attrs and NOISE.search(attrs)))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
            stack.append(node)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def shapes(root: Node, known: dict) -> None:
    """Number the subtrees' shapes (tags alone); equal shapes map onto each other whole."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(n.kids)
    for n in reversed(order):
        key = (n.tag, n.noise, *(k.shape for k in n.kids))
        n.shape = known.setdefault(key, len(known))
        n.size = 1 + sum(k.size for k in n.kids)


class Matcher:
    """Simple tree matching of trees whose shapes share one numbering."""

    def __init__(self) -> None:
        self.shapes: dict = {}
        self.weights: dict[tuple[int, int], int] = {}

    def weight(self, a: Node, b: Node) -> int:
        """Mapped pairs of the largest mapping of a and b; inner pairs come first, on a stack of its own, so any depth will do."""
        if (w := self.known(a, b)) is not None:
            return w
        todo = [(a, b, False)]
        while todo:
            x, y, ready = todo.pop()
            if ready:
                self.weights[x.shape, y.shape] = 1 + self.table(x.kids, y.kids)[-1][-1]
            elif self.known(x, y) is None:
                todo.append((x, y, True))
                todo.extend((p, q, False) for p in x.kids for q in y.kids if self.known(p, q) is None)
        return self.weights[a.shape, b.shape]

    def known(self, a: Node, b: Node) -> int | None:
        if a.shape == b.shape:
            return a.size
        if a.tag != b.tag or a.noise != b.noise:
            return 0
        return self.weights.get((a.shape, b.shape))

    def table(self, x: list[Node], y: list[Node]) -> list[list[int]]:
        rows = [[0] * (len(y) + 1)]
        for a in x:
            last, row = rows[-1], [0]
            for j, b in enumerate(y):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if a.tag == b.tag and (w := last[j] + self.weight(a, b)) > best:
                    best = w
                row.append(best)
            rows.append(row)
        return rows

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        """The mapped nodes."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            yield a, b
            x, y = a.kids, b.kids
            while x and y and x[0].shape == y[0].shape:
                stack.append((x[0], y[0]))
                x, y = x[1:], y[1:]
            while x and y and x[-1].shape == y[-1].shape:
                stack.append((x[-1], y[-1]))
                x, y = x[:-1], y[:-1]
            if not x or not y:
                continue
            rows, i, j = self.table(x, y), len(x), len(y)
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    stack.append((x[i], y[j]))


def blocks(root: Node) -> list[str]:
    """Texts of the content's blocks, in page order."""
    weigh(root)
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}
    stack = [root]
    while stack:
        n = stack.pop()
        if dropped(n):
            continue
        if n.tag in found:
            found[n.tag].append(n)
            if n.tag == "article":
                continue
        stack.extend(reversed(n.kids))
    tops = found["article"] or found["main"][:1] or found["body"][:1] or [root]
    out: list[str] = []
    for top in tops:
        parts: list[str] = []
        todo: list = [(top, top is not root and top.tag != "#text")]
        while todo:
            n, _ = todo.pop()
            if isinstance(n, str):
                out.append(" ".join("".join(parts).split()))
                parts = []
                continue
            if n.tag in ("#text", "#blank"):
                if not n.template:
                    parts.append(n.text)
                continue
            if n is not top and dropped(n):
                parts.append(" " if n.tag not in BLOCK else "")
                continue
            if n.tag == "br":
                parts.append(" ")
            edge = n.tag in BLOCK
            if edge:
                out.append(" ".join("".join(parts).split()))
                parts = []
                todo.append(("", False))
            todo.extend((k, False) for k in reversed(n.kids))
        out.append(" ".join("".join(parts).split()))
    return [x for x in out if x]


def weigh(root: Node) -> None:
    """Mark the elements that hold the content: an article, main or h1 that isn't noise itself, or most of the page's text
    outside links, template and elements dropped by name.  Names in class, id or role don't drop these."""
    order, stack = [], [(root, False)]
    while stack:
        n, out = stack.pop()
        out = out or n.tag in DROP or n.tag == "a" or n.tag == "#text" and n.template
        order.append((n, out))
        stack.extend((k, out) for k in n.kids)
    length: dict[int, int] = {}
    for n, out in reversed(order):
        length[id(n)] = (0 if out else len(n.text)) + sum(length[id(k)] for k in n.kids)
        n.holds = not out and any(k.holds or k.tag in ("article", "main", "h1") and not k.noise for k in n.kids)
    for n, _ in order:
        n.holds = n.holds or 2 * length[id(n)] > length[id(root)]


def dropped(n: Node) -> bool:
    if n.tag == "header":
        return not any(k.tag in ("h1", "h2") for k in n.kids)
    return n.tag in DROP or n.noise and not n.holds and n.tag not in ("html", "body", "main", "h1", "h2")


def extract(source: str | None, references: list[str], state: dict | None = None) -> str:
    """The page's main text.  state keeps parsed references and mapped shapes between calls for one host."""
    source = source or ""
    if not source:
        return ""
    state = {} if state is None else state
    matcher: Matcher = state.setdefault("matcher", Matcher())
    if len(matcher.shapes) > 20_000 or len(matcher.weights) > 200_000:
        known = state.get("known")
        state.clear()
        state["known"], state["matcher"] = known, Matcher()
        matcher = state["matcher"]
    page = tree(source)
    shapes(page, matcher.shapes)
    constant: list[list[Node]] = []
    for ref in references:
        if not ref or ref == source:
            continue
        if ref not in state:
            shapes(parsed := tree(ref), matcher.shapes)
            state[ref] = parsed
        other = state[ref]
        same, total, alike = [], 0, 0
        for a, b in matcher.pairs(page, other):
            if a.tag == "#text":
                total += len(a.text)
                if a.text == b.text:
                    same.append(a)
                    alike += len(a.text)
        if 2 * alike <= max(1, sum_text(page)):
            constant.append(same)
    if len(constant) > 1:
        ids = set.intersection(*({id(n) for n in c} for c in constant))
        for n in constant[0]:
            n.template = id(n) in ids
    return "\n".join(blocks(page))


def sum_text(root: Node) -> int:
    total, stack = 0, [root]
    while stack:
        n = stack.pop()
        total += len(n.text)
        stack.extend(n.kids)
    return total


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    h = p.select("host", "html", F.xxhash64("html").alias("h"))
    again = F.xxhash64("h", F.lit(7))
    ends = h.select("host", "h").groupBy("host").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min_by("h", again).alias("c"), F.max_by("h", again).alias("d"))
    picks = ends.select("host", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("h"))
    refs = h.join(picks, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.min("html").alias("html")).groupBy("host").agg(F.sort_array(F.collect_list(F.coalesce("html", F.lit("")))).alias("refs"))

    refs = materialise(refs, "wrapper-references")
    small = refs.agg(F.sum(F.aggregate("refs", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, dict] = {}
        for b in batches:
            out = []
            for name, source, ref in zip(b.column("host").to_pylist(), b.column("html"), b.column("refs"), strict=True):
                if name not in states:
                    if len(states) >= HOSTS:
                        states.clear()
                    states[name] = {"known": ref.as_py() or []}
                state = states[name]
                out.append(extract(source.as_py(), state["known"], state))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(p.dtypes)
    if small <= BROADCAST_BYTES:
        p = p.join(F.broadcast(refs), "host", "left")
    else:  # a host's pages are dealt to SALTS tasks
        salted = refs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return p.select("page_id", "url", "html", "host", "refs").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
