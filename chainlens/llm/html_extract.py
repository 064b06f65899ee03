"""Operator 10: main-text extraction with a tree-structured graphical model.

Each page is parsed into a tree of elements and text runs.  Every node has a
hidden state, content or not.  A node's own features (tag, words in its class
and id, link share, text length, punctuation) give its potential; parent and
child are tied by potentials that depend on both states and on the child's
tag.  Sum-product messages go from the leaves to the root and back, which
gives each node's marginal probability of being content; a text run is kept
when its marginal is above one half.

The potentials are counts learned from labelled pages.  Labels come from
pages whose markup says what is what: inside ``article`` or ``main`` is
content, except for the parts that the marker words below name.  The counts
add up over pages, so each task counts its own pages and only counts are
shuffled.

Pages with such markup are judged by ``TreeModel``, whose features include
what the labels are read from.  Pages without it are judged by ``PlainModel``.
Its potentials are learned from the same labelled pages after the markup that
gave the labels was taken away (``unmarked``): link share, length, end of
sentence, headings and like neighbours of each block of text, and how states
change from parent to child.

Text: character references are decoded, white space inside a block becomes
one space, blocks are joined by a line feed in page order.  Scripts, styles,
templates, forms and the document head are never text.

Defined results: null or empty html, or a page without content, gives empty
text.  Unclosed and stray tags are tolerated; a cut-off tag ends the page.
A quote opens an attribute value only after ``=``; a value that is never
closed ends at the next ``>``.  Repeated rows each get a row, extra columns
are not read.
"""

from __future__ import annotations

import math
import re
from binascii import crc32
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens.llm.common import sliced

# HTML's elements without content, without text, and that break lines.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
NEVER_TEXT = {"script", "style", "head", "title", "template", "noscript", "iframe", "form", "button", "select",
              "textarea", "input", "svg", "canvas", "object", "audio", "video", "datalist", "option", "label"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font",
          "i", "img", "ins", "kbd", "mark", "nobr", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# A start tag closes the open elements named here (up to the nearest container).
P_CLOSERS = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
             "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
             "table", "ul"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"},
              "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDERS = {"table", "ul", "ol", "dl", "div", "section", "article", "aside", "nav", "header", "footer", "main", "body",
           "html", "td", "th", "form", "blockquote"}
# Words in class, id or role that mark parts that aren't the article.
MARKERS = ("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
           "copyright disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation "
           "newsletter notice notification pagination pager popup promo promoted promotion recommended related replies "
           "reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe teaser "
           "toolbar warning widget").split()
MARKED_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
CONTENT_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

KNOWN_TAGS = VOID | RAW | NEVER_TEXT | INLINE | P_CLOSERS | set(SAME_LEVEL) | HOLDERS | MARKED_TAGS | CONTENT_TAGS

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)|[^>=]+|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAMING = {"class", "id", "role"}
_BARE_END = re.compile(r"=\s*[^\s\"'>][^\s>]*\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKED = set(MARKERS)
_END = re.compile(r"[.!?…;:]['\"”»)]*\s*$")


class Node:
    __slots__ = ("tag", "names", "parent", "text", "children", "chars", "linked", "block")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...] = (), text: str = ""):
        self.tag, self.parent, self.names, self.text = tag, parent, names, text
        self.children: list[int] = []
        self.chars = self.linked = 0
        self.block = -1


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents first; text runs have the tag ``#text``."""
    nodes = [Node("#root", -1)]
    open_: list[int] = [0]

    def add(node: Node) -> int:
        nodes.append(node)
        nodes[node.parent].children.append(len(nodes) - 1)
        return len(nodes) - 1

    def text(run: str) -> None:
        if run and not run.isspace():
            add(Node("#text", open_[-1], text=unescape(run)))
        elif run:
            add(Node("#text", open_[-1], text=" "))

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[k]].tag
            if tag in names:
                del open_[k:]
                return
            if tag in stop:
                return

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                add(Node("br", open_[-1]))
            elif any(nodes[k].tag == tag for k in open_):
                while nodes[open_.pop()].tag != tag:
                    pass
            continue
        if tag in P_CLOSERS:
            close({"p"}, HOLDERS)
        if tag in SAME_LEVEL:
            close(SAME_LEVEL[tag], {"table", "ul", "ol", "dl"} if tag not in ("thead", "tbody") else {"table"})
        names = tuple(x.lower() for a in _ATTRIBUTE.finditer(m.group(3)) if a.group(1).lower() in _NAMING
                      for x in _PARTS.findall(a.group(2) or a.group(3) or a.group(4) or ""))
        k = add(Node(tag, open_[-1], names))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(html, at)
            at = end.end()
        elif tag not in VOID and not (m.group(3).endswith("/") and not _BARE_END.search(m.group(3))):
            open_.append(k)
    return nodes


def measure(nodes: list[Node]) -> None:
    """Characters and linked characters below each node; the nearest block of each text run."""
    for k, x in enumerate(nodes):
        if x.tag == "#text":
            x.chars = len(x.text.strip())
        p = nodes[x.parent] if k else x
        x.block = k if x.tag not in INLINE and x.tag != "#text" else p.block
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        if x.tag == "a":
            x.linked = x.chars
        p = nodes[x.parent]
        p.chars += x.chars
        p.linked += x.linked


NAMES = 1 << 15  # other class and id words are told apart by hash, so the model has a fixed size


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


def _ends(text: str) -> bool:
    return bool(_END.search(text.rstrip()[-16:]))


def features(nodes: list[Node], k: int) -> list[str]:
    x = nodes[k]
    if x.tag == "#text":
        return ["text", f"len {_bucket(x.chars)}", f"end {_ends(x.text)}"]
    out = ["tag " + (x.tag if x.tag in KNOWN_TAGS else str(crc32(x.tag.encode()) % 64))]
    out += [("marker" if n in _MARKED else f"name {crc32(n.encode()) % NAMES}") for n in dict.fromkeys(x.names) if len(n) < 20]
    if x.chars:
        out.append(f"links {round(4 * x.linked / x.chars)}")
        if x.tag not in INLINE:
            out.append(f"size {_bucket(x.chars)}")
    return out


def labels(nodes: list[Node]) -> list[int] | None:
    """Content or not by the page's own markup; None where it doesn't tell."""
    if not any(x.tag in CONTENT_TAGS for x in nodes):
        return None
    state = [0] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        if x.tag in CONTENT_TAGS:
            state[k] = 1
        elif x.tag in MARKED_TAGS or x.tag in NEVER_TEXT or any(n in _MARKED for n in x.names):
            state[k] = 0
        else:
            state[k] = state[x.parent]
    return state


def count_page(html: str, counts: Counter) -> None:
    """Add a labelled page's sufficient statistics: (feature, state) and (parent, child state, kind)."""
    nodes = parse(html)
    measure(nodes)
    state = labels(nodes)
    if state is None:
        return
    for k in range(1, len(nodes)):
        for f in features(nodes, k):
            counts[f"f\t{f}\t{state[k]}"] += 1
        counts[f"s\t{state[k]}"] += 1
        counts[f"e\t{_kind(nodes[k])}\t{state[nodes[k].parent]}\t{state[k]}"] += 1
    nodes, state = unmarked(nodes, state, wrapped=len(nodes) % 2 == 0)
    for k, names in block_features(nodes).items():
        counts[f"S\t{state[k]}"] += 1
        for f in names:
            counts[f"F\t{f}\t{state[k]}"] += 1
    for k in range(1, len(nodes)):
        counts[f"E\t{_kind(nodes[k])}\t{state[nodes[k].parent]}\t{state[k]}"] += 1


def unmarked(nodes: list[Node], state: list[int], wrapped: bool) -> tuple[list[Node], list[int]]:
    """A labelled page without the markup that its labels were read from: the article's element becomes
    a ``div`` (``wrapped``) or goes, marked tags become ``div``, class and id words go."""
    out: list[Node] = []
    states: list[int] = []
    place = [0] * len(nodes)
    for k, x in enumerate(nodes):
        if x.tag in CONTENT_TAGS and not wrapped:
            place[k] = place[x.parent]
            continue
        place[k] = len(out)
        tag = "div" if x.tag in CONTENT_TAGS or x.tag in MARKED_TAGS and x.tag not in NEVER_TEXT else x.tag
        out.append(Node(tag, place[x.parent] if k else -1, text=x.text))
        states.append(state[k])
    measure(out)
    return out, states


def block_features(nodes: list[Node]) -> dict[int, list[str]]:
    """Features of the blocks that hold text of their own: link share, length, end of sentence,
    headings, and how many of the blocks beside it are running text under the same tag."""
    size = len(nodes)
    link, hidden = [False] * size, [False] * size
    own: dict[int, list] = {}
    for k, x in enumerate(nodes):
        if k:
            link[k] = link[x.parent] or x.tag == "a"
            hidden[k] = hidden[x.parent] or x.tag in NEVER_TEXT
        if x.tag == "#text" and x.chars and not hidden[k]:
            o = own.setdefault(x.block, [0, 0, ""])
            o[0] += x.chars
            o[1] += x.chars if link[k] else 0
            o[2] = x.text
    running = {b: 2 * o[1] < o[0] for b, o in own.items()}
    beside = Counter((nodes[b].parent, nodes[b].tag) for b, r in running.items() if r)
    out = {}
    for b, (chars, linked, last) in own.items():
        like = beside[nodes[b].parent, nodes[b].tag] - running[b]
        out[b] = [f"links {round(4 * linked / chars)}", f"size {_bucket(chars)}", f"end {_ends(last)}",
                  f"beside {min(3, like.bit_length())}"] + (["heading"] if nodes[b].tag in HEADINGS else [])
    return out


def _kind(x: Node) -> str:
    """How tightly a child follows its parent: text and inline, blocks, or parts named by tag or marker."""
    if x.tag in CONTENT_TAGS:
        return "article"
    if x.tag in MARKED_TAGS or x.tag in NEVER_TEXT or any(n in _MARKED for n in x.names):
        return "marked"
    return "inline" if x.tag == "#text" or x.tag in INLINE else "block"


PLAIN_BOUND, MARKED_BOUND, CONTENT_BOUND = 0.8, 8.0, 14.0


class TreeModel:
    """Log potentials from counts; sum-product over the tree."""

    # Pseudo-counts (not content, content): what the marker words mean before any page is seen.
    PRIOR = {"marker": (400.0, 1.0), **{f"tag {t}": (400.0, 1.0) for t in MARKED_TAGS},
             **{f"tag {t}": (1.0, 400.0) for t in CONTENT_TAGS}}
    EDGE_PRIOR = {"marked": ((50.0, 0.05), (50.0, 0.05)), "article": ((1.0, 50.0), (1.0, 50.0)),
                  "block": ((20.0, 0.5), (0.5, 20.0)), "inline": ((50.0, 0.05), (0.05, 50.0))}

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        n = [2.0, 2.0]
        feature: dict[str, list[float]] = {f: list(c) for f, c in self.PRIOR.items()}
        edge = {k: [list(r) for r in rows] for k, rows in self.EDGE_PRIOR.items()}
        for key, c in counts.items():
            kind, *rest = key.split("\t")
            if kind == "f":
                feature.setdefault(rest[0], [0.0, 0.0])[int(rest[1])] += c
            elif kind == "s":
                n[int(rest[0])] += c
            elif kind == "e":
                edge[rest[0]][int(rest[1])][int(rest[2])] += c
        # Weight of a feature: log ratio of its rates.  What a marker word or
        # tag says outright may weigh much, a plain tag or size only a little:
        # that pages of a site keep lists in menus says little of a list elsewhere.
        self.weight = {}
        for f, c in feature.items():
            if sum(c) >= 5:
                w = math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2))
                bound = PLAIN_BOUND if f not in self.PRIOR else MARKED_BOUND if w < 0 else CONTENT_BOUND
                self.weight[f] = max(-bound, min(bound, w))
        self.edge = {k: [[math.log(x / sum(r)) for x in r] for r in rows] for k, rows in edge.items()}

    def unary(self, names: list[str]) -> float:
        """Log potential of content: plain features overlap (tag, size, links),
        so their weights are averaged; marker features count in full."""
        plain = [self.weight[f] for f in names if f in self.weight and f not in self.PRIOR]
        return sum(plain) / max(1, len(plain)) + sum(self.weight.get(f, 0.0) for f in names if f in self.PRIOR)

    def potentials(self, nodes: list[Node]) -> list[float]:
        """Log potential of content of every node; the page as a whole is not content."""
        return [-6.0] + [self.unary(features(nodes, k)) for k in range(1, len(nodes))]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content."""
        size = len(nodes)
        unary = [(0.0, u) for u in self.potentials(nodes)]
        edges = [self.edge[_kind(x)] for x in nodes]
        up = [[0.0, 0.0] for _ in range(size)]      # product of the children's messages
        sent = [(0.0, 0.0)] * size                   # message to the parent
        for k in range(size - 1, 0, -1):
            e = edges[k]
            a0, a1 = unary[k][0] + up[k][0], unary[k][1] + up[k][1]
            m0, m1 = _lse(e[0][0] + a0, e[0][1] + a1), _lse(e[1][0] + a0, e[1][1] + a1)
            sent[k] = (m0, m1)
            p = up[nodes[k].parent]
            p[0] += m0
            p[1] += m1
        belief = [(0.0, 0.0)] * size
        belief[0] = (up[0][0], up[0][1] + unary[0][1])
        out = [0.0] * size
        for k in range(1, size):
            p, e = nodes[k].parent, edges[k]
            b0, b1 = belief[p][0] - sent[k][0], belief[p][1] - sent[k][1]
            d0, d1 = _lse(b0 + e[0][0], b1 + e[1][0]), _lse(b0 + e[0][1], b1 + e[1][1])
            x0, x1 = unary[k][0] + up[k][0] + d0, unary[k][1] + up[k][1] + d1
            top = max(x0, x1)
            belief[k] = (x0 - top, x1 - top)
            out[k] = 1 / (1 + math.exp(min(700.0, x0 - x1)))
        return out


class PlainModel(TreeModel):
    """Potentials for pages that don't mark their article, learned from pages whose marks were taken away."""

    BOUND = 3.0      # of a feature's weight: rates of the pages at hand are no certainty for others
    FLOOR = 0.02     # of an edge's probability, for the same reason
    MARKER = -8.0    # where a page does name a part by a marker word or tag
    EDGE_PRIOR = {**TreeModel.EDGE_PRIOR, "block": ((2.0, 2.0), (0.5, 20.0))}

    def __init__(self, counts: dict[str, int], markers: bool = True):
        self.markers = markers
        n = [2.0, 2.0]
        feature: dict[str, list[float]] = {}
        edge = {k: [list(r) for r in rows] for k, rows in self.EDGE_PRIOR.items()}
        for key, c in counts.items():
            kind, *rest = key.split("\t")
            if kind == "F":
                feature.setdefault(rest[0], [0.0, 0.0])[int(rest[1])] += c
            elif kind == "S":
                n[int(rest[0])] += c
            elif kind == "E":
                edge[rest[0]][int(rest[1])][int(rest[2])] += c
        self.weight = {f: max(-self.BOUND, min(self.BOUND, math.log((c[1] + 1) / n[1]) - math.log((c[0] + 1) / n[0])))
                       for f, c in feature.items()}
        self.edge = {}
        for k, rows in edge.items():
            floor = 0.0 if k == "marked" else self.FLOOR
            p = [[max(floor, x / sum(r)) for x in r] for r in rows]
            self.edge[k] = [[math.log(x / sum(r)) for x in r] for r in p]

    def potentials(self, nodes: list[Node]) -> list[float]:
        out = [0.0] * len(nodes)
        for k, names in block_features(nodes).items():
            out[k] = sum(self.weight.get(f, 0.0) for f in names)
        if self.markers:
            for k, x in enumerate(nodes):
                if x.tag in MARKED_TAGS or any(n in _MARKED for n in x.names):
                    out[k] += self.MARKER
        return out


class Extractor:
    """Main text of a page by the model that its markup calls for."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.marked, self.plain = TreeModel(counts), PlainModel(counts)

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = parse(html)
        measure(nodes)
        p = (self.marked if any(x.tag in CONTENT_TAGS for x in nodes) else self.plain).marginals(nodes)
        hidden = [False] * len(nodes)
        blocks: list[str] = []
        held: list[str] = []
        now = -1
        for k, x in enumerate(nodes):
            hidden[k] = x.tag in NEVER_TEXT or (k > 0 and hidden[x.parent])
            if x.block != now and (x.tag == "#text" or x.tag not in INLINE):
                blocks.append("".join(held))
                held, now = [], x.block
            if x.tag == "br":
                held.append(" ")
            elif x.tag == "#text" and not hidden[k] and p[k] > 0.5:
                held.append(x.text)
        blocks.append("".join(held))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _lse(a: float, b: float) -> float:
    top = a if a > b else b
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def train(pages: DataFrame, html_col: str = "html") -> Extractor:
    """Counts over all labelled pages, summed per task first.  Class and id
    words are hashed to ``NAMES`` numbers, so the statistics that come back
    are of a fixed number whatever the pages hold."""
    def count(batches):
        counts: Counter = Counter()
        for b in sliced(batches, 32):
            for html in b.column(0).to_pylist():
                if html:
                    count_page(html, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["k", "n"])

    rows = pages.select(html_col).mapInArrow(count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return Extractor({r[0]: r[1] for r in rows})


def extracted(pages: DataFrame, model: Extractor, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html (and of a column of that name)."""
    shared = pages.sparkSession.sparkContext.broadcast(model.counts)
    names = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = T.StructType(pages.select(*names).schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        model = Extractor(shared.value)
        for b in sliced(batches, 32):
            text = [model.extract(h) for h in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string())],
                                             names=[f.name for f in schema.fields])

    return pages.select(*names, html_col).mapInArrow(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
