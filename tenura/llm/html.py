"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks of text between block-level tags.  A logistic classifier
with fixed weights gives each block's evidence for content or boilerplate,
which become the capacities from the source and to the sink.  Neighbouring
blocks, and blocks close together in the document tree, are tied by smoothness
edges.  The minimum cut, found by maximum flow, is the labelling of least cost,
and blocks on the source side are the page's text.

Each page is labelled on its own inside a scan; nothing is shuffled.  Broken
markup (unclosed or stray tags, cut references) is read as far as it goes.
A null or empty page has an empty text.  Repeated rows are extracted each.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.scratch import free_name

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("script style template noscript title head svg math iframe object canvas audio video".split())
RAW = set("script style template noscript title textarea svg math iframe object canvas audio video".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby s samp small span strike "
             "strong sub sup time tt u var label img wbr br input".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
               "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}}
BOILERPLATE = set("nav footer aside form menu dialog button select textarea fieldset label search".split())
BAD_WORDS = set("ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                "notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment "
                "comments reply replies disqus sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
                "topbar toolbar pagination pager widget login search skip".split())
BAD_OUTSIDE = {"header", "top", "bottom", "links", "meta"}
GOOD_WORDS = set("content article post entry story main body text".split())
BAD_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())

#: The classifier's weights: evidence for content where positive.
WEIGHTS = {"boilerplate": -12.0, "article": 4.0, "outside": -5.0, "good": 1.5, "links": -4.0, "chars": 1.0,
           "sentence": 0.5, "text_tag": 0.5, "copyright": -2.0, "bias": -1.0}
#: Smoothness: between neighbours, divided by their distance in the tree, and between blocks of one parent.
NEIGHBOUR, KIN = 1.0, 0.5


class _Node:
    __slots__ = ("tag", "parent", "depth", "article", "bad", "good", "link", "block")

    def __init__(self, tag, parent, attributes):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if tag in INLINE else self
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.bad = bool(parent and parent.bad) or tag in BOILERPLATE
        self.good = bool(parent and parent.good)
        self.link = bool(parent and parent.link) or tag == "a"
        if tag == "header" and not self.article:
            self.bad = True
        if attributes and not attributes.isspace():
            found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            role = found.get("role", "").lower()
            self.article |= role in ("main", "article")
            names = {w.lower() for k in ("class", "id") for w in _WORDS.findall(found.get(k, ""))}
            self.good |= bool(names & GOOD_WORDS)
            self.bad |= (role in BAD_ROLES or bool(names & BAD_WORDS) or not self.article and bool(names & BAD_OUTSIDE)
                         or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                         or "display:none" in found.get("style", "").replace(" ", "").lower())


def blocks(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters inside links, innermost block element) in page order."""
    out, pieces, linked = [], [], 0
    node = home = _Node("", None, "")
    opened: dict[str, int] = {}
    at, n = 0, len(page)

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            if text:
                out.append((text, linked, home))
        pieces, linked = [], 0

    def close(upto):
        nonlocal node
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent

    def find(tags, stops=()):
        x = node
        while x.parent is not None:
            if x.tag in tags:
                return x
            if x.tag in stops:
                return None
            x = x.parent
        return None

    while at < n:
        m = _TAG.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            piece = page[at:begin]
            pieces.append(piece)
            if node.link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue  # comments, doctypes and stray marks leave no gap
        tag = m[2].lower()
        block = tag not in INLINE
        if block:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if m[1]:
            if opened.get(tag):
                close(find((tag,)).parent)
        elif tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID:
            if tag in CLOSES_P and opened.get("p"):
                p = find(("p",), ("button", "td", "th", "table", "object", "caption"))
                if p:
                    close(p.parent)
            if tag in SIBLINGS:
                x = find(SIBLINGS[tag], SCOPES[tag])
                while x:
                    close(x.parent)
                    x = find(SIBLINGS[tag], SCOPES[tag])
            if tag not in ("html", "body"):
                node = _Node(tag, node, m[3])
                opened[tag] = opened.get(tag, 0) + 1
        if block:
            home = node.block
    flush()
    return out


def _evidence(text: str, linked: int, node: _Node, has_article: bool) -> float:
    w = WEIGHTS
    e = w["bias"] + w["chars"] * min(len(text), 200) / 100 + w["links"] * min(1.0, linked / len(text))
    e += w["sentence"] * (text[-1] in ".!?…:\"'”")
    e += w["text_tag"] * (node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "figcaption"))
    e += w["copyright"] * (text[0] == "©")
    if node.bad:
        e += w["boilerplate"]
    if has_article:
        e += w["article"] if node.article else w["outside"]
    elif node.good:
        e += w["good"]
    return e


def _distance(a: _Node, b: _Node) -> int:
    """Steps between two elements in the tree, at most a dozen."""
    steps = 0
    while a is not b and steps < 12:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(evidence: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Source side of the minimum cut: nodes with source capacity ``e`` (or sink
    capacity ``-e``) and symmetric edges.  Blocking flows: each phase levels
    the nodes from the source and fills all shortest paths in one walk, so long
    pages take a few passes over their edges instead of a search a path."""
    n, tiny = len(evidence), 1e-9
    rest = list(evidence)  # what is left of a node's terminal: source above zero, sink below
    ends: list[int] = []   # an edge's arcs 2k and 2k + 1 are each other's reverse
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(n)]
    for (a, b), c in edges.items():
        arcs[a].append(len(ends))
        arcs[b].append(len(ends) + 1)
        ends += (b, a)
        room += (c, c)
    while True:
        sources = [i for i in range(n) if rest[i] > tiny]
        level = [-1] * n
        for i in sources:
            level[i] = 0
        front, depth, met = sources, 0, False
        while front and not met:
            depth += 1
            reached = []
            for i in front:
                for e in arcs[i]:
                    j = ends[e]
                    if level[j] < 0 and room[e] > tiny:
                        level[j] = depth
                        reached.append(j)
                        met = met or rest[j] < -tiny
            front = reached
        if not met:
            return [x >= 0 for x in level]
        tried = [0] * n  # arcs of a node that lead no further in this phase
        for source in sources:
            node, path = source, []
            while rest[source] > tiny:
                if rest[node] < -tiny:
                    flow = min(rest[source], -rest[node], min(room[e] for e in path))
                    rest[source] -= flow
                    rest[node] += flow
                    full = len(path)
                    for k, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if room[e] <= tiny and k < full:
                            full = k
                    if full < len(path):  # go on from where the path is full
                        node = ends[path[full] ^ 1]
                        del path[full:]
                    continue
                own = arcs[node]
                while tried[node] < len(own) and not (room[own[tried[node]]] > tiny and level[ends[own[tried[node]]]] == level[node] + 1):
                    tried[node] += 1
                if tried[node] < len(own):
                    path.append(own[tried[node]])
                    node = ends[path[-1]]
                elif path:
                    node = ends[path.pop() ^ 1]
                    tried[node] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """Content blocks of a page, one on each line."""
    found = blocks(page or "")
    if not found:
        return ""
    has_article = any(node.article and not node.bad for _, _, node in found)
    evidence = [_evidence(t, linked, node, has_article) for t, linked, node in found]
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, (_, _, node) in enumerate(found):
        if i:
            edges[i - 1, i] = NEIGHBOUR / (1 + _distance(found[i - 1][2], node))
        for kin in (node.parent, node.parent.parent if node.parent else None):
            if kin is not None:
                j = last.get(id(kin))
                if j is not None:
                    edges[j, i] = edges.get((j, i), 0.0) + KIN
                last[id(kin)] = i
    kept = minimum_cut(evidence, edges)
    return "\n".join(t for (t, _, _), k in zip(found, kept) if k)


def extract(pages: DataFrame, html: str = "html", text: str = "main_text") -> DataFrame:
    """``pages`` without the ``html`` column, with the main text as ``text``
    (lengthened by ``_`` where another column has that name)."""
    text = free_name(pages.drop(html), text)
    at = pages.columns.index(html)
    d = pages.withColumn(html, F.col(html).cast("string"))
    rest = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in batches:
            found = pa.array([main_text(p.as_py()) for p in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), found], [*rest, text])

    return d.mapInArrow(run, d.drop(html).withColumn(text, F.lit("")).schema)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, text="text").withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
SQL: dict[str, str] = {}
