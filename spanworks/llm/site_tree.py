"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements with their
class and id. For each node, the structure and the text below it are compared over the
host's pages; the entropy of their distribution, as a share of the greatest possible,
is the node's importance. Branches of low importance are the site's own furniture and are
left out of each page, as are elements whose name, class, id or role says that they are
no part of an article. If a page marks its main text (``main`` or ``article``), only that
is taken, and within it the tree leaves out only branches with a class or id of their own:
passages that merely repeat there are content. Should nothing of the marked text be left, as
on a host of copies of one page, the tree is not applied within it.

A name is the whole of a class or id, its first word (``sidebar-left``), or its last one after
words of place (``site-footer``); other words (``has-sidebar``, ``category-advertising``) tell a
state or a subject. Within the marked main text only a whole class is a name, or a whole id of an
element other than a heading or paragraph, as ids there name subjects. Names and low importance never leave out the page, ``main`` and ``article``
themselves or a ``main`` below the named element; an ``article`` below one is taken if the page
marks no other text and it is longer than what else is left.

The marked roles are needed because menus and adverts that differ from page to page have
a high entropy and would stay by the tree alone.

Cases: null, empty and markup-free html give the text of the whole, or an empty text.
Pages without a host in their url have no site tree. Tags left open, cut off or never
opened are taken as browsers do in the common cases. Rows with equal page_id are kept
each. Hosts with fewer than ``MIN_PAGES`` pages use the marked roles alone.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.words import prepare
from spanworks.workdir import materialize

#: Pages that a node needs on its host, and the importance from which it stays.
MIN_PAGES, IMPORTANCE = 5, 0.2
#: Keys that the pages of one site are dealt to.
PARTS = 32

# Elements of HTML by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset(
    "nav footer aside form script style noscript template head title iframe button select textarea dialog menu object svg "
    "canvas audio video noembed noframes xmp".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices "
    "pager pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget widgets".split())
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Elements whose ids are places to link to, in the marked main text.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Outside the marked main text only.
HEADERS = frozenset(["header"])
#: Words before the one that names the element ("site-footer"), and after one that only tells a state ("sidebar-open").
PLACES = frozenset("site main page global top bottom left right primary secondary mobile desktop side sub inner outer fixed sticky the".split())
STATES = frozenset("open opened closed active visible enabled disabled collapsed expanded loaded".split())
#: Elements that hold the page or its main text: their names tell nothing against it.
WHOLE = frozenset("html body main article".split())
#: A start tag of a key closes an open element of its values, up to the nearest of ``SCOPES``.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPES = frozenset("ul ol dl table article main section body html aside nav footer form td th".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PARTS = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")
_MASK = (1 << 63) - 1


def _roles(name: str) -> tuple[str, ...]:
    """The words of a class or id that may say what the element is: the whole, the first, and the last after words of place."""
    words = [w for w in _PARTS.split(name) if w]
    if len(words) < 2:
        return tuple(words)
    first = () if words[-1] in STATES else (words[0],)
    return (*first, words[-1]) if PLACES.issuperset(words[:-1]) else first


def _label(tag: str, attributes: str) -> tuple[str, set[str], set[str], set[str]]:
    """The node's name in the tree, its classes, its ids, and its roles."""
    classes, ids, roles = set(), set(), set()
    kinds = {"class": classes, "id": ids, "role": roles}
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        if value and (words := kinds.get(key.lower())) is not None:
            words.update(entities.unescape(value.strip("\"'")).lower().split())
    return f"{tag} {' '.join(sorted(classes | ids))}", classes, ids, roles


SOFT, HARD = 1, 2


class Element:
    """``out`` is 0 in the text, ``SOFT`` if a name or the tree leaves it out, ``HARD`` if its kind does; ``held`` is in an article in a ``SOFT`` one; ``branch`` may be a node of the tree."""

    __slots__ = ("tag", "path", "out", "main", "held", "branch", "shape", "text")

    def __init__(self, tag: str, path: int, out: int, main: bool, held: bool, branch: bool, shape: int = 0):
        self.tag, self.path, self.out, self.main, self.held, self.branch = tag, path, out, main, held, branch
        self.shape, self.text = shape, 0


class Page:
    """One pass over a page: its blocks of text, and the nodes of its tree.

    ``blocks`` has (text, whether in the marked main text); ``nodes`` has for each path
    outside it, or with a class or id inside it, the hashes of structure and text below.
    ``trimmed`` tells whether the tree left out a branch inside it; not if ``within`` is false.
    """

    def __init__(self, html: str, low: frozenset[int] = frozenset(), with_nodes: bool = False, within: bool = True):
        self.low, self.with_nodes, self.within, self.trimmed = low, with_nodes, within, False
        self.blocks: list[tuple[str, bool]] = []
        self.nodes: dict[int, tuple[int, int]] = {}
        self.stack = [Element("", 1, 0, False, False, True)]
        self.depth: dict[str, int] = {}  # how many elements of each tag are open
        self.held: list[str] = []
        self.run: list[str] = []
        at = 0
        while found := _TOKEN.search(html, at):
            self.add(html[at : found.start()])
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self.close(tag)
            else:
                self.open(tag, found[3])
                if tag in RAW:
                    end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                    at = end.start() if end else len(html)
        self.add(html[at:])
        self.flush()
        while len(self.stack) > 1:
            self.pop()

    def add(self, text: str) -> None:
        if text and (not self.stack[-1].out or self.stack[-1].held):
            self.run.append(entities.unescape(text) if "&" in text else text)

    def flush(self) -> None:
        if not self.run:
            return
        text = _SPACE.sub(" ", "".join(self.run)).strip()
        self.run = []
        if text and self.stack[-1].held:
            self.held.append(text)
        elif text:
            self.blocks.append((text, self.stack[-1].main))
            if self.with_nodes:
                above = self.stack[-1]
                above.text = zlib.crc32(text.encode("utf-8", "replace"), above.text) + 1

    def pop(self) -> None:
        e = self.stack.pop()
        self.depth[e.tag] -= 1
        if self.with_nodes:  # what lies in an element counts for the one around it once, when it closes
            above = self.stack[-1]
            above.shape = zlib.crc32(e.shape.to_bytes(8, "big"), above.shape)
            if e.text:
                above.text = zlib.crc32(e.text.to_bytes(8, "big"), above.text) + 1
        if self.with_nodes and e.branch and not e.out:
            shape, text = self.nodes.get(e.path, (0, 0))
            self.nodes[e.path] = (shape * 31 + e.shape) & _MASK, (text * 31 + e.text) & _MASK

    def close_to(self, tags: tuple[str, ...]) -> None:
        if not any(self.depth.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self.flush()
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].tag in SCOPES:
                return

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        if tag in BLOCKS:
            self.flush()
            self.close_to(("p",))
        if tag in CLOSES:
            self.close_to(CLOSES[tag])
        if tag in VOID:
            return
        label, classes, ids, roles = _label(tag, attributes)
        above = self.stack[-1]
        if above.main:
            names = classes if tag in ANCHORS else classes | ids
        else:
            names = {w for n in classes | ids for w in _roles(n)}
        path = (above.path * 0x5851F42D4C957F2D + zlib.crc32(label.encode("utf-8", "replace")) + 1) & _MASK
        root = tag == "main" or "main" in roles
        main = above.main or root or tag == "article"
        whole = root or tag in WHOLE
        named = not whole and bool(names & LEFT_OUT_NAMES)
        out, held = above.out, False
        if out == HARD or tag in LEFT_OUT or roles & LEFT_OUT_ROLES:
            out = HARD
        elif out == SOFT and root:
            out = 0
        elif out == SOFT:
            held = above.held or tag == "article"
            out = HARD if above.held and named else SOFT
        elif named or (not main and tag in HEADERS) or (not main and not whole and (names & HEADERS or path in self.low)):
            out = HARD if main else SOFT
        branch = not main or (above.main and not whole and label != f"{tag} ")
        if main and branch and not out and self.within and path in self.low:
            out, self.trimmed = HARD, True
        held = held and out == SOFT
        if out != above.out or held != above.held:
            self.flush()
        shape = zlib.crc32(label.encode("utf-8", "replace")) if self.with_nodes else 0
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.stack.append(Element(tag, path, out, main and not out, held, branch, shape))

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if not self.depth.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if any(e.out for e in self.stack[k:]):
                    self.flush()
                while len(self.stack) > k:
                    self.pop()
                return
            if tag not in BLOCKS and self.stack[k].tag in SCOPES:
                return

    def text(self) -> str:
        marked = any(main for _, main in self.blocks)
        text = "\n\n".join(text for text, main in self.blocks if main or not marked)
        held = "" if marked else "\n\n".join(self.held)
        return held if len(held) > len(text) else text


def main_text(html: str, low: frozenset[int]) -> str:
    page = Page(html, low)
    if page.trimmed and not any(main for _, main in page.blocks):
        page = Page(html, low, within=False)
    return page.text()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for site, html in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(site, path, shape, text) for path, (shape, text) in Page(html or "", with_nodes=True).nodes.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["site", "path", "shape", "text"])


def _entropy(nodes: DataFrame, value: str) -> DataFrame:
    """Per (site, path): pages, and the entropy of ``value`` over them as a share of the greatest possible."""
    counts = nodes.groupBy("site", "path", value).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("site", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return sums.select("site", "path", "pages", ((F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).alias(value))


def low_branches(nodes: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """(site, low): the paths of low importance of each site, from (site, path, shape, text) of every page."""
    shape = _entropy(nodes, "shape").where(F.col("pages") >= min_pages)
    text = _entropy(nodes, "text").where(F.col("pages") >= min_pages).drop("pages")
    both = shape.join(text, ["site", "path"]).where(F.greatest("shape", "text") < importance)
    return both.groupBy("site").agg(F.collect_set("path").alias("low"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "", frozenset(low or ())) for h, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, importance: float = IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html, ...)."""
    prepare(pages.sparkSession)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(host != "", F.xxhash64(host)).alias("site"))
    nodes = plain.where("site is not null").select("site", "html").mapInArrow(_nodes, "site long, path long, shape long, text long")
    nodes = materialize(nodes, "nodes")
    low = low_branches(nodes, min_pages, importance)
    # a site's pages are dealt to several keys, each with a copy of the site's list; beyond these, large keys are
    # split at run time, which takes a fresh exchange of either side (see graph.join_dealt_anew)
    dealt = F.bitwise_not("site").alias("dealt")
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int").alias("part")
    parted = plain.where("site is not null").select("page_id", "url", "html", dealt, part)
    copies = low.select(dealt, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "low")
    sited = parted.join(copies, ["dealt", "part"], "left").select("page_id", "url", "html", "low")
    alone = plain.where("site is null").select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("low"))
    return sited.unionAll(alone).mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
