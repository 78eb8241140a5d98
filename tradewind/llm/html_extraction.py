"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. Its element nodes are paths of tags with their
classes and ids; below each stand the layouts that pages show there (sequences of child
elements) and the contents (texts of blocks), with the number of pages that show each. An
element whose pages all look alike has low entropy, and a text that most pages repeat tells
nothing of a page: ``importance = 1 - ln(k) / ln(pages)`` for a text on k pages, the entropy
of layouts to the base of their number for an element. The importance of a branch is its
element's, weighted by how few layouts there are, and its children's mean (``GAMMA``).

A page loses the branches that name their own role (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments; see the lists below), and the branches whose
importance is below ``LEAST_IMPORTANCE`` together with that of each text in them. What a page
itself marks as its article (``article``, else ``main``) is all that stays, and in it only texts
that ``MAJORITY`` of the site's pages show go. Without such a mark, lists of links go as well.

Pages that say the same outside of the named branches are one page of the site, so that copies
of an article are no template. Hosts with fewer than ``LEAST_PAGES`` different pages tell
nothing; their pages lose named branches only. A text or element on less than ``SHARE`` of the
pages counts as important, which bounds what is known of a site by its pages' usual length,
whatever the number of pages. Counting is by equal observation, combined before each shuffle;
pages of a host never meet in one task.

Defined cases: null and empty html give empty text, a null url or one without ``://`` belongs to
no site. Repeated rows and null ids give one row each. Unclosed and stray tags are closed and
passed over as browsers do; a page of any length is read whole. Extra columns are passed over.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, written
from .url_filters import url_parts

GAMMA, LEAST_IMPORTANCE = 0.9, 0.2
LEAST_PAGES, SHARE, MAJORITY = 6, 0.05, 0.5
#: A list of links: at least so many, and so much of its text.
LEAST_LINKS, LINK_SHARE = 3, 0.8
BATCH_BYTES = 8 << 20

# Fixed values of HTML, and names by which pages tell the role of a branch.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "head script style title noscript template iframe noembed noframes object svg math canvas audio video xmp".split()
)
FORMS = frozenset("form fieldset select option datalist button textarea input label".split())
ROLE_TAGS = frozenset("nav footer aside menu dialog header".split()) | FORMS
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section
    select summary table tbody td tfoot th thead title tr ul""".split()
)
ROLE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies dialog disqus footer gdpr header login masthead menu menus
    modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted
    related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored
    subscribe subscription toolbar widget widgets""".split()
)
#: Roles inside an article that are part of it.
ARTICLE_PARTS = frozenset(["header"])

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _hash(text: str, seed: int = 0) -> int:
    """A signed 64-bit number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, open and close."""
    at, n, start, quotes_hold = 0, len(page), 0, True
    while at < n:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            # "<!-->" and "<!--->" are comments as well.
            end = page.find("-->", at + 2)
            stop = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at) or page.startswith("</", at) and not _NAME.match(page, at):
            end = page.find(">", at)
            stop = n if end < 0 else end + 1
        else:
            name = _NAME.match(page, at)
            if not name:
                at += 1  # a less-than sign
                continue
            tag = _TAG.match(page, at) if quotes_hold else None
            if tag:
                attributes, stop = tag.group(2), tag.end()
            else:
                # A quote that never ends: from here on the next sign ends a tag.
                quotes_hold = False
                end = page.find(">", at)
                attributes, stop = "", n if end < 0 else end + 1
            if start < at:
                yield "text", page[start:at], ""
            word = name.group(1).lower()
            yield "close" if page[at + 1] == "/" else "open", word, attributes
            if word in RAW and page[at + 1] != "/":
                end = re.compile(rf"</{re.escape(word)}(?=[\s/>])", re.I).search(page, stop)
                stop = end.start() if end else n
            at = start = stop
            continue
        if start < at:
            yield "text", page[start:at], ""
        at = start = stop
    if start < n:
        yield "text", page[start:], ""


class Node:
    """An element, or a block of text (``text`` is not None), below its parent."""

    __slots__ = ("parent", "tag", "path", "named", "text", "children", "links", "within", "owner")

    def __init__(self, parent: "Node | None", tag: str, path: int, named: frozenset, text: str | None = None):
        self.parent, self.tag, self.path, self.named, self.text = parent, tag, path, named, text
        self.children: list[Node] = []
        self.links, self.within = 0, False
        #: The node that text in this one belongs to: itself, but for inline elements.
        self.owner = self
        if parent is not None:
            parent.children.append(self)


#: What an opening tag closes: the tag, and the tags that bound the search.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_BOUNDS = frozenset("td th table caption button object template".split())


class _Tree:
    def __init__(self):
        self.root = Node(None, "", 0, frozenset())
        self.stack, self.open = [self.root], {}
        self.nodes = [self.root]
        self.text: list[str] = []
        self.in_link = 0
        self.links = 0

    def flush(self) -> None:
        """The text gathered so far becomes a block."""
        words = " ".join("".join(self.text).split()) if self.text else ""
        if words:
            top = self.stack[-1].owner
            block = Node(top, "", top.path, frozenset(), words)
            block.links = min(self.links, len(words))
            self.nodes.append(block)
        self.text, self.links = [], 0

    def pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        if node.tag == "a":
            self.in_link -= 1

    def close(self, names: tuple[str, ...], bounds: frozenset | tuple) -> None:
        if not any(self.open.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in names:
                if any(n.owner is n for n in self.stack[i:]):
                    self.flush()
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in bounds:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            if tag not in ("br", "option"):
                self.close(("p",), _BOUNDS)
            self.flush()
        if tag in _CLOSES:
            self.close(*_CLOSES[tag])
        elif tag == "a":
            self.close(("a",), _BOUNDS)
        if tag in VOID:
            return
        kept, named = [tag], set()
        if attributes:
            for key, *values in _ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                kept.append(f"{key.lower()}={' '.join(sorted(_DIGITS.sub('0', value).split()))}")
                named.update(w.lower() for w in _WORDS.findall(value))
        key, owner = " ".join(kept), self.stack[-1].owner
        # Inline elements hold no blocks of their own: their text belongs to the block round them.
        if tag not in BLOCKS and tag not in UNSEEN and tag not in ROLE_TAGS and not named & ROLE_NAMES:
            node = Node(None, tag, 0, frozenset())
            node.owner = owner
        else:
            if tag not in BLOCKS:
                self.flush()
            node = Node(owner, tag, _hash(key, owner.path), frozenset(named & (ROLE_NAMES | {"article", "main"})))
            self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "a":
            self.in_link += 1

    def end(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.open.get("p"):
            self.flush()
        elif tag not in VOID:
            self.close((tag,), () if tag in ("table", "html", "body") else ("table",) if tag in ("td", "th", "tr") else _BOUNDS - {tag})

    def data(self, text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        self.text.append(text)
        if self.in_link:
            self.links += len(text)


def parsed(page: str) -> list[Node]:
    """The nodes of a page in page order; the first one is the root."""
    tree = _Tree()
    for kind, value, attributes in tokens(page):
        if kind == "text":
            tree.data(value)
        elif kind == "open":
            tree.start(value, attributes)
        else:
            tree.end(value)
    tree.flush()
    return tree.nodes


def _role(node: Node) -> bool:
    return node.tag in ROLE_TAGS or node.tag in UNSEEN or bool(node.named & ROLE_NAMES)


def _is_article(node: Node, tag: str) -> bool:
    return node.tag == tag or node.text is None and tag in node.named and node.tag in ("div", "section", "td")


def kept_branches(nodes: list[Node]) -> tuple[list[Node], bool]:
    """Text blocks outside of branches that name a role, and whether they are a marked article."""
    below = {id(nodes[0]): False}
    for node in nodes[1:]:
        below[id(node)] = below[id(node.parent)] or _named(node)
    marked: list[Node] = []
    for tag in ("article", "main"):
        found = [n for n in nodes if n.text is None and n.tag not in ("html", "body") and _is_article(n, tag)]
        marked = [n for n in found if not below[id(n)]]
        if not marked:
            # A page may wrap all in one named branch, such as a form.
            marked = [n for n in found if not n.named & ROLE_NAMES and not _in_asides(n)]
        if marked:
            break
    for node in marked:
        node.within = True
    out, gone = [], {id(nodes[0]): False}
    for node in nodes[1:]:
        node.within = node.within or node.parent.within
        if node.text is not None:
            if not gone[id(node.parent)] and (node.within or not marked):
                out.append(node)
        elif node in marked:
            gone[id(node)] = False
        elif node.tag in ("html", "body"):
            gone[id(node)] = False
        else:
            part = node.within and (node.tag in ARTICLE_PARTS or node.tag not in ROLE_TAGS | UNSEEN and node.named & ROLE_NAMES <= ARTICLE_PARTS)
            gone[id(node)] = gone[id(node.parent)] or _role(node) and not part
    return out, bool(marked)


def _named(node: Node) -> bool:
    return node.text is None and node.tag not in ("html", "body") and _role(node)


def _in_asides(node: Node) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in ("nav", "aside", "footer", "header") or node.named & {"comment", "comments", "related", "sidebar"}:
            return True
    return False


def _layout(node: Node) -> int:
    """The sequence of child elements, repeats told once."""
    seen, last = [], None
    for child in node.children:
        if child.text is None and child.path != last:
            last = child.path
            seen.append(str(last))
    return _hash(" ".join(seen), 1)


def _observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page its signature, and each path with the layout or text that it shows there."""
    for batch in batches:
        at, texts = 0, batch.column("html")
        while at < len(texts):
            hosts, pages, paths, shows, layouts = [], [], [], [], []
            while at < len(texts) and len(hosts) < 50_000:
                host = batch.column("host")[at].as_py()
                nodes = parsed(texts[at].as_py() or "")
                blocks, _ = kept_branches(nodes)
                page = _hash("\n".join(b.text for b in blocks), 2)
                seen = {(n.path, _layout(n), True) if n.text is None else (n.path, _hash(n.text), False) for n in nodes[1:]}
                seen.add((0, page, True))
                for path, show, layout in seen:
                    hosts.append(host)
                    pages.append(page)
                    paths.append(path)
                    shows.append(show)
                    layouts.append(layout)
                at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *(pa.array(v, pa.int64()) for v in (pages, paths, shows)), pa.array(layouts, pa.bool_())],
                names=["host", "page", "path", "shows", "layout"],
            )


SITE = "struct<path:bigint,shows:bigint,layout:boolean,pages:bigint,importance:double,kinds:bigint>"


def site_trees(pages: DataFrame) -> DataFrame:
    """``host, site_pages, tree``: what is known of each host with enough different pages.

    ``tree`` lists texts (``shows``) and elements (``layout``) that at least ``SHARE`` of the
    site's pages show; ``pages`` tells how many, ``kinds`` the layouts of an element.
    """
    seen = pages.filter("host != ''").mapInArrow(
        _observations, "host string, page long, path long, shows long, layout boolean"
    )
    shown = (
        seen.distinct().groupBy("host", "path", "shows", "layout").agg(F.count(F.lit(1)).cast("double").alias("k"))
    )
    shown = written(shown, "shown")
    sites = (
        shown.filter("path = 0").groupBy("host").agg(F.sum("k").alias("m")).filter(F.col("m") >= LEAST_PAGES)
    )
    elements = (
        shown.filter("layout AND path != 0")
        .groupBy("host", "path")
        .agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.log("k")).alias("k_ln_k"), F.count(F.lit(1)).alias("kinds"))
        .select(
            F.col("host").alias("host"),
            F.struct(
                "path",
                F.lit(0).cast("long").alias("shows"),
                F.lit(True).alias("layout"),
                F.col("k").cast("long").alias("pages"),
                F.when(F.col("k") > 1, 1 - F.col("k_ln_k") / (F.col("k") * F.log("k"))).otherwise(1.0).alias("importance"),
                F.col("kinds").alias("kinds"),
            ).alias("node"),
            "k",
        )
    )
    texts = shown.filter("NOT layout").select(
        F.col("host").alias("host"),
        F.struct(
            "path",
            "shows",
            F.lit(False).alias("layout"),
            F.col("k").cast("long").alias("pages"),
            F.lit(None).cast("double").alias("importance"),
            F.lit(0).cast("long").alias("kinds"),
        ).alias("node"),
        "k",
    )
    return (
        elements.unionByName(texts)
        .join(sites.select(F.col("host").alias("host"), "m"), "host")
        .filter((F.col("k") >= F.col("m") * SHARE) & (F.col("k") > 1))
        .groupBy("host", F.col("m").cast("long").alias("site_pages"))
        # At most the usual number of blocks of a page, divided by SHARE.
        .agg(F.collect_list("node").cast(f"array<{SITE}>").alias("tree"))
    )


class _Site:
    """What the tree of a host tells of the nodes of a page."""

    def __init__(self, pages: int | None, tree: list[dict] | None):
        self.pages, self.texts, self.elements = pages or 0, {}, {}
        for node in tree or ():
            if node["layout"]:
                self.elements[node["path"]] = (node["importance"], node["kinds"])
            else:
                self.texts[node["path"], node["shows"]] = node["pages"]

    def repeats(self, block: Node) -> int:
        return self.texts.get((block.path, _hash(block.text)), 1) if self.texts else 1

    def importance(self, nodes: list[Node]) -> dict[int, tuple[float, float]]:
        """For each node its importance and the greatest importance of a text in it."""
        out: dict[int, tuple[float, float]] = {}
        for node in reversed(nodes):
            if node.text is not None:
                own = max(0.0, 1 - math.log(self.repeats(node)) / math.log(self.pages))
                out[id(node)] = own, own
            else:
                parts = [out[id(c)] for c in node.children]
                own, kinds = self.elements.get(node.path, (1.0, 0))
                weight = GAMMA**kinds if kinds else 0.0
                mean = sum(p[0] for p in parts) / len(parts) if parts else own
                out[id(node)] = (1 - weight) * own + weight * mean, max((p[1] for p in parts), default=0.0)
        return out


def main_text(page: str, site: _Site) -> str:
    """The text blocks of a page that stay, joined by one space."""
    nodes = parsed(page)
    blocks, marked = kept_branches(nodes)
    if marked:
        if site.pages:
            blocks = [b for b in blocks if site.repeats(b) < max(2, MAJORITY * site.pages)]
        return " ".join(b.text for b in blocks)
    gone = {id(nodes[0]): False}
    value = site.importance(nodes) if site.pages else {}
    size = dict.fromkeys(map(id, nodes), 0)
    links, many = dict(size), dict(size)
    for node in reversed(nodes):
        if node.text is not None:
            size[id(node)], links[id(node)], many[id(node)] = len(node.text), node.links, node.links > 0
        if node.parent is not None:
            for count in (size, links, many):
                count[id(node.parent)] += count[id(node)]
    for node in nodes[1:]:
        low = bool(value) and max(value[id(node)]) < LEAST_IMPORTANCE
        menu = node.text is None and many[id(node)] >= LEAST_LINKS and links[id(node)] >= LINK_SHARE * size[id(node)]
        gone[id(node)] = gone[id(node.parent)] or low or menu
    return " ".join(b.text for b in blocks if not gone[id(b)])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, _Site] = {}
    for batch in batches:
        at, texts = 0, batch.column("html")
        while at < len(texts):
            first, size, out = at, 0, []
            while at < len(texts) and (at == first or size < BATCH_BYTES):
                host = batch.column("host")[at].as_py()
                if host not in held:
                    if len(held) >= 256:
                        held.clear()
                    held[host] = _Site(batch.column("site_pages")[at].as_py(), batch.column("tree")[at].as_py())
                out.append(main_text(texts[at].as_py() or "", held[host]))
                size += len(out[-1])
                at += 1
            rows = [batch.column(c).slice(first, at - first) for c in ("page_id", "url")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page."""
    rows = documents(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("string"))
    rows = rows.withColumn("host", F.coalesce(url_parts(F.col("url"))[0], F.lit("")))
    sites = written(site_trees(rows), "sites")
    kind = rows.schema["page_id"].dataType.simpleString()
    # The size of the written table decides whether sites are broadcast.
    known = rows.join(sites, "host", "left").select("page_id", "url", "html", "host", "site_pages", "tree")
    return known.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
