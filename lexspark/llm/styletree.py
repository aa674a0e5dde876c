"""HTML extraction by site style trees.

Every page becomes a tree of block elements. The trees of one host are merged by path
(tag, class, id); a merged node has importance from two entropies, taken over the host's
different pages: of the child sequences it occurs with (presentation) and of the pages
in which each of its texts occurs (content). A text that stands on all pages has
content importance 0, one that stands on a single page 1. A node's composite importance
weighs its own presentation against the content of all leaves below it, in which each
different text counts by the root of its pages, so many near copies do not outweigh
other pages and a few odd texts do not save a menu. In branches
under LOW importance, seen on at least PAGES different pages, the texts that are
themselves under LOW on the host are removed from each page; texts that are rare on the
host stay. In a page's article element only container branches go (a repeated heading
between paragraphs belongs to the article), and only while the common texts are at most
ARTICLE_SHARE of the article: a page that shares more with its host is a near copy of
other pages, and keeps its text.

What tag, role, class or id say is a prior. Menus, headers, footers, sidebars, notices,
adverts, forms and comments outside the article are presentation nodes of importance 0;
inside it only the names in FOREIGN_NAMES are, other names leave the decision to the
entropies. If a page marks its article, only what lies in it is kept; a marked article in
a marked element (a teaser in a sidebar) counts only if there is no other. Names on the page itself,
on an element whose paragraphs are most of its text, and states (has-sidebar) mark nothing.

The merged statistics are partial aggregates by host and path, so a host with a third of
all pages is no one task's work. What returns to the pages is each host's list of low
nodes and common texts: one dictionary if its measured size is at most BROADCAST_BYTES,
else joined, and read once per host and batch.

Defined cases: null or empty html gives an empty text; a page whose url has no host is
judged by its own marks alone; equal pages of a host count once in the statistics and
each gives its row; unclosed or stray tags, cut pages and text without tags are read as
they come; nodes deeper than DEPTH count as part of their ancestor at that depth; extra
columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches
from lexspark.session import cut_lineage

LOW, PAGES, GAMMA, DEPTH, ARTICLE_SHARE = 0.3, 5, 0.9, 24, 0.34
BROADCAST_BYTES = 8 << 20

# Elements of HTML by their role in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "math", "select", "button", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "search", "legend", "optgroup", "option",
}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "menu", "dl", "table", "div", "section", "article", "td", "th", "body"}
NO_CONTENT = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "search"}
NO_CONTENT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NO_CONTENT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|topbar|"
    r"footer|bottom|sidebar|side|aside|widget|related|recommend(?:ed|ations)?|share|sharing|social|comments?|disqus|respond|replies|reply|cookies?|consent|gdpr|notice|alert|popup|"
    r"modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|pagination|pager|toolbar|copyright|skip|toc|tags)(?:$|[\s_-])", re.IGNORECASE)
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|disqus|respond|feedback)(?:$|[\s_-])", re.IGNORECASE)
# names that are foreign to an article also where they stand in it
FOREIGN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)?|adsense|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|related|recommend(?:ed|ations)?|"
    r"share|sharing|social|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|form|pagination|pager|toolbar|sidebar)(?:$|[\s_-])", re.IGNORECASE)
STATE_NAMES = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is|layout)[_-]\S*", re.IGNORECASE)
PROSE = {"p", "h1", "h2", "h3", "blockquote", "pre"}
CONTAINERS = {"div", "section", "ul", "ol", "menu", "dl", "table", "details", "figure", "fieldset", "center", "hgroup", "header"}
ARTICLE_NAMES = re.compile(r"(?:^|\s)(?:article|post|entry|story)[_-]?(?:body|content|text)(?:$|\s)", re.IGNORECASE)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.IGNORECASE)
_UNSHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Node:
    """A block element: its path in the site tree, its children's tags, and what its marks say."""

    __slots__ = ("anchor", "children", "comment", "depth", "foreign", "key", "mark", "named", "parent", "size", "tag")

    def __init__(self, tag, parent, name="", mark=False, anchor=False, comment=False, named=False, foreign=False):
        self.tag, self.parent, self.mark, self.anchor, self.comment = tag, parent, mark, anchor, comment
        self.named, self.foreign, self.size = named, foreign, 0
        self.depth = parent.depth + 1 if parent else 0
        if parent and self.depth > DEPTH:
            self.key = parent.key
        else:
            self.key = xxhash.xxh3_64_intdigest(f"{parent.key if parent else 0}/{tag}.{name}") >> 1
        self.children = []


def parse(page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """Blocks of text in page order with their elements, and all elements."""
    root = Node("#", None)
    nodes, blocks, open_, run = [root], [], [root], []

    def end_block():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((open_[-1], text))

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            run.append(page[at:])
            break
        if found.start() > at:
            run.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if not found[1] and tag in RAW:
            if not found[3].endswith("/"):
                stop = re.compile(rf"</{tag}\s*[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else size
            continue
        if tag not in BLOCKS:
            if tag == "br":
                run.append("\n")
            continue
        end_block()
        if tag in VOID:
            continue
        if found[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        # end tags that may be left out
        if tag in CLOSED_BY:
            k = len(open_) - 1
            while k > 0 and open_[k].tag not in CLOSED_BY[tag] and (open_[k].tag == "p" or open_[k].tag not in LISTS):
                k -= 1
            if k > 0 and open_[k].tag in CLOSED_BY[tag]:
                while k > 1 and open_[k - 1].tag in CLOSED_BY[tag]:
                    k -= 1
                del open_[k:]
        elif open_[-1].tag == "p":
            open_.pop()
        elif tag == "body" and open_[-1].tag == "head":
            open_.pop()
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(found[3])} if found[3] else {}
        name = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role", "").lower()
        parent = open_[-1]
        comment = parent.comment or bool(name and COMMENT_NAMES.search(name))
        anchor = not comment and (tag in ("article", "main") or role in ("article", "main") or attributes.get("itemprop", "").lower() == "articlebody" or bool(name and ARTICLE_NAMES.search(name)))
        # a mark of the element itself, or of its name alone; ``foreign``: also inside an article
        hidden = bool(found[3]) and (
            bool(_HIDDEN.search(_VALUE.sub("=", found[3]))) or bool(_UNSHOWN.search(attributes.get("style", "")))
            or attributes.get("aria-hidden", "").lower() == "true")
        mark = not anchor and (tag in NO_CONTENT or role in NO_CONTENT_ROLES or comment or hidden)
        says = STATE_NAMES.sub("", name)
        named = not anchor and tag not in ("html", "body") and bool(says and NO_CONTENT_NAMES.search(says))
        foreign = mark or (named and bool(FOREIGN_NAMES.search(says)))
        node = Node(tag, parent, re.sub(r"\d+", "", name.lower()), mark or tag == "header", anchor, comment, named, foreign)
        if not parent.children or parent.children[-1] != tag:
            parent.children.append(tag)
        nodes.append(node)
        open_.append(node)
    end_block()
    return blocks, nodes


def kept_blocks(page: str, low: set[int] | frozenset[int] = frozenset(), common: set[int] | frozenset[int] = frozenset()) -> list[tuple[Node, str]]:
    """The blocks of a page that its marks and the site's low nodes leave; low nodes lose only their ``common`` texts."""
    blocks, nodes = parse(page)
    for node, text in blocks:
        size = len(text) if node.tag in PROSE else 0
        while node is not None and size:
            node.size += size
            node = node.parent
    most = sum(len(text) for _, text in blocks) / 2

    def marked(node) -> bool:
        return node.mark or (node.named and node.size <= most)

    outside: dict[int, bool] = {}  # whether a node lies in no marked element
    within: dict[int, bool] = {}  # whether it lies in an anchor
    for n in nodes:
        up = n.parent
        within[id(n)] = up is not None and (up.anchor or within[id(up)])
        outside[id(n)] = up is None or (outside[id(up)] and not (up.foreign if within[id(up)] else marked(up)))
    anchors = [n for n in nodes if n.anchor]
    anchors = [n for n in anchors if outside[id(n)]] or anchors
    articles = {id(n) for n in anchors}
    holders = set()  # elements that hold an article
    for n in anchors:
        while n is not None and id(n) not in holders:
            holders.add(id(n))
            n = n.parent

    def verdict(node) -> tuple[bool, bool, bool]:
        """Whether the marks leave a node, whether it is in a low branch, and whether in an article."""
        inside, up = False, node
        while up is not None and not inside:
            inside, up = id(up) in articles, up.parent
        below_low = False
        while node is not None and id(node) not in holders:
            # the anchor of a teaser inside the article is an element like any other
            if node.foreign if inside else marked(node):
                return False, False, inside
            below_low = below_low or (node.key in low and (not inside or node.tag in CONTAINERS))
            node = node.parent
        return inside or not articles, below_low, inside

    verdicts: dict[int, tuple[bool, bool, bool]] = {}
    kept, body, shared = [], 0, 0
    for node, text in blocks:
        found = verdicts.get(id(node))
        if found is None:
            found = verdicts[id(node)] = verdict(node)
        good, below_low, inside = found
        if good:
            drop = below_low and _hash(text) in common
            body += len(text) if inside else 0
            shared += len(text) if inside and drop else 0
            kept.append((node, text, drop, inside))
    boilerplate = shared <= ARTICLE_SHARE * body
    return [(node, text) for node, text, drop, inside in kept if not drop or (inside and not boilerplate)]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _observe(batches: Batches) -> Batches:
    """Candidate nodes of each page: path, ancestors, child sequence, texts."""
    for batch in batches:
        host, page_key, node, above, style, texts = [], [], [], [], [], []
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            blocks = kept_blocks(page)
            if not blocks:
                continue
            merged: dict[int, tuple[Node, list, list]] = {}
            for owner, text in blocks:
                merged.setdefault(owner.key, (owner, [], []))[2].append(_hash(text))
                up = owner
                while up is not None and up.parent is not None:
                    merged.setdefault(up.key, (up, [], []))[1].extend(up.children)
                    up = up.parent
            # copies of a page are one page: it is known by all its blocks
            key = _hash("\n".join(t for _, t in blocks))
            for k, (n, children, own) in merged.items():
                line, up = [], n
                while up is not None and up.parent is not None:
                    if not line or line[-1] != up.key:
                        line.append(up.key)
                    up = up.parent
                host.append(h)
                page_key.append(key)
                node.append(k)
                above.append(line)
                style.append(_hash(",".join(dict.fromkeys(children))))
                texts.append(sorted(set(own)))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(page_key, pa.int64()), pa.array(node, pa.int64()), pa.array(above, longs), pa.array(style, pa.int64()), pa.array(texts, longs)],
            ["host", "page", "node", "above", "style", "texts"])


def low_nodes(pages: DataFrame) -> DataFrame:
    """Per host the nodes and texts of low importance: columns ``host``, ``low`` and ``common``; needs host and html."""
    seen = pages.where("host <> '' AND html IS NOT NULL").select("host", "html").mapInArrow(
        _observe, "host string, page bigint, node bigint, above array<bigint>, style bigint, texts array<bigint>")
    seen = cut_lineage(seen)
    once = seen.groupBy("host", "node", "page").agg(F.min("style").alias("style"))
    pages_of = once.groupBy("host", "node").agg(F.count("*").alias("m"))
    log_m = F.greatest(F.log("m"), F.lit(1e-9))
    styles = once.groupBy("host", "node", "style").agg(F.count("*").alias("n"))
    presentation = (
        styles.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
        .select("host", "node", "m", F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / log_m).otherwise(1.0).alias("presentation"))
    )
    # a text on k of the m pages of its node has entropy log k, relative to log m
    texts = seen.select("host", "node", "page", F.explode("texts").alias("text")).distinct().groupBy("host", "node", "text").agg(F.count("*").alias("k"))
    texts = texts.join(pages_of, ["host", "node"]).withColumn("importance", F.when(F.col("m") > 1, 1 - F.log("k") / log_m).otherwise(1.0))
    low_text = F.when((F.col("m") >= PAGES) & (F.col("importance") < LOW), F.col("text"))
    # of a node's texts under LOW there are at most as many as fit on one page times m to the power LOW
    content = texts.groupBy("host", "node").agg(F.sum(F.sqrt("k") * F.col("importance")).alias("sum"), F.sum(F.sqrt("k")).alias("weight"), F.collect_set(low_text).alias("common"))
    content = cut_lineage(content)
    lines = seen.select("host", "node", "above").dropDuplicates(["host", "node"])
    below = (
        lines.join(content, ["host", "node"]).select("host", F.posexplode("above").alias("distance", "ancestor"), "sum", "weight")
        .groupBy("host", F.col("ancestor").alias("node")).agg((F.sum("sum") / F.sum("weight")).alias("content"), F.max("distance").alias("height"))
    )
    own = F.pow(F.lit(GAMMA), F.greatest("height", F.lit(1)))
    composite = F.when(F.col("height") == 0, F.col("content")).otherwise((1 - own) * F.col("presentation") + own * F.col("content"))
    low = (
        below.join(presentation, ["host", "node"]).where((F.col("m") >= PAGES) & (composite < LOW))
        .groupBy("host").agg(F.collect_set("node").alias("low"))
    )
    common = content.where(F.size("common") > 0).select("host", F.explode("common").alias("text")).groupBy("host").agg(F.collect_set("text").alias("common"))
    return low.join(common, "host")


NOTHING = (frozenset(), frozenset())


def _texts(batch: pa.RecordBatch, lists) -> pa.RecordBatch:
    texts = []
    for i, page in enumerate(batch.column("html")):
        texts.append("\n".join(t for _, t in kept_blocks(page.as_py() or "", *lists(i))))
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
        ["page_id", "url", "text", "n_chars"])


def _by_dictionary(shared):
    def extract(batches: Batches) -> Batches:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            yield _texts(batch, lambda i, hosts=hosts: shared.value.get(hosts[i], NOTHING))

    return extract


def _by_column(batches: Batches) -> Batches:
    for batch in batches:
        hosts, seen = batch.column("host").to_pylist(), {}

        def lists(i, batch=batch, hosts=hosts, seen=seen):
            if hosts[i] not in seen:
                seen[hosts[i]] = tuple(frozenset(batch.column(c)[i].as_py() or ()) for c in ("low", "common"))
            return seen[hosts[i]]

        yield _texts(batch, lists)


def extract_articles(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    low = cut_lineage(low_nodes(hosted))
    size = low.agg(F.sum((F.size("low") + F.size("common")) * 8 + F.length("host"))).first()[0] or 0
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    if size > broadcast_bytes:
        return hosted.join(low, "host", "left").mapInArrow(_by_column, schema)
    found = {r["host"]: (frozenset(r["low"]), frozenset(r["common"])) for r in low.collect()}  # at most BROADCAST_BYTES
    return hosted.mapInArrow(_by_dictionary(pages.sparkSession.sparkContext.broadcast(found)), schema)
