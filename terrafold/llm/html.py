"""Main text of web pages. Element subtrees that recur over a host's pages are site templates and go."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: A subtree is a template if it is on so many pages of its host and on this share of them, whichever is more; on a
#: small host this larger share will do for the number, from FEWEST pages on.
LEAST_PAGES, SHARE, SMALL_SHARE, FEWEST = 8, 0.2, 0.6, 3

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never article text.
DROPPED = RAW | frozenset(
    "head nav footer aside form button select option input label menu svg math canvas object embed audio video dialog datalist map".split()
)
#: Words that mark what isn't article text, where a name in class, id or role is made of them and of PARTS alone.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments "
    "disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription "
    "signup login popup modal overlay paywall widget pagination pager skip search complementary contentinfo".split()
)
#: Of these an article has none, whatever holds them or what they hold.
READERS = frozenset("comment comments disqus reply replies respond discussion".split())
#: Words for parts of a page, which say nothing of their own.
PARTS = frozenset(
    "site page main global top bottom left right upper lower inner outer primary secondary first second box area list section block "
    "wrapper wrap container content inline slot unit bar item items form panel group links link icons icon buttons button message msg "
    "header head body title text region zone holder row col column label header posts post articles article stories story thread threads "
    "user reader bottom sticky fixed floating bg image img script iframe tag tags module component mobile desktop".split()
)
#: Inside an article a recurring subtree is a template only in these elements: texts shared by pages are no templates.
CONTAINERS = frozenset("div section ul ol table figure details center dl".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
GAP = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "start", "key")

    def __init__(self, tag: str, attrs: str, start: int):
        self.tag, self.attrs, self.children, self.start, self.key = tag, attrs, [], start, 0


def parse(text: str) -> Node:
    """Tree of elements and strings. Unclosed and stray tags are mended as browsers mostly do; no depth limit."""
    root = Node("#root", "", 0)
    stack, at, end = [root], 0, len(text)
    match = TOKEN.match
    while at < end:
        m = match(text, at)
        whole, tag = m[0], m[2]
        at = m.end()
        if not tag:
            if whole[0] != "<" or whole == "<":
                stack[-1].children.append(whole)
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "article", "body") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS and tag not in ("html", "body"):  # a block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        for k in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
            if stack[k].tag in CLOSES[tag]:
                del stack[k:]
                break
            if stack[k].tag in ("ul", "ol", "dl", "table", "tr") and stack[k].tag != tag:
                break
        node = Node(tag, m[3], m.start())
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            if close is None and tag in ("noscript", "title", "template"):
                continue
            node.children.append(text[at : close.start() if close else end])
            at = close.end() if close else end
            continue
        stack.append(node)
    return root


def walk(root: Node, drops: set[int]) -> Iterator[tuple[Node, bool, bool]]:
    """(node, inside a dropped element, inside an article), parents first. No recursion: pages may nest deeply."""
    todo = [(root, False, False)]
    while todo:
        node, gone, inside = todo.pop()
        yield node, gone, inside
        gone = gone or id(node) in drops
        inside = inside or node.tag in ("article", "main") and not gone
        todo.extend((c, gone, inside) for c in reversed(node.children) if isinstance(c, Node))


def names_of(node: Node) -> tuple[bool, set[str]]:
    """Whether an element is hidden, and the marks among the names in its class, id and role.

    A name like "has-comments" or "notice-period" is no mark: it is not made of marks and parts alone.
    """
    found: set[str] = set()
    for name, *values in ATTRIBUTE.findall(node.attrs):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, found
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, found
            continue
        for token in value.split():
            parts = PART.findall(CAMEL.sub("-", token).lower())
            marks = MARKS.intersection(parts)
            if marks and all(p in MARKS or p in PARTS for p in parts):
                found |= marks
    return False, found


def dropped(root: Node) -> set[int]:
    """Elements (by id()) that hold no article text.

    By kind, or hidden; or marked by name: readers' comments always, others unless they are or hold an unmarked
    article or main element. A header stays in an article, and elsewhere if it holds a top heading.
    """
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        inside = inside or node.tag in ("article", "main")
        todo.extend((c, inside) for c in node.children if isinstance(c, Node))
    gone: set[int] = set()
    holds: set[int] = set()  # elements that are or hold an article whose names aren't marked
    for node, inside in reversed(order):
        hidden, marks = names_of(node) if node.attrs and node.tag not in ("html", "body", "#root") else (False, set())
        article = node.tag in ("article", "main") and not marks and not hidden or any(isinstance(c, Node) and id(c) in holds for c in node.children)
        if node.tag in DROPPED or hidden or not READERS.isdisjoint(marks):
            gone.add(id(node))
        elif marks and not article and node.tag != "main":
            gone.add(id(node))
        elif node.tag == "header" and not inside and not article and not any(isinstance(c, Node) and c.tag in ("h1", "h2") for c in node.children):
            gone.add(id(node))
        elif article:
            holds.add(id(node))
    return gone


def keys(root: Node) -> None:
    """Give each element the hash of its subtree: tag, attributes, text with single spaces, children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        h = xxhash.xxh3_64(f"{node.tag} {node.attrs.strip()}".encode("utf-8", "surrogatepass"))
        for c in node.children:
            h.update(c.key.to_bytes(8, "little") if isinstance(c, Node) else GAP.sub(" ", c).strip().encode("utf-8", "surrogatepass") + b"\0")
        node.key = h.intdigest()


def candidates(root: Node) -> set[int]:
    """Subtrees that may be templates: with text, not paragraphs or headings of an article."""
    keys(root)
    found = set()
    drops = dropped(root)
    for node, gone, inside in walk(root, drops):
        if gone or id(node) in drops or node.tag in ("#root", "html", "body", "main", "article", "br", "hr", "img", "b", "i", "em", "strong", "span", "a"):
            continue
        if not inside or node.tag in CONTAINERS:
            found.add(node.key)
    return found


def main_text(root: Node, templates: frozenset[int] = frozenset()) -> str:
    """Text of the articles (of the whole body where there is none), blocks joined by one line end."""
    if templates:
        keys(root)
    drops = dropped(root)
    has_article = any(n.tag in ("article", "main") and not gone and id(n) not in drops for n, gone, _ in walk(root, drops))
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        if now:
            text = " ".join(entities.unescape("".join(now)).split())
            now.clear()
            if text:
                blocks.append(text)

    todo: list = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            if inside:
                now.append(node)
        else:
            if id(node) in drops or templates and node.key in templates and (not inside or node.tag in CONTAINERS):
                if node.tag in BLOCKS:
                    close()
                continue
            inside = inside or not has_article or node.tag in ("article", "main")
            if node.tag in ("br", "img"):
                now.append(" ")
            block = node.tag in BLOCKS
            if block:
                close()
                todo.append((None, False))
            todo.extend((c, inside) for c in reversed(node.children))
    close()
    return "\n".join(blocks)


def host_of(url):
    """Lower-case host of a URL; null and others give an empty one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """(host, templates): hashes of subtrees that recur over a host's pages.

    A subtree is a template if it is on SHARE of a host's pages and on LEAST_PAGES of them, or on SMALL_SHARE of a
    small host's pages, FEWEST at least. Hashes are counted by (host, hash) with partial counts, so a large host is
    no single task; as each is on a share of the pages, a host has at most the mean number of subtrees a page
    divided by SHARE. Each page is parsed once for the counts.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, found = [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = {k - (1 << 64) if k >> 63 else k for k in candidates(parse(text.as_py() or ""))}
                hosts.extend([host] * (len(mine) + 1))
                found.extend([None, *mine])  # null counts the page
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], ["host", "hash"])

    counts = materialize(
        pages.select(host_of(F.col("url")).alias("host"), "html")
        .mapInArrow(hashes, "host string, hash long").groupBy("host", "hash").count()
        .where(F.col("hash").isNull() | (F.col("count") >= FEWEST)),
        "subtrees",
    )
    total = counts.where("hash IS NULL").select("host", F.col("count").alias("pages"))
    n, pages_ = F.col("count"), F.col("pages")
    enough = (n >= SHARE * pages_) & (n >= F.least(F.lit(LEAST_PAGES), F.greatest(F.lit(FEWEST), SMALL_SHARE * pages_)))
    return (
        counts.where("hash IS NOT NULL").join(total, "host").where(enough & (F.col("host") != ""))
        .groupBy("host").agg(F.array_sort(F.collect_list("hash")).alias("templates"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null and empty pages give an empty text; repeated rows give a row each; an empty table none; other
    columns aren't read. Pages without a host in their URL lose no templates.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                main_text(parse(text.as_py() or ""), frozenset((k + (1 << 64)) & ((1 << 64) - 1) for k in found or ()))
                for text, found in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of(F.col("url")).alias("host"))
    found = materialize(templates(pages), "templates")
    return rows.join(found, "host", "left").select("page_id", "url", "html", "templates").mapInArrow(
        texts, "page_id long, url string, text string, n_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
