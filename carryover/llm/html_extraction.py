"""Main text of web pages: site templates go by counted subtrees, page furniture by its markup.

1. Every element subtree outside article and main is hashed (tag, class, text, children), and inside
   them every box, an element like div or section that has a class or an id, together with its path
   of tags from the article. Rows of a host whose text is the same count as one page; Spark
   counts on how many pages of a host each hash occurs, combining before the shuffle.
2. A subtree that occurs on at least ``min_pages`` pages and ``share`` of the pages of its host is a
   template of the site; templates are few per host by that share, and join the pages by host.
3. Each page is read again: navigation, headers, footers, sidebars, notices, adverts, forms,
   scripts, reader comments and the site's templates go, and what is left of the outermost articles
   and mains is written block by block in page order, or of the page where it has neither.

Headings, paragraphs and lists that articles repeat are their text and stay, however many pages share
them. Inside an article a class only marks furniture on a box, and by a whole word; the class of
an outermost article matters only where another article has text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.session import materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(["script", "style", "noscript", "template", "iframe", "noembed", "noframes", "object", "svg", "math", "canvas", "audio", "video", "head", "title",
                     "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "menu", "dialog", "datalist", "xmp"])
BLOCKS = frozenset(["address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
                    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table",
                    "tbody", "tfoot", "thead", "tr", "ul"])
# an opening tag ends an open element of these kinds, up to the nearest of the fences
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
          "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"html"})}
ENDS_P = frozenset(["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
                    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"])
FENCES_P = frozenset("table td th button object caption html body article section main div li blockquote".split())
FURNITURE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion banner
    cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets related
    recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond reply replies nav navbar
    navigation menu menus footer masthead toolbar login search skiplink""".split())
# inside an article: words that no box of its text is named by
INNER = frozenset("""ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos cookie cookies newsletter subscribe
    subscription sidebar related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager comment comments commentlist disqus
    respond navbar""".split())
BOXES = frozenset("div section aside ul ol dl table figure details fieldset article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "items", "hash", "core", "inside", "key")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.items: list[Node | str] = []
        self.hash = b""
        self.core = False  # holds an article or main element
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.key: int | None = None  # what it is counted by, if it may be a template


def parse(source: str) -> list[Node]:
    """The elements of a page, parents first. Never fails: what is no markup is text."""
    root = Node("#page", "", None)
    nodes, here, at = [root], root, 0
    opened: Counter[str] = Counter()  # open elements by tag: what is not open needs no search

    def close(up: Node) -> Node:
        node = here
        while True:
            opened[node.tag] -= 1
            if node is up:
                return up.parent
            node = node.parent

    while True:
        sign = source.find("<", at)
        if sign < 0:
            here.items.append(source[at:])
            break
        if sign > at:
            here.items.append(source[at:sign])
        if source.startswith("<!--", sign):
            end = source.find("-->", sign + 4)
            at = len(source) if end < 0 else end + 3
            continue
        if source[sign + 1:sign + 2] in ("!", "?"):
            end = source.find(">", sign)
            at = len(source) if end < 0 else end + 1
            continue
        found = _TAG.match(source, sign)
        if not found:
            if re.match(r"</?[a-zA-Z]", source[sign:sign + 3]) and source.find(">", sign) < 0:
                break  # a tag that the page's end cuts off
            here.items.append("<")
            at = sign + 1
            continue
        at, tag = found.end(), found[2].lower()
        if found[1]:
            if opened[tag] > 0:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = close(up)
            continue
        if tag in ENDS_P and opened["p"] > 0:
            up = here
            while up is not root and up.tag != "p" and up.tag not in FENCES_P:
                up = up.parent
            if up.tag == "p":
                here = close(up)
        if tag in CLOSES and any(opened[k] > 0 for k in CLOSES[tag][0]):
            kinds, fences = CLOSES[tag]
            up, hit = here, None
            while up is not root and up.tag not in fences:
                if up.tag in kinds:
                    hit = up
                up = up.parent
            if hit is not None:
                here = close(hit)
        node = Node(tag, found[3], here)
        here.items.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.items.append(source[at:end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            here = node
            opened[tag] += 1
    return nodes


def squeezed(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attributes)}


def subtrees(nodes: list[Node]) -> None:
    """Hash every element after its children, mark what holds an article, and key what may be a template."""
    for node in reversed(nodes):
        text = hashlib.blake2b(digest_size=8)
        text.update(f"<{node.tag} {attributes(node).get('class', '') if node.attributes else ''}>".encode("utf-8", "replace"))
        for item in node.items:
            if isinstance(item, Node):
                text.update(item.hash)
                node.core |= item.core
            elif item.strip():
                text.update(squeezed(item).encode("utf-8", "replace"))
        node.hash = text.digest()
        node.core |= node.tag in ("article", "main")
    path: dict[int, bytes] = {}  # from the outermost article or main
    for node in nodes[1:]:
        if node.inside:
            above = path[id(node)] = hashlib.blake2b(path.get(id(node.parent), b"") + node.tag.encode("utf-8", "replace"), digest_size=8).digest()
            if node.items and node.tag in BOXES and not node.core and node.attributes and {"class", "id"} & attributes(node).keys():
                node.key = int.from_bytes(hashlib.blake2b(node.hash + above, digest_size=8).digest(), "little", signed=True)
        elif node.items and node.tag not in ("html", "head", "body", "title", "script", "style", "article", "main"):
            node.key = int.from_bytes(node.hash, "little", signed=True)


def template_hashes(nodes: list[Node]) -> set[int]:
    """Keys of the subtrees that may be a site's template."""
    return {n.key for n in nodes if n.key is not None}


def _words(named: dict[str, str]) -> set[str]:
    return {w.lower() for w in _NAME.findall(f"{named.get('class', '')} {named.get('id', '')}")}


def _furniture(node: Node) -> bool:
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not node.inside:  # an article's own headline stays
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    named = attributes(node)
    if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return not node.core
    if named.get("role", "").lower() in ROLES:
        return not node.core
    if node.inside:
        if node.tag not in BOXES or (node.core and node.tag != "article"):
            return False
        tokens = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
        return any(t in INNER or re.split("[-_]", t, maxsplit=1)[0] in INNER for t in tokens)
    return not node.core and bool(_words(named) & FURNITURE)


def _text(start: Node, templates: set[int]) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        block = squeezed("".join(line))
        if block:
            blocks.append(block)
        line.clear()

    todo: list[tuple[Node, int]] = [(start, 0)]
    while todo:
        node, place = todo.pop()
        if place == 0 and node.tag in BLOCKS:
            flush()
        for i in range(place, len(node.items)):
            item = node.items[i]
            if isinstance(item, str):
                line.append(item)
            elif item.key in templates or _furniture(item):
                line.append(" ")
            else:
                if item.tag in ("td", "th", "option"):
                    line.append(" ")
                todo += [(node, i + 1), (item, 0)]
                break
        else:
            if node.tag in BLOCKS:
                flush()
    flush()
    return blocks


def main_text(nodes: list[Node], templates: set[int]) -> str:
    """Blocks of the outermost articles and mains in page order, or of the page, without ``templates``, joined by line ends."""
    dropped: set[int] = set()
    for node in nodes[1:]:
        if id(node.parent) in dropped or _furniture(node):
            dropped.add(id(node))
    cores = [n for n in nodes[1:] if n.tag in ("article", "main") and not n.inside and id(n) not in dropped]
    plain = [n for n in cores if n.tag == "main" or not n.attributes or not _words(attributes(n)) & FURNITURE]
    for chosen in (plain, cores):
        blocks = [block for n in chosen for block in _text(n, templates)]
        if blocks:
            return "\n".join(blocks)
    return "\n".join(_text(nodes[0], templates))


def host(url: Column) -> Column:
    """Lower-case host of an absolute url; null when there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents, hashes = [], []
        for source in batch.column(1):
            nodes = parse(source.as_py() or "")
            subtrees(nodes)
            text = main_text(nodes, set()).encode("utf-8", "replace")
            contents.append(hashlib.blake2b(text, digest_size=16).digest())
            hashes.append([None, *sorted(template_hashes(nodes))])  # null counts the page itself
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                                         names=["host", "content", "hashes"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, templates in zip(batch.column(2), batch.column(3).to_pylist()):
            nodes = parse(source.as_py() or "")
            subtrees(nodes)
            texts.append(main_text(nodes, set(templates or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def site_templates(pages: DataFrame, *, min_pages: int = 10, share: float = 0.3) -> DataFrame:
    """(host, templates): the subtree hashes that recur across a host's pages. ``pages`` has (host, html).

    Rows of a host with the same text are one page, whatever stands around it: copies of a page prove no template.
    At most (subtrees of a page) / ``share`` hashes per host can reach the share.
    """
    counted = (pages.where("host IS NOT NULL").mapInArrow(_hash_rows, "host string, content binary, hashes array<bigint>")
               .groupBy("host", "content").agg(F.min("hashes").alias("hashes")).select("host", F.explode("hashes").alias("hash"))
               .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages")))
    counted = materialise(counted.where(F.col("hash").isNull() | (F.col("pages") >= min_pages)), "subtrees")
    total = counted.where("hash IS NULL").select("host", F.col("pages").alias("of"))
    return (counted.where("hash IS NOT NULL").join(total, "host").where(F.col("pages") >= share * F.col("of"))
            .groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("templates")))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, min_pages: int = 10,
                 share: float = 0.3) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    * A null or empty html, and a page with nothing but furniture, give the empty text.
    * A null or relative url has no host; such pages lose no templates.
    * A host with fewer than ``min_pages`` different pages has no templates: nothing tells its furniture from its text
      but the markup. Pages are read whole; a task needs memory for a small multiple of its longest page.
    * Markup is read as browsers do where it is broken: unclosed and stray tags, bare signs and
      cut-off pages give the text that is there. Every row gives a row; rows that
      repeat a text count as one page.
    * An empty table gives an empty result. Other columns are not looked at.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    templates = materialise(site_templates(source.select("host", "html"), min_pages=min_pages, share=share), "templates")
    kind = dict(source.dtypes)["page_id"]
    return (source.join(templates, "host", "left").select("page_id", "url", "html", "templates")
            .mapInArrow(_text_rows, f"page_id {kind}, url string, text string, n_chars bigint"))
