"""Main text of web pages by site template removal.

Every element's subtree is hashed (tag, class, text, children).  Spark counts the different pages of each
host that hold a hash; a hash on ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages or more
is part of the site's template, and its subtrees are deleted.  Inside an article only lists and
containers that are mostly links can be template, so prose that many pages quote stays.  Elements
that say what they are (navigation, forms, adverts, comments and so on) go as well, articles among
them.  What is left of all articles and ``main`` elements, in page order, is the text; those inside
another are part of it.  If none is left, an element with most of the page's text, links apart, stays
whatever it is called, and its articles, else the rest of the page, are the text.  A ``header``
outside of articles and ``main`` is the site's, and goes.

Null html counts as empty and gives an empty text; a null or odd URL belongs to the host with the
empty name.  Rows that repeat an id are pages of their own, but copies of one page count once for its
host's template; an empty table gives an empty result.  Unclosed and cut-off markup is read as far as it
goes; elements nested deeper than ``DEEPEST`` are read as children of one that deep, so parsing
takes time in proportion to the page.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import saved, table

MIN_PAGES = 5
MIN_SHARE = 0.005
DEEPEST = 512

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = re.compile(r"<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("caption legend option optgroup summary tbody tfoot thead tr body html".split())
#: A start tag ends an open element of these kinds, looking up to one of the barriers.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_BARRIER = frozenset("table td th caption html template object".split())
#: Elements that are never main text.
_DROP = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas dialog menu title noembed noframes audio video map".split())
_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu)\b""", re.I)
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: A class or id is one of these when all its parts (between - and _) are names, or names and neutral words.
_NAMES = re.compile(
    r"(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|"
    r"cookies?|consent|gdpr|notice|notices|banner|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|pagination|pager)",
    re.I,
)
_NEUTRAL = frozenset("site page main top bottom left right side bar box block section wrapper wrap container widget list area links link buttons button icons posts articles stories items form inner outer global primary secondary header skip reader user slot unit panel module group text".split())
_PAIRS = frozenset(["side-bar", "site-header", "page-header", "skip-link"])
_HIDDEN = re.compile(r"""\shidden(?=[\s>/=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([/]?)([A-Za-z][^\s/>]*)((?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+))>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^<]*\Z""", re.S)
#: What is no text where no tag can end any more.
_REST = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?/][^>]*\Z|<[A-Za-z][^<]*\Z", re.S)
_SPACE = re.compile(r"\s+")
_LINKS, _PROSE = frozenset(["a"]), frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre br b i em strong span code".split())


class Node:
    """An element: tag, attributes as written, children (text or nodes), and what hashing found."""

    __slots__ = ("attrs", "chars", "children", "digest", "in_links", "tag", "whole")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.digest, self.chars, self.in_links, self.whole = tag, attrs, [], b"", 0, 0, False


def parse(html: str) -> Node:
    """The page's tree; forgiving, in time proportional to the page, never fails."""
    root = Node("#root", "")
    stack = [root]
    within: dict[str, int] = {}  # open elements of each tag
    at, n, last = 0, len(html), html.rfind(">")

    def close(i: int) -> None:
        for x in stack[i:]:
            within[x.tag] -= 1
        del stack[i:]

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html_lib.unescape(raw) if "&" in raw else raw)

    while at < n:
        begin = html.find("<", at)
        while begin >= 0 and not (m := (_TAG if begin <= last else _REST).match(html, begin)):
            begin = html.find("<", begin + 1)
        if begin < 0:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m.re is _REST or m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if not within.get(tag):
                continue
            if tag == "p" or tag in _BLOCK or tag in _BARRIER:
                stop = frozenset() if tag in _BARRIER or tag in ("body", "html") else _BARRIER
            else:
                stop = _BLOCK | _BARRIER
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in stop:
                    break
            continue
        if tag in ("html", "body") and within.get(tag):
            continue
        if tag in _ENDS_P and within.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK or stack[i].tag in _BARRIER:
                    break
        if tag in _ENDS:
            ended, barrier = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    break
                if stack[i].tag in barrier:
                    break
        if tag == "body":
            kept = [x for x in stack[1:] if x.tag == "html"]
            close(1)
            stack += kept
            within["html"] = len(kept)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if _RAW.match(m[0]):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            if tag not in ("script", "style"):
                node.children.append(html_lib.unescape(html[at : end.start() if end else n]))
            at = end.end() if end else n
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
            within[tag] = within.get(tag, 0) + 1
    return root


def named(token: str) -> bool:
    """Does a class or id say that its element is not main text?"""
    low = token.lower()
    parts = [x for x in re.split(r"[-_]+", low) if x]
    if parts and parts[0] in ("comment", "comments"):
        return True
    known = [bool(_NAMES.fullmatch(x)) for x in parts]
    return low in _PAIRS or any(known) and all(k or x in _NEUTRAL for k, x in zip(known, parts, strict=True))


def dropped(node: Node, in_article: bool) -> bool:
    """Does the element say itself that it is not main text?  Of one that holds most of the page's text only hiding counts."""
    if node.whole:
        return node.tag in _DROP and node.tag != "form" or node.tag not in ("html", "body") and bool(_HIDDEN.search(node.attrs))
    if node.tag in _DROP or node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    if node.tag not in ("body", "html", "main"):
        for m in _NAMED.finditer(node.attrs):
            if any(map(named, (m[1] or m[2] or m[3] or "").split())):
                return True
    return bool(_ROLE.search(node.attrs) or _HIDDEN.search(node.attrs))


def find_wholes(root: Node) -> None:
    """Mark the elements with most of the page's text, links apart."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    chars: dict[int, list[int]] = {}
    for node in reversed(order):
        own = [0, 0]
        for c in node.children:
            if not isinstance(c, Node):
                own[0] += len(c) - c.count(" ") - c.count("\n")
            elif c.tag not in ("script", "style", "noscript", "template", "head"):
                own[0] += chars[id(c)][0]
                own[1] += chars[id(c)][1]
        chars[id(node)] = [own[0], own[0]] if node.tag in _LINKS else own
    if total := chars[id(root)][0]:
        for node in order:
            n, links = chars[id(node)]
            node.whole = 2 * n > total and 2 * links <= n


def digest(root: Node) -> None:
    """Hash every subtree, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for m in _NAMED.finditer(node.attrs):
            h.update(b"\x01" + m[0].lower().encode("utf-8", "surrogatepass"))
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\x02" + c.digest)
                node.chars += c.chars
                node.in_links += c.in_links
            elif t := _SPACE.sub(" ", c).strip():
                h.update(b"\x03" + t.encode("utf-8", "surrogatepass"))
                node.chars += len(t)
        if node.tag in _LINKS:
            node.in_links = node.chars
        node.digest = h.digest()


def candidates(root: Node) -> Iterator[Node]:
    """Subtrees that a template may delete: any with text outside articles, mostly links inside."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                within = inside or c.tag in ("article", "main")
                if c.chars and c.tag not in ("html", "head", "body", "article", "main") and (not within or c.tag not in _PROSE and c.in_links * 2 > c.chars):
                    yield c
                todo.append((c, within))


def key_of(node: Node) -> int:
    return int.from_bytes(node.digest, "big", signed=True)


def tops(root: Node, gone: set[int]) -> list[Node]:
    """Articles and ``main`` elements in page order, without those inside another or inside what is dropped."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and id(c) not in gone and not dropped(c, False)]
    return out


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The page's text without elements of the template and those that say what they are."""
    root = parse(html or "")
    gone: set[int] = set()
    if template:
        digest(root)
        gone = {id(c) for c in candidates(root) if key_of(c) in template}
    chosen = tops(root, gone)
    if not chosen:
        find_wholes(root)
        chosen = tops(root, gone) or [root]
    blocks, line = [], []

    def close() -> None:
        if t := _SPACE.sub(" ", "".join(line)).strip():
            blocks.append(t)
        line.clear()

    for top in chosen:
        walk = [(top, top.tag in ("article", "main"), iter(top.children))]
        while walk:
            node, inside, rest = walk[-1]
            c = next(rest, None)
            if c is None:
                walk.pop()
                if node.tag in _BLOCK:
                    close()
                elif node.tag in ("td", "th"):
                    line.append(" ")
            elif isinstance(c, str):
                line.append(c)
            elif id(c) not in gone and not dropped(c, inside):
                if c.tag in _BLOCK:
                    close()
                elif c.tag in ("br", "td", "th"):
                    line.append(" ")
                walk.append((c, inside or c.tag in ("article", "main"), iter(c.children)))
        close()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): the hashes that recur on the host's pages; pages has host, html.

    A host has at most 1 / ``min_share`` times as many as a page has subtrees, so one row holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, whole, pages_ = [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(html.as_py() or "")
                digest(root)
                own = {key_of(c) for c in candidates(root)}
                hosts += [host] * (len(own) + 1)
                keys += [0, *own]
                whole += [True] + [False] * len(own)
                pages_ += [key_of(root)] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(whole, pa.bool_()), pa.array(pages_, pa.int64())], ["host", "key", "whole", "page"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, key long, whole boolean, page long").distinct()
    counts = saved(seen.groupBy("host", "key", "whole").agg(F.count("*").alias("n")).where((F.col("n") >= min_pages) | F.col("whole")), "html-counts")
    totals = counts.where("whole").select("host", F.col("n").alias("pages"))
    often = counts.where("NOT whole").join(totals, "host").where((F.col("n") >= min_pages) & (F.col("n") >= min_share * F.col("pages")))
    return saved(often.groupBy("host").agg(F.collect_list("key").alias("template")), "html-templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, template = None, frozenset()
        for batch in batches:
            texts = []
            for host, html, keys in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                if host != last:
                    last, template = host, frozenset(keys.as_py() or ())
                texts.append(main_text(html.as_py(), template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), pages[html_col].alias("html"))
    templates = site_templates(rows)
    keys = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    side = F.broadcast(templates) if keys * 8 + 64 <= 16 << 20 else templates
    return rows.join(side, "host", "left").select("page_id", "url", "host", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
