"""Main text of web pages: a site's templates are found by counting element subtrees per host.

1. Each page is parsed into a tree, leniently: unclosed and crossed tags, comments, truncated ends.
   Scripts and styles are left out.
2. Every element of the page is hashed with all below it (tags and words, not attributes). In Spark, hashes
   are counted per host over distinct pages (copies of one page count once), pre-aggregated before the shuffle.
3. Subtrees in at least ``least`` distinct pages and the ``share`` of the host's are its
   template. For blocks the ``low_share`` is enough, and for blocks of two words or more outside an
   article or main element also ``many`` pages: the templates of a large host's sections, languages and layouts
   are each on a small part of it (a single word may recur on so many pages by chance). The list goes
   to all tasks if it has at most ``broadcast_rows`` rows; a longer one is joined to the hashes of the pages,
   so that each page gets its own part alone.
4. Pages are parsed again, template subtrees are deleted, and the rest is written out in blocks.

Structure helps: the outermost articles, else the main element, else the body are the content, whichever first has
text. In it, what isn't the page's own by its element (menus, footers, asides, controls) or by a whole name in
its class, id or role is left out. Names never hide the only article or main element, forms around a page's
content count as wrappers, and an article that is wholly made of recurring parts keeps its text.

Edge cases: null and empty pages give an empty text; a page whose URL is null or has no host counts to
the empty host; hosts with few pages have no template and keep what the elements tell; a page without an
article that is all template or menus is empty; repeated rows are each extracted; pages of any length are read whole; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize, ready
from .urls import split_url

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "title", "xmp", "noembed", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
#: Never text of the page's own: parts of the site, and the controls of forms.
_NEVER = {"head", "nav", "footer", "aside", "button", "datalist", "dialog", "fieldset", "label", "legend", "menu", "optgroup", "option", "output", "select"}
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Whole class, id and role names that leave no doubt; what they miss is found by its recurrence.
_WORDS = frozenset("""
ad ads adsbygoogle advert adverts advertisement advertisements advertising ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad sponsored sponsored-content
cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice cookie-popup cookiebar consent consent-banner gdpr gdpr-banner notice notices site-notice notification notifications alert alerts
comments comment comment-list commentlist comments-area comments-section comment-section disqus disqus_thread replies respond reader-comments user-comments
sidebar side-bar sidebar-left sidebar-right left-sidebar right-sidebar nav navbar navigation site-nav main-nav main-navigation primary-nav topnav menu main-menu site-menu nav-menu breadcrumb breadcrumbs pagination pager toolbar skip-link
footer site-footer page-footer global-footer masthead site-header global-header social social-links social-share share-buttons share-bar sharing sharedaddy addthis_toolbox
related-posts related-articles related-stories recommended recommendations newsletter newsletter-signup subscribe subscription signup sign-up login popup pop-up modal overlay paywall promo promos promotion search-form searchform
banner complementary contentinfo alertdialog dialog menubar search tablist
""".split())
_HIDDEN = re.compile(r"""\shidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?(article|main)\b""", re.I)
_PROSE = 60


class Node:
    """bad: 2 by its element, 1 by its words, 0 not. size: characters of text in it; top: article or main, by its element or role; holds: it has one, or is one; prose: it has a paragraph."""

    __slots__ = ("tag", "top", "bad", "items", "key", "size", "holds", "prose")

    def __init__(self, tag: str, bad: int):
        self.tag, self.bad, self.items, self.key, self.size, self.holds, self.prose = tag, bad, [], 0, 0, False, False
        self.top = tag if tag in ("article", "main", "body") else ""


def parse(page: str) -> Node:
    """The tree of a page's elements and its raw texts."""
    root = Node("#", 0)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag doesn't end the content around it
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in _RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends the open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSED_BY:
            ends, scope = _CLOSED_BY[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    if tag not in ("tr",):
                        break
                elif stack[k].tag in scope:
                    break
        bad = 2 if tag in _NEVER else 0
        if attributes and not bad and tag not in ("html", "body"):
            words = {w.lower() for found in _ATTRIBUTE.findall(attributes) for w in "".join(found).split()}
            bad = int(not words.isdisjoint(_WORDS) or _HIDDEN.search(attributes) is not None)
        if tag == "header" and not any(x.top in ("article", "main") for x in stack):
            bad = 2
        node = Node(tag, bad)
        if attributes and (role := _ROLE.search(attributes)):
            node.top = role[1].lower()
        stack[-1].items.append(node)
        if tag not in _VOID:
            stack.append(node)
    _measure(root)
    return root


def _preorder(tops: list[Node]) -> list[Node]:
    """All elements, parents before children, without recursion: trees may be deep."""
    order, todo = [], list(tops)
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(y for y in x.items if isinstance(y, Node))
    return order


def _measure(root: Node) -> None:
    """Sizes of all elements; and a form is bad unless it is a wrapper of the page's content.

    That is a form with an article or main element, or with a paragraph and most of the page's text.
    """
    order = _preorder([root])
    for x in reversed(order):
        x.holds = x.top in ("article", "main")
        for y in x.items:
            if isinstance(y, str):
                x.size += len(y.strip())
            elif y.bad < 2:
                x.size += y.size
                x.holds |= y.holds
                x.prose |= y.prose
        x.prose |= x.tag == "p" and x.size >= _PROSE
    for x in order:
        if x.tag == "form" and not x.holds and not (x.prose and 2 * x.size > root.size):
            x.bad = 2


def _outermost(root: Node, tag: str, within: int) -> list[Node]:
    """The tag's outermost elements, looked for in elements that are bad by their words, and bad so themselves (within 1), or not."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.bad > within:
            continue
        if x.top == tag:
            out.append(x)
        else:
            todo.extend(y for y in reversed(x.items) if isinstance(y, Node))
    return out


def _tops(root: Node):
    """The elements that may hold a page's content, the likeliest first: articles, the main element, the body.

    An element's words, or a wrapper's (a page "with sidebar"), don't hide the only article or main element there is.
    """
    for within in (0, 1):
        for tag in ("article", "main"):
            if found := _outermost(root, tag, within):
                yield found
    yield _outermost(root, "body", 1) or [root]


#: How much recurrence makes a subtree a template, by its kind: the last two bits of its key.
LONG_BLOCK, BLOCK, WITHIN = 0, 1, 2
_LONG_WORDS = 2


def subtree_keys(root: Node) -> tuple[set[int], int]:
    """Sets a key for each element, a hash of all it holds with its kind; and gives all keys and a hash of the whole page.

    Kinds: blocks of two words or more outside an article or main element; other blocks; what is within a line or a table's row.
    """
    order = _preorder([root])
    inside: set[int] = set()
    for x in order:
        if x.top in ("article", "main") or id(x) in inside:
            inside.update(id(y) for y in x.items if isinstance(y, Node))
    keys: set[int] = set()
    words: dict[int, int] = {}
    for x in reversed(order):
        parts, n = [x.tag], 0
        for y in x.items:
            if isinstance(y, Node):
                parts.append(f"\x02{y.key >> 2}")
                n += words[id(y)]
            else:
                own = y.split()
                if own:
                    parts.append(" ".join(own))
                    n += len(own)
        words[id(x)] = n
        kind = WITHIN if x.tag not in _BLOCK or x.top or x.tag == "html" else BLOCK if n < _LONG_WORDS or id(x) in inside else LONG_BLOCK
        x.key = (xxhash.xxh64_intdigest("\x01".join(parts)) - 2**63) & ~3 | kind
        if n and x.tag not in _VOID and x is not root:
            keys.add(x.key)
    return keys, root.key


def _text(tops: list[Node], template: set[int] | frozenset) -> str:
    blocks: list[list[str]] = [[]]
    todo: list = list(reversed(tops))
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.bad and x not in tops or template and x.key in template:
            continue
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif x.tag in _BLOCK:
            blocks.append([])
            todo.append(None)
            todo.extend(reversed(x.items))
        else:
            if x.tag in ("td", "th"):
                blocks[-1].append(" ")
            todo.extend(reversed(x.items))
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(page: str | None, template: set[int] | frozenset = frozenset()) -> str:
    """The content's text in blocks, without the subtrees whose keys are the template's.

    An article or main element that is wholly made of what recurs keeps its text: there it is what the page
    is for, shown on many pages.
    """
    if not page:
        return ""
    root = parse(page)
    if template:
        subtree_keys(root)
    for tops in _tops(root):
        own = _text(tops, frozenset())
        if own:
            left = _text(tops, template) if template else own
            return left or (own if tops[0].top in ("article", "main") else "")
    return ""


def _host_keys(pages: DataFrame) -> DataFrame:
    """host, content, keys: one row a page; what a page has twice counts once."""

    def run(batches):
        for batch in batches:
            hosts, whole, keys = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                own, top = subtree_keys(parse(page or ""))
                hosts.append(split_url(url)[0])
                whole.append(top)
                keys.append(list(own))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["host", "content", "keys"])

    return pages.select("url", "html").mapInArrow(run, "host string, content long, keys array<long>").dropDuplicates(["host", "content"])


def host_templates(contents: DataFrame, least: int = 5, share: float = 0.5, many: int = 20, low_share: float = 0.25) -> DataFrame:
    """host, key of the subtrees that recur across many pages of a host, from _host_keys' rows."""
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    counts = contents.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= least)
    kind, low = F.col("key").bitwiseAND(F.lit(3)), low_share * F.col("n")
    enough = F.when(kind == LONG_BLOCK, F.least(F.lit(float(many)), low)).when(kind == BLOCK, low).otherwise(share * F.col("n"))
    return counts.join(sizes, "host").where(F.col("seen") >= enough).select("host", "key")


def main_text(pages: DataFrame, least: int = 5, share: float = 0.5, broadcast_rows: int = 500_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: int = 20, low_share: float = 0.25) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    contents = materialize(_host_keys(rows), "contents")
    templates = materialize(host_templates(contents, least, share, many, low_share), "templates")

    def answer(batch, texts):
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if templates.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for host, key in templates.toLocalIterator():
            by_host.setdefault(host, set()).add(key)
        shared = spark.sparkContext.broadcast({h: frozenset(k) for h, k in by_host.items()})

        def run(batches):
            for batch in batches:
                yield answer(batch, [extract(page, shared.value.get(split_url(url)[0], frozenset())) for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())])

        return rows.mapInArrow(run, schema)

    # Each content's own part of its host's template, joined by content to the pages. Copies of one page are
    # one key of this join, whose larger side is split where it's skewed (AQE).
    own = contents.select("host", "content", F.explode("keys").alias("key")).join(templates, ["host", "key"]).groupBy("host", "content").agg(F.collect_list("key").alias("drop"))

    def mark(batches):
        for batch in batches:
            urls, htmls = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            whole = [subtree_keys(parse(page or ""))[1] for page in htmls]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([split_url(u)[0] for u in urls], pa.string()), pa.array(whole, pa.int64())], names=["page_id", "url", "html", "host", "content"])

    def cut(batches):
        for batch in batches:
            drops = [frozenset(d or ()) for d in batch.column("drop").to_pylist()]
            yield answer(batch, [extract(p, d) for p, d in zip(batch.column("html").to_pylist(), drops)])

    marked = rows.mapInArrow(mark, f"page_id {kind}, url string, html string, host string, content long")
    return marked.join(own, ["host", "content"], "left").select("page_id", "url", "html", "drop").mapInArrow(cut, schema)
