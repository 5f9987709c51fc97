"""Site templates against a brute-force tree counter, and what names and forms may not hide."""

from collections import defaultdict
from html.parser import HTMLParser

import pytest

from colonnade.llm import templates

BLOCKS = {"div", "p", "ul", "li"}


class Tree(HTMLParser):
    """Nested tuples (tag, items) of well-formed pages."""

    def __init__(self, page):
        super().__init__()
        self.open = [("#", [])]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def plain(node):
    return node if isinstance(node, str) else (node[0], tuple(plain(x) for x in node[1]))


def words(node):
    return len(node.split()) if isinstance(node, str) else sum(map(words, node[1]))


def subtrees(node):
    for x in node[1]:
        if not isinstance(x, str):
            yield x
            yield from subtrees(x)


def brute(pages, least=5, share=0.5, many=20, low=0.25):
    """Texts of {id: (host, page)}, pages without an article or bad elements, by whole subtrees as keys."""
    trees = {i: (h, plain(Tree(p).open[0])) for i, (h, p) in pages.items()}
    seen, sizes = defaultdict(set), defaultdict(set)
    for h, t in trees.values():
        sizes[h].add(t)
        for x in set(subtrees(t)):
            seen[h, x].add(t)
    gone = set()
    for (h, x), on in seen.items():
        n = len(sizes[h])
        block = x[0] in BLOCKS
        enough = share * n if not block else low * n if words(x) < 2 else min(many, low * n)
        if words(x) and len(on) >= max(least, enough):
            gone.add((h, x))

    def text(h, node, out):
        for x in node[1]:
            if isinstance(x, str):
                out[-1] += x
            elif (h, x) not in gone:
                if x[0] in BLOCKS:
                    out.append("")
                text(h, x, out)
                if x[0] in BLOCKS:
                    out.append("")
        return out

    return {i: "\n\n".join(b for b in (" ".join(x.split()) for x in text(h, t, [""])) if b) for i, (h, t) in trees.items()}


def page(i, host, part):
    menu = "".join(f"<li>{host} link {k}</li>" for k in range(4))
    note = "<p>now and then</p>" if i % 6 == 0 else ""
    return f"<body><div><ul>{menu}<li>{'here' if i % 7 == 0 else 'there'}</li></ul></div><div><p>Own text {host} {i} <b>{'bold' if i % 2 else 'both'}</b></p>{note}<p>Yes</p></div><div><p>Section {part} of {host}</p><i>{i % 3}</i></div></body>"


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_equals_brute_force(spark, broadcast_rows):
    pages = {i: (f"h{i % 3}.org", page(i, f"h{i % 3}", i % 11)) for i in range(300)} | {1000 + i: ("few.org", page(i, "few", 0)) for i in range(4)} | {2000 + i: ("same.org", page(1, "same", 0)) for i in range(30)}
    rows = [(i, f"http://{h}/{i}", p, "x", 1) for i, (h, p) in pages.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, keys int").repartition(3)
    got = {r["page_id"]: r["text"] for r in templates.main_text(df, broadcast_rows=broadcast_rows).collect()}
    want = brute(pages)
    assert got == want
    assert sum(got[i] != templates.extract(p) for i, (_, p) in pages.items()) == 300


def test_nameless_menus_go_by_recurrence_alone(spark):
    menu = "<div><div><div>Start</div><div>News of today</div><div>About us all</div></div></div>"
    rows = [(i, f"http://n.org/{i}", f"<html><body>{menu}<div><p>Text {i} of its own</p></div><div><span>Imprint and terms</span></div></body></html>") for i in range(200)]
    got = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum(r["text"] == f"Text {r['page_id']} of its own" for r in got) == 200


def test_short_words_of_articles_stay(spark):
    """Words that recur in articles by chance aren't template, however large the host is; a notice on most articles is."""
    rows = [(i, f"http://a.org/{i}", f"<body><article><h1>Title {i}</h1><p>{'Summary of it' if i % 5 == 0 else f'Start {i}'}</p><p>Share this story</p></article></body>") for i in range(300)]
    got = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Title 0\n\nSummary of it" and got[1] == "Title 1\n\nStart 1"


PROSE = "Prose of some length, more than a label has, and so it is no control of the form around. " * 2


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article class="post category-social tag-search"><p>Main text here</p></article>', "Main text here"),
        ('<form id="aspnetForm"><article><p>x y</p></article></form>', "x y"),
        (f'<form id="aspnetForm"><div><p>{PROSE}</p></div><input><button>Go</button></form>', PROSE.strip()),
        ("<body><p>own</p><form><p>Sign up</p><label>Mail</label><input></form></body>", "own"),
        ('<main><div class="widget-content">in it</div></main>', "in it"),
        ('<article><p>a</p><div class="related-work">b</div><div class="related-posts">c</div></article>', "a\n\nb"),
        ('<article class="sidebar">only one</article>', "only one"),
        ('<article></article><div>beside an empty one</div>', "beside an empty one"),
        ('<div role="main">m</div><div>out</div>', "m"),
        ('<article>post<section class="comments"><article class="comment">theirs</article></section></article>', "post"),
        ('<body><div class="Cookie-Notice big">c</div><div hidden>h</div><p>t</p></body>', "t"),
        ("<nav>all of it is menu</nav>", ""),
    ],
)
def test_what_structure_hides(html, want):
    assert templates.extract(html) == want


def test_article_of_recurring_parts_keeps_its_text():
    article = "<body><div><p>Menu of it</p></div><article><p>One story</p></article></body>"
    root = templates.parse(article)
    keys, _ = templates.subtree_keys(root)
    assert templates.extract(article, keys) == "One story"
    assert templates.extract("<body><p>all of it</p></body>", templates.subtree_keys(templates.parse("<body><p>all of it</p></body>"))[0]) == ""


def test_very_long_page(spark):
    long = "<body><div><p>Menu of it</p></div>" + "<p>word </p>" * 60_000 + "</body>"
    rows = [(i, f"http://l.org/{i}", "<body><div><p>Menu of it</p></div><p>x%d</p></body>" % i) for i in range(9)] + [(9, "http://l.org/9", long)] * 2
    got = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id = 9").collect()
    assert [r["n_chars"] for r in got] == [60_000 * 4 + 59_999 * 2] * 2
