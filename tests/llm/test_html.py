import html
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from fieldmark.llm.html import INLINE, TEXT_BLOCKS, dropped, extract_text, main_text, parse, read_page

SCHEMA = "page_id long, url string, html string, text int"


def text(page):
    p = read_page(page, "h")
    return main_text(p.texts, p.inside, [])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<article><h1>A</h1><p>b <b>c</b>d<br>e</article>", "A b cd e"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul>e</article>", "a b c d e"),
        ("<nav>x</nav><header>y</header><main><header><h1>T</h1></header><p>z</p></main><footer>f</footer>", "T z"),
        ("<body class='has-sidebar'><div class='sidebar'>s</div><div>body &amp; soul &#233; &nbsp; x</div></body>", "body & soul é x"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- c > -->b<form>f<input></form>c</article>", "ab c"),
        ("<article>a<div class=\"comments\"><p>c</p></div><section id='cookie-notice'>n</section>b</article>", "a b"),
        ("<article><p>x < y & z</p><img alt='a>b'>t</article><aside>q</aside>", "x < y & z t"),
        ("<div class='page sidebar-wrap'><article>kept</article></div>", "kept"),
        ("<article>one</article><p>between</p><article>two</article>", "one two"),
        ("<article class='comment'>no</article><p>yes</p>", "yes"),
        ("<p>open <b>never closed<p>next</i></div>end", "open never closed next end"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><p hidden>h</p><div role=dialog>d</div><p>v</p></article>", "v"),
        ("<article><p>We <span class='search'>searched</span> far</p><p class='notice'>n</p></article>", "We searched far n"),
        ("<article><p>a b c d</p><section id='related-work'>e</section><div class='market share'>f</div></article>", "a b c d e f"),
        ("<article><p>a b c d</p><section id='related'>e</section><div class='share buttons'>x</div><div class='share price'>f</div><div class='share box-2'>g</div></article>", "a b c d f"),
        ("<form id='aspnetForm'><input type='hidden'><div><h1>T</h1><p>" + "word " * 40 + "</p></div></form>", "T " + "word " * 39 + "word"),
        ("<article><p>a story of some words</p><form>Your name <input> Mail <input><button>Send</button></form></article>", "a story of some words"),
        ("<div class='widget'><p>all of the page</p></div><nav>menu of many words here</nav>", "all of the page"),
        ("<article><p>" + "short " * 60 + "</p></article><div class='comments'>" + "<p>a long answer</p>" * 200 + "</div>", "short " * 59 + "short"),
        ("<article><div class='page-comments col-3 xyz'>c</div><p>a b c d</p><div class='has-sidebar'>s</div></article>", "a b c d s"),
        ("<div role='search'>find <input></div><div><p role='alert'>an alert is text</p></div>", "an alert is text"),
        ("<article>teaser</article><p>most of the text stands outside</p>", "teaser most of the text stands outside"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 80_000 + "deep" + "</div>" * 80_000, "<b>" * 40_000 + "<div>x</div></i>" * 40_000, "<p><i>" * 100_000])
def test_a_page_of_a_megabyte_in_linear_time(page):
    began = time.time()
    assert read_page(page, "h").texts or "x" not in page
    assert time.time() - began < 20


def plain_text(rows, min_pages, min_share):
    """Subtrees written out as strings and counted in dictionaries, blocks with all subtrees around them."""

    def source(node):
        return f"<{node.tag}>" + "".join(source(x) if not isinstance(x, str) else " ".join(x.split()) for x in node.items if x is not None) + "</>"

    def blocks(node, around):
        out, text = [], []
        for x in node.items:
            if isinstance(x, str):
                text.append(x)
            elif x is None or x.tag not in INLINE:
                out.append((" ".join(html.unescape("".join(text)).split()), around))
                text = []
                if x is not None and not dropped(x, False):
                    out += blocks(x, around if x.tag in TEXT_BLOCKS else [*around, source(x)])
        return [b for b in [*out, (" ".join(html.unescape("".join(text)).split()), around)] if b[0]]

    read = [blocks(parse(page), []) for _, page in rows]
    pages, trees = defaultdict(set), defaultdict(set)
    for (host, _), found in zip(rows, read):
        content = tuple(t for t, _ in found)
        pages[host].add(content)
        for _, around in found:
            for x in around:
                trees[host, x].add(content)
    bad = {k for k, v in trees.items() if len(v) >= max(min_pages, min_share * len(pages[k[0]]))}
    assert not any("<article>" in page or "<main>" in page for _, page in rows)  # where there is none, all blocks count
    return [" ".join(t for t, around in found if not any((host, x) in bad for x in around)) for (host, _), found in zip(rows, read)]


@pytest.mark.parametrize("limits", [(2, 0.0), (3, 0.2), (5, 0.02), (10**9, 1.0)])
def test_against_plain_counts(spark, limits):
    """Pages without articles: subtrees that recur, nested ones, copies of pages, and hosts of many sizes."""
    rng = random.Random(4)
    parts = [f"<div><section>part {i}</section><p>line {i % 3}</p></div>" for i in range(6)]
    rows = []
    for host, n in (("a.org", 40), ("b.org", 12), ("c.org", 3)):
        for i in range(n):
            body = [rng.choice(parts), f"<div><p>own {host} {i}</p>{rng.choice(parts)}</div>", rng.choice(parts), "<p>a passage</p>"]
            rng.shuffle(body)
            rows.append((host, "<div>" + "".join(body) + "</div>"))
    rows += rows[:4]
    df = spark.createDataFrame([(i, f"http://{h}/", p, 0) for i, (h, p) in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.page_id: r.text for r in extract_text(df, *limits).collect()}
    want = plain_text(rows, *limits)
    assert got == dict(enumerate(want))
    if limits[0] == 5:
        assert Counter(want) != Counter(plain_text(rows, 10**9, 1.0))  # the counts change the result


def test_templates(spark):
    rows = [(i, "https://www.a.org/x" if i % 2 else "http://a.org/y?z", f"<div><div>same words everywhere</div><p>shared passage</p><section>own {i}</section></div>", 0) for i in range(30)]
    rows += [(100 + i, "http://b.org", "<div>copy of one page</div>", 0) for i in range(30)]
    rows += [(200, None, None, 0), (201, "http://[bad", "<p>x</p>", 0), (201, "http://[bad", "<p>x</p>", 0), (None, "http://c.org", "<p>é</p>", 0)]
    got = [tuple(r) for r in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert all(by[i][2] == f"shared passage own {i}" for i in range(30))
    assert all(by[100 + i][2] == "copy of one page" for i in range(30))
    assert by[200] == (200, None, "", 0) and by[201] == (201, "http://[bad", "x", 1) and by[None][2:] == ("é", 1)


def test_counts_take_articles_that_recur(spark):
    card = "<section><h2>More</h2><article>a teaser</article></section>"
    page = lambda i: f"<div><div>site name</div><div><p>story {i}</p></div>{card}<article>entry {i}</article><p>after {i}</p></div><nav>links {i}<article>n{i}</article></nav>"
    rows = [(i, "http://a.org", page(i), 0) for i in range(12)] + [(50, "http://b.org", page(50), 0)]
    by = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(by[i] == f"entry {i} n{i}" for i in range(12))
    assert by[50] == "a teaser entry 50 n50"


def test_hosts_of_any_size_have_one_law(spark):
    page = lambda host, i: f"<div><article>teaser {host}{i}</article><article><p>a story {host}{i} of more words</p></article><section>Readers <p>Bob {host}{i}: nice</p></section></div>"
    rows = [(n * 100 + i, f"http://h{n}.org", page(n, i), 0) for n in (1, 4, 5, 30) for i in range(n)]
    by = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(by[n * 100 + i] == f"teaser {n}{i} a story {n}{i} of more words" for n in (1, 4, 5, 30) for i in range(n))


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == " ".join(filter(None, blocks))


def test_empty(spark):
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0
