import html as h
import random
import re
import time

from pyspark.sql import functions as F

from cinderlog.llm import html_text as ht
from cinderlog.llm.registry import op7_html_text

SCHEMA = "page_id long, url string, html string, text string, host int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>x</p>";</script></head><body class="page">
<header><a href=/>Home</a></header><nav><ul><li>Menu</ul></nav><!-- <p>gone</p> --><div class="cookie-notice">Cookies!</div>
<main><article><header><h1>Big &amp; bold</h1></header><p>One<br>two &lt;b&gt;  \n three<p><b>Four</b>five &eacute;&#8364; 1 < 2
<aside>Side</aside><div class="advert"><div>Buy</div></div><form><p>Name</p><input></form><ul><li>a<li>b</ul>
<table><tr><td>c1<td>c2</table><p hidden>hid</p><span class="share">Share this</span>
<section id="comments"><h2>Comments</h2><p>Nice</p></section></div><pre>x\n  y</pre></article></main><footer>&copy; me</footer>"""


def blocks(page):
    """(lines of articles, lines outside of them), without frames by name."""
    return tuple([t for t, _, k in ht.lines(page) if k == kind] for kind in (ht.INSIDE, ht.OUTSIDE))


def test_blocks_of_an_article():
    inside, outside = blocks(PAGE)
    assert inside == ["Big & bold", "One two <b> three", "Fourfive é€ 1 < 2", "a", "b", "c1", "c2", "x y"]
    assert outside == []
    named = [t for t, _, k in ht.lines(PAGE) if k == ht.NAMED]
    assert named == ["Home", "Menu", "Cookies!", "Side", "Buy", "Name", "Comments", "Nice", "© me"]


def test_an_article_is_text_whatever_its_classes_are_called():
    for page in (
        "<div class='layout with-sidebar'><article>x</article></div>",
        "<article class='post comments-open'>x</article>",
        "<main class='no-sidebar'>x</main>",
        "<div role=main class=menu>x</div>",
        "<article><p class='search results'>x</p></article>",
        "<article><table class=menu><tr><td>x</table></article>",
        "<article><menu><li>x</menu></article>",
        "<div class=sidebar>y<article>x</article>y</div>",
        "<nav>y</nav><article>x<p class=ad>x<p>x</article><p class=ad>y",
    ):
        inside, outside = blocks(page)
        assert set(inside) == {"x"} and not outside, page
    # An unclosed framed paragraph ends where the next begins; a framed inline element holds what nests in it.
    assert blocks("<p class='ad'>Ad<p>Text")[1] == ["Text"]
    assert blocks("<article><span class='share'>gone <span>in</span> tail</span> end</article>")[0] == ["end"]
    assert blocks("<article><span class='share'>gone<p>next</p></article>")[0] == ["next"]


def test_broken_markup_does_not_crash_and_takes_linear_time():
    rng = random.Random(1)
    parts = ["<", ">", "<p", "<p>", "</p>", "<div class='", "'", '"', "<!--", "-->", "<!", "<script>", "</script>", "x", " ", "&amp", "&#x", "<article>", "</article>", "<a b=\"c>\">", "</", "<//>", "<br/>", "<div/>", "é", "<nav>", "</nav>", "<div class=ad>", "</div>", "<td>", "<section id=comments>", "<span class=ad>", "</span>", "<ul>", "<li>"]
    for _ in range(5000):
        ht.lines("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    assert blocks("<p>" * 50_000 + "deep") == ([], ["deep"])
    assert blocks("<div>" * 50_000 + "deep " * 100_000)[1] == [" ".join(["deep"] * 100_000)]
    began = time.perf_counter()
    for page in ("<div>" * 20_000 + "</p>" * 20_000, "<span class='ad'>" * 20_000, "<p><td>" + "<div>" * 20_000 + "</p>" * 20_000, "<div class=ad>" * 20_000):
        ht.lines(page)
    assert time.perf_counter() - began < 5


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for k in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = ht.shared_lines(a, b, most=(8, 1 << 24)[k % 2])
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(got) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in got) and got == sorted(got)


def test_paths_are_judged_by_what_pairs_share():
    m = 10**6
    assert ht.judged(29, 29 * m, 29 * m, 10, 100) is None  # too few pairs
    assert ht.judged(100, 100 * m, 100 * m, 90, 100) is True  # shared by all
    assert ht.judged(2400, 40 * m, 40 * m, 5, 100) is True  # one page in sixty
    assert ht.judged(240, 4 * m, 4 * m, 5, 100) is None  # the same, but it may be chance
    assert ht.judged(2400, 40 * m, 40 * m, 50, 100) is None  # much of the text: not frame as a whole
    assert ht.judged(2400, m // 10, m // 100, 90, 100) is False  # hardly ever shared
    assert ht.judged(100, 0, 0, 90, 100) is None  # never, but by few


def test_differencing_alone_tells_frame_from_article(spark):
    """Without HTML's own names (nav, footer, article, class="ad"), the pairs decide every line of the pages given."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    alone = ht.main_text(pages, names=False)
    both = alone.select(F.col("page_id").alias("p"), F.col("text").alias("t")).join(ht.main_text(pages), F.col("p") == F.col("page_id"))
    assert both.count() == 2500 and both.where("t != text").count() == 0


def test_a_frame_without_names_is_found_by_its_pairs(spark):
    words = [f"w{k}" for k in range(50)]
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for k in range(400):
        body = "".join(f"<div class=t>{say(12)}</div>" for _ in range(4))
        # Boilerplate in the article, of two kinds; a box that no name tells of, with text of its own on each page.
        rows.append((k, f"http://a.org/{k % 7}/{k}", f"<div class=box0>{say(9)}</div><article>{body}<div class=more>Read on: {k % 2}</div></article>", "", 0))
    got = {r.page_id: r.text for r in ht.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, _, page, _, _ in rows:
        own = re.findall("<div class=(?:box0|t)>(.*?)</div>", page)
        # The box is content by its pairs; the boilerplate goes although it stands in the article.
        assert got[k].split("\n") == own


def test_paths_beyond_the_table_are_judged_all_the_same(spark, monkeypatch):
    """The size of the workers' table decides no line: of articles, of pages without one, of copies and of empty pages."""
    words = [f"w{k}" for k in range(50)]
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], {}
    for k in range(400):
        own, (site, kind) = [say(12) for _ in range(4)], (("a", "article"), ("b", "section"))[k % 2]
        body = "".join(f"<div class=t>{x}</div>" for x in own)
        page = f"<div class=box>{own[0]} {k}</div><{kind}>{body}<div class=more>Read on: {k // 2 % 2}</div><div class=kin>Of interest</div></{kind}>"
        rows.append((k, f"http://{site}.org/{k % 7}/{k}", page, "", 0))
        want[k] = [f"{own[0]} {k}", *own]
    rows += [(1000 + k, url, page, "", 0) for k, url, page, _, _ in rows[:20]] + [(2000, "http://a.org/1/x", None, "", 0), (2001, None, "", "", 0)]
    want |= {1000 + k: want[k] for k in range(20)} | {2000: [""], 2001: [""]}
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (65_536, 1):
        monkeypatch.setattr(ht, "PATHS", most)
        got = [(r.page_id, r.text.split("\n")) for r in ht.main_text(df).collect()]
        assert sorted(got) == sorted(want.items()), most


def test_differencing_of_pages_without_article(spark):
    page = lambda body: f"<body><div>Site name</div><div>Today</div>{body}<div>Contact</div></body>"
    rows = [
        (1, "http://a.org/x/1", page("<p>first text</p><p>more</p>"), "t", 1),
        (2, "http://a.org/x/2", page("<p>second text</p>"), None, None),
        (3, "http://a.org/x/2?again", page("<p>second text</p>"), None, None),
        (4, "http://a.org/y/9", page("<p>other</p>"), None, None),
        (5, "http://b.org/x/1", page("<p>alone</p>"), None, None),
        (6, None, None, None, None),
        (None, "http://b.org/x/3", "<article>with</article><p>frame</p>", None, None),
        (7, "bad", "plain", None, None),
    ]
    got = {r.page_id: (r.url, r.text) for r in ht.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: (rows[0][1], "first text\nmore"),
        2: (rows[1][1], "second text"),
        3: (rows[2][1], "second text"),
        4: (rows[3][1], "other"),
        5: (rows[4][1], "Site name\nToday\nalone\nContact"),
        6: (None, ""),
        None: (rows[6][1], "with"),
        7: ("bad", "plain"),
    }
    assert ht.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op7_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        lines = [" ".join(h.unescape(re.sub("<b>|</b>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
