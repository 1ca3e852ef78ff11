"""Main text of pages: parsing, what goes by name, and what goes because a site repeats it."""

import time
from collections import Counter

import pytest
from pyspark.sql import Row

from gradeloom.llm import site_templates
from gradeloom.llm.site_templates import parsed

CASES = [
    ("", ""), ("just words", "just words"), ("<p>a<p>b", "a\nb"), ("<p>a &amp; b&nbsp; c\n\t d<br>e</p>", "a & b c d e"),
    ("<p><b>x<br><p>y</p></b>z", "x\ny\nz"), ("<b><p>one</b> two</p>", "one two"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<p>a<!-- <p>no</p> --><i>b</i>c</p><!-- open", "abc"), ("<script>var t='</p>';</script><p>a</p><style>p{}</style>", "a"),
    ("<p>1 < 2 and 3<4 but <5</p>", "1 < 2 and 3<4 but <5"), ("<p>cut <a href='x", "cut"), ("<p title='a>b'>q</p>", "q"), ("<p>&am &lt;b&gt; &#65;&#x42;</p>", "&am <b> AB"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<div>a</p>b</div>", "a\nb"),
    ("<title>t</title><p>a</p><title>open", "a"), ("<p>a</p></div></b><p>b", "a\nb"), ("<DIV><P>A</P></DIV>", "A"), ("<p>x</p\n><p>y", "x\ny"),
]
ARTICLE = "<article><h1>T</h1><p>one</p>{}<p>two</p></article>"
GONE = [
    "<nav>x</nav>", "<aside>x</aside>", "<form>x<input></form>", "<div class='ad'>x</div>", "<div id=comments><p>x</p></div>", "<section class='reader-comments'>x</section>",
    "<div class='cookie-notice'>x</div>", "<div role=navigation>x</div>", "<p hidden>x</p>", "<p style='display: none'>x</p>", "<div class='relatedPosts'>x</div>",
    "<footer>x</footer>", "<div aria-hidden=true>x</div>", "<button>x</button>", "<noscript><p>x</p></noscript>", "<svg><title>x</title></svg>", "<article class=comment>x</article>",
]
FRAMES = [
    "<nav><a>Menu</a></nav><header>Site</header>{}<footer>&copy;</footer>", "<div class='no-sidebar'><div class='page with-ads'>{}</div></div><p>outside</p>",
    "<div class='layout sidebar'>{}</div>", "<main><p>lead</p>{}</main>",
]


@pytest.mark.parametrize("source, text", CASES)
def test_parsing(source, text):
    assert "\n".join(parsed(source).blocks()) == text


@pytest.mark.parametrize("part", GONE)
def test_named_parts_go(part):
    assert parsed(ARTICLE.format(part)).blocks() == ["T", "one", "two"]
    assert parsed(f"<div id=content><p>one</p>{part}<p>two</p></div><p>z</p>").blocks()[:2] == ["one", "two"]


@pytest.mark.parametrize("frame", FRAMES)
def test_the_article_is_the_main_part(frame):
    assert parsed(frame.format(ARTICLE.format(""))).blocks() == ["T", "one", "two"]


def test_main_parts_in_order_of_choice():
    assert parsed("<p>x</p><main><p>a</p></main>").blocks() == ["a"]
    assert parsed("<p>x</p><div itemprop=articleBody>a</div><main>b</main>").blocks() == ["a"]
    assert parsed("<p>x</p><div class=entry-content>a</div>").blocks() == ["a"]
    assert parsed("<article></article><main>b</main>").blocks() == ["b"]
    assert parsed("<article><header><h1>T</h1>by me</header><p>a</p></article><article><p>b</p></article>").blocks() == ["T", "a", "b"]


def test_hostile_pages_take_linear_time():
    start = time.time()
    for source in ("<div>" * 50_000, "<a " * 50_000, "<p class='" * 50_000, "<!--" * 50_000, "</b>" * 50_000, "<b>" * 30_000 + "</i>" * 30_000, "<script>" * 20_000, "&" * 100_000, "<td>" * 30_000, "<li>" * 50_000):
        parsed(source).blocks()
    assert time.time() - start < 20


def site(n, host="a.example", frame="<div><p>Welcome to our site</p><ul><li>Home</li><li>Shop</li></ul></div><div><p>text {k}</p></div><p>Subscribe now</p>"):
    return [(k, f"https://u:p@{host.upper()}:80/{k}?q", frame.format(k=k)) for k in range(n)]


def extracted(spark, rows, **given):
    pages = spark.createDataFrame([Row(page_id=i, url=u, html=h, host="h", main="m", common="c") for i, u, h in rows], "page_id long, url string, html string, host string, main string, common string").repartition(3)
    out = site_templates.main_text(pages, **given)
    return sorted(((r["record"]["page_id"], r["record"]["host"], r["main"]) for r in out.collect()), key=str)


def direct(rows, min_pages=5, min_share=0.01, marked_pages=10, marked_share=0.9):
    """Counts of subtrees by host, page by page, in plain Python."""
    by_host = {}
    for _, url, source in rows:
        host = url.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "//" in url else ""
        page = parsed(source)
        if host:
            text, tree = "\n".join(page.blocks()), (bool(page.main), sorted(set(page.subtrees().values())))
            of = by_host.setdefault(host, {})
            of[text] = min(of.get(text, tree), tree)
    out = []
    for i, url, source in rows:
        host = url.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "//" in url else ""
        page, of = parsed(source), by_host.get(host, {})
        n = Counter(h for _, hashes in of.values() for h in hashes)
        least, share = (marked_pages, marked_share) if page.main else (min_pages, min_share)
        gone = frozenset(k for k, h in page.subtrees().items() if n[h] >= least and n[h] >= share * len(of))
        out.append((i, "h", "\n".join(page.blocks(gone))))
    return sorted(out, key=str)


def test_what_a_site_repeats_goes(spark):
    rows = site(12) + site(4, "small.example") + [(99, "https://a.example/x", "<p>Only here</p><p>Subscribe now</p>"), (100, "https://a.example/y", None), (101, None, "<p>Subscribe now</p>"), (102, "nothing", "")]
    got = extracted(spark, rows)
    assert got == direct(rows)
    by_id = {(i, t) for i, _, t in got}
    assert (3, "text 3") in by_id and (99, "Only here") in by_id and (101, "Subscribe now") in by_id and (100, "") in by_id
    assert (3, "Welcome to our site\nHome\nShop\ntext 3\nSubscribe now") in by_id  # a site of four pages


def test_copies_of_a_page_are_no_template(spark):
    rows = [(k, f"http://b.example/{k}", f"<nav><a>{k}</a></nav><div><p>The same words</p><p>again</p></div>") for k in range(30)] + [(40, "http://b.example/z", "<p>other</p>")]
    assert {t for i, _, t in extracted(spark, rows) if i < 30} == {"The same words\nagain"}


def test_passages_in_articles_stay_and_what_all_articles_have_goes(spark):
    often = [(k, f"http://c.example/{k}", f"<article><p>{k}</p>{'<p>quoted</p>' if k % 2 else ''}<div>Read our terms</div></article>") for k in range(20)]
    got = {i: t for i, _, t in extracted(spark, often)}
    assert got[1] == "1\nquoted" and got[2] == "2"
    assert extracted(spark, often) == direct(often)


def test_empty_table(spark):
    assert extracted(spark, []) == []
