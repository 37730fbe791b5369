import time

import pytest
from pyspark.sql import functions as F

from fleetops.llm.html_text import agreed_paths, best, extract, extracted, host, parsed, votes
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string, host string, text string, path string"


def pages(spark, *some):
    return spark.createDataFrame([(i, u, h, "h", "t", "p") for i, (u, h) in enumerate(some)], PAGES)


PROSE = "A sentence of some length stands here, and another one follows it."
COMMENT = "What a comment this is, longer than all of the article that it stands under! " * 8


def page(body, extra=""):
    return (
        f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href='/'>Home</a></ul></nav>{body}<div class='sidebar'>Side {PROSE}</div>{extra}"
        f"<form><input value='x'>Search</form><div id=cookie-notice>Cookies</div><footer>&copy; us</footer>"
        f"<script>var a = '<p>no</p>';</script></body></html>"
    )


def test_boilerplate_is_left_out():
    body = (
        f"<div class='post-17 main-text'><h1>Title &amp; more</h1><div class='ad'>Buy</div><p>{PROSE}\n  <b>bold</b>&nbsp;end"
        f"<p>Second<br>line<ul><li>One<li>Two</ul><table><tr><td>1<td>2</table><div class='comments'><p>{COMMENT}</p></div></div>"
    )
    text, path = extracted(page(body), [])
    assert text == f"Title & more\n{PROSE} bold end\nSecond line\nOne\nTwo\n1\n2"
    assert path == "html>body>div.main-text.post-#"


@pytest.mark.parametrize(
    "start, end",
    [
        ("", ""),
        ("<!doctype html><title>T</title>", ""),
        ("<head><meta charset=utf-8><title>T</title>", ""),
        ("<html><head><title>T</title></head>", "</html>"),
        ("<body>", "</body>"),
        ("<html><head><title>T</title><body>", ""),
    ],
)
def test_tags_of_html_and_body_may_be_left_out(start, end):
    text, path = extracted(f"{start}<h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><div class=box>short</div>{end}", [])
    assert text == f"T\n{PROSE}\n{PROSE}\nshort"
    assert path == "html>body"


def test_text_beside_html_and_body_is_kept():
    beside = f"one <html>two<body><p>{PROSE}</p></body>three</html><p>four</p>"
    assert extracted(beside, [])[0] == f"one two\n{PROSE}\nthree\nfour"
    assert extracted("<head><title>T</title>only text", [])[0] == "only text"


def test_a_host_without_html_and_body_tags(spark):
    bare = f"<h1>T</h1><p>{PROSE}</p><div class=box>short</div>"
    got = extract(pages(spark, *[("http://a.b/", bare)] * 3, ("http://a.b/", f"<html><body>{bare}</body></html>"))).collect()
    assert {(r["text"], r["path"]) for r in got} == {(f"T\n{PROSE}\nshort", "html>body")}


LONG, REST = " ".join([PROSE] * 9), " ".join([PROSE] * 3)
SPLIT = f"<div class=post><div class=intro><p>{LONG}</p></div><div class=rest><p>{REST}</p></div></div>"


@pytest.mark.parametrize(
    "body, text, path",
    [
        (SPLIT, f"{LONG}\n{REST}", "html>body>div.post"),
        (f"<div class=post><div class=rest><p>{REST}</p></div><div><div class=intro><p>{LONG}</p></div></div></div>", f"{REST}\n{LONG}", "html>body>div.post"),
        (f"<main><section><p>{LONG}</p></section><section><p>{REST}</p></section></main>", f"{LONG}\n{REST}", "html>body>main"),
        (f"<section class=a><p>{LONG}</p></section><section class=b><p>{REST}</p></section>", f"{LONG}\n{REST}", "html>body"),
        (f"<article><section><p>{LONG}</p></section><section>Few</section></article>", f"{LONG}\nFew", "html>body>article"),
        (f"<div class=post><h1>T</h1><p>Few</p><section><p>{LONG}</p></section></div>", f"T\nFew\n{LONG}", "html>body>div.post"),
        (f"<div class=post><p>Few</p><blockquote><p>{LONG}</p></blockquote><p>End</p></div>", f"Few\n{LONG}\nEnd", "html>body>div.post"),
        (f"<h1>T</h1><blockquote><p>{LONG}</p></blockquote>", f"T\n{LONG}", "html>body"),
        (f"<div class=post><h1>T</h1><table><tr><td>{LONG}<td>{REST}<tr><td>{REST}</table></div>", f"T\n{LONG}\n{REST}\n{REST}", "html>body>div.post"),
        (f"<article><p>{LONG}</p></article><article><p>{REST}</p></article>", f"{LONG}\n{REST}", "html>body>article"),
        # What is no part of the article stays out.
        (f"<div class=post><p>{LONG}</p></div><div class=more><a href=/>{REST}</a> and more</div>", LONG, "html>body>div.post"),
        (f"<h1>Site</h1><div class=post><p>{LONG}</p></div><div class=x>&copy; us</div>", LONG, "html>body>div.post"),
        (f"<article><p>{LONG}</p></article><div class=x><p>{REST}</p></div>", LONG, "html>body>article"),
    ],
)
def test_articles_in_several_containers(body, text, path):
    assert extracted(page(body), []) == (text, path)


def test_a_host_with_articles_in_several_containers(spark):
    single = f"<div class=post><div class=intro><p>{LONG}</p></div></div>"
    site = [("http://a.b/", page(SPLIT))] * 3 + [("http://c.d/", page(single))] * 6 + [("http://c.d/", page(SPLIT))] * 2
    got = {r["page_id"]: r["text"] for r in extract(pages(spark, *site)).collect()}
    assert [got[i] for i in range(11)] == [f"{LONG}\n{REST}"] * 3 + [LONG] * 6 + [f"{LONG}\n{REST}"] * 2


def test_a_host_outvotes_a_page(spark):
    short = page("<div class='c1'><p>Short.</p></div><section class='x'><p>" + COMMENT + "</p></section>")
    usual = page(f"<div class='c1'><p>{PROSE}</p><p>{PROSE}</p></div><section class='x'><p>Other</p></section>")
    site = [("http://www.Site.org/a", usual)] * 6 + [("https://site.org:80/b", short), ("http://other.org/", short), (None, short)]
    got = {r["page_id"]: (r["text"], r["path"]) for r in extract(pages(spark, *site)).collect()}
    assert got[0][0] == f"{PROSE}\n{PROSE}"
    assert got[6] == ("Short.", "html>body>div.c#")
    assert got[7][0] == got[8][0] == " ".join(COMMENT.split())
    counted = {(r["host"], r["path"]): r["votes"] for r in votes(pages(spark, *site)).collect()}
    assert counted["site.org", "html>body>div.c#"] == 6
    assert agreed_paths(votes(pages(spark, *site))).filter("host = 'site.org'").first()["paths"][0] == "html>body>div.c#"


@pytest.mark.parametrize(
    "broken, text",
    [
        ("", ""),
        ("  \n ", ""),
        ("just text &lt;3 &#233;&#x4e00;&amp;amp;", "just text <3 é一&amp;"),
        ("<p>a<p>b", "a\nb"),
        ("<div>x<span>y</span> z</div>", "xy z"),
        ("<p><b>one<br><p>two</p>", "one\ntwo"),
        ("</p></div>x", "x"),
        ("<!-- unclosed <p>x", ""),
        ("<script>unclosed <p>x", ""),
        ("<p title='unclosed>x</p><p>y</p>", "x\ny"),
        ("a < b and c > d", "a < b and c > d"),
        ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ("<P CLASS=X>upper</P>", "upper"),
        ("<div hidden><p>gone</p></div><p>here</p>", "here"),
        ("<div>" * 3000 + "<p>deep</p>", "deep"),
    ],
)
def test_broken_pages(broken, text):
    assert extracted(broken, [])[0] == text
    assert extracted(broken, ["html>body>article"])[0] == text


def test_awkward_rows(spark):
    some = [(None, None), ("", ""), ("http://a.b/", None), ("http://a.b/", "<p>x</p>"), ("http://a.b/", "<p>x</p>")]
    got = rows(extract(pages(spark, *some)), "page_id", "url", "text", "n_chars")
    assert got == [(0, None, "", 0), (1, "", "", 0), (2, "http://a.b/", "", 0), (3, "http://a.b/", "x", 1), (4, "http://a.b/", "x", 1)]
    assert extract(pages(spark, *some).limit(0)).count() == 0
    assert best(parsed("<nav>x</nav>")) is None


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<form id=aspnetForm><div class=post><p>{LONG}</p></div><input type=hidden></form>", LONG),
        (f"<div class='site-content has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='post no-comments'><p>{LONG}</p></div>", LONG),
        (f"<div class='post comments-open'><p>{LONG}</p></div>", LONG),
        (f"<div class='content-with-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='search-content'><p>{LONG}</p></div>", LONG),
        (f"<article><div class='post-header'><h1>T</h1></div><p>{LONG}</p></article>", f"T\n{LONG}"),
        (f"<div class='main-nav-layout'><article><h1>T</h1><p>{LONG}</p></article></div>", f"T\n{LONG}"),
        # These still go, also where they are longer than the article.
        (f"<div class=post><p>{REST}</p><div class='comments-area'><p>{COMMENT}</p></div></div>", REST),
        (f"<div class=post><p>{REST}</p><div class='user-comments'><p>{COMMENT}</p></div></div>", REST),
        (f"<div class=post><p>{REST}</p><div class='search-box'><p>{PROSE}</p></div></div>", REST),
        (f"<div class=post><p>{REST}</p><div class='site-header'><h1>S</h1></div><form><p>{PROSE}</p></form></div>", REST),
        (f"<div class=post><p>{REST}</p><div role=alert><p>{PROSE}</p></div><div id=sidebar-2>x</div></div>", REST),
    ],
)
def test_names_need_evidence(body, text):
    assert extracted(page(body), [])[0] == text


@pytest.mark.parametrize(
    "hostile",
    [
        '<p>hi <x "' * 100_000,
        "<p>hi <x \"'" * 100_000,
        "<x '\" y=\"'>" * 80_000,
        "<" * 1_000_000,
        "<!" * 500_000,
        "<a " * 300_000,
        "<span>" * 60_000 + "</b></i></div>" * 40_000,
        "<b><div>" + "<span>" * 60_000 + "</b>" * 100_000,
        "<ul><span>" * 30_000 + "<li>" * 60_000,
        "<script>" * 100_000,
        "<!--" * 200_000,
    ],
)
def test_hostile_pages_take_time_in_proportion(hostile):
    start = time.process_time()
    parsed(hostile)
    assert time.process_time() - start < 10


def test_hosts(spark):
    urls = ["http://www.A.b/x", "https://u:p@a.b:8/x", "a.b/x", "mailto:x@y", "", None, "http:///x", "ftp://é.org?q"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r[0] for r in df.orderBy("i").select(host(F.col("url"))).collect()]
    assert got == ["a.b", "a.b", None, None, None, None, None, "é.org"]
