"""URL parts and listed rules by hand; mined rules and their matches against plain enumeration."""

import random
from itertools import combinations

import pytest

from fleetops.llm import url_rules
from tests.helpers import plan
from tests.llm.helpers import rows

PAGES = "page_id long, url string, html string, row string, token string, tokens string, rule string, confidence string"


def pages(spark, urls, ids=None):
    ids = list(range(len(urls))) if ids is None else ids
    return spark.createDataFrame([(i, u, "h", "r", "t", "ts", "ru", "c") for i, u in zip(ids, urls)], PAGES)


def labels(spark, said):
    return spark.createDataFrame(list(said), "page_id long, unwanted boolean")


def plain_tokens(url):
    if url is None or "://" not in url:
        return []
    rest = url.split("://", 1)[1].split("#")[0]
    place, _, query = rest.partition("?")
    host, slash, path = place.partition("/")
    low = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    listed = ["h:" + x for x in low(host).split(".")[::-1]]
    listed += ["p:" + low(x) for x in (slash + path).split("/")] + ["q:" + low(x.split("=")[0]) for x in query.split("&")]
    return [t for t in dict.fromkeys(listed) if len(t) > 2]


def plain_rules(urls, said):
    known = [(plain_tokens(urls[i])[:16], bad) for i, bad in said.items() if plain_tokens(urls[i])]
    least = max(3, -(-2 * len(known) // 1000))
    seen = {}
    for found, bad in known:
        for size in (1, 2, 3):
            for some in combinations(sorted(found), size):
                n, k = seen.get(some, (0, 0))
                seen[some] = (n + 1, k + bad)
    rules = {s: (k / n, k) for s, (n, k) in seen.items() if k >= least and 2 * k >= n}
    return {s: r for s, r in rules.items() if not any(set(o) < set(s) and rules[o][0] >= r[0] for o in rules)}


CASES = [
    ("http://A.b.NET/x/y?q=1#z", "a.b.net", "/x/y", "net/", "block"),
    ("https://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://badexample.net/en/1", "badexample.net", "/en/1", "net/", "block"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://example.com/de", "example.com", "/de", None, "allow"),
    ("ftp://w.org/fr/a", "w.org", "/fr/a", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://a.net?x/y", "a.net", "", None, "allow"),
    ("http://É.com/Ä", "É.com", "/Ä", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://", "", "", None, "allow"),
    ("http://a.com/?u=http://b.net/", "a.com", "/", None, "allow"),
    ("http://c.com/" + "s/" * 20_000, "c.com", "/" + "s/" * 20_000, None, "allow"),
]


def test_parts_and_listed_rules(spark):
    judged = url_rules.judge(pages(spark, [c[0] for c in CASES] * 2), labels(spark, []))
    got = judged.select("host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([c[1:] for c in CASES] * 2, key=repr)


def test_mined_rules_and_matches(spark):
    pick = random.Random(5)
    urls = []
    for i in range(600):
        host = pick.choice(["www.cheap.pills", "m.fine", "blog.fine", "shop.cheap", "hot"])
        urls.append(f"http://{host}.com/{pick.choice(['en', 'DE', 'x/y'])}/{pick.randrange(9)}?{pick.choice(['ref=1', 'page=2&ref=3', ''])}")
    bad = [("pills" in u and "ref" in u) or ("/DE/" in u and "shop" in u) or pick.random() < 0.1 for u in urls]
    said = {i: bad[i] for i in range(0, 600, 2)}
    rules = plain_rules(urls, said)
    assert len(rules) > 3
    table = pages(spark, [*urls, None, "no"])
    judged = url_rules.judge(table, labels(spark, [*said.items(), (None, True), (1, None)])).collect()
    assert len(judged) == 602
    for row in judged:
        have = set(plain_tokens(urls[row.page_id])) if row.page_id < 600 else set()
        fits = [s for s in rules if set(s) <= have]
        assert row.verdict == ("block" if fits else "allow")
        best = max(fits, key=lambda s: (*rules[s], len(s), s), default=None)
        assert (None if row.mined_rule is None else tuple(row.mined_rule)) == best
    caught = [row.verdict == "block" for row in judged if row.page_id < 600 and "pills" in urls[row.page_id] and "ref" in urls[row.page_id]]
    assert all(caught)


def test_late_tokens_are_learned(spark):
    """Rules come from tokens behind the sixteenth too, and many tokens that always stand together do not hurt."""
    start = "http://www.a.com/" + "/".join(f"dir{k}" for k in range(25))
    urls = [f"{start}/{'ham' if i % 3 else 'spam'}?{'page' if i % 4 else 'ref'}={i}" for i in range(60)]
    bad = ["/spam" in u and "ref" in u for u in urls]
    judged = url_rules.judge(pages(spark, urls), labels(spark, list(enumerate(bad))[:40])).collect()
    assert {row.page_id for row in judged if row.verdict == "block"} == {i for i in range(60) if bad[i]}
    assert {tuple(row.mined_rule) for row in judged if row.mined_rule} == {("p:spam", "q:ref")}


@pytest.mark.parametrize("said", [[], [(0, False)], [(0, True)], [(0, None), (None, True)]])
def test_too_few_labels_allow_all(spark, said):
    judged = url_rules.judge(pages(spark, ["http://a.com/x"] * 3, [0, 0, None]), labels(spark, said))
    assert rows(judged, "page_id", "verdict") == sorted([(0, "allow"), (0, "allow"), (None, "allow")], key=repr)


def test_empty_table(spark):
    assert rows(url_rules.judge(pages(spark, ["x"]).limit(0), labels(spark, [(0, True)]))) == []


def test_no_python_in_the_plan(spark, testdata):
    text = plan(url_rules.op12_url_rules(spark, testdata))
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
    assert "html" not in text


def test_labels_of_pages(spark):
    given = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert rows(url_rules.page_labels(given)) == [(1, True), (2, True), (3, False), (4, None)]
