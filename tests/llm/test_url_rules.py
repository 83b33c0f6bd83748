import duckdb
import pytest

from semblance.llm import components as graph
from semblance.llm.components import components
from semblance.llm.url_rules import OP1_SQL, RULES, judge_urls, op1_url_filter, page_links, with_rules

LINK = '<html><head><link {}></head></html>'


def judged(spark, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int, host string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, RULES, **kw).collect()}


def test_rules_and_odd_urls(spark):
    urls = ["http://A.Example.NET/en/x", "https://example.net", "https://x.net/", "http://nonet/", "no scheme", None, "", "ftp://de.example.com/de/1?q=://b", "http://example.com/DE/", "x://y.org/fr/#f", "http://example.com?/de/", "http://é.net/é", "http://notexample.com/de/"]
    got = judged(spark, [(i, u, None, 0, "clash") for i, u in enumerate(urls)])
    want = [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("nonet", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("de.example.com", "/de/1", "example.com/de/", "block"), ("example.com", "/DE/", None, "allow"), ("y.org", "/fr/", "org/fr/", "allow"), ("example.com", "", None, "allow"),
        ("é.net", "/é", "net/", "block"), ("notexample.com", "/de/", None, "allow"),
    ]
    assert [got[i] for i in range(len(urls))] == want


def test_blocks_travel_over_links_but_not_over_an_allow(spark):
    rows = [
        (1, "http://a.com/1#top", LINK.format('rel="canonical" href="http://b.com/2"'), 0, ""),
        (2, "https://b.com/2", LINK.format("href='/3' rel='canonical'"), 0, ""),
        (3, "http://b.com/3", '<META http-equiv="refresh" content="0; url=http://evil.net/x">', 0, ""),
        (4, "http://s.example.net/en/1", LINK.format('rel=canonical href="//evil.net/x"'), 0, ""),
        (5, "http://clean.com/", LINK.format('rel="canonical" href="http://clean.com/"'), 0, ""),
        (6, "http://clean.com/6", LINK.format('rel="stylesheet" href="http://evil.net/x"'), 0, ""),
        (7, "http://clean.com/a/7", LINK.format('rel="canonical" href="8"'), 0, ""),
        (1, "http://a.com/1#top", "", 0, ""),
    ]
    got = judged(spark, rows)
    assert {k for k, v in got.items() if v[3] == "block"} == {1, 2, 3}
    assert got[4][2:] == ("example.net/en/", "allow") and got[1][2] is None
    links = spark.createDataFrame([("http://clean.com/a/7", "http://q.com/"), ("http://q.com/", "http://evil.net/x")], "from_url string, to_url string")
    assert judged(spark, rows, links=links)[7][3] == "block"


def test_empty_table(spark):
    assert judged(spark, []) == {}


def test_long_lists_of_rules_are_joined_alike(spark):
    rules = [*RULES, *((f"h{i}.zz", "/", "block") for i in range(400))]
    rows = spark.createDataFrame([(f"w.example.net", "/en/1"), ("x.net", "/"), ("h399.zz", "/a"), ("h400.zz", "/")], "host string, path string")
    got = {r.host: (r.rule, r.action) for r in with_rules(rows, rules).collect()}
    assert got == {"w.example.net": ("example.net/en/", "allow"), "x.net": ("net/", "block"), "h399.zz": ("h399.zz/", "block"), "h400.zz": (None, None)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


# html of a page and where its links lead; the page is http://a.com/x/y?q=1
LINKS = [
    ('<link\n  href="http://b.com/"\n  rel="canonical"\n/>', ["http://b.com/"]),
    ('<link data-href="q" rel="canonical" href="https://b.com/1">', ["https://b.com/1"]),
    ("<LINK REL=Canonical HREF=http://b.com/2>", ["http://b.com/2"]),
    ("<link rel='alternate canonical' href='http://b.com/3?a=1&amp;b=2'>", ["http://b.com/3?a=1&b=2"]),
    ('<link rel="canonicals" href="http://b.com/4"><link title="rel=canonical" href="http://b.com/4"><link rel=canonical>', []),
    ('<link title="href=http://no.com/" rel=canonical href=" /5 ">', ["http://a.com/5"]),
    ('<meta http-equiv="refresh" content="0;url=http://b.com/6">', ["http://b.com/6"]),
    ("<meta content='5; URL = \"http://b.com/7\"' http-equiv=Refresh>", ["http://b.com/7"]),
    ('<meta http-equiv="refresh" content="0; http://b.com/8">', ["http://b.com/8"]),
    ('<meta http-equiv="refresh" content="30"><meta name="refresh" content="0;url=http://b.com/9">', []),
    ('<!-- <link rel="canonical" href="http://b.com/10"> --><script>"<link rel=canonical href=http://b.com/10>"</script>', []),
    ('<base href="http://base.com/d/e"><link rel="canonical" href="f">', ["http://base.com/d/f"]),
    ('<base target="_top"><base href="/g/"><link rel="canonical" href="../h">', ["http://a.com/g/../h"]),
    ('<link rel="canonical" href="?p=2"><link rel="canonical" href="z">', ["http://a.com/x/y?p=2", "http://a.com/x/z"]),
    ('<link rel="canonical" href="//b.com/11"><link rel="canonical" href="mailto:me"><link rel="canonical" href="#here"><link rel="canonical" href="">', ["https://b.com/11"]),
    ("<p>no canonical or refresh</p>", []),
]


@pytest.mark.parametrize("html,want", LINKS)
def test_links_of_a_page(spark, html, want):
    got = page_links(spark.createDataFrame([("http://a.com/x/y?q=1", html)], "url string, html string")).collect()
    assert [r.to_url for r in got] == want and all(r.from_url == "http://a.com/x/y?q=1" for r in got)


def test_sql_says_the_same_where_aliases_decide(spark, tmp_path):
    rows = [(i, "http://a.com/x/y?q=1" if i % 2 else f"http://p{i}.org/x/", html) for i, (html, _) in enumerate(LINKS)]
    rows += [(100 + i, f"http://s{i}.com/", html.replace("b.com", "evil.net").replace("base.com", "evil.net")) for i, (html, _) in enumerate(LINKS)]
    rows += [
        (200, "http://b.com/6", '<link rel=canonical href="http://c.com/./a/../b/..">'), (201, "https://c.com/", '<meta http-equiv=refresh content="0;url=http://org/fr/1">'), (202, "http://k.example.com/de/q", ""),
        (203, "http://safe.example.net/en/1", '<link rel=canonical href=http://k.example.com/de/q>'), (204, "http://t.com/1", '<link rel=canonical href=http://k.example.com/de/q#f>'), (205, "http://t.com/1#x", None),
        (206, None, '<link rel=canonical href=http://x.net/>'), (207, "nothing", '<link rel=canonical href=http://x.net/>'), (204, "http://t.com/1", ""), (208, "http://u.com/a/./b", ""), (209, "http://u.com/a/b", "<link rel=canonical href=http://x.net/>"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in op1_url_filter(spark, str(tmp_path)).collect()), key=str)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP1_SQL})").fetchall(), key=str)
    blocked = {r[0] for r in got if r[4] == "block" and r[3] is None}
    assert {100, 101, 102, 103, 106, 107, 108, 111, 114, 204, 205, 208, 209} <= blocked and not {104, 109, 110, 115, 203, 206, 207, 200} & blocked


def test_long_html_and_urls_that_share_an_alias(spark):
    long = "<p>" + "x < y canonical " * 200_000 + "</p>"
    rows = [(i, "http://same.com/", long + LINK.format('rel="canonical" href="http://evil.net/"') if i < 2 else "", 0, "") for i in range(300)]
    got = judged(spark, [*rows, *((1000 + i, None, None, 0, "") for i in range(300))])
    assert len(got) == 600 and all(v[3] == ("block" if k < 1000 else "allow") for k, v in got.items())


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 30)] + [(500, i) for i in range(501, 520)] + [(700, 701)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(60), *range(101, 130)]} | {i: 500 for i in range(500, 520)} | {700: 700, 701: 700}
