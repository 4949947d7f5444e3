import urllib.parse

import duckdb
import pytest

from presswork.llm import urls
from presswork.llm.oracles import ORACLES
from presswork.llm.queries import URL_RULES
from tests.compare import compare

SCHEMA = "page_id long, url string, html string"


def canonical(target):
    return f"<html><head><LINK href='{target}' rel=canonical></head></html>"


def refresh(target):
    return f'<meta http-equiv="Refresh" content="0; URL={target}">'


def judged(spark, rows, rules=URL_RULES, redirects=None):
    pages = spark.createDataFrame(rows, SCHEMA)
    return {r.page_id: r for r in urls.judge_pages(pages, rules, redirects).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://EXAMPLE.com/en/1?x#y", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.example.com/en", "a.example.com", "/en", "com/", "allow"),
        ("http://xexample.com/en/1", "xexample.com", "/en/1", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com?/en/", "example.com", "", None, "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("http://x.net/ES/1", "x.net", "/ES/1", None, "allow"),
        ("http://a://b/es/", "a:", "//b/es/", None, "allow"),
        ("no scheme.net/es/", "", "", None, "allow"),
        ("://x.net/es/", "x.net", "/es/", "net/es/", "block"),
        ("line\nbreak://x.net/es/a\nb", "x.net", "/es/a\nb", "net/es/", "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [(1, url, None)])[1]
    assert (r.host, r.path, r.rule, r.verdict, r.passed_on) == (host, path, rule, verdict, False)


def test_allow_goes_first_among_equals(spark):
    rules = [("block", "b.org", "/a"), ("allow", "b.org", "/a"), ("block", "org", "/a/b")]
    assert judged(spark, [(1, "http://b.org/a/bcd", "")], rules)[1].verdict == "allow"


def test_blocks_are_passed_on_to_aliases(spark):
    rows = [
        # A chain of aliases that ends at a blocked URL, also through pages that are absent.
        (1, "http://a.org/1#top", canonical("http://b.org/2")),
        (2, "http://b.org/2", refresh("http://absent.org/x")),
        (3, "http://c.org/3", canonical("http://absent.org/x")),
        (4, "http://x.net/es/9", canonical("//a.org/1")),
        (5, "http://a.org/1", None),
        (6, "https://A.ORG/1?q#z", canonical("http://a.org/1")),
        # An explicit allow in the component: nothing is passed on, the block itself stays.
        (10, "http://y.net/fr/1", canonical("http://shop.com/")),
        (11, "http://z.org/", canonical("http://y.net/fr/1")),
        (12, "http://shop.com/", None),
        # Relative targets, links that are none, and no links at all.
        (20, "http://d.org/dir/page", canonical("other")),
        (21, "http://d.org/dir/other", canonical("/es/")),
        (22, "http://d.org/es/", '<link rel="stylesheet" href="http://x.net/es/9">'),
        (30, "http://e.org/", "http://x.net/es/9"),
    ]
    got = judged(spark, rows)
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 10}
    assert {i for i, r in got.items() if r.passed_on} == {1, 2, 3, 5, 6}


TARGETS = [
    "http://b.org/x", "HTTPS://B.org/x/../y", "//b.org/z", "/r", "rel", "./rel", "../up", "../../../far/", "..",
    ".", "?z=1", "?z=../1", "a/./b/../c?q=/../", "/a/b/../../../c", "x..y/...", "mailto:me", "#top", "a b",
]
BASES = ["http://a.org/d/e/f?q=1", "http://A.org", "http://a.org/d/", "https://a.org/?x/y"]


def test_targets_resolve_as_in_the_standard_library(spark):
    rows = spark.createDataFrame([(b, t) for b in BASES for t in TARGETS], "base string, target string")
    made = rows.select("*", urls.plain_url(urls._absolute(rows.target, rows.base)).alias("got"))
    for base, target, got in made.collect():
        wanted = urllib.parse.urljoin(base, target) if target != "#top" else base
        parts = urllib.parse.urlsplit(wanted.replace("/x/../y", "/y"))
        query = f"?{parts.query}" if parts.query else ""
        plain = f"{parts.scheme}://{parts.netloc.lower()}{parts.path or '/'}{query}"
        assert got == (plain if parts.netloc else None)


LINKED = [
    (1, "http://a.org/1", '<link rel="alternate CANONICAL" href="http://x.net/es/1">'),
    (2, "http://a.org/2?a=1&b=2", None),
    (3, "http://x.net/es/3", '<link href="http://a.org/2?a=1&amp;b=2" rel=canonical>'),
    (4, "http://a.org/d/e/4", "<link rel='canonical' href='../up'>"),
    (5, "http://x.net/fr/5", '<link rel="canonical" href="http://a.org/d/./x/../up">'),
    (6, "http://a.org/6", '<base href="http://x.net/fr/"><link rel=canonical href=six>'),
    (7, "http://a.org/p/7?y=1", '<LINK REL="canonical" HREF="?z=1">'),
    (8, "http://a.org/p/7?z=1", "<meta http-equiv='refresh' content=\"0; URL='http://x.net/es/8'\">"),
    (9, "http://a.org/9", '<link rel="notcanonical" href="http://x.net/es/1">'),
    (10, "http://a.org/10", '<link data-rel="canonical" href="http://x.net/es/1">'),
    (11, "http://a.org/11", '<link rel="canonical" data-href="http://x.net/es/1" href="#here">'),
    (12, "http://a.org/12", '<base target="_top"><link rel="canonical" href="/x&#x2F;12">'),
    (13, "http://x.net/es/13", '<link rel="canonical" href="http://a.org/x/12">'),
    (14, "http://a.org/14", f"{'<p>' * 50_000}<link rel=canonical href=//x.net/fr/14>"),
    (15, None, '<link rel=canonical href="http://x.net/es/1">'),
    (15, None, '<link rel=canonical href="http://x.net/es/1">'),
    (16, "http://a.org/16", "<link rel=canonical href=>"),
    (17, "http://shop.com/17", '<link rel=canonical href="http://x.net/es/17">'),
    (18, "http://a.org/18", '<link rel="canonical" href="http://shop.com/17"/>'),
]


def test_declared_links_of_every_form(spark):
    got = judged(spark, LINKED)
    assert {i for i, r in got.items() if r.passed_on} == {1, 2, 4, 6, 7, 8, 12, 14}


def test_sql_on_a_table_with_links(spark, tmp_path):
    spark.createDataFrame(LINKED, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/p/*.parquet')")
    got = urls.judge_pages(spark.createDataFrame(LINKED, SCHEMA), URL_RULES)
    assert compare(got, con, ORACLES["op10_url_filter"]) is None


def test_redirect_table_and_hot_group(spark):
    rows = [(i, f"http://h{i % 3}.org/p{i}", None) for i in range(300)] + [(900, "http://x.net/es/1", "")]
    pages = [(i, u) for i, u, _ in rows if i % 2 == 0 and i < 900]
    redirects = spark.createDataFrame(
        [(u, "http://x.net/es/1") for _, u in pages] + [(None, "http://q.org/"), ("bad", "http://q.org/")],
        "from_url string, to_url string",
    )
    got = judged(spark, rows, redirects=redirects)
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i, _ in pages} | {900}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, "http://x.net/es/", None)] * 2, SCHEMA)
    pages = pages.selectExpr("*", "1 as node", "2 as host", "3 as root", "4 as direct")
    got = urls.judge_pages(pages, URL_RULES)
    assert sorted((r.page_id or 0, r.verdict) for r in got.collect()) == [(0, "allow")] * 2 + [(1, "block")] * 2
    assert urls.judge_pages(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.judge_pages(pages, URL_RULES * 200)


def test_no_python_in_the_plan(spark):
    from presswork.llm.queries import QUERIES

    plan = QUERIES["op10_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))
