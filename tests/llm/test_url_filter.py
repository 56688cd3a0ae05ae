from ordermill.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string"


def judged(spark, rows, **more):
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS row")
    return {r.page_id: r for r in uf.judge(pages, **more).collect()}


def canonical(to):
    return f'<html><link href="{to}" rel="canonical"></html>'


def test_rules(spark):
    got = judged(spark, [
        (1, "http://A.Example.ORG/es/1?x#y", None),
        (2, "https://example.org/en/17", ""),
        (3, "https://example.org/fr", ""),
        (4, "https://badexample.org/es/1", ""),
        (5, "https://x.com/de/1", ""),
        (6, "https://x.com/fr/1", ""),
        (7, "https://x.net", ""),
        (8, "no scheme", ""),
        (9, None, ""),
        (10, "https://x.org", ""),
    ])
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/17", "example.org/en/1", "block"),
        3: ("example.org", "/fr", "org/", "allow"),
        4: ("badexample.org", "/es/1", "org/", "allow"),
        5: ("x.com", "/de/1", "com/de/", "block"),
        6: ("x.com", "/fr/1", "com/fr/", "allow"),
        7: ("x.net", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("x.org", "", None, "allow"),
    }


def test_blocks_reach_aliases_in_several_steps(spark):
    refresh = '<META content="0; URL=/two" http-equiv="refresh">'
    got = judged(spark, [
        (1, "http://a.net/one#part", refresh),
        (2, "https://a.net/two", canonical("https://b.com/de/9")),
        (3, "https://b.com/de/9", ""),
        (4, "https://a.net/three", ""),
        (4, "https://a.net/three", ""),
        # an allowed alias keeps its component free, and a rule of one's own stands
        (5, "https://c.net/x", canonical("//d.com/de/1")),
        (6, "https://d.com/de/1", canonical("https://e.org/")),
        (7, "https://e.org/", ""),
    ])
    assert {k: r.verdict for k, r in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"
    }


def test_a_target_that_was_not_crawled_counts(spark):
    got = judged(spark, [(1, "https://a.net/dir/x", canonical("y.html")),
                         (2, "https://a.net/dir/z", canonical("https://q.com/de/"))])
    assert (got[1].verdict, got[2].verdict) == ("allow", "block")


def test_redirect_table_and_many_aliases(spark):
    n = 400
    pages = [(i, f"https://h{i}.net/", "") for i in range(n)]
    hops = spark.createDataFrame(
        [(f"https://h{i}.net/", f"https://h{i + 1}.net/") for i in range(n - 1)]
        + [(f"https://h{n - 1}.net/", "https://z.com/de/")],
        "from_url string, to_url string",
    )
    got = judged(spark, pages, redirects=hops)
    assert len(got) == n and {r.verdict for r in got.values()} == {"block"}


def test_empty(spark):
    assert judged(spark, []) == {}
    got = judged(spark, [(1, "https://x.org/", "")], rules=uf.rules_table(spark).limit(0))
    assert (got[1].rule, got[1].verdict) == (None, "allow")


def test_references_and_dot_segments_of_links(spark):
    got = judged(spark, [
        (1, "https://a.net/one?x=1&y=2", ""),
        (2, "https://b.net/p", canonical("https://a.net/one?x=1&amp;y=2")),
        (3, "https://b.net/d/e/q", canonical("../../p")),
        (4, "https://b.net/d/./f/../g/../e/q", canonical("&#x2f;d/e/q")),
        (5, "https://b.net/z", canonical("https&#58;//a.net/./one?x=1&#38;y=2")),
        (6, "https://a.net/w", canonical("https://q.com/en/../de/")),
        (7, "https://a.net/one?x=1&y=2#z", canonical("/w")),
    ])
    assert {r.verdict for r in got.values()} == {"block"}
    assert got[4].path == "/d/./f/../g/../e/q"


def test_decoding_and_dots_case_by_case(spark):
    from pyspark.sql import functions as F

    texts = ["a&amp;b", "&amp;lt;", "x&#65;y&#x42;z&#;&#300;&#xfff;", "&unknown;", "&#38;amp;", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(uf.decoded(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == ["a&b", "&lt;", "xAyBz&#;&#300;&#xfff;", "&unknown;", "&", ""]
    paths = ["/a/b", "/a/./b", "/a/../b", "/../../b", "/a/b/..", "/a/.", "", "/", "/a..b/...", "/./"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select(uf.without_dots(F.col("p")).alias("d"))
    assert [r.d for r in df.collect()] == ["/a/b", "/a/b", "/b", "/b", "/a/", "/a/", "", "/", "/a..b/...", "/"]


def test_a_very_long_url(spark):
    long = "https://x.com/de/" + "a/" * 200_000
    got = judged(spark, [(1, long, canonical(long + "b")), (2, long + "b", ""), (3, "https://y.net/", canonical(long))])
    assert [got[i].verdict for i in (1, 2, 3)] == ["block"] * 3
