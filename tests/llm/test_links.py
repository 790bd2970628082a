"""URL filters on pages with several links."""

from lakeledger.llm import url_filters


def test_every_canonical_link_and_refresh_is_an_edge(spark):
    rules = [("bad.org", "/", "block")]
    pages = [
        (1, "http://a.net/", '<link rel="canonical" href="http://b.net/"><link rel=next href="http://n.net/">\n<link href="http://bad.org/x" rel="canonical">'),
        (2, "http://b.net/", ""), (3, "http://n.net/", ""),
        (4, "http://c.net/", '<meta http-equiv="refresh" content="0; url=http://d.net/"><META HTTP-EQUIV="refresh" CONTENT="5; URL=http://bad.org/y">'),
        (5, "http://d.net/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = {row.page_id: row.verdict for row in url_filters.url_filter(df, rules).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}
