from panelforge.llm import urlfilter


def test_every_declared_target_is_an_edge(spark):
    link = '<LINK REL="{}" href="{}">'
    pages = [
        ("http://a.net/x/y?q=1", link.format("Canonical", "/bad")),
        ("http://b.net/x/y", link.format("CANONICAL", "//bad.com/z")),
        ("http://c.net/x/y", link.format("canonical", "../up/./z?a=1&amp;b=2")),
        ("http://d.net/x", link.format("canonical", "http://one.net/") + link.format("canonical", "http://two.net/") + "<meta http-equiv=rEfresh content='0; url=three'>"),
        ("http://e.net/x", link.format("canonical", "?p=2")),
        ("http://f.net/x", link.format("canonical", "mailto:a@b.c")),
        ("http://g.net", link.format("canonical", "next")),
    ]
    found = {(r.src, r.dst) for r in urlfilter.page_edges(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert found == {
        ("a.net/x/y?q=1", "a.net/bad"),
        ("b.net/x/y", "bad.com/z"),
        ("c.net/x/y", "c.net/up/z?a=1&b=2"),
        ("d.net/x", "one.net/"),
        ("d.net/x", "two.net/"),
        ("d.net/x", "d.net/three"),
        ("e.net/x", "e.net/x?p=2"),
        ("g.net", "g.net/next"),
    }
