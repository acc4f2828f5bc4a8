"""Any number of rules against trying them one by one; ties; odd hosts and paths."""

import random

import pytest
from pyspark.sql import functions as F

from panelforge.llm import urlfilter
from panelforge.llm.urlfilter import Rule


def one_by_one(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return None
    best = max(fits, key=lambda r: (len(r.text), r.text, r.host, r.verdict == "allow"))
    return best.text, best.verdict


@pytest.fixture(scope="module")
def cases():
    rnd = random.Random(4)
    labels, parts = ["com", "org", "example", "a", "b", "www", "", "é"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/é", "/" + "x" * 40, "a"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5)))
    rules = [Rule(host(), rnd.choice(parts), rnd.choice(["allow", "block"])) for _ in range(700)]
    urls = [(k, f"http://{host()}{rnd.choice(parts)}{rnd.choice(['', 'b', '/b/c', '?q', '#f'])}") for k in range(800)] + [(900, None), (901, "no host"), (902, "http://"), (903, "http://com")] + [(950, "http://www.example.com/a/b")] * 60
    return rules, urls


@pytest.mark.parametrize("how", ["one by one", "by joins", "a table"])
def test_rules_against_one_by_one(spark, cases, how, monkeypatch):
    rules, urls = cases
    monkeypatch.setattr(urlfilter, "MOST_RULES", 10_000 if how == "one by one" else 100)
    rules = rules[:90] if how == "one by one" else rules
    given = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules] + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string") if how == "a table" else rules
    pages = spark.createDataFrame([(k, u, "") for k, u in urls], "page_id int, url string, html string").withColumns({c: F.lit("x") for c in ("verdict", "_key", "rule")})
    got = urlfilter.judge(pages, given).collect()
    assert len(got) == len(urls)
    for r in got:
        assert ((r.rule, r.verdict) if r.rule is not None else None) == one_by_one(r.host, r.path, rules), r


def test_ties(spark):
    rules = [Rule("b.com", "/x", "block"), Rule("com", "/xxx", "allow"), Rule("org", "/a", "block"), Rule("org", "/a", "allow"), Rule("b.net", "/q", "block")]
    pages = spark.createDataFrame([(1, "http://b.com/xxx", ""), (2, "http://org/a", "")], "page_id int, url string, html string")
    for given in (rules, spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")):
        got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, given).collect()}
        assert got == {1: ("com/xxx", "allow"), 2: ("org/a", "allow")}


def test_blocks_reach_aliases_by_joins_too(spark, cases):
    rules, _ = cases
    table = spark.createDataFrame([(f"h{k}.net", "/", "block") for k in range(300)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://free.info/1", '<link rel="canonical" href="http://h7.net/x">'), (2, "http://free.info/2", ""), (3, "http://h9.net/", "")], "page_id int, url string, html string")
    got = {r.page_id: (r.verdict, r.source) for r in urlfilter.judge(pages, table).collect()}
    assert got == {1: ("block", "alias"), 2: ("allow", "default"), 3: ("block", "rule")} and rules


@pytest.mark.parametrize("n", [0, 3])
def test_no_rules_and_no_pages(spark, n):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/c", "")], "page_id int, url string, html string")
    assert urlfilter.judge(pages, none).first().verdict == "allow"
    assert urlfilter.judge(pages.limit(0), none).count() == 0
