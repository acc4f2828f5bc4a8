import random
import re

import pytest
from pyspark.sql import functions as F

from panelforge.llm import decontam, quality_classifier, quality_rules, urlfilter
from panelforge.llm.urlfilter import Rule

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules ------------------------------------------------------------------------------------------


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


ODD = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 30_000, "l one\nl one\n\nl one\n \n ", "é\x0bü\x0c# *$%&|<>", "a a a a a a", "A b c d e f g A b c d e", "the of and " * 60]


def test_base_counts(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(1000 + i, t, None if i % 2 else "en") for i, t in enumerate(ODD)] + [(None, "no id", "xx"), (3, "again", "fr")], small.schema)
    docs = small.unionByName(odd).withColumns({c: F.lit("x") for c in ("n_words", "_text", "_words", "_common", "kept")})
    found = quality_rules.judge(docs).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str)
    assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)
    assert not any(r.kept for r in found if r.base_failed)
    assert all(r.class_distance is None and r.word_distance is None for r in found if r.n_words < quality_rules.GUARD_WORDS)


def test_divergence_rejects_what_labels_call_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.2


def test_js_distance(spark):
    row = spark.range(1).select(quality_rules._js_distance([F.lit(0.5), F.lit(0.5), F.lit(0.0)], [0.5, 0.5, 0.0]).alias("same"), quality_rules._js_distance([F.lit(1.0), F.lit(0.0)], [0.0, 1.0]).alias("apart")).first()
    assert row.same == 0 and row.apart == pytest.approx(1)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_rules.judge(docs).count() == 0


# --- quality classifier -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    found = quality_classifier.classify(docs, labels.where(half == 0), keep=["doc_id"])
    rows = found.join(labels.where(half == 1), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    assert sum(clean) / len(clean) > 0.98
    assert sum(bad) / len(bad) < 0.05
    assert sum(toxic) / len(toxic) < 0.15


def test_site_posteriors_shrink():
    """By hand: a site without rows of its own has the global rate, a large one its own."""
    import math

    m, k = quality_classifier.HOST_WEIGHT, quality_classifier.PATH_WEIGHT

    def path_rate(n, s, host_n, host_s, overall):
        host = (host_s + m * overall) / (host_n + m)
        return (s + k * host) / (n + k)

    assert path_rate(0, 0, 0, 0, 0.8) == pytest.approx(0.8)
    assert path_rate(10**7, 10**6, 10**7, 10**6, 0.8) == pytest.approx(0.1, abs=1e-4)
    assert math.isclose(path_rate(1, 0, 1, 0, 0.5), (0 + k * (m * 0.5 / (1 + m))) / (1 + k))


def test_bad_site_lowers_its_documents(spark):
    good, bad = "The tide of the sea was calm and of a kind that is in the books for long evenings", "BUY!! NOW!! *** $$$ ||| THE!! BEST!! *** ### %%% ONLY!! HERE!! *** $$$ &&& ***"
    rows = [(i, good if i % 2 else bad, "mixed", "a") for i in range(60)] + [(100 + i, bad, "farm", "b") for i in range(200)] + [(900, good, "farm", "b"), (901, good, "mixed", "a"), (902, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(1) for c in ("_q", "_host", "_row", "n")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(found) == len(rows) and set(found[900].asDict()) == {*docs.columns, "quality_score", "toxicity_score", "kept"}
    assert found[900].quality_score < found[901].quality_score
    assert found[901].kept and not found[100].kept


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text", "s", "en"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality_classifier.classify(docs, none).collect()] == [True, True]
    assert quality_classifier.classify(docs.limit(0), none).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------

QUESTION = "Maria has 12 apples and gives 5 kg of them to Peter, then Maria buys 12 more apples; how many apples does Maria have"


@pytest.mark.parametrize("limit", [500_000, 0])
def test_leaks(spark, limit):
    swapped = QUESTION.replace("Maria", "Jonas").replace("12", "31").replace("Peter", "Anna")
    torn = QUESTION.replace("buys 12", "buys 13")
    texts = {
        1: f"Some words before. {QUESTION} and some after it.",
        2: f"well then {swapped.replace(' kg', ' pounds')} ok",
        3: torn,
        4: "Maria has 12 apples and nothing else happens in this text at all",
        5: None,
        6: "",
        7: "12 13 14 15 16 17 18 19",
        8: QUESTION.upper(),
        9: "tiny item",
        10: "a tiny item in more words than it",
        11: QUESTION + " " + " ".join(f"w{i}" for i in range(30_000)),
    }
    rows = [*texts.items(), (1, texts[1]), (None, QUESTION)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "pos", "item", "item_id", "_v")})
    items = [(0, QUESTION), (0, QUESTION), (1, "tiny item"), (2, None), (3, "1 2 3 4 5 6 7"), (None, "Maria has 12 apples and nothing else happens")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, benchmark, broadcast_windows=limit).collect()}
    # 3 gives one name two values, so its slots don't fit; 8 is lower-cased whole, names and all
    assert set(found) == {(1, 0), (2, 0), (9, 1), (11, 0)}
    assert not found[1, 0].reparameterised and found[2, 0].reparameterised
    assert found[1, 0].share >= 0.8


def test_planted_passages(spark):
    """Brute force on plain windows; the tables' benchmark has no numbers or names."""
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    shingles = lambda t: {tuple(x) for w in [[y.lower().strip(".,;:!?") for y in WORD.findall(t or "")]] for x in zip(*(w[i:] for i in range(5)), strict=False)}
    items = {r.item_id: shingles(r.text) for r in benchmark.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for own in [shingles(r.text)] for k, s in items.items() if len(s & own) >= 0.8 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == want and want


def test_nothing_to_leak(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0
    assert decontam.leaks(docs.limit(0), spark.createDataFrame([(1, "a text")], "item_id long, text string")).count() == 0


# --- URL filters --------------------------------------------------------------------------------------------


def slow_rule(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
        path = path[:cut]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD_URLS = [None, "", "no scheme.org/x", "http://", "HTTP://A.Example.ORG/es/1?x=/y#z", "https://É.org/", "x://y://org/z", "http://notorg/", "http://org/", "http://org", "http://a.org?q", "http://com/fr/", "http://b.com/de/#", "http://example.org/en/1\n2", "a\nb://example.org/es/"]


def test_rules(spark):
    pages = [(i, u, None) for i, u in enumerate(ODD_URLS)] + [(None, "http://org/", ""), (3, "http://org/", "<html>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "rule", "_node", "_r", "src")})
    for r in urlfilter.judge(table, urlfilter.RULES).join(table.select("page_id", "url"), "page_id").where("page_id <> 3").collect():
        host, path, rule, verdict = slow_rule(r.url, urlfilter.RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url
    assert urlfilter.judge(table.limit(0), urlfilter.RULES).count() == 0


def test_blocks_reach_aliases(spark):
    rules = [Rule("bad.com", "/", "block"), Rule("good.com", "/", "allow")]
    canonical = '<link href="{}" REL=canonical>'
    refresh = "<meta http-equiv='Refresh' content='0; url={}'>"
    pages = [
        (1, "http://one.net/a", canonical.format("http://two.net/b?utm_source=x")),
        (2, "https://two.net/b#top", refresh.format("http://www.bad.com/x")),
        (3, "http://good.com/", canonical.format("http://one.net/a")),
        (4, "http://three.net/", "<p>http://bad.com/</p>"),
        (5, "http://bad.com/y", None),
        (6, "http://log.net/", ""),
        (7, "http://www.bad.com/x", ""),
    ]
    log = spark.createDataFrame([("http://log.net/", "http://bad.com/deep"), (None, "http://bad.com/")], "src string, dst string")
    found = {r.page_id: (r.verdict, r.source) for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, log).collect()}
    assert found == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "rule"), 4: ("allow", "default"), 5: ("block", "rule"), 6: ("block", "alias"), 7: ("block", "rule")}


def test_random_urls_by_rule(spark):
    random.seed(3)
    hosts, paths = ["example.org", "a.example.org", "x.com", "com", "b.org.uk"], ["", "/", "/es/", "/en/1", "/en/12", "/fr/", "/de/x"]
    urls = [(i, f"http{'s' * (i % 2)}://{random.choice(hosts)}{random.choice(paths)}{random.choice(['', '?a', '#b'])}", None) for i in range(200)]
    found = urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string, html string"), urlfilter.RULES).collect()
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict if r.rule else None) == slow_rule(urls[r.page_id][1], urlfilter.RULES)
