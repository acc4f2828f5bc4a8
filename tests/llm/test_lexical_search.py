"""The blocked product against scores worked out one by one."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import lexical_search as ls


def one_by_one(docs, items, k=10, once=True):
    """(item, rank, doc_id, score), straight from the definition."""
    terms = lambda text: [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(t), len(t)) for i, t in bags if t]
    n_docs, n_terms, asked, out = len(bags), sum(n for *_, n in bags), {}, []
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    for item, bag in asked.items():
        scores = []
        for doc, held, n in bags:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            total = 0
            for t, times in bag.items():
                if t in held:
                    df = sum(t in h for _, h, _ in bags)
                    total += (1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * held[t] // (1000 * held[t] + 8 * m))
            if total > 0:
                scores.append((-total, doc is None, doc or 0))
        out += [(item, r, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("score", "rank", "item", "ids", "terms")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(7) for c in ("doc_id", "term", "block")})
    return sorted([tuple(r) for r in ls.search(d, i, **how).collect()], key=str)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = ["the", "The", "of", "éclair", "Été", "ÉTÉ", "x1", "42", "rare", "中文", "a_b", "don't", *(f"w{k}" for k in range(30))]
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ".", "!", "-", "\n", "\t"]) for _ in range(n))
    docs = [(k, line(rnd.randrange(1, 40))) for k in range(120)]
    docs += [(500, docs[3][1]), (501, docs[3][1]), (501, docs[3][1]), (None, docs[3][1]), (600, None), (601, ""), (602, "--- ..."), (603, line(20_000))]
    items = [(k, line(rnd.randrange(1, 12))) for k in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "the the the rare"), (93, "w1"), (None, "w2 w3"), (94, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"k": 3}, {"once": False}])
def test_scores_one_by_one(spark, texts, how):
    assert got(spark, *texts, **how) == one_by_one(*texts, **how)


def test_many_blocks_of_items(spark, texts, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_TERMS", 40)
    assert got(spark, *texts) == one_by_one(*texts)


def test_equal_texts_go_by_id(spark, texts):
    found = [r[2] for r in sorted((r for r in got(spark, *texts) if r[0] == 94), key=lambda r: r[1])]
    assert [x for x in found if x != 603][:5] == [3, 500, 501, 501, None]  # 603 has every word many times


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty(spark, docs, items):
    assert got(spark, docs, items) == []


def test_counts_beyond_64_bits():
    import numpy as np

    assert ls.impacts(np.array([5]), np.array([10**12]), 10**12, 10**15).tolist() == [5 * 10**9 // (5000 + 8 * (10 + 90 * 10**24 // 10**15))]
