"""Phrases against counts, cuts and subsumption worked out one by one."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import phrases as ph


def n_grams(docs, longest):
    """lang -> phrase (tuple of words) -> occurrences; words of a language."""
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def one_by_one(docs, top, longest, least, percent):
    counts, total = n_grams(docs, longest)
    out = []
    for lang, held in counts.items():
        often = {p: n for p, n in held.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * n >= percent * a for q, n in often.items())
            if not inside:
                score, k = min((1000 * a * total[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(7)
    words = ["New", "york", "CITY", "of", "the", "à", "É", "x_1", "don't", "中文", "\x1c"]
    fixed = ["new york city of the", "of the à", "by and large", "in the long run"]
    text = lambda n: "".join((rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(words)) + rnd.choice([" ", "  ", "\t", ". ", ", ", "\n", ";", "\r\n", "\x0b"] if rnd.random() < 0.3 else [" "]) for _ in range(n))
    rows = [(text(rnd.randrange(0, 40)), rnd.choice(["en", "fr", None])) for _ in range(150)]
    return [*rows, (None, "en"), ("", "fr"), (" . , ", None), ("a b c d e f " * 4000, "en"), *[("same text here", "de")] * 5, ("und too", "und")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string").withColumns({c: F.lit("7") for c in ("phrase", "n", "size", "rank", "chunk", "a", "k")}).repartition(4)


@pytest.mark.parametrize("how", [dict(top=2000, longest=5, least=5, percent=100), dict(top=7, longest=3, least=3, percent=60), dict(top=50, longest=5, least=300, percent=100), dict(top=50, longest=2, least=1, percent=100)])
def test_one_by_one(spark, docs, how):
    got = sorted(tuple(r) for r in ph.collocations(frame(spark, docs), **how).collect())
    assert got == one_by_one(docs, **how)


def test_a_full_sketch_loses_nothing(spark, docs, monkeypatch):
    """So few cells that all of them are heavy: every n-gram survives, and the exact counts decide."""
    monkeypatch.setattr(ph, "MOST_CELLS", ph.CHUNK)
    monkeypatch.setattr(ph, "cells_of", lambda h, width: [(h % np.uint64(3)).astype(np.int64)] * ph.ROWS)
    how = dict(top=2000, longest=5, least=5, percent=100)
    bits = ph.heavy_cells(frame(spark, docs), ph.CHUNK, 5, 5)
    assert np.unpackbits(bits).sum() == 3 * ph.ROWS
    counts = ph.survivors(frame(spark, docs), bits).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where("n >= 5 or size = 0")
    assert counts.count() == ph.frequent(frame(spark, docs), 5, 5).count()
    assert {tuple(r) for r in ph.scored(counts).collect()} == {tuple(r) for r in ph.scored(ph.frequent(frame(spark, docs), 5, 5)).collect()}
    assert how


def test_sketches_never_count_too_little(spark, docs):
    bits = ph.heavy_cells(frame(spark, docs), ph.CHUNK, 5, 5)
    words, (counts, _) = ph.Words(), n_grams(docs, 5)
    for lang, held in counts.items():
        for phrase, n in held.items():
            if n >= 5:
                _, _, w = words.numbers([" ".join(phrase).encode()])
                h = w[:1] ^ ph.seed_of(lang)
                for x in w[1:]:
                    h = ph.mixed(h * ph._STEP + x)
                for r, c in enumerate(ph.cells_of(h, ph.CHUNK)):
                    assert np.unpackbits(bits[r])[c[0]]


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one", "en")]])
def test_nothing_frequent(spark, rows):
    assert ph.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_products_beyond_64_bits(spark):
    big = 10**13
    counts = spark.createDataFrame([("en", 0, "", 10**15), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)], "lang string, size int, phrase string, n long")
    assert ph.scored(counts).first().score == 1000 * (big - 1) * 10**15 // (big * (big + 7))


def test_a_vocabulary_that_turns_over(spark, docs, monkeypatch):
    monkeypatch.setattr(ph.Words, "MOST", 3)
    words = ph.Words()
    for text in (b"a b c d", b"d e f", b"a. a"):
        spelled, ids, hashes = words.numbers([text])
        assert [ph.xxhash.xxh64_intdigest(w) for w in spelled if w != b"\xff"] == [int(h) for h, i in zip(hashes, ids, strict=True) if i]
