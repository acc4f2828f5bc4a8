"""The near-duplicate stage's search against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import simhash


def five_words(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_groups(rows):
    """doc_id -> least doc_id of its component, by all pairs of rows."""
    rows = [(i, t) for i, t in rows if i is not None]
    bits = [(simhash.wide_fingerprint(simhash.split_words(t)), simhash.fingerprint(t, 5), five_words(t)) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, _) in enumerate(rows):
        for m in range(n):
            a, b = bits[n], bits[m]
            near = (a[0] ^ b[0]).bit_count() <= simhash.CANDIDATE_DISTANCE and (a[1] ^ b[1]).bit_count() <= simhash.FINE_DISTANCE
            if a[2] == b[2] or near and alike(a[2], b[2]):
                x, y = sorted((find(i), find(rows[m][0])))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def family(r, base, n, most):
    """Copies of ``base`` with up to ``most`` words replaced each."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, most)):
            words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("nearest", "bucket", "block"), [(4, 65_536, 512), (1, 65_536, 8), (1, 6, 5)])
def test_against_all_pairs(spark, nearest, bucket, block):
    r = random.Random(11)
    base = lambda k: [f"w{r.randrange(4000)}" for _ in range(k)]
    texts = [t for k, n, most in ((150, 60, 5), (90, 30, 3), (30, 8, 2), (200, 9, 4)) for t in family(r, base(k), n, most)]
    texts += [" ".join(base(r.randint(1, 60))) for _ in range(40)] + [None, "", " \n", "one", "one"] + texts[:4]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    rows += [(None, texts[0]), (None, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "component", "s")})
    want = brute_groups(rows)
    found = {x.doc_id for x in simhash.confirmed_duplicates(docs, nearest=nearest, bucket=bucket, block=block).collect()}
    assert found == {i for i, least in want.items() if i != least} and len(found) > 60


def test_intersections():
    r = np.random.default_rng(4)
    sets = [[np.unique(r.integers(-50, 50, n)) for n in r.integers(0, 60, 7)] for _ in range(2)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
    for width in (1, 7, 8192):
        assert (simhash.intersections(*sets, width=width) == want).all()


def test_one_id_with_two_texts(spark):
    """Both texts of document 7 are one document, so what is like either is in its group."""
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, "else")]
    found = simhash.confirmed_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in found} == {7, 9}


def test_crowds_lose_no_link():
    """Left-out pairs are between members that are all named and hang together."""
    r = np.random.default_rng(2)
    core = r.integers(0, 1 << 63, dtype=np.uint64)
    fp = np.array([core ^ sum(np.uint64(1) << np.uint64(b) for b in r.integers(0, 64, 4)) for _ in range(80)], np.uint64)
    later, earlier, tied, to, out = simhash.bucket_pairs(fp, fp, 6, nearest=2)
    every = {(i, j) for i in range(80) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 6}
    got = set(zip(np.maximum(later, earlier).tolist(), np.minimum(later, earlier).tolist(), strict=True))
    assert got <= every and len(got) < len(every)
    assert {x for p in every - got for x in p} <= set(out.tolist())
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(tied.tolist(), to.tolist(), strict=True):
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in every)
