import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import line_dedup, simhash
from panelforge.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "cycles"])
def test_components(spark, shape):
    random.seed(2)
    if shape == "chain":
        edges = [(i, i + 1) for i in range(40)]
    elif shape == "star":
        edges = [(0, i) for i in range(1, 300)]
    elif shape == "cycles":
        edges = [(10 * k + i, 10 * k + (i + 1) % 5) for k in range(6) for i in range(5)]
    else:
        edges = [(random.randrange(120), random.randrange(120)) for _ in range(70)]
    rows = [*edges, edges[0], (edges[0][1], edges[0][0]), (3, 3), (None, 1), (1, None)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert found == least_reachable(nodes, [e for e in edges if e[0] != e[1]])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD = ["", None, " \t\n", "One", "one two", "É A b C d", "a\x0bb\x0cc\x1cd e f", "x " * 70_000, "Same same SAME same same"]


def test_fingerprint():
    for text in ODD:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def check_groups(docs, found, distance=4):
    rows = docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance]
    group = least_reachable(range(len(rows)), edges)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[group[i]] = min(r.doc_id, least.get(group[i], r.doc_id))
    want = sorted(((r.doc_id, f"{fps[i]:016x}", least.get(group[i])) for i, r in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found.collect()), key=str) == want


def test_groups_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_groups(docs, simhash.near_duplicates(docs))


def test_groups_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "one two"), (None, "no other has this text"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "first", "component", "part", "value")})
    check_groups(docs, simhash.near_duplicates(docs))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def near_fingerprints():
    """A crowd about one centre, clusters, and strangers, with many pairs at distance 3 to 6."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    out = {0, base}
    for centre in (base, rng.getrandbits(64), 0):
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            out.add(x)
    out |= {rng.getrandbits(64) for _ in range(50)}
    return sorted(out)


@pytest.mark.parametrize(("parts", "distance", "bucket"), [(2, 4, 65536), (3, 4, 65536), (4, 4, 65536), (1, 2, 65536), (2, 3, 65536), (2, 4, 3), (2, 3, 3)])
def test_links_connect_all_within_distance(spark, parts, distance, bucket):
    fps = near_fingerprints()
    values = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    found = [(r.src % 2**64, r.dst % 2**64) for r in simhash.links(values, distance, parts, bucket).collect()]
    assert all(bin(a ^ b).count("1") <= distance for a, b in found)
    edges = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= distance]
    assert least_reachable(fps, found) == least_reachable(fps, edges)


def test_thresholds_are_unequal_and_sum_up():
    rng = np.random.default_rng(1)
    # half of the bits are copies of a few, the rest are independent
    free = rng.random((500, 32)) < 0.5
    bits = np.concatenate([free, np.repeat(rng.random((500, 2)) < 0.5, 16, axis=1)], axis=1).astype(float)
    both = bits.T @ bits
    groups = simhash.group_bits(500, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    # copies of one bit end up together
    assert any(len(set(range(32, 48)) & set(g)) == 16 for g in groups)
    thresholds = simhash.allocate(500, both, groups, 6)
    assert sum(thresholds) == 6 - 4 + 1 and len(set(thresholds)) > 1


def check_lines(docs, found):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.sql(line_dedup.SQL).fetchall()
    got = found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (4, 4), (5, 2)])
def test_lines_on_the_smallest_table(spark, batches, fanout):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_lines(docs, line_dedup.dedup_lines(docs, batches=batches, fanout=fanout))


def test_lines_of_odd_rows(spark):
    long = "A line of at least twenty"
    texts = [None, "", "\n\n", f" {long}\t\nshort", f"{long.upper()}\n{long}", f"x\n{long}\r", "É" * 20, "É" * 20 + " ", "é" * 20, "É" * 19, "É" * 20, f"{long}\n" * 3, "ǅ line of at least twenty\n" + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h1", "k", "last", "_lost", "n_lines", "doc")})
    found = line_dedup.dedup_lines(docs)
    check_lines(docs.select("doc_id", "text"), found)
    assert set(found.columns) == {*docs.columns, "n_dropped"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_rows_without_or_with_equal_ids(spark):
    long = "A line of at least twenty"
    rows = [(None, long), (None, long), (7, long), (9, f"{long}\nmore"), (9, f"{long}\nmore")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in found.collect()) == [(0, "", 1), (0, "", 1), (7, "", 1), (9, f"{long}\nmore", 0), (9, f"{long}\nmore", 0)]
    found = line_dedup.dedup_lines(spark.createDataFrame([(None, long)] * 3, "doc_id long, text string"))
    assert [r.text for r in found.collect()] == [long] * 3


def test_runs_first_seen_wins_across_batches(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen = set()
    for k in range(5):
        own = [(k, f"line {i} of the corpus, long enough") for i in range(k, k + 4)]
        batch = line_dedup.line_hashes(spark.createDataFrame(own, "doc_id long, text string"), "doc_id", "text")
        assert runs.new(batch).count() == len({t for _, t in own} - seen)
        seen |= {t for _, t in own}
        runs.add(batch)
        assert all(len(level) < 2 for level in runs.levels)
    assert runs.lines().count() == len(seen)
    assert runs.lines().agg(F.sum("n_docs")).first()[0] == 20
    runs.remove()
