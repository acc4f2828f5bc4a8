import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import packing, sharding, tokencount
from panelforge.llm.common import WordTokenizer, default_tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with those the operators make."""
    rows = [(1, None), (2, ""), (3, "a b " * 9000), (4, "Same text."), (4, "Same text."), (None, "No id.\nTwo lines"), (5, "É. ß!! x***"), (6, "Same text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit(7) for c in ("length", "piece", "_row", "_bucket", "size", "slot", "n_tokens", "sequence_id")})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abZÉñİΣ'\"<|>.,;!*# \n\t\r1 ́", max_size=40))
def test_cached_tokenizer_equals_the_plain_one(text):
    token = test_cached_tokenizer_equals_the_plain_one.__dict__.setdefault("t", WordTokenizer(default_tokenizer_path()))
    assert list(np.frombuffer(token.encode(text), "<u4")) == token.encoder.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_text_and_a_cache_that_turns_over(plain):
    token = WordTokenizer(default_tokenizer_path())
    token.CACHE = 20
    for text in ["x<|endoftext|>y. <|ENDOFTEXT|>", *(f"word{chr(97 + i)} Other{i}, done." for i in range(40))]:
        assert list(np.frombuffer(token.encode(text), "<u4")) == plain(text)


def best_fit_one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins[bins.index(min(fits))] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_counted_best_fit_is_best_fit_one_by_one(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    placed, opened = packing.best_fit_decreasing(histogram, 30)
    room = {}
    for n, count in histogram.items():
        own = sorted((p for p in placed if p.length == n), key=lambda p: p.rank)
        for rank in range(count):
            p = [x for x in own if x.rank <= rank][-1]
            i = rank - p.rank
            room.setdefault(p.sequence + i // p.per_bin, []).append((p.offset + i % p.per_bin * n, n))
    for spots in room.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= 30
    assert len(room) == opened
    assert sorted(30 - sum(n for _, n in s) for s in room.values()) == best_fit_one_by_one(lengths, 30)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    assert tree.tightest(0) is None
    for c in (3, 7, 7, 10):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (0, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.add(7, -2)
    assert tree.tightest(4) == 10


def check_packing(docs, packed, plain, capacity):
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain(r.text), 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            key = (r.doc_id, k, at, len(part), zlib.crc32(part.tobytes()))
            expected[key] = expected.get(key, 0) + 1
    found = {}
    for r in packed:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        found[key] = found.get(key, 0) + 1
    assert found == expected
    spots = {}
    for r in packed:
        spots.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(spots) == len(best_fit_one_by_one([r.length for r in packed], capacity))


def test_packing_on_the_smallest_table(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(docs, packing.pack_documents(docs).collect(), plain, packing.CAPACITY)


def test_packing_odd_rows(spark, odd_docs, plain):
    check_packing(odd_docs, packing.pack_documents(odd_docs, capacity=64).collect(), plain, 64)
    kept = packing.pack_documents(odd_docs, capacity=64, keep_ids=True).where("doc_id = 4").collect()
    assert [r.ids for r in kept] == [[*plain("Same text."), 0]] * 2


def test_packing_nothing(spark, odd_docs):
    assert packing.pack_documents(odd_docs.limit(0)).count() == 0


def test_length_histogram(spark, odd_docs, plain):
    lengths = tokencount.encoded_lengths(odd_docs)
    every = [len(plain(r.text)) for r in odd_docs.collect()]
    assert sorted(r.n_tokens for r in lengths.collect()) == sorted(every)
    histogram = tokencount.length_histogram(lengths, block=8)
    rows = histogram.collect()
    assert sorted(r.length for r in rows) == sorted(set(every))
    for r in rows:
        longer = [n for n in every if n >= r.length]
        assert (r.n_docs, r.n_tokens) == (every.count(r.length), every.count(r.length) * r.length)
        assert (r.docs_from, r.tokens_from, r.docs_to) == (len(longer), sum(longer), sum(n <= r.length for n in every))
        assert r.truncated_total == sum(min(n, r.length) for n in every)
    limits = tokencount.limit_report(histogram, [0, 3, 64, 10**6]).collect()
    for r in limits:
        assert (r.docs_over, r.tokens_kept) == (sum(n > r.context for n in every), sum(min(n, r.context) for n in every))
        assert r.tokens_kept + r.tokens_lost == sum(every)
    q = tokencount.length_quantiles(histogram, [0.5, 1.0]).first()
    assert q["q1.0"] == max(every) and q["q0.5"] == sorted(every)[(len(every) + 1) // 2 - 1]
    assert tokencount.length_histogram(lengths.limit(0)).count() == 0


def check_shards(docs, plan, shards):
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in plan), key=str) == want
    slots = {s: sorted(r.slot for r in plan if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r.law for r in plan} <= {"rows"} and all(r.grown_shard is None for r in plan)


def test_shards(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = sharding.shard_plan(docs).collect()
    check_shards(docs, plan, sharding.SHARDS)
    # the same whatever the partitions, another one for another seed
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_plan(docs.repartition(7, F.rand(3))).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in plan}
    assert again != {(r.doc_id, r.shard, r.slot) for r in sharding.shard_plan(docs, seed=5).collect()}
    check_shards(odd_docs, sharding.shard_plan(odd_docs, shards=3).collect(), 3)
    assert sharding.shard_plan(odd_docs.limit(0)).count() == 0


def test_shuffle_is_uniform(spark):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = sharding.shard_plan(docs).collect()
    by_id = [r.shard for r in sorted(plan, key=lambda r: r.doc_id)]
    # neighbours are as often in one shard as chance has it
    same = sum(a == b for a, b in zip(by_id, by_id[1:], strict=False))
    assert abs(same - 1000) < 150


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}
    plan = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_plan(docs).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == plan


def test_segment_tree_is_as_good_as_search():
    random.seed(4)
    tree, held = packing.CapacityTree(50), []
    for _ in range(2000):
        if held and random.random() < 0.5:
            c = held.pop(random.randrange(len(held)))
            tree.add(c, -1)
        else:
            held.append(random.randint(0, 50))
            tree.add(held[-1], 1)
        need = random.randint(0, 50)
        assert tree.tightest(need) == min((c for c in held if c >= need), default=None)
