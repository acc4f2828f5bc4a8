"""The tokenization automaton against plain BPE, the tokenizer library and exact round trips."""

import hashlib
import itertools
import random
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.default_path())


def merged_by_rank(word, merges):
    """BPE as it is defined: the best pair, leftmost first, until there is none."""
    tokens = list(word)
    rank = {(u, v): (k, w) for k, (u, v, w) in enumerate(merges)}
    while found := [(*rank[pair], i) for i, pair in enumerate(itertools.pairwise(tokens)) if pair in rank]:
        _, w, i = min(found, key=lambda x: (x[0], x[2]))
        tokens[i : i + 2] = [w]
    return tokens


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_merging_by_rank(seed):
    """Random merges over few letters, equal pairs and merges that never apply among them; every word of up to 7 letters."""
    rnd, labels, merges = random.Random(seed), {97: b"a", 98: b"b", 99: b"c"}, []
    while len(merges) < 14:
        u, v = rnd.choice(list(labels)), rnd.choice(list(labels))
        if labels[u] + labels[v] not in labels.values():
            w = 1000 + len(merges)
            labels[w] = labels[u] + labels[v]
            merges.append((u, v, w))
    automaton = bpe.MergeAutomaton(labels, merges)
    for n in range(8):
        for word in itertools.product(b"abc", repeat=n):
            tokens = automaton.encode(bytes(word))
            assert tokens == merged_by_rank(word, merges)
            state = automaton.START
            for t in tokens:  # the path is there, arc by arc
                assert automaton.has_arc(state, t)
                state = automaton.after[t]


def test_only_one_path_spells_a_word():
    labels = {97: b"a", 98: b"b", 200: b"ab", 201: b"aa", 202: b"aab"}
    automaton = bpe.MergeAutomaton(labels, [(97, 98, 200), (97, 97, 201), (97, 200, 202)])

    def paths(word, state):
        if not word:
            return [[]]
        return [[t, *rest] for t, x in labels.items() if word.startswith(x) and automaton.has_arc(state, t) for rest in paths(word[len(x) :], automaton.after[t])]

    for n in range(9):
        for word in itertools.product(b"ab", repeat=n):
            assert paths(bytes(word), automaton.START) == [automaton.encode(bytes(word))]


def test_two_merges_of_one_token_are_an_error():
    with pytest.raises(ValueError):
        bpe.MergeAutomaton({97: b"a", 1: b"aa", 2: b"aaa"}, [(97, 97, 1), (97, 1, 2), (1, 97, 2)])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="theTHE 's\n\t0’é中\x1c\x85　٣", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|", "a", " ", "\n", "the"]), max_size=8).map("".join)))
def test_texts_equal_the_library(plain, ours, text):
    want = plain.encode(text, add_special_tokens=False).ids
    got = ours.encode(text)
    assert list(np.frombuffer(got, "<u4")) == want
    assert ours.decode(got) == plain.decode(want, skip_special_tokens=False) == text


def test_letters_new_to_unicode_and_long_words(plain, ours):
    for text in ["a࢏1 ՘b\U00010940", "\U000323b0\U000323b1 x", "a" * 20_000, "ab1" * 5_000, "=-" * 6_000, "é" * 9_000, " " * 5_000 + "x", "\n" * 3_000]:
        assert list(np.frombuffer(ours.encode(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids


def test_a_cache_that_turns_over(plain):
    small = bpe.Encoder(bpe.default_path())
    small.CACHE = 5
    for k in range(60):
        text = f"word{k} Other{k}, done'll {k % 7}  twice {k % 7}"
        assert list(np.frombuffer(small.encode(text), "<u4")) == plain.encode(text, add_special_tokens=False).ids


def test_ids_that_are_no_text(plain, ours):
    for ids in ([220, 250], [161], [50256, 161, 50256], []):
        assert ours.decode(array("I", ids).tobytes()) == plain.decode(ids, skip_special_tokens=False)
    with pytest.raises(KeyError):
        ours.decode(array("I", [60_000]).tobytes())


def test_null_empty_repeated_and_clashing(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "same", "z"), (3, "same", "z"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumns({c: F.lit(7) for c in ("decoded", "n_tokens", "batch")})
    coded = bpe.encode_documents(docs)
    assert coded.columns == docs.columns and dict(coded.dtypes)["ids"] == "binary"
    back = bpe.decode_documents(coded, into="decoded").collect()
    assert sorted((r.doc_id or 0, r.decoded, r.n_tokens) for r in back) == [(0, "no id", 7), (1, "", 7), (2, "", 7), (3, "same", 7), (3, "same", 7)]
    assert bpe.token_digests(docs).count() == 5
    assert bpe.token_digests(docs.limit(0)).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode_documents(null).first().text == ""


def test_query_equals_the_library(spark, plain):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_bpe_codec(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
