import pytest

import corpus_pipeline
from panelforge.llm import decontam

LONG = "the quiet river bends past seven old mills before it meets the wide grey sea and turns slowly towards the northern harbour where boats wait"
NAMED = "Maria has 12 apples and gives 5 kg of them to Peter, then Maria buys 12 more apples; how many apples does Maria have"
PAIR = "A farmer owns 3 cows and 5 sheep near the river and sells 2 cows at the market every week"


def found(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.all_leaks(docs, benchmark, **more).collect()}


@pytest.mark.parametrize("limit", [500_000, 0])
def test_long_parts_are_leaks(spark, limit):
    words = LONG.split()
    texts = [f"some text first {' '.join(words[:14])} then another end", f"some text first {' '.join(words[3:15])} then another end", LONG]
    assert set(found(spark, texts, [LONG], broadcast_windows=limit)) == {(0, 0), (2, 0)}


def test_all_leaks_keep_the_template_rows(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(decontam.leaks(docs, benchmark)) == rows(decontam.all_leaks(docs, benchmark))


def test_other_case_and_no_marks(spark):
    bare = NAMED.replace(",", "").replace(";", "")
    texts = [NAMED.upper(), NAMED.title(), bare.lower(), f"and so. {bare} and then", "nothing of it in here at all today"]
    assert set(found(spark, texts, [NAMED])) == {(k, 0) for k in range(4)}


def test_one_changed_slot_keeps_the_rest(spark):
    torn = NAMED.replace("buys 12", "buys 13")
    same = PAIR.replace("3 cows", "4 cows").replace("5 sheep", "4 sheep")
    got = found(spark, [torn, same], [NAMED, PAIR])
    assert set(got) == {(0, 0), (1, 1)}
    assert got[1, 1].share == 1.0 and got[1, 1].reparameterised


def test_windows_that_contradict_are_dropped(spark):
    got = found(spark, [NAMED.replace("has 12", "has 13")], [NAMED])
    # the three windows with 13 contradict the five with 12
    assert got[0, 0].n_matched == got[0, 0].n_windows - 3


def test_short_and_literal_free_items(spark):
    items = ["a tiny item", "12 13 14 15 16 17", "1 2 3 4 5 6"]
    texts = ["here is a tiny item among others", "numbers: 12 13 14 15 16 17 end", "21 22 23 24 25 26", "a tiny thing"]
    assert set(found(spark, texts, items)) == {(0, 0), (1, 1)}


def test_stage_judges_rows_without_id(spark, tmp_path):
    spark.createDataFrame([(0, LONG)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"x {LONG}"), (None, "clean text"), (None, None), (1, LONG), (2, "clean text")], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()}
    assert kept == {(None, "clean text"), (None, None), (2, "clean text")}
