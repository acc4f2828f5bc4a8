"""Ranked lexical search: every item against all documents, as a blocked sparse matrix product.

Items times documents is (items x terms) by (terms x documents). The left factor
holds how often an item has a term; the right one holds int64 impacts, the
weight of a term times how much a document is about it. Documents are cut into
blocks of rows of an Arrow batch. Items are cut into blocks too, as many as
their terms need, and each is a pass over the documents: the only data that go to
every worker are one block's terms, at most about ``BLOCK_TERMS`` rows.

A pass makes two jobs. The first reads the texts and writes each document block
as a compressed sparse matrix of the terms that the items have; sums over blocks
give the number of documents, their length and the documents of each term. The
second multiplies: for each item it merges the postings of its terms into one row
of int64 sums (Gustavson's algorithm, in numpy), and keeps the best k. Those are
reduced in each task, then by a salted and a final window, so no window holds
more than a few rows of an item a salt.

What each case gives:

* null text: no terms, like a text of separators; such a document is in no sum and
  never found, such an item finds nothing.
* Texts of any length are read whole.
* Documents with equal scores go by doc_id, nulls last. Rows that share a doc_id
  are documents of their own, each with its rank.
* Items that share an item_id (null is an id too) are one item with the terms of all.
* Empty tables: no rows. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import LOWER, UPPER, checkpoint, for_workers

#: Distinct (item, term) pairs of one block of items.
BLOCK_TERMS = 500_000
#: A term is a run of ASCII letters, digits and anything beyond ASCII, with A to Z lower-cased.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(SEPARATORS + UPPER.encode(), b" " * len(SEPARATORS) + LOWER.encode())
_SALTS = 64


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times: how often an item has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, term, n) for i, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True) for term, n in Counter(terms_of(text)).items()]
            item, term, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array(n, pa.int64())], ["item_id", "term", "times"])

    found = for_workers(items).select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


_BLOCKS = "ids array<long>, lengths binary, bounds binary, terms binary, times binary, seen array<struct<term: int, n: long>>, n_docs long, n_terms long"


def term_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row a block of documents that have terms: their ids and lengths, and the sparse matrix of ``vocabulary``'s terms in them (int64, row bounds, terms, times).

    ``seen`` has how many of the block's documents have each term; n_docs and n_terms are its sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            ids, lengths, bounds, terms, times = [], [], [0], [], []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                if words := terms_of(text):
                    held = Counter(map(get, words))
                    held.pop(None, None)
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.extend(held.keys())
                    times.extend(held.values())
                    bounds.append(len(terms))
            if ids:
                packed = [np.array(x, np.int64).tobytes() for x in (lengths, bounds, terms, times)]
                seen = [{"term": int(t), "n": int(n)} for t, n in zip(*np.unique(np.array(terms, np.int64), return_counts=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed), pa.array([seen], pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))), pa.array([len(ids)], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["ids", "lengths", "bounds", "terms", "times", "seen", "n_docs", "n_terms"])

    return for_workers(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCKS)


def weight(n_docs: int, n_with: int) -> int:
    """How much a term counts that ``n_with`` of ``n_docs`` documents have."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n_with + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How much documents of ``lengths`` are about terms they have so many ``times``: saturating, and less for long documents."""
    # Python's integers: the product of three counts may pass 64 bits
    m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def best(item: np.ndarray, score: np.ndarray, missing: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` of each item, by descending score, then by id."""
    order = np.lexsort((doc, missing, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
    return order[place < k]


def multiply(block: dict, item_bounds: np.ndarray, item_term: np.ndarray, item_times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> list[np.ndarray]:
    """item, score, id missing, id of the best ``k`` documents of one block for each item."""
    unpack = lambda name: np.frombuffer(block[name], np.int64)
    lengths, bounds, terms, times = map(unpack, ("lengths", "bounds", "terms", "times"))
    row = np.repeat(np.arange(len(lengths)), np.diff(bounds))
    impact = weights[terms] * impacts(times, lengths[row], n_docs, n_terms)
    by_term = np.argsort(terms, kind="stable")
    row, impact = row[by_term], impact[by_term]
    post = np.searchsorted(terms[by_term], np.arange(len(weights) + 1))
    ids = np.array([x or 0 for x in block["ids"]], np.int64)
    missing = np.array([x is None for x in block["ids"]])
    found = []
    for i in range(len(item_bounds) - 1):
        own = slice(item_bounds[i], item_bounds[i + 1])
        first, last = post[item_term[own]], post[item_term[own] + 1]
        sizes = last - first
        if not sizes.any():
            continue
        # the postings of all the item's terms, one after another, merged into one row of sums
        places = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        sums = np.zeros(len(lengths), np.int64)
        np.add.at(sums, row[places], impact[places] * np.repeat(item_times[own], sizes))
        at = np.flatnonzero(sums > 0)
        if len(at) > k:
            at = at[sums[at] >= np.partition(sums[at], len(at) - k)[len(at) - k]]
        found.append([np.full(len(at), i), sums[at], missing[at], ids[at]])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


def ranked(rows: DataFrame, k: int, *salt: str) -> DataFrame:
    order = Window.partitionBy("item", *salt).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list, k: int, once: bool) -> DataFrame:
    """item (its place among ``names``), rank, doc_id, score for one block of items; ``rows`` are its (item, term, times)."""
    vocabulary: dict[bytes, int] = {}
    for r in rows:
        vocabulary.setdefault(bytes(r["term"]), len(vocabulary))
    rows = sorted(rows, key=lambda r: r["item"])
    item_term = np.array([vocabulary[bytes(r["term"])] for r in rows], np.int64)
    item_times = np.array([1 if once else r["times"] for r in rows], np.int64)
    item_bounds = np.searchsorted([r["item"] for r in rows], np.arange(rows[-1]["item"] + 2))
    blocks = checkpoint(term_blocks(docs, vocabulary))
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in blocks.select(F.inline("seen")).groupBy("term").agg(F.sum("n")).collect():  # a row a term of this block of items
        weights[term] = weight(n_docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            for block in batch.to_pylist():
                both = [np.concatenate(x) for x in zip(held, multiply(block, item_bounds, item_term, item_times, weights, n_docs, n_terms, k), strict=True)]
                keep = best(*both, k)
                held = [x[keep] for x in both]
        item, score, missing, ids = held
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=missing.astype(bool))], ["item", "score", "doc_id"])

    local = blocks.select("ids", "lengths", "bounds", "terms", "times").mapInArrow(run, "item long, score long, doc_id long")
    return ranked(ranked(local.withColumn("_salt", F.spark_partition_id() % _SALTS), k, "_salt").drop("rank", "_salt"), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest score above 0 for each item.

    With ``once`` a term counts once for an item, else as often as it has it.
    """
    spark = docs.sparkSession
    pairs = checkpoint(item_terms(items))
    n_blocks = max(1, math.ceil(pairs.count() / BLOCK_TERMS))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    found = None
    for b in range(n_blocks):
        rows = pairs.where(F.col("block") == b).collect()
        names = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        if not names:
            continue
        place = {name: n for n, name in enumerate(names)}
        got = search_block(docs, [{"item": place[r["item_id"]], "term": r["term"], "times": r["times"]} for r in rows], k, once)
        ids = spark.createDataFrame([(n, name) for n, name in enumerate(names)], "item long, item_id long")
        got = got.join(ids, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
        got = checkpoint(got) if n_blocks > 1 else got
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
k AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY doc_id, n, term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, k GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term), k GROUP BY item_id, doc_id
),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
