"""Phrases that occur together more often than chance: n-gram counts through count-min sketches, cohesion scores, subsumption.

Most n-grams are rare, so they are never counted one by one. The first pass adds
every n-gram's hash to a count-min sketch in each task. Sketches are merged by
adding their cells; a cell never counts too little, so an n-gram all of whose cells
are below the least count can't be frequent. What the second pass gets is one bit a
cell: it reads the texts again and aggregates exactly, by the words themselves,
the n-grams whose cells and whose parts' cells all reach the least count. Nothing
frequent is lost, and the few rare ones that collided with others fall out by their
exact counts.

Then each frequent phrase is scored at its weakest cut, phrases that are only ever
part of one longer phrase go, and each language's best are returned.

Scale: cells are saturated at the least count, so a byte is enough for one up to 255.
Their number follows the corpus up to ``MOST_CELLS``; at that bound a sketch takes
128 MB of a worker and its bits 16 MB. Beyond it estimates get looser, results stay
exact, and the second pass aggregates more (a least count that grows with the
corpus keeps it tight). Both passes run in twice as many tasks as the session has
cores, not one a split: each adds up all it reads, sketch or counts, so what is
merged doesn't grow with the splits. Counts are shuffled by language and phrase.

What each case gives:

* null text: no words, like the empty text; null language: ``und``.
* Texts of any length, repeated rows: read whole, each row counts. doc_id isn't used.
* Ties: score, then count, both descending, then the phrase by its bytes; of equal
  cuts the one after the fewest words.
* Empty tables, and those without a frequent phrase: no rows. Other columns of
  ``docs`` are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import LOWER, UPPER, checkpoint, for_workers

LONGEST, LEAST = 5, 100
ROWS = 2
MOST_CELLS = 1 << 26
CHUNK = 1 << 14
#: Phrases that a task of the second pass adds up before it hands them on.
HELD = 300_000
#: Languages whose totals go to every task; more are joined by a shuffle.
MOST_LANGS = 10_000
_SALTS = 64
#: Bytes of text an n-gram of each size, about; and n-grams a cell, as a share of the least count.
_BYTES, _LOAD = 8, 0.2
_BREAK = b"\xff"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t" + UPPER.encode(), _BREAK * len(_BREAKS) + b" " + LOWER.encode())
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """word -> number, with the hash of each; 0 is the break between pieces."""

    MOST = 1_000_000

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.fresh: list[int] = [0]
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word))
        return n

    def numbers(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of ``texts`` with breaks between pieces and texts, their numbers, their hashes."""
        if len(self) > self.MOST:
            self.clear()
            self.__init__()
        words = _BREAK.join(texts).translate(_TABLE).replace(_BREAK, b" \xff ").split()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self.hashes, self.fresh = np.r_[self.hashes, np.array(self.fresh, np.uint64)], []
        return words, ids, self.hashes[ids]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row of a sketch."""
    mask = np.uint64(width - 1)
    return [((h >> np.uint64(32 * r)) & mask).astype(np.int64) for r in range(ROWS)]


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    found = defaultdict(list)
    for text, lang in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
        found[lang].append(text)
    return found


def _texts(docs: DataFrame) -> DataFrame:
    """text, lang in twice as many tasks as there are cores: each adds up what it reads, whatever the number of splits."""
    texts = for_workers(docs).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return texts.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)


def sketch_width(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> int:
    """Cells of a row, a power of two: so many that a cell gets about a fifth of the least count from rare n-grams."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(CHUNK, 1 << int(size * longest / _BYTES / max(1, least * _LOAD)).bit_length()))


def sketches(docs: DataFrame, width: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """chunk, cells: the sketch of each task, cut into chunks of ``CHUNK`` cells; all-zero chunks are left out."""
    kind = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = np.zeros((ROWS, width), kind), Words()
        for batch in batches:
            hashes = []
            for lang, texts in by_language(batch).items():
                _, ids, word_hash = words.numbers(texts)
                whole, h = ids > 0, word_hash ^ seed_of(lang)
                for n in range(longest):
                    if n:
                        whole, h = whole[:-1] & (ids[n:] > 0), mixed(h[:-1] * _STEP + word_hash[n:])
                    hashes.append(h[whole])
            for row, cells in enumerate(cells_of(np.concatenate(hashes), width) if hashes else []):
                cells, times = np.unique(cells, return_counts=True)
                table[row, cells] = np.minimum(table[row, cells] + times, least)
        chunks = table.reshape(-1, CHUNK)
        for k in np.flatnonzero(chunks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(chunks[k].tobytes(), 1)], pa.binary())], ["chunk", "cells"])

    return _texts(docs).mapInArrow(run, "chunk long, cells binary")


def heavy_cells(docs: DataFrame, width: int, longest: int = LONGEST, least: int = LEAST) -> np.ndarray:
    """One bit a cell of the merged sketches: whether it reaches the least count. ``ROWS`` times ``width`` bits come to the driver."""
    kind = np.min_scalar_type(least)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def reached():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for chunk, cells in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                if chunk != at:
                    if at is not None:
                        yield reached()
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(zlib.decompress(cells), kind)
        if at is not None:
            yield reached()

    # sorted, so that a task holds one chunk's sum and not a group of sketches
    merged = sketches(docs, width, longest, least).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk long, bits binary")
    bits = np.zeros((ROWS * width // CHUNK, CHUNK // 8), np.uint8)
    for chunk, held in merged.collect():
        bits[chunk] = np.frombuffer(held, np.uint8)
    return bits.reshape(ROWS, -1)


def survivors(docs: DataFrame, bits: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """lang, size, phrase, n: exact counts, a task's added up as far as it can hold them, of the n-grams that may be frequent; size 0 has all words."""
    width = bits.shape[1] * 8

    def heavy(h: np.ndarray) -> np.ndarray:
        rows = [bits[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 for r, c in enumerate(cells_of(h, width))]
        return np.logical_and.reduce(rows)

    def batch_of(held: dict[tuple[str, int, bytes], int]) -> pa.RecordBatch:
        langs, sizes, phrases = zip(*held, strict=True) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "size", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = Words(), Counter()
        for batch in batches:
            for lang, texts in by_language(batch).items():
                spelled, ids, word_hash = words.numbers(texts)
                held[lang, 0, b""] += int((ids > 0).sum())
                h, key, alive = word_hash ^ seed_of(lang), ids.copy(), ids > 0
                for n in range(1, longest + 1):
                    if n > 1:  # both parts of one word less may be frequent
                        at = np.flatnonzero(alive[:-1] & alive[1:])
                        h_at, key_at = mixed(h[at] * _STEP + word_hash[at + n - 1]), key[at] * len(words) + ids[at + n - 1]
                    else:
                        at = np.flatnonzero(alive)
                        h_at, key_at = h[at], key[at]
                    kept = heavy(h_at)
                    at, h_at, key_at = at[kept], h_at[kept], key_at[kept]
                    # the key is exact: the number of the phrase less its last word, and that word's number
                    _, first, dense, times = np.unique(key_at, return_index=True, return_inverse=True, return_counts=True)
                    alive = np.zeros(len(ids), bool)
                    alive[at] = True
                    h[at], key[at] = h_at, dense
                    for i, k in zip(at[first].tolist(), times.tolist(), strict=True):
                        held[lang, n, b" ".join(spelled[i : i + n])] += k
            if len(held) > HELD:
                yield batch_of(held)
                held = Counter()
        yield batch_of(held)

    return _texts(docs).mapInArrow(run, "lang string, size int, phrase binary, n long").withColumn("phrase", F.col("phrase").cast("string"))


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, n: all n-grams of up to ``longest`` words with at least ``least`` occurrences, and each language's words in all (size 0)."""
    bits = heavy_cells(docs, sketch_width(docs, longest, least), longest, least)
    counts = survivors(docs, bits, longest).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= least) | (F.col("size") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, n, score, l, r of phrases of two words and more, at the cut with the lowest score."""
    words = F.split("phrase", " ")
    part = lambda name, n: counts.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    total = counts.where("size = 0").select("lang", F.col("n").alias("_total"))
    total = F.broadcast(total) if total.count() <= MOST_LANGS else total
    phrases = counts.where("size > 1").withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = phrases.withColumns({"first": F.array_join(F.slice(words, 1, F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    exact = "(1000 * cast(a as decimal(16)) * cast(_total as decimal(16))) div (cast(l as decimal(16)) * cast(r as decimal(16)))"
    weakest = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "_total")).alias("cut"))
    return weakest.select("lang", "phrase", "size", "a", F.col("cut._total").alias("n"), "cut.score", "cut.l", "cut.r")


def subsumed(counts: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase of those that lie within a longer phrase with at least ``percent`` of their occurrences."""
    words = F.split("phrase", " ")
    longer = counts.where("size > 2").withColumn("_m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_m") + 1)))
    inner = longer.select("lang", F.array_join(F.slice(words, F.col("_at"), F.col("_m")), " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_longer"))
    return counts.where("size > 1").join(inner, ["lang", "phrase"]).where(100 * F.col("_longer") >= percent * F.col("n")).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = 2000, longest: int = LONGEST, least: int = LEAST, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words with at least ``least`` occurrences.

    a, l and r count the phrase and the two parts of its weakest cut, n the
    language's words; score is 1000 a n / (l r), rounded down.
    """
    counts = checkpoint(frequent(docs, longest, least))
    found = scored(counts).join(subsumed(counts, percent), ["lang", "phrase"], "left_anti")
    # first within a share of a language's phrases, so that no task gets more than so many shares' best
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        found = found.withColumn("rank", place).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM i GROUP BY 1, 2, 3),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS (SELECT lang, k, phrase, n, string_split(phrase, ' ') AS ws FROM f WHERE n >= 100),
c AS (SELECT lang, k, phrase, n AS a, ws, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, t.n, cut, CAST((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ') JOIN t ON t.lang = c.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.lang = b.lang AND len(x.phrase) > len(b.phrase) AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.n >= 100 * b.a)),
o AS (SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
