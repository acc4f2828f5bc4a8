"""Best-fit packing of documents into fixed-length training sequences.

Lengths are small integers, so best-fit decreasing over the whole corpus needs
only how many pieces there are of each length. One grouped count (at most
``capacity`` rows, whatever the corpus) goes to the driver, which runs best-fit
decreasing over counts: a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and a run of equal pieces that meets a
run of equally filled bins is placed in one step. Each step is a row of a
placement table; an executor finds a piece's sequence and offset from its
length and its rank among the pieces of that length. The result is the one that
piece-by-piece best-fit decreasing gives, not one packing a partition.

Scale: the placement table is bounded by ``capacity`` squared, not by the
corpus. Ranks are dealt in salted buckets, so a length that a third of all
pieces share is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelforge.llm.common import checkpoint, default_tokenizer_path, for_workers, tokenizer

#: Appended to every document.
END_ID = 0
CAPACITY = 2048
#: Pieces of one length that share a rank bucket, about.
BUCKET_ROWS = 100_000


class CapacityTree:
    """A segment tree over remaining capacities 0..size; a leaf counts the open runs of bins with that capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that has an open bin."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.leaves


@dataclass
class Placement:
    """Pieces of ``length`` from rank ``rank`` on go ``per_bin`` at a time into sequences from ``sequence`` on, from offset ``offset`` on."""

    length: int
    rank: int
    sequence: int
    per_bin: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements for ``histogram`` (length -> pieces) and the number of sequences."""
    tree, runs = CapacityTree(capacity), {}
    placed: list[Placement] = []
    opened = 0

    def put(room: int, sequence: int, bins: int) -> None:
        runs.setdefault(room, []).append((sequence, bins))
        tree.add(room, 1)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                sequence, bins = opened, -(-left // (capacity // length))
                opened += bins
            else:
                sequence, bins = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(bins, left // each)
            if full:
                placed.append(Placement(length, rank, sequence, each, capacity - room))
                put(room - each * length, sequence, full)
                rank, left, sequence, bins = rank + full * each, left - full * each, sequence + full, bins - full
            if bins and left and left < each:
                placed.append(Placement(length, rank, sequence, each, capacity - room))
                put(room - left * length, sequence, 1)
                left, sequence, bins = 0, sequence + 1, bins - 1
            if bins:
                put(room, sequence, bins)
    return placed, opened


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the id column, piece, start, length, ids_crc32 and, on request, the ids themselves.

    Null and empty texts are one piece with the end id only. Rows with the same
    id are kept apart. Only the two named columns are read, so extra columns
    with clashing names don't matter.
    """
    source = for_workers(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        encode = tokenizer(path).encode
        end = int(END_ID).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            ids: list = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, crc32(part)))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("int32"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` in 1..capacity) with sequence_id and offset.

    An empty table gives an empty table. Ties (equal lengths) are broken by the
    place in the checkpointed table, so a recomputed task gives the same ranks.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # numbering rows is repeatable only over stored rows
    stored = checkpoint(for_workers(pieces).select(*own)).withColumn("_row", F.monotonically_increasing_id())
    histogram = {int(n): int(c) for n, c in stored.groupBy("length").count().collect()}
    placed, _ = best_fit_decreasing(histogram, capacity)
    buckets = max(64, sum(histogram.values()) // bucket_rows)
    dealt = stored.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = dealt.withColumn("_in", F.row_number().over(inside).cast("long")).join(starts, ["length", "_bucket"])
    ranked = ranked.select(*own, (F.col("_before") + F.col("_in") - 1).alias("_rank"))
    spots = _lookup(placed)
    out = ranked.withColumn("_at", spots("length", "_rank"))
    return out.select(*own, F.col("_at.sequence_id"), F.col("_at.offset"))


def _lookup(placed: list[Placement]):
    """A vectorised lookup from (length, rank) to the sequence and the offset there."""
    rows = sorted((p.length, p.rank, p.sequence, p.per_bin, p.offset) for p in placed)
    table = np.array(rows, dtype=np.int64).reshape(-1, 5).T.copy()

    @pandas_udf("sequence_id long, offset long")
    def spots(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        step = np.int64(1) << 46
        at = np.searchsorted(table[0] * step + table[1], lengths * step + ranks, side="right") - 1
        i = ranks - table[1][at]
        return pd.DataFrame({"sequence_id": table[2][at] + i // table[3][at], "offset": table[4][at] + i % table[3][at] * lengths})

    return spots


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(token_pieces(docs, path or default_tokenizer_path(), capacity, keep_ids), capacity)
