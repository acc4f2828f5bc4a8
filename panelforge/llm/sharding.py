"""A uniform global shuffle into shards by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by a seeded hash of their
content. Pass two permutes each bucket with a seeded Fisher-Yates shuffle. The
buckets laid end to end are the shuffled corpus; record number p goes to shard
p mod shards, so shard sizes differ by one row at most (law ``rows``) and equal
texts are spread like any others, however many there are.

Only an identifier, sizes and checksums travel in ``shard_plan``;
``write_shards`` carries whole records. A bucket is permuted from sorted rows,
so the order in which a shuffle delivers them, or a lost executor, changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, for_workers

SHARDS = 8
SEED = 20_240_607
#: Bytes of records that one bucket holds, about.
BUCKET_BYTES = 64 << 20
#: Least number of buckets, so that small inputs use every core too.
LEAST_BUCKETS = 48
#: Records with one and the same key that a bucket takes whole.
CROWD = 10_000


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def bucket_count(total_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(LEAST_BUCKETS, -(-int(total_bytes) // bucket_bytes))


def scatter(records: DataFrame, keys: list[str], buckets: int, seed: int = SEED) -> DataFrame:
    """Pass one: ``records`` with _bucket, uniform over the distinct ``keys`` by a seeded hash."""
    return records.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)).cast("int"))


def _permuted(table, seed: int, order: list[str]):
    """Pass two for one bucket: its rows in canonical order, then a Fisher-Yates permutation as _place."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order]))
    place = np.arange(table.num_rows, dtype=np.int64)
    # numpy's shuffle is Fisher-Yates; the bucket is part of the seed
    bucket = table.column("_bucket")[0].as_py() if table.num_rows else 0
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(place)
    return table.append_column("_place", pa.array(place))


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under law ``rows``) of every row.

    Null texts have size 1 and the checksum of no bytes. Null ids and repeated
    rows are rows like any others. An empty table gives an empty one.
    """
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), _size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    placed = _shuffled(slim, ["doc_id", "text_crc32"], ["doc_id", "text_crc32", "size"], bucket_count(total, bucket_bytes), seed)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_position"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _shuffled(records: DataFrame, keys: list[str], order: list[str], buckets: int, seed: int) -> DataFrame:
    """``records`` with _position, their place in the shuffled corpus.

    Records with a key that over ``CROWD`` records share would all meet in one
    bucket. They are dealt by a row number, which is cut from its lineage so
    that it stays the same.
    """
    key = F.xxhash64(F.lit(seed), *keys)
    crowds = records.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select("_key", F.lit(True).alias("_crowd"))
    if crowds.take(1):
        numbered = records.withColumn("_key", key).join(crowds, "_key", "left").withColumn("_row", F.monotonically_increasing_id())
        salted = F.when(F.col("_crowd"), F.xxhash64("_key", "_row")).otherwise(F.col("_key"))
        dealt = checkpoint(for_workers(numbered.withColumn("_bucket", F.pmod(salted, F.lit(buckets)).cast("int")).drop("_key", "_crowd", "_row")))
    else:
        dealt = scatter(for_workers(records), keys, buckets, seed)
    counts = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row a bucket: a bucket holds a fixed share of memory, so this stays small
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", _place long"
    inside = dealt.groupBy("_bucket").applyInArrow(lambda table: _permuted(table, seed, order), schema)
    return inside.join(starts, "_bucket").withColumn("_position", F.col("_start") + F.col("_place"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole records to ``path``/shard=K in shuffled order within each file, with their slot."""
    size = docs.agg(F.sum(_size(F.col(text_col)))).first()[0] or 0
    own = docs.columns
    rows = docs.withColumn("_crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    placed = _shuffled(rows, [id_col, "_crc"], [id_col, "_crc"], bucket_count(size, bucket_bytes), seed)
    out = placed.select(*own, F.pmod(F.col("_position"), F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("_position") / shards).alias("slot"))
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
