"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint

#: Edges that a task writes, about.
EDGES_PER_TASK = 100_000


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, planned so that adaptive execution can split a hot key of ``left``.

    A join right above an aggregation on the same key reuses its partitioning,
    which can't be split. A hash of the key as a second join key makes Spark
    deal both sides anew for the join itself.
    """
    tag = F.xxhash64(key)
    return left.withColumn("_tag", tag).join(right.withColumn("_tag", tag), [key, "_tag"], how).drop("_tag")


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) for every node of ``edges``.

    Nodes may be of any ordered type. Edges with a null end, loops and repeats
    are ignored, so a node with no other edge doesn't appear. A hot node costs
    no task more than its share: minima are pre-aggregated and the joins can be
    split. Each round is checkpointed; it takes a logarithmic number of them.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = skew_join(both, _least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        # every edge of large runs from the greater to the lesser end
        joined = skew_join(large, _least_neighbour(large), "u")
        # few edges need few files
        tasks = min(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), seen[0] // EDGES_PER_TASK + 1)
        ends = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("_m").alias("v")), F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("x"))
        e = checkpoint(ends.select("x.u", "x.v").where("u <> v").distinct().coalesce(tasks))
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
