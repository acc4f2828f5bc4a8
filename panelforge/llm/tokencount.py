"""Exact token counts for every context limit from one length histogram.

Documents are counted by encoded length; suffix sums over the histogram then
answer totals, quantiles and truncated totals for any limit without a second
look at the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, default_tokenizer_path, for_workers, tokenizer

#: Lengths whose suffix sums are made in one task.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row. Null and empty texts have no tokens; no special tokens are added."""
    path = path or default_tokenizer_path()

    def run(batches):
        import pyarrow as pa

        encode = tokenizer(path).encode
        for batch in batches:
            counts = [len(encode(text.as_py() or "")) // 4 for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return for_workers(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens", block: int = BLOCK) -> DataFrame:
    """One row a length that occurs, with the sums that answer a context limit of that length.

    n_docs, n_tokens: of exactly this length. docs_from, tokens_from: of this
    length or more (suffix sums). docs_to: of this length or less, over all
    documents the quantile of this length. truncated_total: tokens left if every
    document is cut to this length. Rows with a null length count as length 0;
    an empty table gives no rows.

    Suffix sums run in two levels, blocks of lengths and lengths within a block,
    so no task sees more than ``block`` lengths or one row a block.
    """
    counts = lengths.groupBy(F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))
    # a row a length, read by both levels: cut, or every text would be encoded twice
    counts = checkpoint(counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / block).alias("_block")))
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("n_docs").alias("_docs"), F.sum("n_tokens").alias("_tokens"))
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_docs").over(Window.partitionBy()).alias("_all_docs"),
        F.sum("_tokens").over(Window.partitionBy()).alias("_all_tokens"),
    )
    summed = counts.withColumn("_d", F.sum("n_docs").over(inside)).withColumn("_t", F.sum("n_tokens").over(inside)).join(blocks, "_block")
    docs_from, tokens_from = F.col("_d") + F.col("_docs_above"), F.col("_t") + F.col("_tokens_above")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        (F.col("_all_docs") - docs_from + F.col("n_docs")).alias("docs_to"),
        (F.col("_all_tokens") - tokens_from + F.col("length") * docs_from).alias("truncated_total"),
    )


def limit_report(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, tokens kept when cut to it, tokens lost. A limit is a column of one aggregate, not a join."""
    sums = []
    for x in dict.fromkeys(int(v) for v in limits):
        over = F.col("length") > x
        kept = F.sum(F.when(over, F.col("n_docs") * x).otherwise(F.col("n_tokens")))
        lost = F.sum(F.when(over, F.col("n_tokens") - F.col("n_docs") * x))
        parts = (F.lit(x).cast("long"), F.sum(F.when(over, F.col("n_docs"))), kept, lost)
        names = ("context", "docs_over", "tokens_kept", "tokens_lost")
        sums.append(F.struct(*(F.coalesce(p, F.lit(0)).alias(n) for p, n in zip(parts, names, strict=True))))
    return histogram.agg(F.array(*sums).alias("_all")).select(F.inline("_all"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share the least length that at least that share of documents doesn't exceed."""
    total = F.max("docs_to").over(Window.partitionBy())
    ranked = histogram.select("length", "docs_to", total.alias("_all"))
    cols = [F.min(F.when(F.col("docs_to") >= F.ceil(F.lit(float(s)) * F.col("_all")), F.col("length"))).alias(f"q{s}") for s in shares]
    return ranked.agg(*cols)
