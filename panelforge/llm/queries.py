"""One registered query an operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, chat, decontam, lexical_search, line_dedup, packing, phrases, quality_classifier, quality_rules, sharding, simhash, tokencount, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.length_histogram(tokencount.encoded_lengths(_table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.RULES)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 9) for c in ("class_distance", "word_distance")})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.all_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(chat.export_lines(_table(spark, sf_dir, "conversations")))
    return chats.withColumn("conv_id", F.col("conv_id").cast("long"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing,
        op2_token_counts,
        op3_url_filter,
        op4_quality_classifier,
        op5_external_shuffle,
        op6_line_dedup,
        op7_simhash_groups,
        op8_quality_rules,
        op9_decontamination,
        op10_chat_format,
        op11_phrase_mining,
        op12_lexical_search,
        op13_bpe_codec,
    )
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op3_url_filter": urlfilter.SQL, "op6_line_dedup": line_dedup.SQL, "op8_quality_rules": quality_rules.oracle_sql(), "op9_decontamination": decontam.oracle_sql(), "op10_chat_format": chat.SQL, "op11_phrase_mining": phrases.SQL, "op12_lexical_search": lexical_search.SQL}
