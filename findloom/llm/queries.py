"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import spread, stored
from . import chat, codes, decontaminate, embeddings, lm, oracle, packing, pieces, pii, quality, sharding, simhash, spelling, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_weighted_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)


def op2_projection_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.turns_as_calls(_table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.TURN_TOOLS)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 2
    return lm.score_documents(docs, held_out)


def op6_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model_file = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(_table(spark, sf_dir, "documents"), model_file, digests=True)


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.pii_spans(docs, pii.train(docs))
    # No base span holds a comma, so kinds can be counted in the joined list.
    counts = [F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(docs["text"]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.fit_and_encode(codes.usable(_table(spark, sf_dir, "embeddings")))
    digest = F.lit(codes.books_digest(books))
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_spelling_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), typo_one_in=199)
    return spelling.spelling_groups(stored(words, "words"))


def queries() -> dict:
    return {
        "op1_weighted_tree_sharding": op1_weighted_tree_sharding,
        "op2_projection_forest_dedup": op2_projection_forest_dedup,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_tool_call_linking": op4_tool_call_linking,
        "op5_deleted_interpolation": op5_deleted_interpolation,
        "op6_distinct_chunk_pieces": op6_distinct_chunk_pieces,
        "op7_skip_chain_pii": op7_skip_chain_pii,
        "op8_path_template_filter": op8_path_template_filter,
        "op9_packing": op9_packing,
        "op10_quality_rules": op10_quality_rules,
        "op11_benchmark_decontamination": op11_benchmark_decontamination,
        "op12_elkan_codes": op12_elkan_codes,
        "op13_spelling_neighbourhoods": op13_spelling_neighbourhoods,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
