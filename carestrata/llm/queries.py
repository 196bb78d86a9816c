"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carestrata.llm import (
    automata, chosen_path, cuckoo, fuzzy_lines, merge_replay, merkle, scaled_sketch, source_stripes, string_kernel,
    text_density, tier_packing, token_spans, twins, vptree)
from carestrata.llm.tables import read_table


def op1_vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.remove_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op3_automata_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_scaled_sketch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(read_table(spark, sf_dir, "documents"))


def op6_merge_replay_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encode_digests(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op7_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op8_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("row")


def op10_text_density_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.extract(read_table(spark, sf_dir, "pages"))


def op11_source_divergence_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_stripes.divergences(read_table(spark, sf_dir, "documents"))


def op12_cuckoo_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claimed = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(read_table(spark, sf_dir, "documents"), claimed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_vantage_point_neighbours, op2_fuzzy_line_dedup, op3_automata_substring_dedup, op4_section_token_counts,
        op5_scaled_sketch_fingerprints, op6_merge_replay_bpe, op7_chosen_path_near_duplicates, op8_tier_packing,
        op9_string_kernel_toxicity, op10_text_density_extraction, op11_source_divergence_stripes,
        op12_cuckoo_exact_duplicates, op13_merkle_manifest)
}

#: DuckDB twins, where SQL can express a query on whole tables.
ORACLE: dict[str, str] = {
    "op11_source_divergence_stripes": twins.SOURCE_STRIPES,
    "op12_cuckoo_exact_duplicates": twins.EXACT_DUPLICATES,
    "op13_merkle_manifest": twins.MERKLE_MANIFEST,
}
