"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("content")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import PASSAGE, without_repeats

    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"), "n_passages")


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("archive")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls, labelled, train

    return judge_urls(table(spark, sf_dir, "pages"), train(labelled(spark))).drop("score")


def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair, written_out

    return repair(table(spark, sf_dir, "conversations")).select("*", F.sha2(written_out(F.col("turns")), 256).alias("repaired_sha256")).drop("turns")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_token_counts": op2_token_counts,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_impact_topk": op4_impact_topk,
    "op5_host_rules": op5_host_rules,
    "op6_pareto_mix": op6_pareto_mix,
    "op7_suffix_runs": op7_suffix_runs,
    "op8_warc_zstd": op8_warc_zstd,
    "op9_url_filter": op9_url_filter,
    "op10_linear_grouping": op10_linear_grouping,
    "op11_token_alignment": op11_token_alignment,
    "op12_language_id": op12_language_id,
    "op13_conversation_repair": op13_conversation_repair,
}
