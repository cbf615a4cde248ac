"""Driver queries of the training-data operators, each over its whole table with production parameters, and the SQL that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import embedding_dedup, exact_search, jaccard_join, license_scan, mixing, oracles, packing, pii, prefix_trie, quality_classifier, quality_rules, token_binary, url_filters


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The URL rules, as the contract fixes them: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    # counts are of the base spans, each of which begins with its kind
    counts = [F.regexp_count("base_spans", F.lit(f"(^|,){kind}:")).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Target weights in hundredths; all other sources share the rest.
MIX_SHARES = {"src0": 20, "src1": 15, "src2": 12, "src3": 10, "src4": 8}
MIX_OTHER = 35


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), MIX_SHARES, MIX_OTHER)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_seq")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own: a source is a directory, and each language of it one below."""
    docs = _read(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan.scan(files).select("doc_id", "path", "license", "license_via", "license_score")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return token_binary.token_digests(token_binary.write_token_files(docs, tokenizer_path("word_bpe_49k.json")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_read(spark, sf_dir, "documents"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(_read(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_retrieval_packing": op2_retrieval_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mixing": op6_source_mixing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_token_binary": op9_token_binary,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_exact_search": op11_exact_search,
    "op12_prefix_trie": op12_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracles.url_filters(URL_RULES),
    "op5_quality_rules": oracles.quality(),
    "op6_source_mixing": oracles.mixing_sql(MIX_SHARES, MIX_OTHER),
    "op7_embedding_dedup": oracles.EMBEDDINGS,
    "op10_jaccard_join": oracles.JACCARD,
    "op11_exact_search": oracles.EXACT_SEARCH,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
}
