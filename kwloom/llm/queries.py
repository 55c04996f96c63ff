"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwloom.llm import (
    bpe,
    conversation_trie,
    decontaminate,
    html_text,
    language_id,
    license_scan,
    line_dedup,
    order_minhash,
    substring_dedup,
    toxicity,
    url_filter,
    vp_tree,
    whitening,
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.identify(_table(spark, sf_dir, "documents"), PIECES)


def op3_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    return vp_tree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and the links of its text."""
    return order_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, laid out as files of a source and language."""
    files = license_scan.document_paths(_table(spark, sf_dir, "documents"))
    name = F.regexp_extract("path", r"(\d+)(?:\.txt)?$", 1)
    return license_scan.scan(files).select(name.cast("long").alias("doc_id"), "*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that share a passage of the item's size."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to token ids and back, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, as counts and a digest."""
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations."""
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 components of most variance, each at variance one."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more have, as counts and a digest."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_vp_tree": op3_vp_tree,
    "op4_toxicity": op4_toxicity,
    "op5_order_minhash": op5_order_minhash,
    "op6_license_scan": op6_license_scan,
    "op7_decontaminate": op7_decontaminate,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_whitening": op12_whitening,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.duckdb_sql(),
    "op7_decontaminate": decontaminate.duckdb_sql(),
    "op9_substring_dedup": substring_dedup.duckdb_sql(),
    "op11_conversation_trie": conversation_trie.duckdb_sql(),
    "op13_line_dedup": line_dedup.duckdb_sql(),
}
