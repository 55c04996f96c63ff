"""Documents to token counts: the stages of a training-data pipeline, each written before the next.

Every stage works on all rows that the one before it kept. Its decisions take effect: rows go, or
their text changes; all but the last return the columns of documents. Where SQL cannot express a
stage, tests hold it against a brute-force version.

All stages: an empty table gives an empty one; other columns and any names they have pass
unchanged; texts of any length are worked on whole; no stage fails on nulls in any column.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwloom.llm import bpe, decontaminate, language_id, order_minhash, substring_dedup
from kwloom.llm.base import rest, sent_if_small, stored

#: A language less likely than this is no language the corpus knows.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or like none, go.

    Null, empty and letterless texts are in no language. Repeated rows and null ids are judged
    row by row; of languages equally likely the first counts. Without a labelled row all go.
    """
    model = language_id.fit(docs.where(~language_id.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    said = language_id.told(F.col("text").cast("string"), model, spark)
    columns = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # no name clashes with them
    kept = docs.select(columns.alias("row"), said.alias("said")).where((F.col("said.lang_pred") != "und") & (F.col("said.score") >= LEAST_SCORE))
    return kept.select("row.*")


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id.

    Null, empty and blank texts and rows with a null id are like no other and stay. Repeated rows
    of an id are one document and stay or go together.
    """
    rest(spark)
    gone = sent_if_small(stored(order_minhash.near_duplicates(docs).where("class_id <> doc_id").select("doc_id")))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of an earlier one; those with nothing left go.

    A text that loses nothing stays byte by byte. Null and empty texts, and texts shorter than a
    window, lose nothing and stay. Rows of one id never cut each other; a null id is no earlier
    document. The smallest id that has a passage keeps it.
    """
    rest(spark)
    names = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    cut = substring_dedup.dedup(
        docs.toDF(*names.values()), names["text"], names["doc_id"], carry=[n for c, n in names.items() if c != "doc_id"]
    ).where("n_words = 0 or n_removed < n_words")
    cut = cut.withColumn(names["text"], F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(names["text"])))
    if "n_chars" in names:
        length = F.length(names["text"]).cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, length).otherwise(F.col(names["n_chars"])))
    return cut.select(*(F.col(n).alias(c) for c, n in names.items()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none. All rows of an id go when one holds a passage; rows with a
    null id stay. An empty benchmark takes nothing.
    """
    rest(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = sent_if_small(stored(decontaminate.leaks(docs, benchmark).select("doc_id").distinct()))
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text.

    A null text counts as empty: no token, digests of nothing. Repeated rows and null ids give a
    row each.
    """
    rest(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("near_dedup", near_deduplicated),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenized),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
