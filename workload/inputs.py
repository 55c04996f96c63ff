"""Tables the registered queries share, all derived from the given Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwloom.functions import filters
from kwloom.functions import text as tx
from kwloom.operators import assembly, candidates, metrics, universal
from kwloom.operators.common import cut_lineage, scalar
from workload import lexicons as wl

_materialised: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a file too small to split is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages", "conversations") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def materialised(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a shared table once per application and keep it in the checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _materialised:
        _materialised[key] = cut_lineage(build())
    return _materialised[key]


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(keyword, freq, df): n-grams of the corpus found in two or more sentences."""
    docs = table(spark, sf_dir, "documents")
    return candidates.ngram_counts(candidates.clean_sentences(docs)).select(
        F.col("ngram").alias("keyword"), F.col("count").alias("freq"), "df"
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(spark, sf_dir, "keywords", lambda: keyword_table(spark, sf_dir))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.sentence_table(table(spark, sf_dir, "documents"))


def doc_count(spark: SparkSession, sf_dir: str):
    return scalar(table(spark, sf_dir, "documents"), F.count(F.lit(1)))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for stored suggestions: longer keywords under their first two words."""
    kw = keywords(spark, sf_dir).filter(tx.word_count("keyword") > 2)
    lang = F.when(F.length("keyword") % 2 == 0, "en").otherwise("ar")
    return kw.select(
        assembly.probe("keyword").alias("query"), lang.alias("lang"), F.lit("ae").alias("country"),
        F.col("keyword").alias("suggestion"),
    )


def universal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universal.universal_terms(
        table(spark, sf_dir, "documents"), threshold=wl.UNIVERSAL_THRESHOLD,
        defaults=wl.UNIVERSAL_DEFAULTS,
    )


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with the flags and the first-word cluster that scoring needs."""

    def build() -> DataFrame:
        kw = keywords(spark, sf_dir)
        checked = assembly.validate_with_suggestions(kw, suggestions(spark, sf_dir), country="ae")
        return (
            kw.join(checked, "keyword")
            .withColumn("is_question", filters.is_question("keyword", wl.QUESTION_LEADS))
            .withColumn("cluster", F.get(tx.words("keyword"), F.lit(0)))
        )

    return materialised(spark, sf_dir, "flagged", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_candidates(
        flagged(spark, sf_dir),
        goals=wl.GOALS,
        geo="ae",
        niche="contracting",
        competitors=wl.COMPETITORS,
        intent_rules=wl.INTENT_RULES,
        total_docs=doc_count(spark, sf_dir),
        terms=universal_terms(spark, sf_dir),
        metric_options={"triggers": wl.SERP_TRIGGERS, "head_terms": wl.HEAD_TERMS},
        triggers=wl.TRIGGERS,
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full keyword row of every keyword."""
    return materialised(
        spark, sf_dir, "items", lambda: assembly.assemble_items(scored(spark, sf_dir))
    )


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(competitor, keyword): two-word phrases of each document source."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "competitor")
    return candidates.key_phrases(docs, "competitor")


def existing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as published content: keywords are their two-word phrases."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.floor(F.col("n_chars") / 5).cast("int").alias("word_count"),
        "text",
    )
    return candidates.with_phrases(docs).select("ord", "url", "keywords", "word_count")
