"""Output quality rules and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.functions import text as tx
from kwloom.operators.common import scalar


def length_reason(keyword: Column | str, min_words: int = 2, max_words: int = 6) -> Column:
    """Why a keyword's length is wrong, else null."""
    size = tx.word_count(keyword)
    shown = size.cast("string")
    return F.when(
        size < min_words, F.concat(F.lit("Too few words: "), shown, F.lit(f" < {min_words}"))
    ).when(size > max_words, F.concat(F.lit("Too many words: "), shown, F.lit(f" > {max_words}")))


def score_reason(min_opportunity: float = 0.0, min_interest: float = 0.0) -> Column:
    """First score threshold a row misses, else null."""
    opp = F.coalesce("opportunity_score", F.lit(0.0))
    interest = F.coalesce("relative_interest", F.lit(0.0))
    return F.when(
        opp < min_opportunity,
        F.concat(F.lit("Low opportunity: "), tx.fixed(opp, 2), F.lit(f" < {min_opportunity}")),
    ).when(
        interest < min_interest,
        F.concat(F.lit("Low relative interest: "), tx.fixed(interest, 2), F.lit(f" < {min_interest}")),
    )


def qa_table(
    items: DataFrame,
    min_cluster_size: int = 3,
    max_words: int = 6,
    min_words: int = 2,
    min_opportunity: float = 0.0,
    min_interest: float = 0.0,
) -> DataFrame:
    """Rows with ``rejected_by`` (length, score, cluster or null) and ``reason``."""
    cluster = F.coalesce("cluster", F.lit("unknown"))
    judged = (
        items.withColumn("cluster", cluster)
        .withColumn("_length", length_reason(F.coalesce("keyword", F.lit("")), min_words, max_words))
        .withColumn("_score", score_reason(min_opportunity, min_interest))
    )
    alive = F.col("_length").isNull() & F.col("_score").isNull()
    sizes = judged.filter(alive).groupBy("cluster").agg(F.count(F.lit(1)).alias("_size"))
    small = F.concat(
        F.lit("Cluster too small: "), F.col("_size").cast("string"), F.lit(f" < {min_cluster_size}")
    )
    stage = (
        F.when(F.col("_length").isNotNull(), "length")
        .when(F.col("_score").isNotNull(), "score")
        .when(F.col("_size") < min_cluster_size, "cluster")
    )
    return judged.join(sizes, "cluster", "left").select(
        *items.columns,
        stage.alias("rejected_by"),
        F.coalesce("_length", "_score", F.when(F.col("_size") < min_cluster_size, small)).alias("reason"),
    )


def qa_keep(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("rejected_by").isNull()).drop("rejected_by", "reason")


def cluster_sizes(items: DataFrame, min_size: int = 3) -> DataFrame:
    """(cluster, keyword_count, kept) of a keyword table."""
    return items.groupBy(F.coalesce("cluster", F.lit("unknown")).alias("cluster")).agg(
        F.count(F.lit(1)).alias("keyword_count"),
        (F.count(F.lit(1)) >= min_size).alias("kept"),
    )


def qa_report(judged: DataFrame) -> DataFrame:
    """One row of counters for a :func:`qa_table`."""

    def rows(stage: str) -> Column:
        return F.count(F.when(F.col("rejected_by") == stage, 1))

    removed = F.count("rejected_by")
    lost = judged.filter(F.col("rejected_by") == "cluster").select("cluster").distinct()
    return judged.agg(
        F.count(F.lit(1)).alias("original_count"),
        (F.count(F.lit(1)) - removed).alias("final_count"),
        removed.alias("removed_count"),
        F.when(F.count(F.lit(1)) > 0, removed / F.count(F.lit(1)))
        .otherwise(F.lit(0.0))
        .alias("removal_rate"),
        rows("length").alias("length_rejected"),
        rows("score").alias("score_rejected"),
        rows("cluster").alias("cluster_rejected"),
    ).withColumn("clusters_removed", scalar(lost, F.count(F.lit(1))))


def qa_text(report: DataFrame, **rules) -> DataFrame:
    """The report row as readable text."""
    bar = "=" * 60
    percent = F.concat(tx.fixed(F.col("removal_rate") * 100, 1), F.lit("%"))

    def shown(name: str) -> Column:
        return F.col(name).cast("string")

    lines = [
        F.lit(f"{bar}\nQA VALIDATION REPORT\n{bar}\n"),
        F.concat(F.lit("Original keywords:  "), shown("original_count")),
        F.concat(F.lit("Final keywords:     "), shown("final_count")),
        F.concat(F.lit("Removed:            "), shown("removed_count"), F.lit(" ("), percent, F.lit(")\n")),
        F.lit("Rejection breakdown:"),
        F.concat(F.lit("  - Length violations: "), shown("length_rejected")),
        F.concat(F.lit("  - Score thresholds:  "), shown("score_rejected")),
        F.concat(
            F.lit("  - Small clusters:    "), shown("cluster_rejected"), F.lit(" ("),
            shown("clusters_removed"), F.lit(" clusters)\n"),
        ),
        F.lit("Validation rules applied:"),
        *[F.lit(f"  - {name}: {value}") for name, value in rules.items()],
        F.lit(f"\n{bar}"),
    ]
    return report.select(F.concat_ws("\n", *lines).alias("report"))
