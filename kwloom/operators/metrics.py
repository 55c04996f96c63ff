"""Keyword metrics that need the whole table: ranks, ranges, opportunity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwloom import lexicon as lx
from kwloom.functions import classify, scoring
from kwloom.functions import text as tx
from kwloom.operators.common import cut_lineage, scalar
from kwloom.operators.universal import with_universal_penalty


def _rank_table(values: DataFrame) -> DataFrame:
    """(value, fraction): average-tie rank over n for each distinct (value, n).

    Distinct values are dealt out by range and written with their part: part totals are
    accumulated over the few parts, values inside their part, so no task sees the whole
    table however the values are spread.
    """
    dealt = cut_lineage(values.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("n").alias("in_part"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("in_part").over(upto), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("value")
    ranked = dealt.withColumn(
        "below",
        F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    size = scalar(dealt, F.sum("n"))
    rank = F.col("before") + F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.join(offsets, "part").select(
        "value", F.when(size <= 1, F.lit(0.5)).otherwise(rank / size).alias("fraction")
    )


def percentile_rank(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """Average-tie rank divided by the row count; 0.5 for a single row."""
    values = df.groupBy(F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # stored, a short table of distinct values has a known size: it goes to the rows, not they to it
    ranks = cut_lineage(_rank_table(values).withColumnRenamed("fraction", out_col))
    return df.join(ranks, df[value_col] == ranks["value"], "left").drop("value")


def minmax(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """(x - min) / (max - min); the denominator is 1 when all values agree."""
    return df.withColumn(out_col, _spread(df, value_col))


def _spread(source: DataFrame, value_col: str) -> Column:
    """Position of ``value_col`` between the limits it has in ``source``."""
    limits = scalar(source, F.struct(F.min(value_col).alias("lo"), F.max(value_col).alias("hi")))
    span = F.when(limits["hi"] > limits["lo"], limits["hi"] - limits["lo"]).otherwise(F.lit(1.0))
    return (F.col(value_col) - limits["lo"]) / span


def raw_proxies(
    keywords: DataFrame,
    total_docs: Column | None = None,
    total_results: Column | None = None,
    head_terms: Iterable[str] = lx.HEAD_TERMS,
) -> DataFrame:
    """Add ``volume_raw`` and ``difficulty_raw`` (needs freq, is_question, validated)."""
    return keywords.withColumn(
        "volume_raw", scoring.volume_raw("keyword", "freq", "is_question", "validated", total_docs)
    ).withColumn(
        "difficulty_raw",
        scoring.difficulty_raw("keyword", "freq", total_results, total_docs, head_terms),
    )


def keyword_metrics(
    keywords: DataFrame,
    total_docs: Column | None = None,
    total_results_col: str | None = None,
    triggers: tuple = lx.SERP_FEATURE_TRIGGERS,
    head_terms: Iterable[str] = lx.HEAD_TERMS,
) -> DataFrame:
    """Add interest, difficulty, click potential, features and flags.

    Needs keyword, intent, freq, is_question, validated; keep the input materialised
    (:func:`common.cut_lineage`), because ranks and limits read it a second time.
    """
    results = F.col(total_results_col) if total_results_col else None
    raw = raw_proxies(keywords, total_docs, results, head_terms)
    # the limits come from the raw table, not from behind the rank join
    ranked = percentile_rank(raw, "volume_raw", "relative_interest").withColumn(
        "difficulty", _spread(raw, "difficulty_raw")
    )
    estimated = (
        F.lit(True)
        if total_results_col is None
        else scalar(keywords, F.count(total_results_col)) == 0
    )
    return (
        ranked.withColumn("relative_interest", tx.clamp(F.col("relative_interest")))
        .withColumn("difficulty", tx.clamp(F.col("difficulty")))
        .withColumn("serp_features", scoring.serp_features("keyword", "intent", triggers))
        .withColumn("ctr_potential", scoring.ctr_potential("serp_features"))
        .withColumn("estimated", estimated)
        .drop("volume_raw", "difficulty_raw")
    )


def mean_direction(vectors: DataFrame, vector_col: str) -> DataFrame:
    """One row: the mean of the unit vectors, from per-dimension sums."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    unit = tx.let(norm, lambda n: F.transform(v, lambda x: x / n))
    dims = (
        vectors.select(F.posexplode(unit).alias("dim", "x"))
        .groupBy("dim")
        .agg(F.avg("x").alias("x"))
    )
    # one entry per dimension: the width of the embedding bounds this array
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return dims.agg(F.transform(ordered, lambda d: d["x"]).alias("mean"))


def naturalness(
    keywords: DataFrame,
    natural: DataFrame,
    unnatural: DataFrame,
    vector_col: str = "vector",
    out_col: str = "naturalness",
) -> DataFrame:
    """(mean cosine to natural - mean cosine to unnatural + 1) / 2, clamped.

    Mean cosine is linear in the references, so each set shrinks to one mean vector.
    """
    table = keywords.withColumn("_good", mean_direction(natural, vector_col).scalar()).withColumn(
        "_bad", mean_direction(unnatural, vector_col).scalar()
    )
    v = F.col(vector_col).cast("array<double>")

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(v, v))
    gap = dot(v, F.col("_good")) / size - dot(v, F.col("_bad")) / size
    score = tx.clamp((gap + F.lit(1.0)) / F.lit(2.0))
    return table.withColumn(out_col, score).drop("_good", "_bad")


def with_opportunity(
    keywords: DataFrame,
    goals: str = "traffic",
    geo: str = "global",
    niche: str | None = None,
    commercial_weight: float = 0.5,
    terms: DataFrame | None = None,
    naturalness_col: str | None = None,
    unvalidated_penalty: float = 0.9,
    use_ctr: bool = True,
    triggers: Mapping[str, Iterable[str]] = lx.TRIGGERS,
) -> DataFrame:
    """Add ``opportunity_score`` to a table with metrics."""
    table = keywords if terms is None else with_universal_penalty(keywords, terms)
    score = scoring.opportunity(
        F.col("relative_interest"),
        F.col("ctr_potential"),
        F.col("difficulty"),
        F.col("intent"),
        goals,
        commercial=scoring.commercial_value("keyword", "intent", geo, niche, triggers),
        commercial_weight=commercial_weight,
        naturalness=F.col(naturalness_col) if naturalness_col else None,
        penalty=F.col("universal_penalty") if terms is not None else None,
        validated=F.col("validated"),
        unvalidated_penalty=unvalidated_penalty,
        use_ctr=use_ctr,
    )
    return table.withColumn("opportunity_score", score)


def score_candidates(
    keywords: DataFrame,
    goals: str = "traffic",
    geo: str = "global",
    niche: str | None = None,
    commercial_weight: float = 0.25,
    competitors: Iterable[str] = (),
    intent_rules: Mapping[str, Iterable[str]] = lx.INTENT_RULES,
    total_docs: Column | None = None,
    terms: DataFrame | None = None,
    naturalness_col: str | None = None,
    unvalidated_penalty: float = 0.9,
    metric_options: dict | None = None,
    triggers: Mapping[str, Iterable[str]] = lx.TRIGGERS,
) -> DataFrame:
    """Intent, metrics and opportunity in one call (needs freq, is_question, validated)."""
    verdict = classify.intent("keyword", competitors, intent_rules)
    table = keywords.withColumn("_verdict", verdict).select(
        *keywords.columns,
        F.col("_verdict.intent").alias("intent"),
        F.col("_verdict.confidence").alias("intent_confidence"),
    )
    scored = keyword_metrics(table, total_docs, **(metric_options or {}))
    return with_opportunity(
        scored, goals, geo, niche, commercial_weight, terms, naturalness_col,
        unvalidated_penalty, triggers=triggers,
    ).withColumn("funnel_stage", classify.funnel_stage("intent"))
