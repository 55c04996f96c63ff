"""Scores of single keywords as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx


def _universal(freq: Column, total_docs: Column) -> Column:
    return (total_docs > 0) & (freq >= total_docs * 0.8)


def volume_raw(
    keyword: Column | str,
    freq: Column | str,
    is_question: Column | str,
    validated: Column | str,
    total_docs: Column | None = None,
) -> Column:
    count = tx.as_col(freq)
    total = F.lit(0) if total_docs is None else total_docs
    extra = F.greatest(F.lit(0), tx.word_count(keyword) - 2)
    base = (
        (F.lit(1.0) + F.log1p(F.greatest(F.lit(1), count)))
        * F.when(tx.as_col(is_question), 1.2).otherwise(1.0)
        * (F.lit(1.0) + F.lit(0.05) * extra)
        * F.when(tx.as_col(validated), 2.0).otherwise(1.0)
    )
    return F.when(_universal(count, total), F.lit(0.1)).otherwise(base)


def difficulty_raw(
    keyword: Column | str,
    freq: Column | str,
    total_results: Column | None = None,
    total_docs: Column | None = None,
    head_terms: Iterable[str] = lx.HEAD_TERMS,
) -> Column:
    text = tx.as_col(keyword)
    total = F.lit(0) if total_docs is None else total_docs
    results = F.lit(None).cast("long") if total_results is None else total_results
    length = F.when(tx.word_count(text) <= 2, 1.0).otherwise(0.6)
    head = F.when(tx.contains_any(text, head_terms), 1.2).otherwise(1.0)
    return (
        F.when(_universal(tx.as_col(freq), total), F.lit(10.0))
        .when(F.coalesce(results, F.lit(0)) != 0, F.log10(F.greatest(F.lit(10), results)))
        .otherwise(length * head)
    )


def business_relevance(intent: Column | str, goals: str) -> Column:
    name, wish = tx.as_col(intent), goals.lower()
    score = F.lit(None).cast("double")
    if any(g in wish for g in ("sales", "revenue", "lead")):
        score = F.when(name.isin("transactional", "commercial"), 1.0)
    if any(g in wish for g in ("traffic", "brand", "awareness", "exposure")):
        score = F.coalesce(score, F.when(name.isin("informational", "navigational"), 0.8))
    return F.coalesce(score, F.lit(0.6))


def serp_features(
    keyword: Column | str, intent: Column | str, triggers: tuple = lx.SERP_FEATURE_TRIGGERS
) -> Column:
    """Ordered array of the result-page features a keyword is likely to show."""
    name, missing = tx.as_col(intent), F.lit(False)

    def found(kw: Column) -> Column:
        hits = {f: tx.contains_any(kw, terms) for f, terms in triggers}
        return tx.compact(
            *[F.when(cond, F.lit(f)) for f, cond in hits.items()],
            F.when((name == "informational") & ~hits.get("featured_snippet", missing),
                   F.lit("people_also_ask")),
            F.when(name.isin("transactional", "commercial") & ~hits.get("top_ads", missing),
                   F.lit("top_ads")),
            F.when((name == "local") & ~hits.get("local_pack", missing), F.lit("local_pack")),
        )

    # inside the array every test would fold case again
    return tx.let(F.lower(tx.as_col(keyword)), found)


def ctr_potential(
    features: Column | str,
    impact: Mapping[str, float] = lx.SERP_FEATURE_IMPACT,
    default: float = 0.05,
) -> Column:
    table = F.create_map(*[F.lit(v) for pair in impact.items() for v in pair])
    ctr = F.aggregate(
        tx.as_col(features),
        F.lit(1.0),
        lambda acc, f: acc * (F.lit(1.0) - F.coalesce(F.try_element_at(table, f), F.lit(default))),
    )
    return tx.clamp(ctr, 0.2, 1.0)


def commercial_value(
    keyword: Column | str,
    intent: Column | str | None = None,
    geo: str = "global",
    niche: str | None = None,
    triggers: Mapping[str, Iterable[str]] = lx.TRIGGERS,
) -> Column:
    """Price-per-click proxy from intent and trigger words, 0 to 1."""
    kw = F.lower(tx.as_col(keyword))
    tokens = F.array_distinct(tx.words(kw))
    name = F.lit("informational") if intent is None else tx.as_col(intent)

    def hits(group: str) -> Column:
        return F.size(F.array_intersect(tokens, tx.literal_array(triggers[group])))

    def bump(cond: Column, amount: float) -> Column:
        return F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))

    score = F.coalesce(
        *[F.when(name == k, F.lit(v)) for k, v in lx.INTENT_VALUE.items()], F.lit(0.1)
    )
    score = score + bump(tx.contains_any(kw, triggers["transactional"]), 0.3)
    score = score + F.least(F.lit(0.2), hits("commercial") * 0.1)
    score = score + F.least(F.lit(0.15), hits("b2b") * 0.1)
    if geo.lower() in lx.GULF_GEOS:
        score = score + bump(tx.contains_any(kw, triggers["local"]), 0.15)
    if niche and niche.lower() in lx.NICHE_TERMS:
        score = score + bump(tx.contains_any(kw, lx.NICHE_TERMS[niche.lower()]), 0.1)
    return tx.clamp(score)


def universal_penalty(
    universal_tokens: Column, per_term: float = 0.3, max_penalty: float = 0.9
) -> Column:
    """Penalty from the number of distinct universal tokens in a keyword."""
    return F.least(universal_tokens * per_term, F.lit(max_penalty))


def opportunity(
    interest: Column,
    ctr: Column,
    difficulty: Column,
    intent: Column,
    goals: str,
    commercial: Column | None = None,
    commercial_weight: float = 0.5,
    naturalness: Column | None = None,
    penalty: Column | None = None,
    validated: Column | None = None,
    unvalidated_penalty: float = 0.9,
    use_ctr: bool = True,
) -> Column:
    """Opportunity score of a keyword, 0 to 1."""
    base = interest * (ctr if use_ctr else F.lit(1.0))
    base = base * (F.lit(1.0) - difficulty) * business_relevance(intent, goals)
    score = base
    if commercial is not None and any(g in goals.lower() for g in lx.LEAD_GOALS):
        score = base + base * (commercial * commercial_weight)
    if naturalness is not None:
        score = (
            F.when(naturalness < 0.4, score * naturalness)
            .when(naturalness < 0.6, score * (F.lit(0.5) + naturalness))
            .otherwise(score)
        )
    if penalty is not None:
        score = score * (F.lit(1.0) - penalty)
    if validated is not None and unvalidated_penalty > 0:
        score = F.when(validated, score).otherwise(score * (1 - unvalidated_penalty))
    return tx.clamp(score)


def gap_score(opportunity_col: Column, difficulty: Column, missing: Column) -> Column:
    base = opportunity_col * (F.lit(1.0) - difficulty)
    return F.when(missing, base * 1.5).otherwise(base)
