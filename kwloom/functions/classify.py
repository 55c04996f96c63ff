"""Rule classifiers as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx


def _verdict(intent: str, confidence: float) -> Column:
    return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"))


def intent(
    keyword: Column | str,
    competitors: Iterable[str] = (),
    rules: Mapping[str, Iterable[str]] = lx.INTENT_RULES,
    signals: Mapping[str, Iterable[str]] = lx.INTENT_SIGNALS,
) -> Column:
    """Struct (intent, confidence) from ordered rules, signals and brand names."""
    kw = F.lower(tx.as_col(keyword))
    spaced = tx.one_spaced(kw)
    cases = []
    for name, terms in rules.items():
        hit = tx.contains_any(kw, [t for t in terms if " " in t]) | tx.has_word(spaced, terms)
        cases.append((hit, _verdict(name, 1.0)))
    for name, terms in signals.items():
        cases.append((tx.has_word(spaced, terms), _verdict(name, 0.5)))
    brands = [c.strip().split(".")[0].lower() for c in competitors if c.strip()]
    brands = [b for b in brands if b]
    cases.append((tx.contains_any(kw, brands), _verdict("navigational", 0.8)))
    cases.append((F.lit(True), _verdict("informational", 0.1)))
    return tx.first_match(cases)


def funnel_stage(intent_col: Column | str) -> Column:
    name = tx.as_col(intent_col)
    return F.coalesce(*[F.when(name == k, v) for k, v in lx.FUNNEL.items()], F.lit("MOFU"))


def query_type(
    query: Column | str,
    locale: str = "global",
    patterns: Mapping[str, Iterable[str]] = lx.QUERY_TYPE_PATTERNS,
    locale_patterns: Mapping[str, Mapping[str, Iterable[str]]] = lx.QUERY_TYPE_LOCALES,
) -> Column:
    """First query type with a matching pattern, else ``complex_research``."""
    kw = F.lower(tx.as_col(query))
    merged = {k: list(v) for k, v in patterns.items()}
    for name, extra in locale_patterns.get(locale, {}).items():
        merged.setdefault(name, []).extend(extra)
    for name, extra in lx.QUERY_TYPE_FALLBACKS.items():
        merged.setdefault(name, list(extra))
    cases = [(kw.rlike(tx.any_pattern(p)), F.lit(name)) for name, p in merged.items() if p]
    return F.coalesce(tx.first_match(cases), F.lit("complex_research"))


def ai_suitability(query: Column | str) -> Column:
    """How well a query suits an AI answer, 0 to 1."""
    text = tx.as_col(query)
    kw = F.lower(text)

    def bump(cond: Column, amount: float) -> Column:
        return F.when(cond, F.lit(amount)).otherwise(F.lit(0.0))

    score = (
        F.lit(0.5)
        + bump(tx.starts_with_any(kw, lx.QUESTION_WORDS), 0.15)
        + bump(tx.word_count(text) >= 5, 0.1)
        + bump(tx.contains_any(kw, ("vs", "versus", "compare", "difference")), 0.15)
        + bump(tx.contains_any(kw, ("best", "top", "recommended")), 0.1)
        - bump(tx.contains_any(kw, ("near me", "in dubai", "in abu dhabi")), 0.1)
        - bump(tx.contains_any(kw, ("buy", "price", "discount", "book", "hire")), 0.15)
    )
    return tx.clamp(score)


def content_format(keyword: Column | str, formats: tuple = lx.CONTENT_FORMATS) -> Column:
    kw = F.lower(tx.as_col(keyword))
    return tx.first_match((tx.contains_any(kw, p), F.lit(name)) for name, p, _ in formats)


def format_minimum(format_col: Column, default: int, formats: tuple = lx.CONTENT_FORMATS) -> Column:
    return F.coalesce(*[F.when(format_col == n, F.lit(m)) for n, _, m in formats], F.lit(default))


def schema_type(intent_col: Column | str, cluster: Column | str) -> Column:
    name, group = F.lower(tx.as_col(intent_col)), F.lower(tx.as_col(cluster))
    cases = [(tx.contains_any(group, terms), F.lit(t)) for t, terms in lx.SCHEMA_CLUSTER_TERMS]
    cases += [(name == k, F.lit(v)) for k, v in lx.SCHEMA_BY_INTENT.items()]
    return F.coalesce(tx.first_match(cases), F.lit("WebPage"))


def suggested_length(intent_col: Column | str) -> Column:
    name = tx.as_col(intent_col)
    return F.coalesce(
        *[F.when(name == k, v) for k, v in lx.LENGTH_BY_INTENT.items()],
        F.lit("1000-1500 words"),
    )


def suggested_type(intent_col: Column | str) -> Column:
    name = tx.as_col(intent_col)
    return F.coalesce(
        *[F.when(name == k, v) for k, v in lx.TYPE_BY_INTENT.items()],
        F.lit("Blog Post or Article"),
    )


def topic_fallback(keyword: Column | str, stopwords: Iterable[str] = lx.TOPIC_STOPWORDS) -> Column:
    """First telling word, else the first two words, else the keyword."""
    text = tx.as_col(keyword)
    parts = tx.words(F.lower(text))
    telling = F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))
    return (
        F.when(F.size(parts) == 0, text)
        .when(F.size(telling) > 0, F.get(telling, F.lit(0)))
        .otherwise(F.array_join(F.slice(parts, 1, 2), " "))
    )


def parent_topic(topic: Column | str, cluster: Column | str, keyword: Column | str) -> Column:
    """Assigned topic unless vague, then the cluster's name, then the first word."""
    assigned = tx.as_col(topic)
    fallback = F.regexp_replace(F.lower(tx.as_col(cluster)), "^cluster-", "")
    vague = assigned.isNull() | F.lower(assigned).isin(*lx.VAGUE_TOPICS)
    return F.lower(
        F.when(~vague, assigned)
        .when(fallback != "", fallback)
        .otherwise(F.get(tx.words(keyword), F.lit(0)))
    )


def seed_type(
    seed: Column | str,
    service_terms: Iterable[str] = lx.SERVICE_TERMS,
    product_terms: Iterable[str] = lx.PRODUCT_TERMS,
    service_trades: Iterable[str] = lx.SERVICE_TRADES,
    product_goods: Iterable[str] = lx.PRODUCT_GOODS,
) -> Column:
    tokens = tx.words(F.lower(tx.as_col(seed)))
    return F.coalesce(
        tx.first_match(
            [
                (tx.has_token(tokens, service_terms), F.lit("service")),
                (tx.has_token(tokens, product_terms), F.lit("product")),
                (tx.has_token(tokens, service_trades), F.lit("service")),
                (tx.has_token(tokens, product_goods), F.lit("product")),
            ]
        ),
        F.lit("unknown"),
    )
