"""Report tables over the keyword table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import classify
from kwloom.functions import text as tx
from kwloom.functions.entities import extract_entities
from kwloom.operators.assembly import rank_order
from kwloom.operators.common import exact_sum, mean, mode_per_group, scalar, top_per_group


def _rows() -> Column:
    return F.count(F.lit(1))


def executive_summary(items: DataFrame, high: float = 0.5) -> DataFrame:
    return items.agg(
        _rows().alias("total_keywords"),
        F.count_distinct("cluster").alias("unique_clusters"),
        tx.fixed(mean("relative_interest"), 2).alias("avg_relative_interest"),
        tx.fixed(mean("difficulty"), 2).alias("avg_difficulty"),
        tx.fixed(mean("opportunity_score"), 2).alias("avg_opportunity"),
        F.count(F.when(F.col("opportunity_score") >= high, 1)).alias("high_priority"),
    )


def intent_distribution(items: DataFrame) -> DataFrame:
    total = scalar(items, _rows())
    counts = items.filter(F.col("intent").isNotNull()).groupBy("intent").agg(_rows().alias("keywords"))
    return counts.select(
        tx.title_case("intent").alias("intent"),
        "keywords",
        F.concat(tx.fixed(F.col("keywords") / total * 100, 1), F.lit("%")).alias("share"),
    ).orderBy(F.desc("keywords"), F.asc("intent"))


def top_clusters(items: DataFrame, n: int = 5) -> DataFrame:
    means = items.groupBy("cluster").agg(mean("opportunity_score").alias("average"))
    return (
        means.orderBy(F.desc(F.round("average", 9)), F.asc("cluster"))
        .limit(n)
        .select("cluster", tx.fixed(F.col("average"), 3).alias("avg_opportunity"))
    )


def site_architecture(items: DataFrame, shown: int = 5) -> DataFrame:
    """Topic, cluster and first keywords with their scores, one row per node."""
    nodes = (
        items.rollup("parent_topic", "cluster")
        .agg(mean("opportunity_score").alias("score"), F.grouping_id().alias("level"))
        .filter("level < 3")
    )
    upper = nodes.select(
        "parent_topic",
        F.coalesce("cluster", F.lit("")).alias("cluster"),
        F.lit(0).alias("position"),
        F.when(F.col("level") == 1, "L1 - Pillar").otherwise("L2 - Cluster").alias("level"),
        F.when(F.col("level") == 1, tx.title_case("parent_topic")).otherwise(F.col("cluster")).alias("name"),
        F.lit("").alias("intent"),
        tx.fixed(F.col("score"), 2).alias("opportunity"),
    )
    leaves = top_per_group(items, ["parent_topic", "cluster"], rank_order(), shown).select(
        "parent_topic",
        "cluster",
        F.col("rank").alias("position"),
        F.lit("L3 - Keyword").alias("level"),
        F.col("keyword").alias("name"),
        "intent",
        tx.fixed(F.col("opportunity_score"), 2).alias("opportunity"),
    )
    return upper.unionByName(leaves)


def cluster_analysis(items: DataFrame) -> DataFrame:
    return (
        items.filter(F.col("cluster").isNotNull())
        .groupBy("cluster")
        .agg(
            F.count("keyword").alias("count"),
            tx.rounded(exact_sum("relative_interest"), 3).alias("total_interest"),
            tx.rounded(mean("relative_interest"), 3).alias("avg_interest"),
            tx.rounded(mean("difficulty"), 3).alias("avg_difficulty"),
            tx.rounded(mean("opportunity_score"), 3).alias("avg_opportunity"),
        )
        .orderBy(F.desc("avg_opportunity"), F.asc("cluster"))
    )


def intent_analysis(items: DataFrame) -> DataFrame:
    return (
        items.filter(F.col("intent").isNotNull())
        .groupBy("intent")
        .agg(
            F.count("keyword").alias("count"),
            tx.rounded(mean("relative_interest"), 3).alias("avg_interest"),
            tx.rounded(mean("difficulty"), 3).alias("avg_difficulty"),
            tx.rounded(mean("opportunity_score"), 3).alias("avg_opportunity"),
        )
        .orderBy(F.desc("count"), F.asc("intent"))
    )


def priority_matrix(
    items: DataFrame, min_opportunity: float = 0.3, max_difficulty: float = 0.7, n: int = 50
) -> DataFrame:
    return (
        items.filter(
            (F.col("opportunity_score") >= min_opportunity) & (F.col("difficulty") <= max_difficulty)
        )
        .orderBy(F.desc("opportunity_score"), F.asc("keyword"))
        .limit(n)
    )


ANSWER_COLUMNS = ("geo_suitability", "info_gain_score", "geo_query_type")


def answer_columns(items: DataFrame) -> DataFrame | None:
    """Keyword, cluster and whichever answer-engine columns exist; None without any."""
    if not any(c in items.columns for c in ANSWER_COLUMNS):
        return None
    return items.select(*[c for c in items.columns if c in ("keyword", "cluster", *ANSWER_COLUMNS)])


def location_analysis(
    items: DataFrame, gazetteer: tuple = lx.GAZETTEER, match: str = "substring"
) -> DataFrame:
    """Per emirate: keywords, local and contracting keywords, mean score."""
    tagged = items.select(
        "keyword",
        "opportunity_score",
        extract_entities("keyword", "ae", gazetteer, match).alias("e"),
    ).filter(F.col("e.emirate").isNotNull())
    return (
        tagged.groupBy(F.col("e.emirate").alias("emirate"))
        .agg(
            F.count("keyword").alias("total_keywords"),
            F.count(F.when(F.col("e.is_local"), 1)).alias("local_keywords"),
            F.count(F.when(F.col("e.is_contracting"), 1)).alias("contracting_keywords"),
            tx.rounded(mean("opportunity_score"), 3).alias("avg_opportunity"),
        )
        .orderBy(F.desc("total_keywords"), F.asc("emirate"))
    )


def recommendations(items: DataFrame, geo: str = "ae", high: float = 0.6) -> DataFrame:
    """Up to four advice rows."""

    def row(position: int, source: DataFrame, priority: str, category: str, text: Column, action: Column):
        return source.select(
            F.lit(position).alias("position"),
            F.lit(priority).alias("priority"),
            F.lit(category).alias("category"),
            text.alias("recommendation"),
            action.alias("action"),
        )

    strong = items.agg(F.count(F.when(F.col("opportunity_score") >= high, 1)).alias("n")).filter("n > 0")
    means = items.groupBy("cluster").agg(mean("opportunity_score").alias("m"))
    best = means.agg(
        F.min_by("cluster", F.struct((-F.round("m", 9)).alias("m"), "cluster")).alias("cluster")
    ).filter("cluster is not null")
    counts = items.filter("intent is not null").groupBy("intent").agg(_rows().alias("n"))
    common = counts.agg(
        F.min_by(F.struct("intent", "n"), F.struct((-F.col("n")).alias("n"), "intent")).alias("t")
    ).filter("t is not null")
    rows = row(
        1, strong, "HIGH", "Quick Wins",
        F.concat(F.lit("Prioritize "), F.col("n").cast("string"),
                 F.lit(f" high-opportunity keywords (score ≥ {high})")),
        F.lit("Create or optimize content for these keywords first"),
    )
    rows = rows.unionByName(row(
        2, best, "HIGH", "Content Strategy",
        F.concat(F.lit("Focus content efforts on '"), "cluster", F.lit("' cluster")),
        F.lit("Develop comprehensive pillar content for this topic"),
    ))
    rows = rows.unionByName(row(
        3, common, "MEDIUM", "Content Format",
        F.concat(F.lit("Most keywords are "), F.col("t.intent"), F.lit(" intent ("),
                 F.col("t.n").cast("string"), F.lit(" keywords)")),
        F.concat(F.lit("Optimize content format for "), F.col("t.intent"), F.lit(" search intent")),
    ))
    if geo.lower() == "ae":
        rows = rows.unionByName(row(
            4, items.agg(_rows().alias("n")), "MEDIUM", "Localization",
            F.lit("Target Abu Dhabi-specific terms"),
            F.lit("Include TAMM, Estidama, and local district names in content"),
        ))
    return rows


def _best_rows(items: DataFrame, n: int) -> DataFrame:
    order = [F.desc("opportunity_score"), F.asc("keyword")]
    return top_per_group(items, ["cluster"], order, n)


def _listed(name: str, low: int, high: int) -> Column:
    """Keywords ranked ``low`` to ``high``, in rank order (at most ``high`` per group)."""
    picked = F.collect_list(
        F.when(F.col("rank").between(low, high), F.struct("rank", F.col("keyword").alias("k")))
    )
    return F.transform(F.array_sort(picked), lambda s: s["k"]).alias(name)


def seo_metadata(items: DataFrame, brand: str = "Brand", location: str = "Abu Dhabi") -> DataFrame:
    """Title, description, heading and schema type per cluster."""
    table = items.withColumn("cluster", F.coalesce("cluster", F.lit("general")))
    top = _best_rows(table, 4)

    def of_first(col: str) -> Column:
        return F.max(F.when(F.col("rank") == 1, F.col(col)))

    heads = top.groupBy("cluster").agg(
        of_first("keyword").alias("primary_keyword"),
        of_first("parent_topic").alias("topic"),
        of_first("intent").alias("intent"),
        _listed("secondary_keywords", 2, 4),
    )
    totals = table.groupBy("cluster").agg(
        _rows().alias("keywords_count"), mean("opportunity_score").alias("avg_opportunity")
    )
    primary = tx.title_case(F.coalesce("primary_keyword", "cluster"))
    topic = tx.title_case(F.coalesce("topic", "cluster"))
    intent = F.coalesce("intent", F.lit("informational"))
    base = F.concat(F.lit("Best "), primary)
    suffix = f" | {brand} {location}"
    room = 60 - len(suffix) - 3
    if room < 0:
        # a negative end counts back from the end of the text
        cut = F.substr(base, F.lit(1), F.greatest(F.length(base) + room, F.lit(0)))
    else:
        cut = F.substring(base, 1, room)
    title = F.when(F.length(base) + len(suffix) <= 60, F.concat(base, F.lit(suffix))).otherwise(
        F.concat(cut, F.lit("..." + suffix))
    )
    named = F.filter("secondary_keywords", lambda k: k != "")
    services = F.when(
        F.size("secondary_keywords") > 0,
        F.concat(
            F.lit(" We offer: "), F.array_join(F.transform(named, tx.title_case), ", "), F.lit(".")
        ),
    ).otherwise(F.lit(""))
    full = F.concat(
        F.lit("Expert "), topic, F.lit(f" services in {location}."), services,
        F.lit(" Contact us for a free quote!"),
    )
    description = F.when(
        F.length(full) > 160, F.concat(F.substring(full, 1, 157), F.lit("..."))
    ).otherwise(full)
    return (
        heads.join(totals, "cluster")
        .select(
            "cluster",
            title.alias("title"),
            description.alias("description"),
            "primary_keyword",
            "secondary_keywords",
            F.coalesce("topic", F.lit("")).alias("parent_topic"),
            intent.alias("intent"),
            classify.schema_type(intent, "cluster").alias("suggested_schema"),
            F.concat(topic, F.lit(" - "), primary).alias("h1_suggestion"),
            "keywords_count",
            "avg_opportunity",
        )
        .orderBy(F.desc(F.round("avg_opportunity", 9)), F.asc("cluster"))
    )


def _brief_parts(items: DataFrame) -> DataFrame:
    """One row per cluster with everything a brief prints."""
    means = items.groupBy("cluster").agg(
        _rows().alias("keywords"),
        mean(F.coalesce("relative_interest", F.lit(0.0))).alias("interest"),
        mean(F.coalesce("difficulty", F.lit(0.0))).alias("difficulty"),
        mean(F.coalesce("ctr_potential", F.lit(1.0))).alias("ctr"),
    )
    known = items.select(
        "cluster",
        "keyword",
        "opportunity_score",
        F.coalesce("intent", F.lit("informational")).alias("intent"),
        F.coalesce("funnel_stage", F.lit("MOFU")).alias("funnel_stage"),
    )
    intents = mode_per_group(known, "cluster", "intent", "primary_intent")
    funnels = mode_per_group(known, "cluster", "funnel_stage", "funnel")
    top = _best_rows(known, 10).groupBy("cluster").agg(_listed("targets", 1, 10))
    asked = known.filter(tx.starts_with_any(F.col("keyword"), lx.QUESTION_WORDS))
    questions = _best_rows(asked, 8).groupBy("cluster").agg(_listed("questions", 1, 8))
    return (
        means.join(intents, "cluster")
        .join(funnels, "cluster")
        .join(top, "cluster")
        .join(questions, "cluster", "left")
        .withColumn("questions", F.coalesce("questions", tx.literal_array([])))
    )


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda k: F.concat(F.lit("- "), k)), "\n")


def _targets_block() -> Column:
    more = F.when(
        F.col("keywords") > 10,
        F.concat(F.lit("- ... and "), (F.col("keywords") - 10).cast("string"), F.lit(" more")),
    ).otherwise(F.lit(""))
    return F.concat(F.lit("## Target Keywords\n"), _bullets(F.col("targets")), F.lit("\n"), more)


def _questions_block() -> Column:
    listed = F.when(F.size("questions") > 0, _bullets(F.col("questions"))).otherwise(
        F.lit("- No question-style keywords detected")
    )
    return F.concat(F.lit("## Questions to Answer\n"), listed)


def _advice_block() -> Column:
    return F.concat(
        F.lit("## Content Recommendations\n- **Funnel Stage:** "), "funnel",
        F.lit("\n- **Word Count:** "), classify.suggested_length("primary_intent"),
        F.lit("\n- **Content Type:** "), classify.suggested_type("primary_intent"),
    )


def _heading(prefix: str) -> Column:
    return F.concat(F.lit(f"# {prefix}: "), tx.title_case(F.replace("cluster", F.lit("-"), F.lit(" "))))


def _h1_block() -> Column:
    return F.concat(F.lit("## Suggested H1\n> "), tx.title_case(F.get("targets", F.lit(0))))


# --- fixed values: checklists printed in briefs ---
BRIEF_CHECKLIST = """## SEO Checklist
- [ ] Include primary keyword in H1
- [ ] Address top questions in subheadings
- [ ] Add internal links to related content
- [ ] Include relevant entities/topics
- [ ] Optimize meta description with key terms
"""
GEO_BRIEF_CHECKLIST = """## SEO Checklist
- [ ] Include primary keyword in H1
- [ ] Address top questions in H2/H3 subheadings
- [ ] Add internal links to related service pages
- [ ] Include relevant UAE entities/topics
- [ ] Optimize meta description with key terms + location
- [ ] Add FAQ schema for featured snippet potential
- [ ] Include business schema with UAE address
"""
CONTRACTING_TERMS = ("Civil Defense approval", "Municipality permit", "NOC", "fit-out")
NO_REGION = "None specified (consider adding location modifiers)"


def content_brief(items: DataFrame) -> DataFrame:
    """(cluster, brief): Markdown brief per cluster."""
    overview = F.concat(
        F.lit("## Overview\n- **Primary Intent:** "), tx.title_case("primary_intent"),
        F.lit("\n- **Keywords:** "), F.col("keywords").cast("string"),
        F.lit("\n- **Avg. Search Volume Score:** "), tx.fixed(F.col("interest"), 2),
        F.lit("\n- **Avg. Difficulty Score:** "), tx.fixed(F.col("difficulty"), 2),
    )
    body = F.concat_ws(
        "\n\n", _heading("Content Brief"), overview, _h1_block(), _targets_block(),
        _questions_block(), _advice_block(), F.lit(BRIEF_CHECKLIST),
    )
    return _brief_parts(items).select("cluster", body.alias("brief"))


def geo_brief(
    items: DataFrame,
    geo: str = "ae",
    niche: str | None = None,
    gazetteer: tuple = lx.GAZETTEER,
    emirates: Iterable[str] = tuple(k for k, _ in lx.EMIRATES),
) -> DataFrame:
    """(cluster, brief): Markdown brief with regions, districts and location variants."""
    tagged = items.select("cluster", extract_entities("keyword", geo, gazetteer).alias("e")).filter(
        "e.is_local"
    )
    # distinct names per cluster, at most one per gazetteer entry
    places = tagged.groupBy("cluster").agg(
        F.array_sort(F.collect_set("e.emirate")).alias("regions"),
        F.array_sort(F.collect_set("e.district")).alias("districts"),
    )
    parts = (
        _brief_parts(items)
        .join(places, "cluster", "left")
        .withColumn("regions", F.coalesce("regions", tx.literal_array([])))
        .withColumn("districts", F.coalesce("districts", tx.literal_array([])))
    )

    def listed(col: Column, otherwise: str) -> Column:
        return F.when(F.size(col) > 0, F.array_join(col, ", ")).otherwise(F.lit(otherwise))

    overview = F.concat(
        F.lit(f"## Market Overview\n- **Target Geo:** {geo.upper()}\n- **Primary Intent:** "),
        tx.title_case("primary_intent"),
        F.lit("\n- **Keywords:** "), F.col("keywords").cast("string"),
        F.lit("\n- **Avg. Search Volume Score:** "), tx.fixed(F.col("interest"), 2),
        F.lit("\n- **Avg. Difficulty Score:** "), tx.fixed(F.col("difficulty"), 2),
        F.lit("\n- **Avg. CTR Potential:** "), tx.fixed(F.col("ctr"), 2),
    )
    variants = F.transform(
        tx.literal_array(list(emirates)[:3]),
        lambda e: F.concat_ws(" ", F.get(F.col("targets"), F.lit(0)), e),
    )
    targeting = F.concat(
        F.lit("## Geographic Targeting\n- **Emirates Covered:** "),
        listed(F.col("regions"), NO_REGION),
        F.lit("\n- **Districts/Areas:** "), listed(F.slice("districts", 1, 5), "N/A"),
        F.lit("\n- **Recommended Location Variants:** "), F.array_join(variants, ", "),
    )
    local_terms = ", ".join(CONTRACTING_TERMS) if niche == "contracting" else "permits, approvals, licenses"
    local = F.concat(
        F.lit("## UAE/Gulf-Specific Requirements\n"
              f"- [ ] Include local regulatory terms ({local_terms})\n"
              "- [ ] Reference specific Emirates ("),
        listed(F.slice("regions", 1, 3), "Dubai, Abu Dhabi"),
        F.lit(")\n- [ ] Add local trust signals (DED license, years in UAE, local portfolio)\n"
              "- [ ] Include UAE-relevant pricing info (AED, VAT considerations)\n"
              "- [ ] Add location-specific schema markup (LocalBusiness, Service)"),
    )
    body = F.concat_ws(
        "\n\n", _heading("GEO Content Brief"), overview, _h1_block(), _targets_block(),
        targeting, _questions_block(), _advice_block(), local, F.lit(GEO_BRIEF_CHECKLIST),
    )
    return parts.select("cluster", body.alias("brief"))


def results_table(items: DataFrame, max_rows: int = 25) -> DataFrame:
    """First rows for display with two-decimal scores, and how many rows remain."""
    total = scalar(items, _rows())
    return (
        items.orderBy(*rank_order())
        .limit(max_rows)
        .select(
            "keyword",
            "cluster",
            "intent",
            "funnel_stage",
            tx.fixed(F.col("relative_interest"), 2).alias("interest"),
            tx.fixed(F.col("difficulty"), 2).alias("difficulty"),
            tx.fixed(F.col("opportunity_score"), 2).alias("opportunity"),
            F.greatest(total - max_rows, F.lit(0)).alias("remaining"),
        )
    )
