"""From scored keywords to the ranked, checked output table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import classify
from kwloom.functions import text as tx
from kwloom.operators.common import scalar, top_per_group

PIECE = rf"{tx.WORD}+|{tx.NON_WORD}"

KEYWORD_COLUMNS = (
    "keyword", "cluster", "parent_topic", "intent", "funnel_stage", "relative_interest",
    "difficulty", "ctr_potential", "serp_features", "estimated", "validated",
    "opportunity_score",
)
KEYWORD_SCHEMA = (
    "keyword string, cluster string, parent_topic string, intent string, "
    "funnel_stage string, relative_interest double, difficulty double, "
    "ctr_potential double, serp_features array<string>, estimated boolean, "
    "validated boolean, opportunity_score double"
)


def probe(keyword: Column | str) -> Column:
    """Query under which a keyword's suggestions are stored: its first two words."""
    spaced = tx.one_spaced(keyword)
    two = F.substring_index(spaced, " ", 2)
    return F.when(two != spaced, two).otherwise(tx.as_col(keyword))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _matched_phrases(suggestion: Column, longest: Column, lead: Column | None = None, least: Column | None = None) -> Column:
    """Every string a suggestion validates, up to ``longest`` pieces.

    A keyword matches when it equals the suggestion, opens it before a space, or lies
    between two word boundaries; each is a run of pieces (words or single characters).
    With ``lead`` only the runs whose first piece agrees with that text are opened. With ``least``
    runs of fewer pieces, and those that end in a space, are left out.
    """

    def runs(v: Column) -> Column:
        p, is_word = v["p"], v["is_word"]

        def word_at(i: Column) -> Column:
            return F.coalesce(F.get(is_word, i), F.lit(False))

        def edge(i: Column) -> Column:
            """Word boundary right before piece ``i``."""
            return word_at(i) != word_at(i - 1)

        def opens(i: Column) -> Column:
            return F.startswith(v["lead"], F.get(p, i)) | F.startswith(F.get(p, i), v["lead"])

        def from_start(first: Column) -> Column:
            last = F.least(F.size(p), first + longest.cast("int"))
            begin = first + v["least"]

            def phrase(stop: Column) -> Column:
                whole = (first == 0) & (stop == F.size(p))
                opening = (first == 0) & (F.coalesce(F.get(p, stop), F.lit("")) == " ")
                wanted = whole | opening | (edge(first) & edge(stop))
                if least is not None:
                    wanted = (F.get(p, stop - 1) != " ") & wanted
                return F.when(wanted, F.array_join(F.slice(p, first + 1, stop - first), ""))

            stops = F.when(begin <= last, F.sequence(begin, last)).otherwise(F.array().cast("array<int>"))
            return F.array_compact(F.transform(stops, phrase))

        starts = F.sequence(F.lit(0), F.size(p) - 1)
        if lead is not None:
            starts = F.filter(starts, opens)
        return F.when(F.size(p) > 0, F.flatten(F.transform(starts, from_start)))

    def with_flags(p: Column) -> Column:
        flags = F.transform(p, lambda piece: piece.rlike(tx.WORD))
        return F.struct(
            p.alias("p"), flags.alias("is_word"), (F.lit("") if lead is None else lead).alias("lead"),
            (F.lit(1) if least is None else least).alias("least"),
        )

    return tx.let(tx.let(_pieces(suggestion), with_flags), runs)


def validate_with_suggestions(
    keywords: DataFrame,
    suggestions: DataFrame,
    country: str = "us",
    language: str = "en",
    bilingual: bool = False,
    limit: int | None = None,
    freq_col: str = "freq",
) -> DataFrame:
    """(keyword, validated) from a stored table (query, lang, country, suggestion).

    Suggestions are opened into the phrases they validate, which makes the match a plain
    equi-join on (probe, phrase): a hot probe never meets its suggestions pairwise. A keyword
    is asked under its own first words, so phrases that open otherwise, that are shorter or that
    end in a space go before the shuffle.
    ``limit`` checks only the most frequent keywords, as a rate-limited run would.
    """
    home = country.lower()
    languages = lx.SUGGESTION_LANGUAGES.get(home, ("en",)) if (
        bilingual or home in lx.SUGGESTION_LANGUAGES
    ) else (language,)
    checked = keywords if limit is None else keywords.orderBy(
        F.desc(freq_col), F.asc("keyword")
    ).limit(limit)
    asked = checked.filter(F.col("keyword") != "").select("keyword").withColumn("probe", probe("keyword"))
    low = tx.strip(F.lower("keyword"))
    pieces = F.length(F.regexp_replace(low, rf"{tx.WORD}+", "w"))  # a word is one piece
    longest = scalar(asked, F.max(pieces))
    stored = suggestions.filter((F.col("country") == home) & F.col("lang").isin(*languages)).select(
        F.col("query").alias("probe"), tx.strip(F.lower("suggestion")).alias("suggestion")
    )
    spaced = F.coalesce(tx.one_spaced(F.lower("probe")), F.lit(""))
    opened = stored.distinct().withColumn("longest", longest).withColumn("lead", F.substring_index(spaced, " ", 1))
    least = F.greatest(F.length(F.regexp_replace(spaced, rf"{tx.WORD}+", "w")), F.lit(1))  # pieces of the probe
    phrases = _matched_phrases(F.col("suggestion"), F.col("longest"), F.col("lead"), F.col("least"))
    accepted = (
        opened.withColumn("least", least)
        .select("probe", "lead", F.explode(phrases).alias("phrase"))
        .filter(F.startswith("phrase", "lead"))
        .select("probe", "phrase")
        .distinct()
    )
    hit = accepted.withColumn("validated", F.lit(True))
    # probe and phrase follow from the keyword: repeated keywords meet where the join has dealt them
    return (
        asked.withColumn("phrase", low)
        .join(hit, ["probe", "phrase"], "left")
        .groupBy("probe", "phrase", "keyword")
        .agg(F.count("validated").alias("_hits"))
        .select("keyword", (F.col("_hits") > 0).alias("validated"))
    )


def assemble_items(
    scored: DataFrame, topics: DataFrame | None = None, fallback: Column | None = None
) -> DataFrame:
    """Output rows with defaults filled, text lower-cased and the score clamped.

    ``topics`` is (keyword, topic), matched on the keyword or its lower case; of repeated
    keywords the first topic in order counts. Without them ``fallback`` is the topic.
    """
    table = scored
    if topics is not None:
        topics = topics.groupBy("keyword").agg(F.min("topic").alias("topic"))
        exact = topics.select("keyword", F.col("topic").alias("_exact"))
        lower = topics.select(F.col("keyword").alias("_low"), F.col("topic").alias("_lower"))
        table = (
            table.join(exact, "keyword", "left")
            .join(lower, F.lower("keyword") == F.col("_low"), "left")
            .withColumn("_topic", F.coalesce(F.nullif("_exact", F.lit("")), F.col("_lower")))
        )
    else:
        table = table.withColumn("_topic", F.lit(None).cast("string") if fallback is None else fallback)
    intent = F.coalesce("intent", F.lit("informational"))
    return table.select(
        F.lower("keyword").alias("keyword"),
        F.lower("cluster").alias("cluster"),
        classify.parent_topic("_topic", "cluster", "keyword").alias("parent_topic"),
        intent.alias("intent"),
        classify.funnel_stage(intent).alias("funnel_stage"),
        F.coalesce("relative_interest", F.lit(0.0)).alias("relative_interest"),
        F.coalesce("difficulty", F.lit(0.0)).alias("difficulty"),
        F.coalesce("ctr_potential", F.lit(1.0)).alias("ctr_potential"),
        F.coalesce("serp_features", tx.literal_array([])).alias("serp_features"),
        F.coalesce("estimated", F.lit(True)).alias("estimated"),
        F.coalesce("validated", F.lit(False)).alias("validated"),
        tx.clamp(F.coalesce("opportunity_score", F.lit(0.0))).alias("opportunity_score"),
    )


def rank_order() -> list[Column]:
    return [F.desc("opportunity_score"), F.desc("relative_interest"), F.asc("keyword")]


def top_per_cluster(items: DataFrame, n: int = 12) -> DataFrame:
    """Best ``n`` keywords of each cluster by opportunity, then interest."""
    return top_per_group(items, ["cluster"], rank_order(), n).drop("rank")


def global_ranking(items: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = items.orderBy(*rank_order())
    return ordered if limit is None else ordered.limit(limit)


def quality_gate(items: DataFrame, min_opportunity: float = 0.5, enabled: bool = True) -> DataFrame:
    """Keep validated keywords and unvalidated ones with a high score."""
    if not enabled:
        return items
    return items.filter(F.col("validated") | (F.col("opportunity_score") >= min_opportunity))


def _as_list(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return tx.literal_array([])
    if dict(df.dtypes)[name] == "string":
        parts = F.transform(F.split(name, ","), tx.strip)
        return F.coalesce(F.filter(parts, lambda s: s != ""), tx.literal_array([]))
    return F.coalesce(F.col(name), tx.literal_array([]))


def validate_schema(items: DataFrame) -> DataFrame:
    """Normalise rows and add ``errors``, one "field: message" per broken rule."""
    squeeze = lambda c: F.array_join(tx.words(c), " ")

    def column(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in items.columns else F.lit(default)

    def errors_of(keyword: Column) -> Column:
        # length is checked on the stripped text, before inner spaces are squeezed
        stripped = tx.strip(keyword)
        found = [
            F.when(keyword.isNull(), F.lit("keyword: Field required")),
            F.when(F.length(stripped) < 1, F.lit("keyword: at least 1 character")),
            F.when(F.length(stripped) > 500, F.lit("keyword: at most 500 characters")),
            F.when(~column("intent", "informational").isin(*lx.INTENTS), F.lit("intent: not allowed")),
            F.when(
                ~column("funnel_stage", "TOFU").isin(*lx.FUNNEL_STAGES),
                F.lit("funnel_stage: not allowed"),
            ),
        ]
        for name in ("relative_interest", "difficulty", "ctr_potential", "opportunity_score",
                     "info_gain_score", "geo_suitability"):
            if name in items.columns:
                found.append(
                    F.when(~F.col(name).between(0.0, 1.0), F.lit(f"{name}: must lie in 0..1"))
                )
        return tx.compact(*found)

    fixed = {
        "keyword": F.lower(squeeze("keyword")),
        "cluster": squeeze(column("cluster", "unclustered")),
        "parent_topic": squeeze(column("parent_topic", "")),
        "intent": column("intent", "informational"),
        "funnel_stage": column("funnel_stage", "TOFU"),
        "relative_interest": column("relative_interest", 0.0),
        "difficulty": column("difficulty", 0.5),
        "ctr_potential": column("ctr_potential", 0.5),
        "serp_features": _as_list(items, "serp_features"),
        "estimated": column("estimated", True),
        "validated": column("validated", False),
        "opportunity_score": column("opportunity_score", 0.5),
    }
    if "uae_entities" in items.columns:
        fixed["uae_entities"] = _as_list(items, "uae_entities")
    extra = [c for c in items.columns if c not in fixed]
    return items.select(
        *[c.alias(name) for name, c in fixed.items()], *extra,
        errors_of(F.col("keyword")).alias("errors"),
    )


def require_valid(checked: DataFrame) -> DataFrame:
    """Fail the job on the first row with errors; otherwise pass rows on unchanged."""
    problem = F.array_join("errors", "; ")
    guard = F.when(F.size("errors") > 0, F.raise_error(problem)).otherwise(F.lit(True))
    return checked.filter(F.coalesce(guard.cast("boolean"), F.lit(True)))
