"""The registered queries: one per operator, over whole tables.

Arrays are joined with ``|`` so that results compare as plain values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kwloom.functions import answers, bilingual, classify, filters, scoring
from kwloom.functions import entities as en
from kwloom.functions import text as tx
from kwloom.operators import (
    assembly, candidates, clustering, gaps, information, metrics, places, quality, reports,
    responses, universal,
)
from kwloom.operators.common import cut_lineage, shared_folder
from kwloom.sources import documents, html, ledger, search, sinks, sitemaps
from workload import inputs
from workload import lexicons as wl

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def keep(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return keep


def bar(col: Column | str) -> Column:
    return F.array_join(tx.as_col(col), "|")


def long(col: Column | str) -> Column:
    return tx.as_col(col).cast("long")


def kw_query(name: str, **columns: Callable[[], Column]) -> None:
    """A per-keyword operator over the whole keyword table."""

    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.keywords(spark, sf_dir).select(
            "keyword", *[make().alias(out) for out, make in columns.items()]
        )


def sentence_query(name: str, **columns: Callable[[], Column]) -> None:
    """A per-text operator over every sentence of the corpus."""

    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inputs.sentences(spark, sf_dir).select(
            "doc_id", long("sent_no").alias("sent_no"),
            *[make().alias(out) for out, make in columns.items()],
        )


def item_query(name: str):
    def keep(fn: Callable[[DataFrame], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: fn(inputs.items(spark, sf_dir))
        return fn

    return keep


# --- A: sources and ledgers -------------------------------------------------------------


def _escaped(url: Column) -> Column:
    return F.replace(url, F.lit("&"), F.lit("&amp;"))


@query("a3_sitemap_urls")
def _(spark, sf_dir):
    page = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.col("page_id").cast("string")
    head = '<?xml version="1.0"?>'
    leaf = page.select(
        F.concat(F.lit("leaf-"), number).alias("sitemap_url"),
        F.concat(F.lit(head + "<urlset><url><loc> "), _escaped(F.col("url")),
                 F.lit(" </loc></url></urlset>")).alias("xml"),
    )
    # every index names its leaf and itself, so the walk has to notice the cycle
    index = page.select(
        F.concat(F.lit("index-"), number).alias("sitemap_url"),
        F.concat(
            F.lit(head + "<sitemapindex><sitemap><loc>leaf-"), number,
            F.lit("</loc></sitemap><sitemap><loc>index-"), number,
            F.lit("</loc></sitemap></sitemapindex>"),
        ).alias("xml"),
    )
    return sitemaps.sitemap_urls(leaf.unionByName(index), index.select("sitemap_url"))


def _listed(spark, sf_dir):
    page = inputs.table(spark, sf_dir, "pages")
    place = F.when(F.col("page_id") % 3 == 0, "/sitemap_index.xml").otherwise("/sitemap.xml")
    return page.select(
        F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("domain"),
        place.alias("location"),
        F.col("page_id").alias("pos"),
        "url",
    )


@query("a4_competitor_urls")
def _(spark, sf_dir):
    return documents.competitor_urls(
        _listed(spark, sf_dir), path_filters=("/EN/", "/fr/"), max_pages=3
    )


@query("a5_dedup_by_url")
def _(spark, sf_dir):
    page = inputs.table(spark, sf_dir, "pages")
    base = F.regexp_replace("url", "[?#].*$", "")
    docs = page.select(F.regexp_replace(base, r"\d+.*$", "").alias("url"), F.col("page_id").alias("ord"))
    return documents.dedup_by_url(docs)


@query("a5_add_unseen")
def _(spark, sf_dir):
    page = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    ours = page.filter(F.col("url").contains(".com/"))
    return documents.add_unseen(ours, page)


@query("a6_seed_document")
def _(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("title"), "text")
    return documents.seed_document(rows, "villa design", "owners, , builders", "en", "ae")


def _serp_responses(spark, sf_dir):
    page = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    title = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    total = F.col("page_id") * 10
    one = F.struct(title.alias("title"), F.col("url").alias("link"), F.lit("s").alias("snippet"))
    serp = F.struct(
        F.array(one, one).alias("organic_results"),
        F.struct(total.alias("total_results")).alias("search_information"),
    )
    two = F.struct(title.alias("name"), F.col("url").alias("url"))
    bing = F.struct(
        F.struct(F.array(two, two, two).alias("value"), total.alias("totalEstimatedMatches")).alias("webPages")
    )
    three = F.array(F.struct(title.alias("title"), F.col("url").alias("href"), F.lit("b").alias("body")))
    kind = F.col("page_id") % 3
    return page.select(
        title.alias("query"),
        F.when(kind == 0, "serpapi").when(kind == 1, "bing").otherwise("free").alias("provider"),
        F.when(kind == 0, F.to_json(serp)).when(kind == 1, F.to_json(bing)).otherwise(F.to_json(three)).alias("response"),
    )


@query("a7_serp_results")
def _(spark, sf_dir):
    rows = search.serp_results(_serp_responses(spark, sf_dir), max_results=2)
    return rows.select(
        "query", "provider", long("position").alias("position"), "title", "url", "snippet",
        F.coalesce("total_results", F.lit(-1)).alias("total_results"),
    )


@query("a8_related_questions")
def _(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    text = F.concat(F.when(F.col("turn") % 4 == 0, "  How ").otherwise("x "), F.col("text"))
    serp = F.struct(F.array(F.struct(text.alias("question"))).alias("related_questions"))
    bing = F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("value")).alias("relatedSearches"))
    is_serp = F.col("conv_id") % 2 == 0
    stored = turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query"),
        F.when(is_serp, "serpapi").otherwise("bing").alias("provider"),
        F.when(is_serp, F.to_json(serp)).otherwise(F.to_json(bing)).alias("response"),
    )
    return search.related_questions(stored).select("query", long("position").alias("position"), "question")


@query("a9_suggestions")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    texts = F.array(F.col("query"), F.lit("  "), F.concat(F.lit(" "), F.col("keyword"), F.lit("  ")))
    stored = kw.select("keyword", assembly.probe("keyword").alias("query")).select(
        "query", F.lit("en").alias("lang"), F.lit("ae").alias("country"),
        F.concat(
            F.lit("["), F.to_json(F.struct(F.col("query"))), F.lit(","), F.to_json(texts), F.lit("]")
        ).alias("response"),
    )
    return search.suggestions(stored).select("query", long("position").alias("position"), "suggestion")


@query("a9_suggestion_languages")
def _(spark, sf_dir):
    nations = inputs.table(spark, sf_dir, "nation").select(F.substring("n_name", 1, 2).alias("country"))
    return search.suggestion_languages(nations).select("country", bar("languages").alias("languages"))


def _stage_entries(spark, sf_dir):
    return inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("stage_name"),
        "ts",
        F.col("event_id").alias("item_count"),
    )


@query("a13_stage_latest")
def _(spark, sf_dir):
    latest = ledger.stage_latest(_stage_entries(spark, sf_dir))
    return latest.select("run_id", "stage_name", "ts", "item_count")


@query("a13_completed_stages")
def _(spark, sf_dir):
    done = ledger.completed_stages(ledger.stage_latest(_stage_entries(spark, sf_dir)))
    return done.select("run_id", bar("stages").alias("stages"), "last_stage")


def _runs(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("run_id")).agg(
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.when(F.max_by("event_type", "ts") == "purchase", "completed").otherwise("running").alias("status"),
    )


@query("a14_run_retention")
def _(spark, sf_dir):
    gone = ledger.runs_to_delete(_runs(spark, sf_dir), keep_last=10)
    return gone.select("run_id", "status", "updated_at")


def _written(spark, suffix: str) -> str:
    return f"{shared_folder(spark)}/kwloom-{uuid.uuid4().hex}{suffix}"


def _clustered_keywords(spark, sf_dir):
    return inputs.keywords(spark, sf_dir).select("keyword", F.split_part("keyword", F.lit(" "), F.lit(1)).alias("cluster"))


@query("a2_scan_url_list")
def _(spark, sf_dir):
    path = _written(spark, "")
    inputs.table(spark, sf_dir, "pages").select("url").write.text(path)
    return documents.scan_url_list(spark, path)


@query("a10_read_keyword_json")
def _(spark, sf_dir):
    path = _written(spark, ".json")
    _clustered_keywords(spark, sf_dir).withColumn("cluster", F.left("keyword", F.lit(1))).write.json(path)
    return documents.read_keyword_json(spark, path, "T").select("keyword", "cluster")


@query("a11_write_keywords")
def _(spark, sf_dir):
    path = _written(spark, ".json")
    sinks.write_keywords(_clustered_keywords(spark, sf_dir), path)
    return documents.read_keyword_json(spark, path).select("keyword", "cluster")


@query("a12_write_run")
def _(spark, sf_dir):
    path = _written(spark, "")
    sinks.write_run(_clustered_keywords(spark, sf_dir), path, "20260101000000")
    return spark.read.parquet(path).where("run_id = '20260101000000'").select("keyword", "cluster")


# --- B: web pages ---------------------------------------------------------------------------


def _parsed(spark, sf_dir):
    return html.parse_pages(inputs.table(spark, sf_dir, "pages"))


@query("b1_visible_text")
def _(spark, sf_dir):
    return html.visible_text(_parsed(spark, sf_dir))


@query("b2_page_title")
def _(spark, sf_dir):
    return html.page_title(_parsed(spark, sf_dir))


@query("b3_link_density")
def _(spark, sf_dir):
    return html.link_density(_parsed(spark, sf_dir))


@query("b4_content_blocks")
def _(spark, sf_dir):
    return html.content_blocks(_parsed(spark, sf_dir))


@query("b5_weighted_text")
def _(spark, sf_dir):
    return html.weighted_text(_parsed(spark, sf_dir))


@query("b6_weighted_terms")
def _(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    weight = F.when(F.col("lang") == "en", 2.0).when(F.col("lang") == "fr", 1.5).otherwise(1.0)
    return html.weighted_terms(docs.select("text", weight.alias("weight")))


# --- C: text and candidates ---------------------------------------------------------------------


@query("c1_clean_text")
def _(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", tx.clean_text("text").alias("clean"), tx.clean_text("text", True).alias("no_digits")
    )


@query("c2_tokenize")
def _(spark, sf_dir):
    tokens = tx.tokenize(tx.clean_text("text"), candidates.lx.ENGLISH_STOPWORDS)
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tokens, " ").alias("tokens"), long(F.size(tokens)).alias("n_tokens")
    )


@query("c3_sentences")
def _(spark, sf_dir):
    return inputs.sentences(spark, sf_dir).select("doc_id", long("sent_no").alias("sent_no"), "sentence")


@query("c4_protect_phrases")
def _(spark, sf_dir):
    rows = inputs.sentences(spark, sf_dir)
    return candidates.protect_table(rows, wl.PROTECTED).select(
        "doc_id", long("sent_no").alias("sent_no"), "protected", "restored"
    )


@query("c5_ngram_counts")
def _(spark, sf_dir):
    return inputs.keyword_table(spark, sf_dir)


@query("c6_tfidf_top_terms")
def _(spark, sf_dir):
    best = candidates.tfidf_top_terms(inputs.table(spark, sf_dir, "documents"))
    return best.select("doc_id", "term", F.round("weight", 9).alias("weight"), long("rank").alias("rank"))


def _extracted(spark, sf_dir, stem: bool):
    return candidates.extract_candidates(
        inputs.table(spark, sf_dir, "documents"), stem=stem,
        filter_options={
            "scraping_artifact": wl.ARTIFACT,
            "grammar_invalid": {"invalid_starts": wl.INVALID_STARTS},
            "entity_conflict": wl.CONFLICT,
            "negative_sentiment": {"terms": wl.NEGATIVE},
            "stop_phrase": wl.STOP_PHRASE,
        },
    )


@query("c7_extract_candidates")
def _(spark, sf_dir):
    return _extracted(spark, sf_dir, False).select("keyword", long("ord.origin").alias("origin"))


@query("c7_extract_candidates_stemmed")
def _(spark, sf_dir):
    return _extracted(spark, sf_dir, True).select("keyword")


@query("c8_merge_candidates")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    nouns = inputs.table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword"), F.col("p_partkey").alias("ord"))
    lines = responses.parse_expansion(
        inputs.table(spark, sf_dir, "conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("batch_id"), F.col("text").alias("response"))
    ).select("keyword", F.col("batch_id").alias("ord"))
    merged = candidates.merge_candidates(kw.select("keyword", F.col("freq").alias("ord")), nouns, lines)
    return merged.select("keyword", long("origin").alias("origin"), "ord")


@query("c9_keyword_freq")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir).select("keyword")
    return candidates.keyword_freq(kw, inputs.table(spark, sf_dir, "documents"))


kw_query("c10_is_question", is_question=lambda: filters.is_question("keyword", wl.QUESTION_LEADS))
kw_query(
    "c11_seed_type",
    seed_type=lambda: classify.seed_type("keyword", wl.SERVICE, wl.PRODUCT, wl.TRADES, wl.GOODS),
)


def _seeds(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("seed"), F.col("p_type").alias("audience")
    )


@query("c12_seed_expansions")
def _(spark, sf_dir):
    out = candidates.seed_expansions(
        _seeds(spark, sf_dir), "seed", "audience", service_terms=("ring", "bolt"),
        product_terms=("widget",), service_trades=("red",), product_goods=("small",),
    )
    return out.select("p_partkey", "seed_type", long("position").alias("position"), "keyword")


@query("c13_reference_phrases")
def _(spark, sf_dir):
    return candidates.reference_phrases(_seeds(spark, sf_dir)).select(
        "p_partkey", long("position").alias("position"), "phrase"
    )


# --- D: filters ------------------------------------------------------------------------------------

kw_query("d1_scraping_artifact", dropped=lambda: filters.scraping_artifact("keyword", **wl.ARTIFACT))
kw_query("d2_stop_phrase", dropped=lambda: filters.stop_phrase("keyword", **wl.STOP_PHRASE))
sentence_query(
    "d3_numeric_noise",
    dropped=lambda: filters.numeric_noise("sentence"),
    number=lambda: filters.numeric_noise(F.regexp_replace("sentence", r"\p{L}+", "7")),
)
kw_query("d4_negative_sentiment", dropped=lambda: filters.negative_sentiment("keyword", wl.NEGATIVE))
kw_query("d5_grammar_invalid", dropped=lambda: filters.grammar_invalid("keyword", wl.INVALID_STARTS))


@query("d5_grammar_tagged")
def _(spark, sf_dir):
    """Tags as a table: by the length of each word of the corpus's keywords."""
    kw = inputs.keywords(spark, sf_dir).select("keyword")
    words = kw.select("keyword", F.posexplode(tx.words("keyword")).alias("position", "token"))
    size = F.length("token")
    tags = words.where("position < 3").select(
        "keyword", "position", "token",
        F.when(size > 8, "NOUN").when(size > 6, "ADJ").when(size == 4, "X").when(size < 3, "SCONJ").otherwise("PROPN").alias("pos"),
        F.when(size == 5, "DT").when(size == 6, "NNS").otherwise("FW").alias("tag"),
    )
    checked = candidates.grammar_checked(kw, tags, invalid_starts=wl.INVALID_STARTS, most_nouns=2)
    return checked.select("keyword", F.col("grammar_invalid").alias("dropped"))


kw_query("d6_entity_conflict", dropped=lambda: filters.entity_conflict("keyword", **wl.CONFLICT))
kw_query("d7_near_me_valid", valid=lambda: filters.near_me_valid("keyword", wl.MOVED_PHRASE))
kw_query(
    "d8_near_me_fix",
    fixed=lambda: F.coalesce(filters.near_me_fix("keyword", wl.MOVED_PHRASE), F.lit("<dropped>")),
)
kw_query("d9_phrase_invalid", dropped=lambda: filters.phrase_invalid("keyword", **wl.PHRASE))


@query("d10_universal_terms")
def _(spark, sf_dir):
    return inputs.universal_terms(spark, sf_dir)


@query("d11_entirely_universal")
def _(spark, sf_dir):
    counts = universal.universal_token_counts(
        inputs.keywords(spark, sf_dir), inputs.universal_terms(spark, sf_dir)
    )
    return counts.select("keyword", (F.col("tokens") == F.col("universal")).alias("dropped"))


@query("d12_stem_dedup")
def _(spark, sf_dir):
    return candidates.stem_dedup(inputs.keywords(spark, sf_dir), order_col="keyword")


@query("d12_stem_dedup_sorted_words")
def _(spark, sf_dir):
    """The same grouping under a key SQL can write: the keyword's words in order."""
    kw = inputs.keywords(spark, sf_dir)
    key = F.array_join(F.sort_array(tx.words("keyword")), " ")
    return candidates.stem_dedup(
        kw.withColumn("score", (F.col("freq") % 3).cast("double")), "score", "keyword", key
    ).select("keyword", "freq")


kw_query(
    "d13_basic_filter",
    kept=lambda: filters.basic_filter("keyword", wl.BLACKLIST, 2, 3, 8, **wl.PHRASE),
)

# --- E: classifiers ------------------------------------------------------------------------------------


def _intent() -> Column:
    return classify.intent("keyword", wl.COMPETITORS, wl.INTENT_RULES, wl.INTENT_SIGNALS)


@query("e1_intent")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    return kw.withColumn("i", _intent()).select("keyword", "i.intent", "i.confidence")


item_query("e2_funnel_stage")(
    lambda t: t.select("keyword", classify.funnel_stage("intent").alias("funnel_stage"))
)
sentence_query(
    "e3_query_type",
    query_type=lambda: classify.query_type("sentence", "data", wl.QUERY_PATTERNS, wl.QUERY_LOCALES),
)
sentence_query(
    "e4_ai_suitability", suitability=lambda: F.round(classify.ai_suitability("sentence"), 9)
)
kw_query("e5_content_format", format=lambda: F.coalesce(classify.content_format("keyword"), F.lit("")))
item_query("e6_schema_type")(
    lambda t: t.select("keyword", classify.schema_type("intent", "parent_topic").alias("schema_type"))
)
item_query("e7_suggest_length_type")(
    lambda t: t.select(
        "keyword",
        classify.suggested_length("intent").alias("length"),
        classify.suggested_type("intent").alias("type"),
    )
)
kw_query("e8_topic_fallback", topic=lambda: classify.topic_fallback("keyword", wl.TOPIC_STOPWORDS))


@query("e9_parent_topic")
def _(spark, sf_dir):
    kw = inputs.flagged(spark, sf_dir)
    topic = F.when(F.length("keyword") % 3 == 0, F.upper(classify.topic_fallback("keyword"))).when(
        F.length("keyword") % 3 == 1, "Misc"
    )
    named = F.concat(F.lit("cluster-"), F.when(F.length("keyword") % 2 == 0, F.col("cluster")).otherwise(""))
    return kw.select("keyword", classify.parent_topic(topic, named, "keyword").alias("parent_topic"))


# --- F: metrics ---------------------------------------------------------------------------------------------


@query("f1_volume_raw")
def _(spark, sf_dir):
    total = inputs.doc_count(spark, sf_dir)
    raw = scoring.volume_raw("keyword", "freq", "is_question", "validated", total)
    return inputs.flagged(spark, sf_dir).select("keyword", F.round(raw, 9).alias("volume_raw"))


@query("f2_difficulty_raw")
def _(spark, sf_dir):
    results = F.when(F.length("keyword") % 4 == 0, F.col("freq") * 1000)
    raw = scoring.difficulty_raw(
        "keyword", "freq", results, inputs.doc_count(spark, sf_dir), wl.HEAD_TERMS
    )
    return inputs.flagged(spark, sf_dir).select("keyword", F.round(raw, 9).alias("difficulty_raw"))


@query("f3_relative_interest")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir).withColumn("value", F.log1p("freq"))
    ranked = metrics.percentile_rank(kw, "value", "relative_interest")
    return ranked.select("keyword", F.round("relative_interest", 9).alias("relative_interest"))


@query("f4_difficulty_norm")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    return metrics.minmax(kw, "freq", "x").select("keyword", F.round("x", 9).alias("difficulty"))


item_query("f5_business_relevance")(
    lambda t: t.select(
        "keyword",
        scoring.business_relevance("intent", wl.GOALS).alias("mixed"),
        scoring.business_relevance("intent", "Sales").alias("sales"),
        scoring.business_relevance("intent", "brand exposure").alias("brand"),
    )
)


def _intents(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    return kw.withColumn("intent", _intent()["intent"])


@query("f6_serp_features")
def _(spark, sf_dir):
    features = scoring.serp_features("keyword", "intent", wl.SERP_TRIGGERS)
    return _intents(spark, sf_dir).select("keyword", bar(features).alias("features"))


@query("f7_ctr_potential")
def _(spark, sf_dir):
    features = scoring.serp_features("keyword", "intent", wl.SERP_TRIGGERS)
    return _intents(spark, sf_dir).select(
        "keyword", F.round(scoring.ctr_potential(features), 9).alias("ctr_potential")
    )


@query("f8_commercial_value")
def _(spark, sf_dir):
    value = scoring.commercial_value("keyword", "intent", "ae", "contracting", wl.TRIGGERS)
    return _intents(spark, sf_dir).select("keyword", F.round(value, 9).alias("commercial_value"))


@query("f9_naturalness")
def _(spark, sf_dir):
    vectors = inputs.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    scored = metrics.naturalness(
        vectors, vectors.filter("label = 0"), vectors.filter("label = 1")
    )
    return scored.select("vec_id", F.round("naturalness", 6).alias("naturalness"))


@query("f10_universal_penalty")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir).select("keyword")
    out = universal.with_universal_penalty(kw, inputs.universal_terms(spark, sf_dir))
    return out.select("keyword", F.round("universal_penalty", 9).alias("penalty"))


@query("f11_keyword_metrics")
def _(spark, sf_dir):
    kw = inputs.flagged(spark, sf_dir).withColumn("intent", _intent()["intent"])
    out = metrics.keyword_metrics(
        kw, inputs.doc_count(spark, sf_dir), triggers=wl.SERP_TRIGGERS, head_terms=wl.HEAD_TERMS
    )
    return out.select(
        "keyword",
        F.round("relative_interest", 9).alias("relative_interest"),
        F.round("difficulty", 9).alias("difficulty"),
        F.round("ctr_potential", 9).alias("ctr_potential"),
        bar("serp_features").alias("serp_features"), "estimated", "validated",
    )


item_query("f12_opportunity")(
    lambda t: t.select("keyword", F.round("opportunity_score", 9).alias("opportunity_score"))
)

# --- G: clusters -------------------------------------------------------------------------------------------------


def _clusters(spark, sf_dir):
    return inputs.flagged(spark, sf_dir).select("keyword", "freq", "cluster")


@query("g1_vectorize")
def _(spark, sf_dir):
    """The weight of each word of each keyword; a keyword without words has one row of nulls."""
    rows = clustering.word_weights(inputs.keywords(spark, sf_dir).select("keyword"))
    return rows.select("keyword", "word", F.round("weight", 6).alias("weight"))


@query("g2_select_k")
def _(spark, sf_dir):
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("keyword"), F.col("embedding").alias("vector")
    )
    prepared = cut_lineage(clustering.vectorize(vectors.select("keyword"), vectors))
    n = prepared.count()
    best = clustering.choose_k_silhouette(prepared, n)
    return spark.range(1).select(
        F.lit(n).alias("n"), F.lit(clustering.choose_k(n, 8)).alias("by_size"),
        F.lit(best).alias("by_silhouette"),
    )


@query("g3_cluster_keywords")
def _(spark, sf_dir):
    vectors = inputs.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("keyword"),
        F.col("embedding").alias("vector"),
    )
    return clustering.cluster_keywords(vectors.select("keyword"), embeddings=vectors)


@query("g3_first_word_clusters")
def _(spark, sf_dir):
    return clustering.first_word_clusters(inputs.keywords(spark, sf_dir)).select("keyword", "cluster")


@query("g4_cluster_name")
def _(spark, sf_dir):
    table = _clusters(spark, sf_dir).withColumn("cluster_id", F.col("cluster")).drop("cluster")
    return clustering.cluster_names(table, stopwords=wl.NAME_STOPWORDS)


@query("g5_pillar")
def _(spark, sf_dir):
    return clustering.pillars(_clusters(spark, sf_dir))


@query("g6_keyword_entities")
def _(spark, sf_dir):
    return clustering.keyword_entities(inputs.keywords(spark, sf_dir), stopwords=wl.ENTITY_STOPWORDS)


def _cooccurrence(spark, sf_dir):
    return clustering.entity_cooccurrence(
        _clusters(spark, sf_dir), min_density=1.2, stopwords=wl.ENTITY_STOPWORDS
    )


@query("g7_entity_cooccurrence")
def _(spark, sf_dir):
    out = _cooccurrence(spark, sf_dir)
    return out.withColumn("risk_reasons", bar("risk_reasons"))


@query("g8_cluster_risk_summary")
def _(spark, sf_dir):
    return clustering.cluster_risk_summary(_cooccurrence(spark, sf_dir))


# --- H: assembly -------------------------------------------------------------------------------------------------------


@query("h1_suggest_validate")
def _(spark, sf_dir):
    return assembly.validate_with_suggestions(
        inputs.keywords(spark, sf_dir), inputs.suggestions(spark, sf_dir), country="ae"
    )


@query("h1_suggest_validate_top")
def _(spark, sf_dir):
    return assembly.validate_with_suggestions(
        inputs.keywords(spark, sf_dir), inputs.suggestions(spark, sf_dir), country="ae", limit=100
    )


def _plain(t: DataFrame) -> DataFrame:
    scores = ("relative_interest", "difficulty", "ctr_potential", "opportunity_score")
    return t.withColumns({s: F.round(s, 9) for s in scores}).withColumn(
        "serp_features", bar("serp_features")
    )


@query("h2_assemble_items")
def _(spark, sf_dir):
    scored = inputs.items(spark, sf_dir).drop("parent_topic", "funnel_stage")
    topics = scored.filter(F.length("keyword") % 3 != 0).select(
        "keyword",
        F.when(F.length("keyword") % 3 == 1, F.upper("cluster")).otherwise("Other").alias("topic"),
    )
    return _plain(assembly.assemble_items(scored, topics))


item_query("h3_top_per_cluster")(
    lambda t: _plain(assembly.top_per_cluster(t, 4)).select("keyword", "cluster", "opportunity_score")
)
item_query("h4_global_ranking")(
    lambda t: _plain(assembly.global_ranking(t, 500)).select("keyword", "opportunity_score")
)
item_query("h5_quality_gate")(lambda t: _plain(assembly.quality_gate(t, 0.05)).select("keyword", "validated"))


@query("h6_validate_schema")
def _(spark, sf_dir):
    lab = F.length("keyword")
    messy = inputs.items(spark, sf_dir).select(
        F.concat(F.lit("  "), F.upper("keyword"), F.lit(" "), F.when(lab % 5 == 0, F.lit("  X ")).otherwise("")).alias("keyword"),
        F.when(lab % 7 != 0, F.concat(F.lit(" "), F.col("cluster"), F.lit("  b "))).alias("cluster"),
        F.when(lab % 11 == 0, "odd").otherwise(F.col("intent")).alias("intent"),
        (F.col("relative_interest") * F.when(lab % 13 == 0, 3.0).otherwise(1.0)).alias("relative_interest"),
        F.when(lab % 2 == 0, " a, ,b ").alias("serp_features"),
    )
    out = assembly.validate_schema(messy)
    return out.select(
        "keyword", "cluster", "intent", "funnel_stage", bar("serp_features").alias("serp_features"),
        F.round("relative_interest", 9).alias("relative_interest"), "difficulty",
        bar("errors").alias("errors"),
    )


@query("h7_score_candidates")
def _(spark, sf_dir):
    out = metrics.score_candidates(
        inputs.flagged(spark, sf_dir), goals="brand", geo="global", intent_rules=wl.INTENT_RULES,
        metric_options={"triggers": wl.SERP_TRIGGERS, "head_terms": wl.HEAD_TERMS},
        unvalidated_penalty=0.0, triggers=wl.TRIGGERS,
    )
    return out.select(
        "keyword", "intent", "intent_confidence", "funnel_stage",
        F.round("relative_interest", 9).alias("relative_interest"),
        F.round("difficulty", 9).alias("difficulty"),
        F.round("opportunity_score", 9).alias("opportunity_score"),
    )


# --- I: gaps -------------------------------------------------------------------------------------------------------------


@query("i1_competitor_gaps")
def _(spark, sf_dir):
    found = gaps.competitor_gaps(
        inputs.items(spark, sf_dir), inputs.rankings(spark, sf_dir), 0.03, 0.5
    )
    return found.select("keyword", "gap_reason", F.round("gap_score", 9).alias("gap_score"))


item_query("i2_gap_score")(
    lambda t: t.select(
        "keyword",
        F.round(
            scoring.gap_score(F.col("opportunity_score"), F.col("difficulty"), ~F.col("validated")), 9
        ).alias("gap_score"),
    )
)


@query("i3_competitor_overlap")
def _(spark, sf_dir):
    out = gaps.competitor_overlap(inputs.items(spark, sf_dir), inputs.rankings(spark, sf_dir))
    return out.select(
        "competitor", "overlap_count", bar("overlap_keywords").alias("overlap_keywords"),
        "unique_to_us_count", "unique_to_them_count",
        bar("unique_to_them_sample").alias("unique_to_them_sample"),
        F.round("overlap_percentage", 9).alias("overlap_percentage"),
    )


item_query("i4_quick_wins")(
    lambda t: gaps.quick_wins(t, 0.3, 0.2).select("keyword", F.round("quick_win_score", 9).alias("score"))
)


@query("i5_gap_report")
def _(spark, sf_dir):
    report = gaps.gap_report(inputs.items(spark, sf_dir), inputs.rankings(spark, sf_dir))
    return report["summary"].withColumn("recommendations", bar("recommendations"))


@query("i5_thin_clusters")
def _(spark, sf_dir):
    return gaps.thin_clusters(inputs.items(spark, sf_dir))


def _content_gaps(spark, sf_dir):
    rivals = inputs.suggestions(spark, sf_dir).select(F.col("suggestion").alias("keyword"))
    return gaps.content_gaps(
        inputs.keywords(spark, sf_dir), inputs.existing_content(spark, sf_dir), rivals
    )


@query("i6_content_gaps")
def _(spark, sf_dir):
    return _content_gaps(spark, sf_dir).select(
        "keyword", "gap_type", long("priority").alias("priority"), "action",
        F.coalesce("expected_format", F.lit("")).alias("expected_format"),
        long("recommended_word_count").alias("recommended_word_count"),
        F.coalesce("existing_url", F.lit("")).alias("existing_url"),
        long(F.coalesce("current_word_count", F.lit(-1))).alias("current_word_count"),
    )


@query("i7_content_calendar")
def _(spark, sf_dir):
    plan = gaps.content_calendar(_content_gaps(spark, sf_dir), 3, 20)
    return plan.select(
        long("week").alias("week"), long("slot").alias("slot"), "keyword", "gap_type",
        F.coalesce("format", F.lit("")).alias("format"),
        long("target_word_count").alias("target_word_count"),
    )


@query("i8_gaps_by_cluster")
def _(spark, sf_dir):
    known = inputs.flagged(spark, sf_dir).filter(F.length("keyword") % 2 == 0)
    return gaps.gaps_by_cluster(_content_gaps(spark, sf_dir), known).select("keyword", "cluster")


@query("i9_location_gaps")
def _(spark, sf_dir):
    out = gaps.location_gaps(inputs.keywords(spark, sf_dir), ("Erst",), ("anea", "erst", "que"))
    return out.select("base_keyword", "location", "keyword_variant", long("priority").alias("priority"))


@query("i10_prioritize_leads")
def _(spark, sf_dir):
    def worth(kw: Column) -> Column:
        return scoring.commercial_value(kw, F.lit("commercial"), "ae", None, wl.TRIGGERS)

    return gaps.prioritize_leads(_content_gaps(spark, sf_dir), worth).select(
        "keyword", "gap_type", long("priority").alias("priority"), "commercial_value"
    )


# --- J and K: places, Arabic and English -----------------------------------------------------------------------------------------


def _enriched(spark, sf_dir):
    return places.enrich_entities(inputs.keywords(spark, sf_dir).select("keyword"), "ae", wl.GAZETTEER)


ENTITY_COLUMNS = (
    "emirate", "district", "landmark", "free_zone", "government_entity", "certification",
    "legal_term", "construction_term", "location_type",
)


@query("j1_extract_entities")
def _(spark, sf_dir):
    out = _enriched(spark, sf_dir)
    return out.select(
        "keyword", *[F.coalesce(c, F.lit("")).alias(c) for c in ENTITY_COLUMNS],
        "is_local", "is_contracting",
    )


@query("j1_gazetteer_matches")
def _(spark, sf_dir):
    """The table form: a gazetteer of any size meets keywords in an equi-join."""
    names = inputs.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tokens = inputs.keywords(spark, sf_dir)
    # keys: phrases of the corpus, filed under a nation each
    gazetteer = tokens.select(
        F.when(F.length("keyword") % 2 == 0, "district").otherwise("landmark").alias("kind"),
        F.length("keyword").alias("ord_length"),
        F.col("keyword").alias("key"),
        F.concat(F.lit("the "), "keyword").alias("display"),
        (F.length("keyword") % 25).alias("n_nationkey"),
    ).join(names, "n_nationkey").select(
        "kind", F.struct(-F.col("ord_length"), "key").alias("ord"), "key", "display",
        F.col("n_name").alias("region"), F.lit("phrase").alias("type"),
    )
    return places.gazetteer_matches(inputs.keywords(spark, sf_dir), gazetteer, 3)


@query("j2_location_variations")
def _(spark, sf_dir):
    out = places.location_variations(
        inputs.keywords(spark, sf_dir), include_districts=True, primary_emirate="region-b",
        emirates=wl.REGIONS, gazetteer=wl.GAZETTEER,
    )
    return out.select("keyword", long("position").alias("position"), "variation")


@query("j3_enrich_entities")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir).select("keyword", "freq")
    out = places.enrich_entities(kw, "ae", wl.GAZETTEER, "token")
    return out.select(
        "keyword", "freq", *[F.coalesce(c, F.lit("")).alias(c) for c in ENTITY_COLUMNS],
        "is_local", "is_contracting",
    )


@query("j4_entity_clusters")
def _(spark, sf_dir):
    return places.entity_clusters(inputs.keywords(spark, sf_dir), "ae", wl.GAZETTEER)


@query("k1_term_translate")
def _(spark, sf_dir):
    words = inputs.sentences(spark, sf_dir).select(F.explode(tx.words("sentence")).alias("word"))
    arabic = bilingual.arabic_equivalent("word", wl.TERMS)
    return (
        words.withColumn("arabic", arabic)
        .filter("arabic is not null")
        .groupBy("word", "arabic", bilingual.english_equivalent("arabic", wl.TERMS).alias("english"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _arabic_texts(spark, sf_dir):
    """Keyword variants in Arabic, made by the term dictionary."""
    variants = bilingual.expand_bilingual("keyword", wl.TERMS, wl.LOCATIONS, True)
    return inputs.keywords(spark, sf_dir).select("keyword", F.explode(variants).alias("text"))


@query("k2_detect_arabic")
def _(spark, sf_dir):
    return _arabic_texts(spark, sf_dir).select(
        "text", bilingual.detect_arabic("text").alias("arabic"),
        bilingual.detect_arabizi("text").alias("arabizi"),
    )


sentence_query("k2_detect_arabizi", arabizi=lambda: bilingual.detect_arabizi("sentence"))


@query("k3_expand_bilingual")
def _(spark, sf_dir):
    return _arabic_texts(spark, sf_dir)


@query("k4_arabic_intent")
def _(spark, sf_dir):
    return _arabic_texts(spark, sf_dir).select(
        "text", F.coalesce(bilingual.arabic_intent("text"), F.lit("")).alias("intent")
    )


@query("k5_normalize_arabic")
def _(spark, sf_dir):
    marked = F.replace(F.replace("text", F.lit("ق"), F.lit("قّ")), F.lit("ال"), F.lit("أل"))
    return _arabic_texts(spark, sf_dir).select("text", bilingual.normalize_arabic(marked).alias("normal"))


@query("k6_bilingual_keywords")
def _(spark, sf_dir):
    made = bilingual.bilingual_keywords(
        "keyword", wl.TERMS, wl.LOCATIONS, wl.KEY_LOCATIONS, include_dialects=True
    )
    return (
        inputs.keywords(spark, sf_dir)
        .select(F.posexplode(made).alias("position", "b"))
        .select(
            long("position").alias("position"), "b.english",
            F.coalesce("b.arabic", F.lit("")).alias("arabic"),
            bar("b.dialect_variants").alias("dialects"), "b.is_location", "b.is_construction",
        )
    )


@query("k7_bilingual_query")
def _(spark, sf_dir):
    out = _arabic_texts(spark, sf_dir).withColumn(
        "q", bilingual.bilingual_query(
            "text", wl.TERMS, wl.LOCATIONS, whole_word_locations=True
        )
    )

    def pairs(col: str) -> Column:
        return bar(F.transform(col, lambda p: F.concat_ws("=", p["english"], p["arabic"])))

    return out.select(
        "text", "q.primary_language", "q.is_arabizi",
        F.coalesce("q.arabic_intent", F.lit("")).alias("arabic_intent"),
        F.coalesce("q.english_equivalent", F.lit("")).alias("english_equivalent"),
        F.coalesce("q.arabic_equivalent", F.lit("")).alias("arabic_equivalent"),
        pairs("q.construction_terms").alias("terms"), pairs("q.location_terms").alias("places"),
    )


# --- L: answer engines -----------------------------------------------------------------------------------------------------


@query("l1_information_gain")
def _(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first_id"))
    texts = docs.join(first, "source").select(
        F.col("source").alias("comparison_id"),
        F.when(F.col("doc_id") == F.col("first_id"), "mine").otherwise("theirs").alias("side"),
        F.col("doc_id").alias("part"),
        "text",
    )
    out = information.information_gain(texts)
    return out.withColumns(
        {c: bar(c) for c in ("unique_concepts", "common_concepts", "missing_concepts", "recommendations")}
    )


@query("l2_trust_signals")
def _(spark, sf_dir):
    signals = answers.trust_signals("text", "data", locale_patterns=wl.TRUST_LOCALES)
    out = inputs.table(spark, sf_dir, "documents").withColumn("s", signals).select("doc_id", "s.*")
    return out.withColumns({c: bar(c) for c in ("signals_found", "signals_missing", "recommendations")})


@query("l3_faq_jsonld")
def _(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pages = (
        asked.join(told, ["conv_id", "turn"])
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))).alias("pairs"))
    )
    return pages.select("conv_id", answers.faq_jsonld("pairs").alias("json_ld"))


@query("l4_howto_jsonld")
def _(spark, sf_dir):
    lines = tx.sentences("text")
    made = answers.howto_jsonld(F.get(lines, F.lit(0)), lines, description=F.col("lang"), total_time=F.lit(""))
    return inputs.table(spark, sf_dir, "documents").select("doc_id", made.alias("json_ld"))


@query("l5_business_jsonld")
def _(spark, sf_dir):
    nations = inputs.table(spark, sf_dir, "nation")
    firms = inputs.table(spark, sf_dir, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    place = F.struct(
        F.lit("Street 1").alias("streetAddress"), F.col("n_name").alias("addressLocality"),
        F.lit(None).cast("string").alias("addressRegion"), F.lit(None).cast("string").alias("addressCountry"),
    )
    made = answers.business_jsonld(
        "s_name", address=place, url=F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")),
        phone=F.lit(""), rating=F.lit(4.5), review_count=F.col("s_suppkey") % 3,
        services=F.array("n_name"),
    )
    return firms.select("s_suppkey", made.alias("json_ld"))


@query("l6_service_jsonld")
def _(spark, sf_dir):
    made = answers.service_jsonld(
        "p_name", "p_brand", area_served=F.array("p_type"), price_from=F.col("p_size"), currency="AED"
    )
    return inputs.table(spark, sf_dir, "part").select("p_partkey", answers.script_tag(made).alias("html"))


@query("l7_snippet")
def _(spark, sf_dir):
    rows = inputs.sentences(spark, sf_dir)
    kinds = tx.literal_array(["direct_answer", "list", "tutorial", "comparative", "other"])
    kind = F.get(kinds, F.col("sent_no") % 5)
    points = tx.words("sentence")
    return rows.select(
        "doc_id", long("sent_no").alias("sent_no"),
        answers.snippet("sentence", kind, points).alias("snippet"),
    )


@query("l8_citation_excerpt")
def _(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", answers.citation_excerpt("text").alias("excerpt"),
        answers.citation_excerpt(F.concat(F.lit("«"), "text"), 80).alias("short"),
    )


# --- M: stored responses --------------------------------------------------------------------------------------------------


@query("m1_parse_expansion")
def _(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    stored = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("batch_id"), F.col("text").alias("response")
    )
    out = responses.parse_expansion(stored, 5)
    return out.select("batch_id", "keyword", long("position").alias("position"))


def _batched(spark, sf_dir, answer: Column):
    """Keyword batches and one JSON answer per batch, wrapped in prose.

    A batch holds at most 50 keywords. Some keywords are left out of their answer and
    some answers are broken.
    """
    batches = responses.keyword_batches(inputs.keywords(spark, sf_dir).select("keyword"), 50)
    told = F.when(F.length("keyword") % 5 != 0, F.struct(F.col("keyword").alias("k"), answer.alias("v")))
    entries = F.map_from_entries(F.collect_list(told))
    stored = batches.groupBy("batch_id").agg(
        F.concat(
            F.lit("Sure, here it is: "), F.to_json(entries),
            F.lit(" - tell me if you need more."),
        ).alias("response")
    )
    return batches, stored


@query("m2_parse_intents")
def _(spark, sf_dir):
    kinds = tx.literal_array(["Local", "direct answer", "TRANSACTIONAL", "odd one", "comparative"])
    answer = F.get(kinds, F.length("keyword") % 7)
    batches, stored = _batched(spark, sf_dir, answer)
    return responses.parse_intents(batches, stored).select("keyword", "intent")


def _verdicts(spark, sf_dir):
    kinds = tx.literal_array(["Valid", "no", " true ", "invalid", "1", "yes"])
    answer = F.get(kinds, F.length("keyword") % 7)
    batches, stored = _batched(spark, sf_dir, answer)
    return responses.parse_verdicts(batches, stored)


@query("m3_parse_verdicts")
def _(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("keyword", "valid")


@query("m3_verify_filter")
def _(spark, sf_dir):
    kw = inputs.keywords(spark, sf_dir)
    return responses.verify_filter(kw, _verdicts(spark, sf_dir)).select("keyword", "freq")


@query("m4_parse_topics")
def _(spark, sf_dir):
    answer = F.when(F.length("keyword") % 3 == 0, F.concat(F.lit(" Topic "), F.upper(F.substring("keyword", 1, 3)))).otherwise(" ")
    batches, stored = _batched(spark, sf_dir, answer)
    return responses.parse_topics(batches, stored).select("keyword", "topic")


@query("m5_keyword_batches")
def _(spark, sf_dir):
    out = responses.keyword_batches(inputs.keywords(spark, sf_dir).select("keyword"), 50)
    return out.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("keyword").alias("first"), F.max("keyword").alias("last")
    )


# --- N and O: quality and reports ---------------------------------------------------------------------------------------------

sentence_query(
    "n1_qa_length", reason=lambda: F.coalesce(quality.length_reason("sentence", 3, 12), F.lit(""))
)
item_query("n2_qa_scores")(
    lambda t: t.select(
        "keyword", F.coalesce(quality.score_reason(0.02, 0.4), F.lit("")).alias("reason")
    )
)
item_query("n3_qa_cluster_size")(lambda t: quality.cluster_sizes(t, 5))


def _judged(t: DataFrame) -> DataFrame:
    return quality.qa_table(t, 5, 2, 2, 0.01, 0.1)


item_query("n4_qa_validate")(
    lambda t: _judged(t).select(
        "keyword", F.coalesce("rejected_by", F.lit("")).alias("rejected_by"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
)
item_query("n4_qa_report")(
    lambda t: quality.qa_report(_judged(t)).withColumn("removal_rate", F.round("removal_rate", 9))
)
item_query("n4_qa_text")(
    lambda t: quality.qa_text(quality.qa_report(_judged(t)), min_cluster_size=5, max_word_count=2)
)
item_query("o1_executive_summary")(reports.executive_summary)
item_query("o2_intent_distribution")(reports.intent_distribution)
item_query("o3_top_clusters")(reports.top_clusters)
item_query("o4_site_architecture")(
    lambda t: reports.site_architecture(t).withColumn("position", long("position"))
)
item_query("o5_cluster_analysis")(reports.cluster_analysis)
item_query("o6_intent_analysis")(reports.intent_analysis)
item_query("o7_priority_matrix")(
    lambda t: _plain(reports.priority_matrix(t, 0.03, 0.7)).select("keyword", "opportunity_score", "difficulty")
)
item_query("o8_geo_columns")(
    lambda t: reports.answer_columns(
        t.withColumn("geo_suitability", F.round(classify.ai_suitability("keyword"), 9))
    )
)
item_query("o9_location_analysis")(lambda t: reports.location_analysis(t, wl.GAZETTEER))
item_query("o10_recommendations")(
    lambda t: reports.recommendations(t, "ae", 0.2).withColumn("position", long("position"))
)
item_query("o11_seo_metadata")(
    lambda t: reports.seo_metadata(t)
    .withColumn("secondary_keywords", bar("secondary_keywords"))
    .withColumn("avg_opportunity", F.round("avg_opportunity", 9))
)
item_query("o12_content_brief")(reports.content_brief)
item_query("o13_geo_brief")(lambda t: reports.geo_brief(t, "ae", None, wl.GAZETTEER))
item_query("o14_results_table")(
    lambda t: reports.results_table(t).withColumn("remaining", long("remaining"))
)
