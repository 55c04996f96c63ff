"""Steps shared by the keyword queries: the same rows as the plain form, with the costly part gone from the plan."""

import random

from pyspark.sql import functions as F

from kwloom.functions import bilingual, classify, scoring
from kwloom.functions import text as tx
from kwloom.operators import assembly, candidates, clustering, gaps, metrics, universal

TEXTS = ["red villa", " a\tb  c ", "", " ", None, "A b", "villa-design cost, low", "x y z", "ab ab ab", "best villa", "b", "é日 本 straße x"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_found_without_arrays(evaluate, spark):
    terms = ("red", "b", "", "ab ab", "villa", "y")
    low = F.lower("t")
    assert evaluate(tx.has_word(tx.one_spaced(low), terms), *TEXTS) == evaluate(tx.has_token(tx.words(low), terms), *TEXTS)
    parts = tx.words("t")
    first_two = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, 2), " ")).otherwise(F.col("t"))
    assert evaluate(assembly.probe("t"), *TEXTS) == evaluate(first_two, *TEXTS)
    table = spark.createDataFrame([("red villa",)], "keyword string")
    rules = {"commercial": ("red", "a b"), "local": ("villa",)}
    assert table.select(classify.intent("keyword", (), rules)["intent"]).first()[0] == "commercial"
    assert "split" not in plan(table.select(classify.intent("keyword", (), rules)))


def test_phrases_of_a_lead(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices(["red", "re", " ", "-", "villa", ".", "é"], k=rng.randint(0, 7))), rng.choice(["red", "re", "", "red-", "é", " "])) for _ in range(300)]
    table = spark.createDataFrame([*rows, (None, "red")], "s string, lead string")
    every = assembly._matched_phrases(F.col("s"), F.lit(4))
    led = assembly._matched_phrases(F.col("s"), F.lit(4), F.col("lead"))
    picked = lambda a: F.filter(a, lambda p: F.startswith(p, F.col("lead")))
    got = table.select(picked(every).alias("a"), picked(led).alias("b"), F.size(every).alias("n"), F.size(led).alias("m")).collect()
    assert all(r.a == r.b for r in got)
    assert sum(r.m for r in got if r.m) < 0.7 * sum(r.n for r in got if r.n)


def test_phrases_of_documents(spark):
    docs = spark.createDataFrame(
        [(i, random.Random(i).choice(["a", "b", None]), t) for i, t in enumerate([*TEXTS, "red villa red villa red", "Red, villa"])], "id int, source string, text string"
    ).repartition(3)
    arrays = F.array_distinct(tx.ngrams(tx.gram_tokens(tx.clean_text("text")), 2, 2))
    plain = docs.select("id", "source", arrays.alias("keywords"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(candidates.with_phrases(docs).select("id", "source", "keywords")) == rows(plain)
    assert rows(candidates.key_phrases(docs, "source")) == rows(plain.select("source", F.explode("keywords").alias("keyword")).distinct())


def test_a_short_list_of_terms_goes_to_the_tokens(spark):
    kw = spark.createDataFrame([("the villa",), ("the the of",), ("wall",)], "keyword string")
    found = universal.universal_token_counts(kw, spark.createDataFrame([("the",), ("of",)], "term string").repartition(2).distinct())
    assert sorted(map(tuple, found.collect())) == [("the the of", 2, 2), ("the villa", 2, 1), ("wall", 1, 0)]
    assert "hashpartitioning(term" not in plan(found)


def test_the_last_page_of_a_keyword(spark):
    targets = spark.createDataFrame([("Red villa",), ("blue door",), ("green roof",), ("old wall",)], "keyword string")
    schema = "ord long, url string, keywords array<string>, word_count int"
    pages = [(1, "u1", ["red villa", "blue door"], 10), (2, "u2", ["Red Villa"], 20), (3, "u3", None, 30)]

    def found(rows):
        out = gaps.content_gaps(targets, spark.createDataFrame(rows, schema).repartition(2))
        return out, {r["keyword"]: (r["gap_type"], r["existing_url"], r["current_word_count"]) for r in out.collect()}

    table, got = found(pages)
    missing = ("missing_topic", None, None)
    assert got == {"Red villa": ("thin_content", "u2", 20), "blue door": ("thin_content", "u1", 10), "green roof": missing, "old wall": missing}
    assert "SortAggregate" not in plan(table)
    # rows without a number, or with the number of another row, count as they are
    _, got = found([*pages, (None, "u4", ["green roof", "blue door"], 40), (2, "u2b", ["old wall"], 50)])
    assert got == {"Red villa": ("thin_content", "u2", 20), "blue door": ("thin_content", "u1", 10),
                   "green roof": ("thin_content", None, 0), "old wall": ("thin_content", "u2b", 50)}


def test_the_term_of_a_keyword_is_looked_up_once(spark):
    kw = spark.createDataFrame([("villa cost",), ("blue door",), (None,)], "keyword string")
    terms, places = (("villa", "V", ("v1", "v2")), ("cost", "C", ())), (("north", "N"),)
    made = bilingual.bilingual_keywords("keyword", terms, places, ("north", "south"), include_dialects=True)
    table = kw.select(F.posexplode(made).alias("position", "b")).select("position", "b.*")
    got = [tuple(r) for r in table.collect() if r.english and ("villa" in r.english or "blue" in r.english)]
    assert got == [
        (0, "villa cost", "V cost", ["v1", "v2"], False, True), (1, "villa cost north", "V cost N", [], True, True),
        (2, "villa cost south", None, [], True, True), (0, "blue door", None, [], False, False),
        (1, "blue door north", "blue door N", [], True, False), (2, "blue door south", None, [], True, False),
    ]
    logical = kw.select(made.alias("made"))._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("filter(") == 1


def test_cluster_names_look_up_only_the_most_frequent(spark, monkeypatch):
    rows = [(0, "red villa", 2), (0, "villa red", 1), (0, "old door", 0), (1, "red villa", 5), (1, "villa red", 4), (2, "a b", 9), (2, None, 8), (None, "x y", 7), (3, "a", None)]
    table = spark.createDataFrame(rows, "cluster_id int, keyword string, ord int").repartition(3)
    stored, cut = [], clustering.cut_lineage
    monkeypatch.setattr(clustering, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    got = {r.cluster_id: r.cluster for r in clustering.cluster_names(table, order_col="ord").collect()}
    # both words of a cluster are met twice: the one that stands first in order names it
    assert got == {0: "cluster-villa", 1: "cluster-villa-1", 2: "cluster-a-b", 3: "cluster-misc", None: "cluster-misc"}
    assert {(r[0], r[1]) for r in stored[0].collect()} == {(0, "red"), (0, "villa"), (1, "red"), (1, "villa"), (2, "a b")}


def test_phrases_shorter_than_the_probe_are_not_opened(spark):
    rng = random.Random(5)
    pieces = ["red", "a", " ", " ", "villa", ".", "é", "İ", "\t"]
    words = ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(250)]
    kw = spark.createDataFrame([(w, 1) for w in [*words[:150], *words[:20], None, ""]], "keyword string, freq int").repartition(3)
    sug = spark.createDataFrame([(w,) for w in words[80:]], "keyword string").select(
        assembly.probe("keyword").alias("query"), F.lit("en").alias("lang"), F.lit("us").alias("country"), F.col("keyword").alias("suggestion")
    )
    got = sorted(map(tuple, assembly.validate_with_suggestions(kw, sug).collect()))
    low = tx.strip(F.lower("keyword"))
    asked = kw.where("keyword <> ''").select("keyword").distinct().withColumn("query", assembly.probe("keyword")).withColumn("phrase", low)
    every = F.explode(assembly._matched_phrases(tx.strip(F.lower("suggestion")), F.lit(20)))
    want = asked.join(sug.select("query", every.alias("phrase")).distinct().withColumn("hit", F.lit(True)), ["query", "phrase"], "left")
    assert got == sorted(map(tuple, want.select("keyword", F.coalesce("hit", F.lit(False))).collect()))
    assert 10 < sum(v for _, v in got) < len(got)
    opened = spark.createDataFrame([("red villa cost", "red", 3)], "s string, lead string, least int")
    assert opened.select(assembly._matched_phrases(F.col("s"), F.lit(5), F.col("lead"), F.col("least"))).first()[0] == ["red villa", "red villa cost"]


def test_features_fold_case_once(evaluate, spark):
    triggers = (("a", ("RED", "villa")), ("featured_snippet", ("door", "é")), ("b", ()))
    table = spark.createDataFrame([("Best VILLA", "informational"), ("é door", "informational"), ("x", "local"), (None, "commercial"), ("red", None)], "keyword string, intent string")
    found = scoring.serp_features("keyword", "intent", triggers)
    assert [r[0] for r in table.select(found).collect()] == [["a", "people_also_ask"], ["featured_snippet"], ["local_pack"], ["top_ads"], []]
    assert table.select(found.alias("f"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_a_short_list_of_values_goes_to_the_rows(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("a", 1.0)], "keyword string, v double").repartition(3)
    out = metrics.percentile_rank(table, "v", "rank")
    assert sorted(((r.keyword, r["rank"]) for r in out.collect()), key=repr) == [("a", 0.5), ("a", 0.5), ("b", 0.9), ("c", 0.9), ("d", None)]
    assert "hashpartitioning" not in plan(out)


def test_a_short_list_of_terms_goes_to_the_rows(spark, monkeypatch):
    rows = [("the villa",), ("The the of",), ("wall",), (None,), (" ",), ("of villa the",)]
    kw = spark.createDataFrame(rows, "keyword string").repartition(3)
    terms = spark.createDataFrame([("the",), ("of",), (None,)], "term string").repartition(2)
    ranked = lambda df: sorted(map(tuple, df.collect()), key=repr)
    scored = universal.with_universal_penalty(kw, terms)
    assert "hashpartitioning" not in plan(scored)
    twice = terms.unionByName(terms.limit(0)).union(spark.createDataFrame([("a\x1fb",)], "term string"))
    for other in (twice, terms):
        if other is terms:
            monkeypatch.setattr(universal, "LISTED", 0)
        assert ranked(universal.with_universal_penalty(kw, other)) == ranked(scored)
    assert {r.keyword: round(r.universal_penalty, 3) for r in scored.collect()} == {
        "the villa": 0.3, "The the of": 0.6, "wall": 0.0, None: 0.0, " ": 0.0, "of villa the": 0.6
    }
    assert scored.schema == universal.with_universal_penalty(kw, twice).schema


def test_gaps_are_stored_before_they_are_sorted(spark):
    kw = spark.createDataFrame([("red villa", 0.9, 0.1), ("blue door", 0.7, 0.2)], "keyword string, opportunity_score double, difficulty double")
    rankings = spark.createDataFrame([("c", "Blue door")], "competitor string, keyword string")
    for out, first in ((gaps.competitor_gaps(kw, rankings), "red villa"), (gaps.content_gaps(kw, None, rankings), "red villa")):
        assert out.first()["keyword"] == first and "Join" not in plan(out)
