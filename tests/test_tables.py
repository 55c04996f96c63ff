import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwloom.functions import bilingual
from kwloom.operators import assembly, candidates, clustering, gaps, information, kmeans, metrics, quality, reports, responses
from kwloom.plans.pipeline import KeywordPlan
from kwloom.sources import html, ledger, sinks, sitemaps
from kwloom.sources.documents import read_keyword_json, scan_text_dir, scan_url_list, seed_document
from workload import queries


def test_ngram_counts_and_small_corpus(spark):
    s = spark.createDataFrame([("red villa design red villa",), ("red villa cost",)], "sentence string")
    rows = {r["ngram"]: (r["count"], r["df"]) for r in candidates.ngram_counts(s, min_df=1).collect()}
    assert rows["red villa"] == (3, 2) and rows["villa design red"] == (1, 1)
    def counted(min_df, *sentences):
        df = spark.createDataFrame([(x,) for x in sentences], "sentence string")
        return {r["ngram"] for r in candidates.counted_ngrams(df, (2, 3), min_df, (), ("the",)).collect()}

    assert counted(2, "red villa design", "red villa cost") == {"red villa"}
    assert counted(3, "red villa design", "red villa cost") == {"red villa"}  # lowered to two sentences
    assert counted(2, "red villa", "blue house") == {"red villa", "blue house"}  # nothing repeats
    assert counted(2, "see the villa", "the villa cost", "blue house") == set()  # only an edge n-gram repeats


def test_malformed_sitemaps_are_skipped(spark):
    good = "<urlset><url><loc>http://a/1</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>good</loc></sitemap><sitemap><loc>bad</loc></sitemap></sitemapindex>"
    maps = spark.createDataFrame(
        [("good", good), ("bad", good[:40]), ("index", index), ("none", None), ("blank", " ")], "sitemap_url string, xml string"
    )
    got = {(r["root"], r["url"]) for r in sitemaps.sitemap_urls(maps, maps.select("sitemap_url")).collect()}
    assert got == {("good", "http://a/1"), ("index", "http://a/1")}
    assert {r[0] for r in sitemaps.malformed(maps).collect()} == {"bad", "none", "blank"}


def test_repeated_topics_do_not_multiply_items(spark):
    scored = spark.createDataFrame([("a b", "c", "informational")], "keyword string, cluster string, intent string")
    for name, kind in (("relative_interest", "double"), ("difficulty", "double"), ("ctr_potential", "double"),
                       ("serp_features", "array<string>"), ("estimated", "boolean"), ("validated", "boolean"),
                       ("opportunity_score", "double")):
        scored = scored.withColumn(name, F.lit(None).cast(kind))
    topics = spark.createDataFrame([("a b", "two"), ("a b", "one"), ("A b", "three")], "keyword string, topic string")
    assert [r["parent_topic"] for r in assembly.assemble_items(scored, topics).collect()] == ["one"]


def test_locations_match_inside_words_by_default(spark):
    df = spark.createDataFrame([("bay window",), ("baywindow",)], "k string")
    terms, places = (("zinc", "زنك", ("توتياء",)),), (("bay", "خليج"),)
    by_default, whole = (
        [r["v"] for r in df.select(bilingual.expand_bilingual("k", terms, places, *flag).alias("v")).collect()] for flag in ((), (True,))
    )
    assert [len(v) for v in by_default] == [2, 2] and [len(v) for v in whole] == [2, 1]


def test_percentile_rank_averages_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (9.5,)], "x double")
    got = sorted(r["p"] for r in metrics.percentile_rank(df, "x", "p").collect())
    assert got == [0.25, 0.625, 0.625, 1.0]


def test_gaps(spark):
    kw = spark.createDataFrame(
        [("a b", 0.8, 0.2, "c"), ("c d", 0.7, 0.4, "c"), ("e f", 0.4, 0.8, "c"), ("g h", 0.6, 0.2, "z")],
        "keyword string, opportunity_score double, difficulty double, cluster string",
    ).withColumn("validated", F.lit(False))
    rivals = spark.createDataFrame([("x", "A b")], "competitor string, keyword string")
    got = {r["keyword"]: r for r in gaps.competitor_gaps(kw, rivals).collect()}
    assert set(got) == {"a b", "c d", "g h"}
    assert "competitor_missing" not in got["a b"]["gap_reason"] and "competitor_missing" in got["c d"]["gap_reason"]
    assert got["a b"]["gap_score"] == pytest.approx(0.64)
    assert gaps.gap_report(kw, rivals)["summary"].first()["gap_count"] == 3


def test_suggestion_matching_is_exact(spark):
    import re

    texts = ["best villa design dubai", "villa-design", "my villa", "villa design"]
    keys = ["villa design", "villa", "design dubai", "illa", "best villa", "a design"]
    sug = spark.createDataFrame(
        [(k if len(k.split()) <= 2 else " ".join(k.split()[:2]), "en", "us", t) for k in keys for t in texts],
        "query string, lang string, country string, suggestion string",
    )
    kw = spark.createDataFrame([(k,) for k in keys], "keyword string")
    got = {r["keyword"]: r["validated"] for r in assembly.validate_with_suggestions(kw, sug).collect()}
    want = {
        k: any(k == t or t.startswith(k + " ") or re.search(rf"\b{re.escape(k)}\b", t) for t in texts) for k in keys
    }
    assert got == want


def test_schema_quality_and_reports(spark):
    rows = [("  Villa  X ", "c", "informational", 0.5), ("y z", "c", "odd", 1.5)]
    items = spark.createDataFrame(rows, "keyword string, cluster string, intent string, difficulty double")
    got = {r["keyword"]: r["errors"] for r in assembly.validate_schema(items).collect()}
    assert got["villa x"] == [] and len(got["y z"]) == 2
    full = assembly.validate_schema(items.limit(1)).drop("errors")
    assert quality.qa_report(quality.qa_table(full, min_cluster_size=1)).first()["final_count"] == 1
    meta = reports.seo_metadata(full).first()
    assert len(meta["title"]) <= 70 and meta["primary_keyword"] == "villa x"
    assert "# Content Brief: C" in reports.content_brief(full).first()["brief"]


def test_responses(spark):
    batches = spark.createDataFrame([(1, "A b"), (1, "c d"), (2, "e f")], "batch_id int, keyword string")
    answers = spark.createDataFrame(
        [(1, 'Here: {"a b": "Direct Answer", "c d": false} ok'), (2, "no json")], "batch_id int, response string"
    )
    assert {r["keyword"]: r["intent"] for r in responses.parse_intents(batches, answers).collect()} == {
        "A b": "direct_answer", "c d": "informational", "e f": "informational"}
    valid = {r["keyword"]: r["valid"] for r in responses.parse_verdicts(batches, answers).collect()}
    assert valid["c d"] is False and valid["e f"] is True


PAGE = """<html><head><title> T &amp; x </title><meta name="description" content="About it"></head><body>
<nav><p>Menu text here</p></nav><div class="cookie-bar"><p>Cookie text</p></div>
<script>var a = "</p>";</script><div><a href="https://wa.me/1">Chat with us</a></div>
<span>+971 50 123</span><div><a href="/1">a long link text that fills the whole of it</a></div>
<h1>Main head</h1><p>Read <a href="/x">this</a> now<br>and then<p>Nested part</p>
<ul><li>Same line</li><li>same LINE</li></ul></body></html>"""


def test_visible_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE)], "page_id int, url string, html string")
    parsed = html.parse_pages(pages)
    lines = html.visible_text(parsed).first()["text"].split("\n")
    # the paragraph is never closed, so it holds what follows, as the tag order says
    assert lines[0] == "Main head"
    assert lines[1] == "Read this | now and then Nested part Same line same LINE"
    assert lines[2:] == ["Nested part", "Same line"]
    assert html.page_title(parsed).first()["title"] == "T & x"
    weights = {(r["source"], r["text"]): r["weight"] for r in html.weighted_text(parsed).collect()}
    assert weights[("meta", "About it")] == 2.5 and weights[("h1", "Main head")] == 3.0


def test_cluster_keywords(spark):
    words = [f"villa design {i}" for i in range(10)] + [f"office lease {i}" for i in range(10)]
    kw = spark.createDataFrame([(w,) for w in words], "keyword string")
    out = clustering.cluster_keywords(kw, restarts=2)
    assert out.count() == 20 and out.filter("cluster is null").isEmpty()
    assert clustering.choose_k(3, 8) == 3 and clustering.choose_k(500, 2) == 6


def test_word_vectors_at_full_width(spark, tmp_path, monkeypatch):
    kw = spark.createDataFrame([(f"{w} villa",) for w in ("red", "blue", "green")] + [("the",)], "keyword string").coalesce(1)
    monkeypatch.setattr(queries.inputs, "keywords", lambda *_: kw)
    got = {(r.keyword, r.word): r.weight for r in queries.REGISTRY["g1_vectorize"](spark, str(tmp_path)).collect()}
    rare, common = np.log(5 / 2) + 1, np.log(5 / 4) + 1
    norm = float(np.hypot(rare, common))
    want = {(f"{w} villa", x): float(v) / norm for w in ("red", "blue", "green") for x, v in ((w, rare), ("villa", common))}
    assert got.pop(("the", None)) is None and got == pytest.approx(want, abs=2e-6)


def test_cluster_queries_search_the_whole_range(spark, tmp_path, monkeypatch):
    rows = [(i, [float(i == 0), 1.0], 0) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    fits, tried = kmeans.fit, []
    monkeypatch.setattr(kmeans, "fit", lambda v, ks, restarts, seed: tried.append((list(ks), restarts)) or fits(v, ks, 1, seed, 1))
    queries.REGISTRY["g2_select_k"](spark, str(tmp_path))
    queries.REGISTRY["g3_cluster_keywords"](spark, str(tmp_path))
    assert tried == [(list(range(4, 16)), 10), ([2], 10)]


def test_files_and_ledger(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "One.TXT").write_text("hello\nworld")
    (tmp_path / "docs" / "skip.csv").write_text("x")
    (tmp_path / "urls").write_text("http://a\n\n http://b \n")
    assert [(r["title"], r["text"]) for r in scan_text_dir(spark, str(tmp_path / "docs")).collect()] == [("One", "hello\nworld")]
    assert [r["url"] for r in scan_url_list(spark, str(tmp_path / "urls")).collect()] == ["http://a", "http://b"]
    rows = assembly.validate_schema(spark.createDataFrame([("a b", "C")], "keyword string, cluster string")).drop("errors")
    sinks.write_keywords(rows, str(tmp_path / "out.json"), str(tmp_path / "out.csv"))
    assert read_keyword_json(spark, str(tmp_path / "out.json"), "c").count() == 1
    sinks.write_run(rows, str(tmp_path / "runs"), "20260101000000")
    ledger.save_stage(rows, str(tmp_path / "l"), "r1", "scan", "v1")
    ledger.save_stage(rows.limit(0), str(tmp_path / "l"), "r1", "scan", "v2")
    assert ledger.load_stage(spark, str(tmp_path / "l"), "r1", "scan").count() == 0


def test_pipeline_smoke(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", f"d{i}", t) for i, t in enumerate((
            "Espresso machines brew rich espresso coffee at home.",
            "How to clean espresso machines and grind coffee beans.",
            "Best espresso coffee beans for home brewing guide."))],
        "url string, title string, text string",
    )
    plan = KeywordPlan(seed="espresso machines", filter_unvalidated=False, unvalidated_penalty=0.0)
    items = plan.run(docs)["items"].collect()
    assert items and all(r["keyword"] == r["keyword"].lower() for r in items)
    assert all(0.0 <= r["opportunity_score"] <= 1.0 for r in items)
    pairs = [(r["cluster"], r["keyword"]) for r in items]
    assert len(pairs) == len(set(pairs))


def test_interrupted_run_resumes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(
        [(f"d{i}", f"d{i}", t) for i, t in enumerate((
            "Espresso machines brew rich espresso coffee at home.",
            "How to clean espresso machines and grind coffee beans.",
            "Best espresso coffee beans for home brewing guide."))],
        "url string, title string, text string",
    )
    plan = KeywordPlan(seed="espresso machines", filter_unvalidated=False, unvalidated_penalty=0.0)
    want = sorted(map(str, plan.run(docs)["items"].collect()))
    run = ledger.ResumableRun(spark, str(tmp_path), "r1", inputs="v1")
    score = metrics.score_candidates

    def broken(*args, **kwargs):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as lost:
        lost.setattr(metrics, "score_candidates", broken)
        with pytest.raises(RuntimeError):
            plan.run(docs, resume=run)
    done = ledger.completed_stages(ledger.stage_latest(ledger.read_stages(spark, str(tmp_path)))).first()
    assert done["stages"] == ["found", "terms", "candidates", "clustered", "flagged"]
    with monkeypatch.context() as again:  # what is done is not done again
        for name in ("extract_candidates", "keyword_freq"):
            again.setattr(candidates, name, broken)
        again.setattr(clustering, "cluster_keywords", broken)
        assert sorted(map(str, plan.run(docs, resume=run)["items"].collect())) == want
        again.setattr(metrics, "score_candidates", broken)
        assert sorted(map(str, plan.run(docs, resume=run)["items"].collect())) == want
        with pytest.raises(RuntimeError):  # other inputs, other signatures
            plan.run(docs, resume=ledger.ResumableRun(spark, str(tmp_path), "r1", inputs="v2"))
    assert metrics.score_candidates is score
    wanted = [("found", "x"), ("new", "y")]
    assert {r.stage_name for r in ledger.pending_stages(ledger.read_stages(spark, str(tmp_path)), "r1", wanted).collect()} == {"found", "new"}


def test_json_array_of_many_partitions(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('q"\n'), F.col("id"))).alias("t")).repartition(7).orderBy("id")
    sinks.write_json_array(rows.where("id % 100 < 50"), str(tmp_path / "out.json"))
    told = json.loads((tmp_path / "out.json").read_text())
    assert told == [{"id": i, "t": f'q"\n{i}' if i % 3 else None} for i in range(1000) if i % 100 < 50]
    sinks.write_json_array(rows.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["none.json", "out.json"]
    assert read_keyword_json(spark, str(tmp_path / "none.json")).count() == 0


def test_grammar_by_tags(spark):
    phrases = {
        "villa wall roof garden": "NOUN NOUN NOUN NOUN", "villa wall big garden": "NOUN NOUN ADJ NOUN", "for wall roof garden pool": "ADP NOUN NOUN NOUN NOUN",
        "into villa": "SCONJ NOUN", "the villa": "DET NOUN", "top villa wall roof garden": "X NOUN NOUN NOUN NOUN", "und villa": "X NOUN", "villa": "CCONJ",
        "villa wall roof xx": "NOUN NOUN NOUN X", "villa wall": "NOUN NOUN",
    }
    tags = [(k, i, w, p, "DT" if w == "the" else "IN" if w == "into" else "NN" if p == "NOUN" else "FW")
            for k, line in phrases.items() for i, (w, p) in enumerate(zip(k.split(), line.split(), strict=True))]
    table = spark.createDataFrame(tags, "keyword string, position int, token string, pos string, tag string").repartition(3)
    kw = spark.createDataFrame([(k,) for k in [*phrases, "no tags here", "and so on"]], "keyword string")
    got = {r.keyword for r in candidates.grammar_checked(kw, table, invalid_starts=("und", "and")).where("grammar_invalid").collect()}
    assert got == {"villa wall roof garden", "into villa", "the villa", "und villa", "and so on", "villa wall roof xx"}


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_run_over_parts(spark, seed):
    rng = random.Random(seed)
    rows = [(c, s, p, " ".join(rng.choices(["red", "villa", "wall", "x", "the", "pool"], k=rng.choice([0, 1, 1, 2, 3, 5]))))
            for c in "ab" for s in ("mine", "theirs") for p in range(9)]
    texts = spark.createDataFrame(rows, "comparison_id string, side string, part int, text string").repartition(4)
    got = {(r.comparison_id, r.term): (r.mine, r.theirs) for r in information.term_weights(texts, None, ("the",)).collect()}
    want = {}
    for c in "ab":
        counts = []
        for side in ("mine", "theirs"):
            words = [w for r in rows if r[:2] == (c, side) for w in r[3].split() if len(w) > 1 and w != "the"]
            counts.append(Counter(" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))
        for term in {*counts[0], *counts[1]}:
            weigh = 1 if term in counts[0] and term in counts[1] else np.log(1.5) + 1
            want[c, term] = tuple(float(k[term] * weigh) for k in counts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    told = information.information_gain(texts, None, None, ("the",), None).collect()
    assert all(sorted(r.common_concepts) == sorted(t for (c, t), (m, y) in want.items() if c == r.comparison_id and m and y) for r in told)


def test_batches_and_numbers(spark):
    kw = spark.createDataFrame([(f"k{i:04d}",) for i in range(505)], "keyword string").repartition(6)
    got = {r.keyword: r.batch_id for r in responses.keyword_batches(kw, 50).collect()}
    assert got == {f"k{i:04d}": i // 50 for i in range(505)}
    none = seed_document(spark.createDataFrame([], "url string, title string, text string"), "a b", "c, ,d", "en", "ae").collect()
    assert [tuple(r) for r in none] == [("seed", "a b", "a b\nc\nd\nen ae")]


def test_pages_with_many_links_cost_in_proportion(spark):
    body = "".join(f'<p>word {i} <a href="/{i}">link number {i}</a></p>' for i in range(10_000))
    page = spark.createDataFrame([(1, "u", f"<div>{body}</div>")], "page_id long, url string, html string")
    parsed = html.parse_pages(page)
    box = html.link_density(parsed).collect()
    linked = sum(len(f"link number {i}") for i in range(10_000))
    words = sum(len(f"word {i}") for i in range(10_000))
    assert [(r["chars"], round(r["density"], 9)) for r in box] == [(linked + words, round(linked / (linked + words), 9))]
    assert html.content_blocks(parsed).count() == 20_001


def test_keyword_json_in_every_layout(spark, tmp_path):
    (tmp_path / "lines").write_text('{"keyword": "a b", "cluster": "C"}\n\n{"keyword": "c d", "cluster": "e"}\n')
    (tmp_path / "array").write_text('[\n {"keyword": "a b",\n "cluster": "C"},\n {"keyword": "c d", "cluster": "e"}\n]\n')
    (tmp_path / "one").write_text('[{"keyword": "a b", "cluster": "C"}, {"keyword": "c d", "cluster": "e"}]')
    (tmp_path / "none").write_text("")
    for name in ("lines", "array", "one"):
        assert sorted(r["keyword"] for r in read_keyword_json(spark, str(tmp_path / name)).collect()) == ["a b", "c d"]
        assert read_keyword_json(spark, str(tmp_path / name), "c").count() == 1
    assert read_keyword_json(spark, str(tmp_path / "none")).count() == 0


def test_suggestions_are_opened_into_phrases_of_their_probe_only(spark, monkeypatch):
    kw = spark.createDataFrame(
        [(k, 1) for k in ("Red Villa design", "red villa", "villa design", "design cost", "Blue  Door handle", "red", None, "")], "keyword string, freq int"
    )
    stored = [
        ("Red Villa", "red villa design cost"), ("red villa", "the red villa x"), ("villa design", "red villa design"),
        ("design cost", "red villa design"), ("Blue Door", "blue  door handle set"), ("red", "red. villa"), (None, "red"),
    ]
    hints = spark.createDataFrame([(q, "en", "ae", s) for q, s in stored], "query string, lang string, country string, suggestion string")
    opened = []
    explode = F.explode
    monkeypatch.setattr(assembly.F, "explode", lambda c: opened.append(c) or explode(c))
    found = assembly.validate_with_suggestions(kw, hints, "ae")
    hits = {r["keyword"] for r in found.collect() if r["validated"]}
    assert hits == {"Red Villa design", "red villa", "villa design", "Blue  Door handle", "red"} and opened
    # what the shuffle is given: phrases that some keyword under the probe can be
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "phrase" in plan.split("Generate")[0]


def test_gap_report_reads_its_rankings_once(spark):
    scans = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            scans.add(1)
            yield batch

    kw = spark.createDataFrame([("red villa", "red", 0.8, 0.2, True), ("blue door", "blue", 0.7, 0.3, False)],
                               "keyword string, cluster string, opportunity_score double, difficulty double, validated boolean")
    rivals = spark.createDataFrame([("a", "Red villa"), ("a", "red villa"), ("b", "green roof")], "competitor string, keyword string").coalesce(1)
    report = gaps.gap_report(kw, rivals.mapInArrow(rows, rivals.schema))
    assert report["summary"].collect()[0]["gap_count"] == 2
    overlap = {r["competitor"]: (r["overlap_count"], r["unique_to_them_count"]) for r in report["competitor_analysis"].collect()}
    assert overlap == {"a": (1, 0), "b": (0, 1)} and scans.value == 1
