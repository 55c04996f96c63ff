from pyspark.sql import functions as F

from kwloom.functions import answers, bilingual, classify, filters, scoring
from kwloom.functions import text as tx
from kwloom.functions.entities import extract_entities
from kwloom.functions.stemming import stem_word


def test_clean_text_and_title(evaluate):
    texts = ("  Été -- 3D_print! Now ", "")
    assert evaluate(tx.clean_text("t"), *texts) == ["été 3d_print now", ""]
    assert evaluate(tx.title_case("t"), "abu-dhabi 3d o'neil") == ["Abu-Dhabi 3D O'Neil"]


def test_sentences_and_protected_phrases(evaluate):
    assert evaluate(tx.sentences("t"), "One. Two?\n\n Three") == [["One.", "Two?", "Three"]]
    phrases = ("abu dhabi", "near me")
    protected = tx.protect_phrases("t", phrases)
    assert evaluate(protected, "Villas Abu Dhabi near me") == ["Villas Abu_Dhabi near_me"]
    assert evaluate(tx.restore_phrases(protected, phrases), "in Abu Dhabi") == ["in abu dhabi"]


def test_phrase_rules(evaluate):
    bad = (
        "2024", "january 2024", "q1 2023", "2023-2024", "march", "skip to content", "read more",
        "services in", "company for", "very good", "is the", "", "   ",
    )
    good = (
        "home renovation services", "Dubai contractors", "best plumbing company", "contractor",
        "waterproofing solutions",
    )
    assert all(evaluate(filters.phrase_invalid("t"), *bad))
    assert not any(evaluate(filters.phrase_invalid("t"), *good))


def test_other_filters(evaluate):
    assert evaluate(filters.scraping_artifact("t"), "en ae", "contractors in uae", "villa login", "villa design") == [
        True, False, True, False]
    assert evaluate(filters.stop_phrase("t"), "in dubai", "villa in dubai") == [True, False]
    assert evaluate(filters.numeric_noise("t"), "971 50", "villa 2 3", "villa 3") == [True, True, False]
    assert evaluate(filters.negative_sentiment("t"), "villa SCAM", "villa") == [True, False]
    assert evaluate(filters.grammar_invalid("t"), "vs villa", "villa vs flat") == [True, False]
    assert evaluate(filters.entity_conflict("t"), "dubai sharjah", "dubai to sharjah") == [True, False]
    assert evaluate(filters.near_me_fix("t"), "near me villas", "villas near me", "near me near me", "near me x") == [
        "villas near me", "villas near me", None, "x near me"]


def test_intent_and_formats(evaluate):
    assert [r["intent"] for r in evaluate(classify.intent("t", ["acme.com"]), "how to build", "best villa", "find villa", "acme villa", "villa")] == [
        "informational", "commercial", "transactional", "navigational", "informational"]
    assert evaluate(classify.query_type("t", "en-AE"), "what is mep", "villas or flats which", "x near me", "zz") == [
        "direct_answer", "comparative", "local", "complex_research"]
    assert evaluate(classify.topic_fallback("t"), "how to villa", "how to", "x") == ["villa", "how to", "x"]


def test_commercial_value_and_ctr(evaluate):
    def value(text, intent="informational", **kw):
        return evaluate(scoring.commercial_value("t", F.lit(intent), **kw), text)[0]

    assert value("buy villa dubai", "transactional") >= 0.6
    assert value("what is villa") <= 0.4
    assert value("villa contractors") > value("villa")
    for geo in ("ae", "sa", "qa", "kw", "bh", "om"):
        assert value("fit out project", geo=geo) > value("fit out project", geo="us")
    assert value("villa renovation", niche="contracting") > value("villa renovation")

    def ctr(text, intent):
        return evaluate(scoring.ctr_potential(scoring.serp_features("t", F.lit(intent))), text)[0]

    assert ctr("how to buy cheap furniture near me tutorial", "transactional") >= 0.2
    assert ctr("xyz123", "navigational") == 1.0
    assert ctr("contractors near me", "local") < 0.9


def test_stemmer():
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat",
        "conditional": "condit", "digitizer": "digit", "hopefulness": "hope", "formaliti": "formal",
        "triplicate": "triplic", "electrical": "electr", "revival": "reviv", "allowance": "allow",
        "adoption": "adopt", "effective": "effect", "rate": "rate", "controll": "control",
        "constructions": "construct", "construction": "construct", "dying": "die",
    }
    assert {w: stem_word(w) for w in pairs} == pairs


def test_places_and_bilingual(evaluate):
    e = evaluate(extract_entities("t"), "villa renovation in mussafah", "plain")
    assert (e[0]["emirate"], e[0]["district"], e[0]["is_contracting"]) == ("Abu Dhabi", "Mussafah", True)
    assert not e[1]["is_local"]
    out = evaluate(bilingual.expand_bilingual("t", whole_word_locations=True), "villa painting in dubai")[0]
    assert "فيلا painting in dubai" in out and "villa painting في dubai" in out
    assert not any("pa" + "في" in v for v in out)
    assert evaluate(bilingual.normalize_arabic("t"), "غرفةٌ أحمد") == ["غرفه احمد"]


def test_excerpt_and_trust(evaluate):
    assert evaluate(answers.citation_excerpt("t", 20), "short text", "A long first part. And more of it") == [
        "Short text", "A long first part."]
    s = evaluate(answers.trust_signals("t"), "Licensed and insured, 10 years of experience")[0]
    assert s["signals_found"] == ["Years of experience mentioned", "Licensed professional", "Insurance mentioned"]
