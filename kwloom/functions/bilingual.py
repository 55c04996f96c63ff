"""Arabic / English text as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx

ARABIC_CHARACTER = r"[؀-ۿݐ-ݿࢠ-ࣿ]"
ARABIZI_DIGIT = "[37529]"


def _terms(terms: tuple) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(en).alias("english"),
                F.lit(ar).alias("arabic"),
                tx.literal_array(dialect).alias("dialect"),
            )
            for en, ar, dialect in terms
        ]
    )


def _locations(locations: tuple) -> Column:
    return F.array(
        *[F.struct(F.lit(en).alias("english"), F.lit(ar).alias("arabic")) for en, ar in locations]
    )


def _padded(text: Column) -> Column:
    """Text whose words are all fenced by single spaces, for whole-word tests."""
    return F.concat(F.lit(" "), F.regexp_replace(text, rf"{tx.NON_WORD}+", " "), F.lit(" "))


def _mentions(text: Column, term: Column, whole_words: bool) -> Column:
    if not whole_words:
        return F.contains(text, term)
    return F.contains(_padded(text), F.concat(F.lit(" "), term, F.lit(" ")))


def _swap(text: Column, old: Column, new: Column, whole_words: bool) -> Column:
    if not whole_words:
        return F.replace(text, old, new)
    fenced = F.concat(
        F.lit(rf"(?<!{tx.WORD})\Q"), old, F.lit(rf"\E(?!{tx.WORD})")
    )
    return F.regexp_replace(text, fenced, new)


def arabic_equivalent(term: Column | str, terms: tuple = lx.BILINGUAL_TERMS) -> Column:
    table = F.create_map(*[F.lit(v) for en, ar, _ in terms for v in (en, ar)])
    return F.try_element_at(table, F.lower(tx.as_col(term)))


def english_equivalent(term: Column | str, terms: tuple = lx.BILINGUAL_TERMS) -> Column:
    back = {ar: en for en, ar, _ in terms}
    table = F.create_map(*[F.lit(v) for pair in back.items() for v in pair])
    return F.try_element_at(table, tx.as_col(term))


def detect_arabic(text: Column | str) -> Column:
    return tx.as_col(text).rlike(ARABIC_CHARACTER)


def detect_arabizi(text: Column | str) -> Column:
    """Latin text with a digit that stands for an Arabic letter."""
    return tx.as_col(text).rlike(ARABIZI_DIGIT)


def normalize_arabic(text: Column | str) -> Column:
    """Strip diacritics; unify final ta marbuta, alef forms and final alef maqsura."""
    out = F.regexp_replace(tx.as_col(text), r"[ً-ْٰ]", "")
    out = F.regexp_replace(out, f"ة(?!{tx.WORD})", "ه")
    out = F.regexp_replace(out, "[إأآا]", "ا")
    return F.regexp_replace(out, f"ى(?!{tx.WORD})", "ي")


def arabic_intent(text: Column | str, intents: tuple = lx.ARABIC_INTENTS) -> Column:
    col = tx.as_col(text)
    return tx.first_match((tx.contains_any(col, terms), F.lit(name)) for name, terms in intents)


def expand_bilingual(
    keyword: Column | str,
    terms: tuple = lx.BILINGUAL_TERMS,
    locations: tuple = lx.BILINGUAL_LOCATIONS,
    whole_word_locations: bool = False,
) -> Column:
    """Array of distinct variants: the keyword, its first term and every location swapped."""
    text = tx.as_col(keyword)
    kw = F.lower(text)

    def variants(k: Column) -> Column:
        first = F.slice(F.filter(_terms(terms), lambda t: F.contains(k, t["english"])), 1, 1)
        by_term = F.transform(
            first,
            lambda t: F.transform(
                F.concat(F.array(t["arabic"]), t["dialect"]),
                lambda s: F.replace(k, t["english"], s),
            ),
        )
        places = F.filter(
            _locations(locations), lambda p: _mentions(k, p["english"], whole_word_locations)
        )
        by_place = F.transform(
            places, lambda p: _swap(k, p["english"], p["arabic"], whole_word_locations)
        )
        return F.concat(F.flatten(by_term), by_place)

    return F.array_distinct(F.concat(F.array(text), tx.let(kw, variants)))


def bilingual_keywords(
    keyword: Column | str,
    terms: tuple = lx.BILINGUAL_TERMS,
    locations: tuple = lx.BILINGUAL_LOCATIONS,
    key_locations: tuple = lx.KEY_LOCATIONS,
    include_arabic: bool = True,
    include_dialects: bool = False,
    include_locations: bool = True,
) -> Column:
    """Array of structs: the base keyword, then one per key location."""
    known = dict(locations)

    def with_term(k: Column) -> Column:
        found = F.get(F.filter(_terms(terms), lambda t: F.contains(k["kw"], t["english"])), F.lit(0))
        return F.struct(k["text"].alias("text"), k["kw"].alias("kw"), found.alias("term"))

    def with_arabic(v: Column) -> Column:
        arabic = F.replace(v["kw"], v["term"]["english"], v["term"]["arabic"])
        return F.struct(v["text"].alias("text"), v["term"].alias("term"), arabic.alias("arabic"))

    def entries(v: Column) -> Column:
        text, arabic, term = v["text"], v["arabic"], v["term"]

        def entry(english: Column, arabic_text: Column, variants: Column, location: bool) -> Column:
            return F.struct(
                english.alias("english"),
                arabic_text.cast("string").alias("arabic"),
                variants.alias("dialect_variants"),
                F.lit(location).alias("is_location"),
                term.isNotNull().alias("is_construction"),
            )

        dialect = (
            F.coalesce(term["dialect"], tx.literal_array([]))
            if include_dialects
            else tx.literal_array([])
        )
        made = [entry(text, arabic, dialect, False)]
        for place in key_locations if include_locations else ():
            local = F.lit(None)
            if include_arabic and place in known:
                local = F.concat_ws(" ", F.coalesce(F.nullif(arabic, F.lit("")), text), F.lit(known[place]))
            made.append(entry(F.concat_ws(" ", text, F.lit(place)), local, tx.literal_array([]), True))
        return F.array(*made)

    text = tx.as_col(keyword)
    start = F.struct(text.alias("text"), F.lower(text).alias("kw"))
    return tx.let(tx.let(tx.let(start, with_term), with_arabic), entries)


def bilingual_query(
    query: Column | str,
    terms: tuple = lx.BILINGUAL_TERMS,
    locations: tuple = lx.BILINGUAL_LOCATIONS,
    intents: tuple = lx.ARABIC_INTENTS,
    whole_word_locations: bool = False,
) -> Column:
    """Language, Arabic intent, term and location hits and the first replacement."""
    text = tx.as_col(query)
    kw, arabic = F.lower(text), detect_arabic(text)
    lexicon = F.transform(
        _terms(terms), lambda t: F.struct(t["english"].alias("english"), t["arabic"].alias("arabic"))
    )
    # both sides normalised, so dictionary words ending in ta marbuta still match
    arabic_hits = tx.let(
        normalize_arabic(text),
        lambda n: F.filter(lexicon, lambda t: F.contains(n, normalize_arabic(t["arabic"]))),
    )
    english_hits = tx.let(kw, lambda k: F.filter(lexicon, lambda t: F.contains(k, t["english"])))
    hits = F.when(arabic, arabic_hits).otherwise(english_hits)
    first = F.get(hits, F.lit(0))
    nothing = F.lit(None).cast("string")
    places = tx.let(
        kw,
        lambda k: F.filter(
            _locations(locations), lambda p: _mentions(k, p["english"], whole_word_locations)
        ),
    )
    return F.struct(
        F.when(arabic, "arabic").otherwise("english").alias("primary_language"),
        (~arabic & detect_arabizi(text)).alias("is_arabizi"),
        F.when(arabic, arabic_intent(text, intents)).alias("arabic_intent"),
        F.when(arabic, F.replace(text, first["arabic"], first["english"]))
        .otherwise(nothing)
        .alias("english_equivalent"),
        F.when(~arabic, F.replace(kw, first["english"], first["arabic"]))
        .otherwise(nothing)
        .alias("arabic_equivalent"),
        hits.alias("construction_terms"),
        F.when(arabic, F.filter(places, lambda p: F.lit(False)))
        .otherwise(places)
        .alias("location_terms"),
    )
