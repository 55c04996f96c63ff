"""Keyword filters: each predicate is true when the keyword is to be dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx


def scraping_artifact(
    keyword: Column | str,
    codes: Iterable[str] = lx.MARKET_CODES,
    navigation: Iterable[str] = lx.NAVIGATION_EXACT,
    auth_terms: Iterable[str] = lx.AUTH_TERMS,
    switches: Iterable[str] = lx.LANGUAGE_SWITCHES,
    leads: Iterable[str] = lx.QUERY_LEADS,
    switch_codes: Iterable[str] = lx.SWITCH_CODES,
    prepositions: Iterable[str] = lx.CODE_PREPOSITIONS,
    artifact_tokens: Iterable[str] = lx.ARTIFACT_TOKENS,
) -> Column:
    kw = tx.strip(F.lower(tx.as_col(keyword)))
    parts = tx.words(kw)
    size = F.size(parts)
    code, auth = tx.alternatives(codes), tx.alternatives(auth_terms)
    pair, sp = tx.alternatives(switch_codes), tx.SPACE
    garbage = kw.rlike(
        f"^(?:{tx.alternatives(navigation)})$"
        f"|^(?:{auth}){sp}"
        f"|{sp}(?:{auth})$"
        f"|{tx.BOUNDARY}(?:{tx.alternatives(switches)}){tx.BOUNDARY}"
        f"|^(?:{tx.alternatives(leads)}){sp}+(?:{code})(?:{sp}|$)"
        f"|{sp}(?:{pair}){sp}(?:{pair})(?:{sp}|$)"
    )
    bare_code = kw.rlike(f"^(?:.*{sp})?(?:{code})$|^(?:{code}){sp}")
    after_preposition = (size >= 2) & F.get(parts, size - 2).isin(*prepositions)
    substantive = F.size(
        F.filter(parts, lambda w: (F.length(w) > 2) & ~w.isin(*artifact_tokens))
    )
    thin = substantive < F.when(size <= 2, 1).otherwise(2)
    return F.when(garbage, True).when(bare_code, ~after_preposition).otherwise(thin)


def stop_phrase(
    keyword: Column | str,
    prefixes: Iterable[str] = lx.STOP_PHRASE_PREFIXES,
    geo_tokens: Iterable[str] = lx.GEO_TOKENS,
    fillers: Iterable[str] = lx.STOP_PHRASE_FILLERS,
) -> Column:
    parts = tx.words(F.lower(tx.as_col(keyword)))
    empty = [*prefixes, *geo_tokens, *fillers]
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    only_geo = F.get(parts, F.lit(0)).isin(*prefixes) & F.forall(
        rest, lambda w: w.isin(*geo_tokens)
    )
    nothing_left = F.forall(parts, lambda w: w.isin(empty))
    return (F.size(parts) >= 2) & (only_geo | nothing_left)


def numeric_noise(keyword: Column | str) -> Column:
    kw = tx.as_col(keyword)
    parts = tx.words(kw)
    numeric = F.size(F.filter(parts, lambda w: w.rlike(r"^\p{Nd}+$")))
    return kw.rlike(r"^[\p{Nd}\s\p{Z}\x1c-\x1f\x85.-]+$") | (
        (F.size(parts) > 0) & (numeric * 2 > F.size(parts))
    )


def negative_sentiment(
    keyword: Column | str, terms: Iterable[str] = lx.NEGATIVE_TERMS
) -> Column:
    return tx.has_token(tx.words(F.lower(tx.as_col(keyword))), terms)


def grammar_invalid(
    keyword: Column | str,
    invalid_starts: Iterable[str] = lx.INVALID_STARTS,
    tags: Column | None = None,
    valid_starts: Iterable[str] = lx.VALID_STARTS,
    start_tags: Iterable[str] = lx.INVALID_START_TAGS,
    run_starts: Iterable[str] = lx.NOUN_RUN_STARTS,
    most_nouns: int = lx.MOST_NOUNS,
) -> Column:
    """A phrase must not open with a joining word, nor by its tags with one, nor be a pile of nouns.

    ``tags`` is an array of (token, pos, tag) in the order of the phrase; without it (null) only
    the first rule holds. Words not tagged as anything else than a noun count as nouns when
    they are plain letters and long enough.
    """
    parts = tx.words(F.lower(tx.as_col(keyword)))
    first = F.get(parts, F.lit(0))
    opens = first.isin(*invalid_starts)
    if tags is None:
        return (F.size(parts) >= 2) & opens

    def by_tags(t: Column) -> Column:
        head = F.get(t, F.lit(0))
        joins = head["pos"].isin("CCONJ", "SCONJ") | (head["tag"].isin(*start_tags) & ~head["token"].isin(*valid_starts))

        def noun(w: Column) -> Column:
            plain = w["token"].rlike(r"^\p{Ll}{4,}$") & ~w["pos"].isin(*lx.OTHER_THAN_NOUNS)
            return w["pos"].isin("NOUN", "PROPN") | w["tag"].isin(*lx.NOUN_TAGS) | plain

        nouns = F.size(F.filter(t, noun))
        content = F.size(F.filter(t, lambda w: ~w["pos"].isin("SPACE", "PUNCT")))
        built = F.exists(
            t,
            lambda w: ((w["pos"] == "VERB") & ~w["token"].isin("be", "is", "are"))
            | (w["pos"] == "ADJ")
            | ((w["pos"] == "ADP") & w["token"].isin(*lx.LINKING_PREPOSITIONS)),
        )
        piled = (nouns > most_nouns) & ~first.isin(*run_starts)
        nearly = (content > 3) & (nouns >= content - 1) & ~first.isin(*run_starts, *lx.PATTERN_STARTS)
        return joins | ((piled | nearly) & ~built)

    tagged = F.when(F.size(tags) > 0, tx.let(tags, by_tags)).otherwise(F.lit(False))
    return (F.size(parts) >= 2) & (opens | (~first.isin(*valid_starts) & F.coalesce(tagged, F.lit(False))))


def entity_conflict(
    keyword: Column | str,
    cities: Iterable[str] = lx.CONFLICT_CITIES,
    connectors: Iterable[str] = lx.CONFLICT_CONNECTORS,
) -> Column:
    kw = F.lower(tx.as_col(keyword))
    named = tx.let(
        kw, lambda k: F.size(F.filter(tx.literal_array(cities), lambda c: F.contains(k, c)))
    )
    return (named > 1) & ~kw.rlike(f" (?:{tx.alternatives(connectors)}) ")


def _phrase_count(kw: Column, phrase: str) -> Column:
    return F.regexp_count(kw, F.lit(tx.alternatives([phrase])))


def near_me_valid(keyword: Column | str, phrase: str = "near me") -> Column:
    kw = tx.strip(F.lower(tx.as_col(keyword)))
    count = _phrase_count(kw, phrase)
    return (count == 0) | ((count == 1) & kw.endswith(phrase))


def near_me_fix(keyword: Column | str, phrase: str = "near me") -> Column:
    """Move a misplaced phrase to the end; null when nothing sensible is left."""
    original = tx.as_col(keyword)
    kw = tx.strip(F.lower(original))
    rest = tx.strip(F.replace(kw, F.lit(phrase), F.lit("")))
    return (
        F.when(_phrase_count(kw, phrase) > 1, F.lit(None).cast("string"))
        .when(near_me_valid(original, phrase), original)
        .when(rest == "", F.lit(None).cast("string"))
        .otherwise(F.concat_ws(" ", rest, F.lit(phrase)))
    )


def phrase_invalid(
    keyword: Column | str,
    navigation: Iterable[str] = lx.NAVIGATION_PHRASES,
    prepositions: Iterable[str] = lx.DANGLING_PREPOSITIONS,
    common_words: Iterable[str] = lx.COMMON_WORDS,
    temporal_names: Iterable[str] = lx.TEMPORAL_NAMES,
    has_noun: Column | None = None,
) -> Column:
    """Linguistic check; ``has_noun`` replaces the common-word rule when tags exist."""
    kw = tx.strip(F.lower(tx.as_col(keyword)))
    parts = tx.words(kw)
    names, year = list(temporal_names), r"\p{Nd}{4}"
    first = F.get(parts, F.lit(0))
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    temporal = (
        first.isin(names) | first.rlike(f"^(?:{year}|q[1-4]|{year}-{year})$")
    ) & F.forall(rest, lambda w: w.isin(names) | w.rlike(f"^{year}$"))
    weak = (
        (F.size(parts) > 1) & F.forall(parts, lambda w: w.isin(*common_words))
        if has_noun is None
        else ~has_noun
    )
    return F.coalesce(
        (kw == "")
        | kw.rlike(r"^\p{Nd}+$")
        | temporal
        | kw.isin(*navigation)
        | F.element_at(parts, -1).isin(*prepositions)
        | weak,
        F.lit(True),
    )


def basic_filter(
    keyword: Column | str,
    blacklist: Iterable[str] = (),
    min_words: int = 2,
    max_words: int = 6,
    min_chars: int = 5,
    **phrase_options,
) -> Column:
    """True when the keyword passes black list, length and phrase checks."""
    kw = tx.as_col(keyword)
    size = tx.word_count(kw)
    return (
        ~tx.contains_any(F.lower(kw), [b.lower() for b in blacklist])
        & size.between(min_words, max_words)
        & (F.length(kw) >= min_chars)
        & ~phrase_invalid(kw, **phrase_options)
    )


def is_question(keyword: Column | str, leads: Iterable[str] = lx.QUESTION_LEADS) -> Column:
    return tx.starts_with_any(F.lower(tx.as_col(keyword)), leads, " ")


def entirely_universal(keyword: Column | str, terms: Iterable[str] = lx.UNIVERSAL_TERMS) -> Column:
    """Every token is in a short fixed term list (see ``operators.universal`` for tables)."""
    parts = tx.words(F.lower(tx.as_col(keyword)))
    return (F.size(parts) > 0) & F.forall(parts, lambda w: w.isin(*terms))
