"""Text normalisation, tokens and n-grams as Columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space and word characters, spelled out because Java's \s and \w are ASCII
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_array(values: Iterable[str]) -> Column:
    """A constant string array; written as one literal, it folds when the plan is made."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\u001f".join(values)), "\u001f")


def java_pattern(pattern: str) -> str:
    """Write a Python-style pattern for Java: ``\\b`` becomes a Unicode boundary.

    Next to a literal letter or digit only the other side is looked at.
    """
    pattern = re.sub(r"(?<!\\)\\b(?=[A-Za-z0-9])(?!\w[?*{])", lambda _: rf"(?<!{WORD})", pattern)
    pattern = re.sub(r"(?<=[^\\][A-Za-z0-9])\\b", lambda _: rf"(?!{WORD})", pattern)
    return pattern.replace(r"\b", BOUNDARY)


def any_pattern(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{java_pattern(p)})" for p in patterns)


def alternatives(terms: Iterable[str]) -> str:
    return "|".join(re.escape(t).replace(r"\ ", " ") for t in terms)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda passed to ``transform`` or ``filter`` re-evaluates every outer expression it
    mentions for each element; binding it as a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column | str) -> Column:
    return F.regexp_replace(as_col(col), rf"^{SPACE}+|{SPACE}+$", "")


def words(col: Column | str) -> Column:
    """Whitespace-separated words; a blank string gives an empty array.

    White space is unified first: splitting on one plain character needs no regex.
    """
    return F.filter(F.split(F.regexp_replace(as_col(col), rf"{SPACE}+", " "), " "), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def clean_text(col: Column | str, remove_digits: bool = False) -> Column:
    """Lower-case and reduce every run of non-word characters to one space."""
    keep = r"[^\p{L}\p{Nl}\p{No}_]+" if remove_digits else rf"{NON_WORD}+"
    return F.trim(F.regexp_replace(F.lower(as_col(col)), keep, " "))


def tokenize(col: Column | str, stopwords: Iterable[str]) -> Column:
    return F.filter(words(col), lambda w: ~w.isin(*stopwords))


def sentence_pieces(col: Column | str) -> Column:
    """Newlines are hard boundaries; inside a line split after ``. ! ?`` and space."""
    return F.split(as_col(col), rf"\n|(?<=[.!?]){SPACE}+")


def sentences(col: Column | str) -> Column:
    return F.filter(F.transform(sentence_pieces(col), strip), lambda s: s != "")


def content_sentences(col: Column | str) -> Column:
    """Cleaned sentences of three or more raw words, as an array.

    The whole text is lower-cased once; case plays no part in splitting.
    """
    kept = F.filter(sentence_pieces(F.lower(as_col(col))), three_words)
    return F.transform(kept, lambda s: F.trim(F.regexp_replace(s, rf"{NON_WORD}+", " ")))


def has_content(col: Column | str) -> Column:
    """True when a text has a sentence of three or more words."""
    return F.exists(sentence_pieces(col), three_words)


def _longest_first(phrases: Iterable[str]) -> list[str]:
    return sorted(phrases, key=len, reverse=True)


def protect_phrases(col: Column | str, phrases: Iterable[str], lowered: bool = False) -> Column:
    """Join listed phrases with underscores: longest first, no word boundary needed.

    ``lowered`` says that the text is lower case, which saves folding case in the match.
    """
    text = as_col(col)
    phrases = _longest_first(phrases)
    if not phrases:
        return text
    found = f"({alternatives(phrases)})" if lowered else f"(?i)({alternatives(phrases)})"
    present = contains_any(text, phrases) if lowered else text.rlike(found)
    joined = _rewrite_matches(text, found, lambda p: F.translate(p, " ", "_"))
    return F.when(present, joined).otherwise(text)


def _rewrite_matches(text: Column, found: str, rewrite) -> Column:
    """Apply ``rewrite`` to every match of a one-group pattern."""
    pieces = F.split(F.regexp_replace(text, found, "\u0001$1\u0002"), "[\u0001\u0002]")
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 1, rewrite(p)).otherwise(p)), ""
    )


def restore_phrases(col: Column | str, phrases: Iterable[str]) -> Column:
    """Inverse of :func:`protect_phrases`; a restored phrase comes back in lower case."""
    text = as_col(col)
    joined = [p.replace(" ", "_") for p in _longest_first(phrases)]
    if not joined:
        return text
    found = f"(?i)({alternatives(joined)})"
    restored = _rewrite_matches(text, found, lambda p: F.lower(F.translate(p, "_", " ")))
    return F.when(text.contains("_"), restored).otherwise(text)


def gram_tokens(clean: Column | str) -> Column:
    """Tokens that take part in n-grams: two or more characters."""
    return F.filter(F.split(as_col(clean), " "), lambda t: F.length(t) >= 2)


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of ``lo`` to ``hi`` tokens, joined by one space."""

    def of_length(toks: Column, n: int) -> Column:
        if n == 1:
            return toks
        starts = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(0)))

        def gram(first: Column, i: Column) -> Column:
            rest = [part for k in range(1, n) for part in (F.lit(" "), F.get(toks, i + k))]
            return F.concat(first, *rest)

        return F.transform(starts, gram)

    return let(tokens, lambda t: F.concat(*[of_length(t, n) for n in range(lo, hi + 1)]))


def edge_stopword(gram: Column | str, stopwords: Iterable[str]) -> Column:
    """True when the first or the last word of a single-spaced n-gram is a stopword."""
    text = as_col(gram)
    stop = list(stopwords)
    return F.substring_index(text, " ", 1).isin(stop) | F.substring_index(text, " ", -1).isin(stop)


def three_words(text: Column) -> Column:
    """A text has three or more words."""
    solid = r"[^\s\p{Z}\x1c-\x1f\x85]"
    return text.rlike(f"{solid}{SPACE}+{solid}+{SPACE}+{solid}")


def title_case(col: Column | str) -> Column:
    """Each run of letters in title case, also after digits, hyphens and apostrophes."""
    runs = F.regexp_extract_all(as_col(col), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def contains_any(col: Column, terms: Iterable[str]) -> Column:
    """Raw substring test against a short list."""
    found = F.lit(False)
    for term in terms:
        found = found | col.contains(term)
    return found


def has_token(tokens: Column, terms: Iterable[str]) -> Column:
    terms = list(terms)
    return F.arrays_overlap(tokens, literal_array(terms)) if terms else F.lit(False)


def one_spaced(col: Column | str) -> Column:
    """The words of a text, one space apart: ``words`` without making an array."""
    return F.trim(F.regexp_replace(as_col(col), rf"{SPACE}+", " "))


def has_word(text: Column, terms: Iterable[str]) -> Column:
    """``has_token`` on a :func:`one_spaced` text; a term of several words is never a token."""
    fenced = F.concat(F.lit(" "), text, F.lit(" "))
    return contains_any(fenced, [f" {t} " for t in terms if t and " " not in t])


def starts_with_any(col: Column, terms: Iterable[str], suffix: str = "") -> Column:
    return col.rlike(f"^(?:{alternatives(terms)}){suffix}")


def first_match(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """First value whose condition holds, else null."""
    return F.coalesce(*[F.when(cond, value) for cond, value in pairs], F.lit(None))


def compact(*values: Column) -> Column:
    """Array of the non-null values, in order."""
    return F.array_compact(F.array(*values))


def clamp(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col))


def fixed(col: Column, digits: int) -> Column:
    """Decimal string rounded half-even on the exact value, as ``'%.nf'`` prints it."""
    shape = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col, F.lit(shape))


def rounded(col: Column, digits: int) -> Column:
    return fixed(col, digits).cast("double")


def replace_slots(template: Column, **slots: Column) -> Column:
    """Fill ``{name}`` slots of a template string."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
