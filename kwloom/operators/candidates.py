"""From documents to candidate keywords."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import classify, filters
from kwloom.functions import text as tx
from kwloom.functions.stemming import stem_key
from kwloom.operators.common import cut_lineage, exploded, first_by, top_per_group
from kwloom.operators.grams import HashFilter, Tokens, counted, gram_rows, hash_counts, hash_filter, token_hashes

ORDER = "struct<origin:int,major:double,minor:string>"


def order_key(origin: int, major: Column, minor: Column) -> Column:
    """Explicit list position: source first, then rank, then text."""
    return F.struct(
        F.lit(origin).alias("origin"),
        major.cast("double").alias("major"),
        minor.cast("string").alias("minor"),
    )


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sentence with its position in the document."""
    return docs.select(
        id_col, F.posexplode(tx.sentences(text_col)).alias("sent_no", "sentence")
    )


def clean_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Cleaned sentences of two or more words."""
    return exploded(docs, tx.content_sentences(text_col), "sentence").filter(
        F.col("sentence").contains(" ")
    )


def _grams(sentence: Column, lo: int, hi: int, phrases: Iterable[str]) -> Column:
    return tx.ngrams(tx.gram_tokens(tx.protect_phrases(sentence, phrases, lowered=True)), lo, hi)


def ngram_counts(
    sentences: DataFrame,
    ngram_range: tuple[int, int] = (2, 3),
    min_df: int = 2,
    phrases: Iterable[str] = lx.PROTECTED_PHRASES,
    stopwords: Iterable[str] = lx.ENGLISH_STOPWORDS,
) -> DataFrame:
    """(ngram, count, df): occurrences and sentences of each n-gram with a content edge.

    Hashes are counted first; only n-grams whose hash is in ``min_df`` sentences become strings
    and are counted, exactly, by string. N-grams that open or close with a stopword go before.
    """
    text = cut_lineage(sentences.select(tx.protect_phrases("sentence", phrases, lowered=True).alias("_text")))
    stop = np.sort(token_hashes(stopwords))

    def content(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, size, h = tokens.grams(*ngram_range)
        kept = ~tokens.edges_in(first, size, stop)
        return first[kept], size[kept], h[kept]

    def by_hash(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        first, _, h = content(tokens)
        at, _, df = counted(h, tokens.row[first])
        return h[at], df

    wanted = None
    if min_df > 1:
        wanted = hash_filter(cut_lineage(hash_counts(text, "_text", by_hash, min_df).select("h")))

    def by_string(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        first, size, h = content(tokens)
        if wanted is not None:
            hit = wanted.passes(h)
            first, size, h = first[hit], size[hit], h[hit]
        at, count, df = counted(h, tokens.row[first])
        return {"gram": tokens.text(first[at], size[at]), "count": count, "df": df}

    strings = gram_rows(text, "_text", by_string, "gram string, count long, df long").groupBy("gram").agg(
        F.sum("count").alias("count"), F.sum("df").alias("df")
    )
    # a protected phrase may itself open or close with a stopword once it is restored
    return strings.filter(F.col("df") >= min_df).select(
        tx.restore_phrases("gram", phrases).alias("ngram"), "count", "df"
    ).filter(~tx.edge_stopword("ngram", stopwords))


def counted_ngrams(
    sentences: DataFrame, ngram_range: tuple[int, int], min_df: int, phrases: Iterable[str], stopwords: Iterable[str]
) -> DataFrame:
    """``ngram_counts`` with ``min_df`` as the corpus allows.

    Fewer sentences than ``min_df`` lower it to their number; if then no n-gram at all reaches
    it, every n-gram counts.
    """
    least = min(min_df, max(1, sentences.limit(min_df).count()))
    grams = cut_lineage(ngram_counts(sentences, ngram_range, least, phrases, stopwords))
    if least == 1 or not grams.isEmpty():
        return grams
    every = exploded(sentences, F.array_distinct(_grams(F.col("sentence"), *ngram_range, phrases)), "gram")
    if every.groupBy("gram").count().where(F.col("count") >= least).isEmpty():
        return ngram_counts(sentences, ngram_range, 1, phrases, stopwords)
    return grams


def _first_of(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where each hash of each group occurs first, in rising order."""
    order = np.lexsort((hashes, group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (group[order][1:] != group[order][:-1])
    return np.sort(order[new])


def with_phrases(docs: DataFrame, n: int = 2, text_col: str = "text", out: str = "keywords") -> DataFrame:
    """``docs`` with the distinct ``n``-token phrases of the cleaned text, in order, in its place."""
    rest = [c for c in docs.columns if c != text_col]
    cleaned = docs.select(*rest, tx.clean_text(text_col).alias("_text"))

    def lists(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        first, size, h = tokens.grams(n, n)
        at = _first_of(h, tokens.row[first])
        held = np.bincount(tokens.row[first[at]], minlength=batch.num_rows)
        ends = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
        phrases = tokens.text(first[at], size[at])
        return {c: batch.column(c) for c in rest} | {
            out: pa.ListArray.from_arrays(ends, phrases, mask=batch.column("_text").is_null())
        }

    kinds = [f"`{c}` {cleaned.schema[c].dataType.simpleString()}" for c in rest]
    return gram_rows(cleaned, "_text", lists, ", ".join([*kinds, f"`{out}` array<string>"]))


def key_phrases(docs: DataFrame, key_col: str, n: int = 2, text_col: str = "text", out: str = "keyword") -> DataFrame:
    """(key, phrase): distinct ``n``-token phrases of each key's cleaned texts.

    Phrases are told apart by hash inside a chunk of text, then by string.
    """
    cleaned = docs.select(F.col(key_col), tx.clean_text(text_col).alias("_text"))

    def distinct(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        first, size, h = tokens.grams(n, n)
        keys = batch.column(key_col)
        code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[tokens.row[first]]
        at = _first_of(h, code)
        return {"key": keys.take(pa.array(tokens.row[first[at]])), "phrase": tokens.text(first[at], size[at])}

    kind = cleaned.schema[key_col].dataType.simpleString()
    rows = gram_rows(cleaned, "_text", distinct, f"key {kind}, phrase string")
    return rows.distinct().select(F.col("key").alias(key_col), F.col("phrase").alias(out))


def _leading(tokens: Tokens, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of n-grams as numbers in the order of the strings."""
    begin, length = tokens.start[first], tokens.end[first + size - 1] - tokens.start[first]
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(8):
        byte = tokens.data[begin + np.minimum(k, length - 1)]
        out = (out << np.uint64(8)) | np.where(k < length, byte, 0).astype(np.uint64)
    return out


def _contenders(
    tokens: Tokens, ngram_range: tuple[int, int], shared: HashFilter, weights: tuple[float, float], n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first token, size, hash, tf) of the terms that can be among the best ``n`` of their row.

    A term whose hash no other row has weighs tf times the first of ``weights``, which is known
    here. Any other weighs tf times the second at most, or, if the filter only seems to know it,
    as much as the first kind. The n-th best of that kind is a bound that most others stay under.
    """
    first, size, h = tokens.grams(*ngram_range)
    row = tokens.row[first]
    order = np.lexsort((h, row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    start = np.flatnonzero(new)
    at, tf = order[start], np.diff(np.append(start, len(order)))
    first, size, h, row = first[at], size[at], h[at], row[at]
    alone = ~shared.passes(h)
    own = np.flatnonzero(alone)
    lead = _leading(tokens, first[own], size[own])
    ranked = own[np.lexsort((lead, -tf[own], row[own]))]
    lead = _leading(tokens, first[ranked], size[ranked])
    begin = np.searchsorted(row[ranked], row[ranked], side="left")
    place = np.arange(len(ranked)) - begin
    last = np.flatnonzero(place == n - 1)  # of each row with so many
    rows = int(row.max(initial=-1)) + 1
    least, before = np.zeros(rows), np.full(rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    least[row[ranked[last]]], before[row[ranked[last]]] = tf[ranked[last]], lead[last]
    keep = np.zeros(len(h), dtype=bool)
    level = (tf[ranked] == least[row[ranked]]) & (lead <= before[row[ranked]])  # strings decide
    keep[ranked[(place < n) | level]] = True
    others = np.flatnonzero(~alone)
    bound = least[row[others]]
    high = tf[others] * weights[1] >= bound * weights[0] * (1 - 1e-9)
    seeming = (tf[others] > bound) | ((tf[others] == bound) & (_leading(tokens, first[others], size[others]) <= before[row[others]]))
    keep[others[high | seeming]] = True
    return row[keep], first[keep], size[keep], h[keep], tf[keep]


def tfidf_top_terms(
    docs: DataFrame,
    k: int = 10,
    ngram_range: tuple[int, int] = (2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Iterable[str] = lx.PROTECTED_PHRASES,
    stopwords: Iterable[str] = lx.ENGLISH_STOPWORDS,
) -> DataFrame:
    """(id, term, weight, rank): best ``2k`` terms of each document, then the edge filter.

    The per-document norm does not change a document's own order and is left out. Documents are
    read once, for their cleaned text. Its n-grams are counted by hash; a document's terms are
    then cut to those that can still be among its best, and only these look up their frequency.
    N-grams are told apart by 64 bits when documents are counted.
    """
    kept = docs.filter(tx.has_content(text_col))
    joined = F.array_join(tx.content_sentences(text_col), " ")
    body = cut_lineage(kept.select(id_col, tx.protect_phrases(joined, phrases, lowered=True).alias("_text")))
    total = body.count()

    def by_hash(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        first, _, h = tokens.grams(*ngram_range)
        at, _, df = counted(h, tokens.row[first])
        return h[at], df

    shared = cut_lineage(hash_counts(body, "_text", by_hash, 2))
    known = hash_filter(shared)
    weights = tuple(float(np.log((1 + total) / (1 + df)) + 1) for df in (1, 2))

    def best_of(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        row, first, size, h, tf = _contenders(tokens, ngram_range, known, weights, 2 * k)
        return {"id": batch.column(id_col).take(pa.array(row)), "term": tokens.text(first, size), "h": h.view(np.int64), "tf": tf}

    kind = body.schema[id_col].dataType.simpleString()
    terms = gram_rows(body, "_text", best_of, f"id {kind}, term string, h long, tf long").withColumnRenamed("id", id_col)
    idf = F.log((F.lit(1) + F.lit(total)) / (F.lit(1) + F.coalesce("df", F.lit(1)))) + F.lit(1.0)
    weighted = terms.join(shared, "h", "left").withColumn("weight", F.col("tf") * idf)
    best = top_per_group(weighted, [id_col], [F.desc("weight"), F.asc("term")], 2 * k)
    restored = best.withColumn("term", tx.restore_phrases("term", phrases))
    return restored.filter(~tx.edge_stopword("term", stopwords)).select(
        id_col, "term", "weight", "rank"
    )


def candidate_filters(keyword: Column, **options) -> Column:
    """True for a keyword that passes the extraction cascade (``options`` per filter)."""
    dropped = (
        filters.scraping_artifact(keyword, **options.get("scraping_artifact", {}))
        | filters.grammar_invalid(keyword, **options.get("grammar_invalid", {}))
        | filters.entity_conflict(keyword, **options.get("entity_conflict", {}))
        | filters.negative_sentiment(keyword, **options.get("negative_sentiment", {}))
        | filters.stop_phrase(keyword, **options.get("stop_phrase", {}))
        | filters.numeric_noise(keyword)
    )
    return ~dropped


def tag_sequences(tags: DataFrame) -> DataFrame:
    """(keyword, tags): the (token, pos, tag) rows of each keyword in the order of ``position``."""
    rows = F.sort_array(F.collect_list(F.struct("position", "token", "pos", "tag")))  # words of one keyword
    return tags.groupBy("keyword").agg(
        F.transform(rows, lambda r: F.struct(r["token"].alias("token"), r["pos"].alias("pos"), r["tag"].alias("tag"))).alias("tags")
    )


def grammar_checked(keywords: DataFrame, tags: DataFrame, **options) -> DataFrame:
    """Add ``grammar_invalid`` to keywords by a tag table (keyword, position, token, pos, tag).

    Keywords that the table does not have are judged by the rules that need no tags.
    """
    sequences = tag_sequences(tags).withColumnRenamed("tags", "_tags")
    checked = filters.grammar_invalid("keyword", tags=F.col("_tags"), **options)
    return keywords.join(sequences, "keyword", "left").withColumn("grammar_invalid", checked).drop("_tags")


def extract_candidates(
    docs: DataFrame,
    min_df: int = 2,
    top_terms: int = 10,
    ngram_range: tuple[int, int] = (2, 3),
    phrases: Iterable[str] = lx.PROTECTED_PHRASES,
    stopwords: Iterable[str] = lx.ENGLISH_STOPWORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    stem: bool = True,
    filter_options: dict | None = None,
) -> DataFrame:
    """(keyword, ord): n-grams and TF-IDF terms after the filter cascade and stem dedup."""
    sentences = clean_sentences(docs, text_col)
    grams = counted_ngrams(sentences, ngram_range, min_df, phrases, stopwords).select(
        F.col("ngram").alias("keyword"), order_key(0, -F.col("count"), F.col("ngram")).alias("ord")
    )
    terms = tfidf_top_terms(
        docs, top_terms, ngram_range, id_col, text_col, phrases, stopwords
    ).select(F.col("term").alias("keyword"), order_key(1, F.lit(0), F.col("term")).alias("ord"))
    keyword = F.lower(tx.strip("keyword"))
    pool = (
        grams.unionByName(terms)
        .select(keyword.alias("keyword"), "ord")
        .filter(tx.word_count("keyword") >= 2)
        .filter(candidate_filters(F.col("keyword"), **(filter_options or {})))
        .withColumn("keyword", filters.near_me_fix("keyword"))
        .filter(F.col("keyword").isNotNull())
    )
    distinct = pool.groupBy("keyword").agg(F.min("ord").alias("ord"))
    return stem_dedup(distinct, order_col="ord") if stem else distinct


def stem_dedup(
    keywords: DataFrame,
    score_col: str | None = None,
    order_col: str = "ord",
    key: Column | None = None,
) -> DataFrame:
    """One keyword per stem key: best score, then shortest, then first."""
    score = F.coalesce(F.col(score_col), F.lit(0.0)) if score_col else F.lit(0.0)
    rank = F.struct(
        (-score).alias("score"), F.length("keyword").alias("length"), F.col(order_col).alias("ord"),
        F.col("keyword").alias("keyword"),
    )
    keyed = keywords.withColumn("_stem", stem_key("keyword") if key is None else key)
    return first_by(keyed, ["_stem"], rank).select(*keywords.columns)


def merge_candidates(*sources: DataFrame) -> DataFrame:
    """Ordered distinct union: the first source that has a keyword wins.

    Each source has (keyword, ord); ``ord`` orders rows inside the source.
    """
    parts = [
        s.select(
            F.lower("keyword").alias("keyword"),
            F.struct(F.lit(i).alias("origin"), F.col("ord").alias("ord")).alias("rank"),
        )
        for i, s in enumerate(sources)
    ]
    pool = parts[0]
    for part in parts[1:]:
        pool = pool.unionByName(part)
    merged = pool.groupBy("keyword").agg(F.min("rank").alias("rank"))
    return merged.select("keyword", F.col("rank.origin").alias("origin"), F.col("rank.ord").alias("ord"))


def keyword_freq(
    keywords: DataFrame,
    docs: DataFrame,
    text_col: str = "text",
    hi: int = 3,
) -> DataFrame:
    """Add ``freq``: occurrences of each keyword as a 1 to ``hi`` token n-gram of the corpus.

    A filter of the keywords' hashes stands in front of the shuffle: n-grams that are no keyword
    never become strings. Keywords and counts then meet by string.
    """
    table = cut_lineage(keywords)

    def whole(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        length = np.bincount(tokens.row, minlength=batch.num_rows)
        first, size, h = tokens.grams(1, hi)
        return {"h": np.unique(h[size == length[tokens.row[first]]]).view(np.int64)}

    wanted = hash_filter(cut_lineage(gram_rows(table.select("keyword"), "keyword", whole, "h long")))

    def found(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        first, size, h = tokens.grams(1, hi)
        hit = wanted.passes(h)
        first, size, h = first[hit], size[hit], h[hit]
        at, count, _ = counted(h, tokens.row[first])
        return {"_gram": tokens.text(first[at], size[at]), "freq": count}

    text = docs.select(tx.clean_text(text_col).alias("_text"))
    counts = gram_rows(text, "_text", found, "_gram string, freq long").groupBy("_gram").agg(F.sum("freq").alias("freq"))
    return (
        table.join(counts, F.col("keyword") == F.col("_gram"), "left")
        .withColumn("freq", F.coalesce("freq", F.lit(0)))
        .drop("_gram")
    )


def seed_expansions(
    seeds: DataFrame, seed_col: str = "seed", audience_col: str | None = None, **term_options
) -> DataFrame:
    """Template keywords of each seed, chosen by seed type, in template order."""
    kind = classify.seed_type(seed_col, **term_options)
    s = tx.clean_text(seed_col)
    a = tx.clean_text(F.coalesce(F.col(audience_col), F.lit(""))) if audience_col else F.lit("")
    arr = tx.literal_array
    templates = F.concat(
        arr(lx.SEED_TEMPLATES),
        F.when(kind == "service", arr(lx.SERVICE_TEMPLATES))
        .when(kind == "product", arr(lx.PRODUCT_TEMPLATES))
        .otherwise(arr(lx.UNKNOWN_TEMPLATES)),
        F.when(a != "", arr(lx.AUDIENCE_TEMPLATES)).otherwise(arr([])),
    )
    filled = tx.let(
        F.struct(s.alias("s"), a.alias("a")),
        lambda v: F.transform(
            templates, lambda t: F.trim(tx.replace_slots(t, s=v["s"], a=v["a"]))
        ),
    )
    distinct = F.array_distinct(F.filter(filled, lambda q: tx.word_count(q) >= 2))
    return seeds.select(
        "*", kind.alias("seed_type"), F.posexplode(distinct).alias("position", "keyword")
    )


def reference_phrases(seeds: DataFrame, seed_col: str = "seed") -> DataFrame:
    """Ten natural phrases around each seed."""
    filled = tx.let(
        F.lower(tx.strip(seed_col)),
        lambda s: F.transform(
            tx.literal_array(lx.REFERENCE_TEMPLATES), lambda t: tx.replace_slots(t, s=s)
        ),
    )
    return seeds.select("*", F.posexplode(filled).alias("position", "phrase"))


def protect_table(docs: DataFrame, phrases: Iterable[str], text_col: str = "sentence") -> DataFrame:
    """Text with phrases protected, and the same text restored."""
    protected = tx.protect_phrases(text_col, phrases)
    return docs.select(
        "*", protected.alias("protected"), tx.restore_phrases(protected, phrases).alias("restored")
    )
