"""Terms found in most documents, and keywords made of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import scoring
from kwloom.functions import text as tx
from kwloom.operators.common import cut_lineage, scalar
from kwloom.operators.grams import Tokens, chunks, counted, gram_rows, hash_filter

#: Documents of a group, and terms of it that a task holds, about.
GROUP, HASHES = 2000, 2_000_000
#: Terms that go to the keywords as a constant.
LISTED = 2000


def universal_terms(
    docs: DataFrame,
    text_col: str = "text",
    threshold: float = 0.8,
    min_docs: int = 3,
    defaults: Iterable[str] = lx.UNIVERSAL_TERMS,
) -> DataFrame:
    """(term): terms of at least ``threshold`` of the cleaned documents, plus defaults.

    A term of such a share of all documents has it in some group of documents. So every task
    names the terms that have it in one of its groups, and only these are counted, by string:
    no shuffle grows with the vocabulary.
    """
    cleaned = docs.filter(F.coalesce(F.col(text_col), F.lit("")) != "").select(tx.clean_text(text_col).alias("_text"))
    total = scalar(cleaned, F.count(F.lit(1)))

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0

        def named() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n >= threshold * rows * (1 - 1e-9)].view(np.int64))], names=["h"])

        for batch in chunks(batches, "_text"):
            tokens = Tokens.of(batch.column("_text"), 1)
            at, _, of = counted(tokens.hashes, tokens.row)
            held.append(np.repeat(tokens.hashes[at], of))  # once a row
            rows, size = rows + batch.num_rows, size + len(held[-1])
            if rows >= GROUP or size >= HASHES:
                yield named()
                held, rows, size = [], 0, 0
        if rows:
            yield named()

    wanted = hash_filter(cut_lineage(cleaned.mapInArrow(frequent, "h long").distinct()))

    def found(tokens: Tokens, batch: pa.RecordBatch) -> dict:
        hit = np.flatnonzero(wanted.passes(tokens.hashes))
        at, _, df = counted(tokens.hashes[hit], tokens.row[hit])
        return {"term": tokens.text(hit[at], np.ones(len(at), dtype=np.int64)), "df": df}

    counts = gram_rows(cleaned, "_text", found, "term string, df long", 1).groupBy("term").agg(F.sum("df").alias("df"))
    found_terms = counts.filter((F.col("df") / total >= threshold) & (total >= min_docs)).select("term")
    listed = docs.sparkSession.range(1).select(F.explode(tx.literal_array(defaults)).alias("term"))
    return found_terms.unionByName(listed).distinct()


def universal_token_counts(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """(keyword, tokens, universal): distinct tokens and how many of them are universal."""
    tokens = keywords.select(
        "keyword", F.explode(F.array_distinct(tx.words(F.lower("keyword")))).alias("term")
    )
    # stored, a short list of terms has a known size and goes to the tokens, not they to it
    flagged = tokens.join(cut_lineage(terms).withColumn("hit", F.lit(1)), "term", "left")
    return flagged.groupBy("keyword").agg(
        F.count(F.lit(1)).alias("tokens"), F.count("hit").alias("universal")
    )


def _listed_tokens(terms: DataFrame) -> Column | None:
    """Universal tokens of a row's keyword by a constant list of terms; None for a long or repeating one."""
    found = [r[0] for r in terms.select("term").where("term is not null").limit(LISTED + 1).collect()]
    if len(found) > LISTED or len(set(found)) < len(found) or any("\u001f" in t for t in found):
        return None
    return F.size(F.array_intersect(tx.words(F.lower("keyword")), tx.literal_array(found)))


def drop_entirely_universal(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """Remove keywords whose tokens are all universal."""
    counts = universal_token_counts(keywords, terms)
    boilerplate = counts.filter("tokens = universal").select("keyword")
    return keywords.join(boilerplate, "keyword", "left_anti")


def with_universal_penalty(keywords: DataFrame, terms: DataFrame, **options) -> DataFrame:
    """Add ``universal_penalty`` to a table of distinct keywords."""
    terms = cut_lineage(terms)
    listed = _listed_tokens(terms)
    if listed is not None:
        hits = F.when(F.col("keyword").isNotNull(), listed).otherwise(F.lit(0))
        return keywords.withColumn("universal_penalty", scoring.universal_penalty(hits.cast("long"), **options))
    counts = universal_token_counts(keywords, terms).select("keyword", "universal")
    count = F.coalesce("universal", F.lit(0))
    return (
        keywords.join(counts, "keyword", "left")
        .withColumn("universal_penalty", scoring.universal_penalty(count, **options))
        .drop("universal")
    )
