"""Gazetteer operators over keyword tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import entities as en
from kwloom.functions import text as tx


def enrich_entities(keywords: DataFrame, geo: str = "ae", gazetteer: tuple = lx.GAZETTEER,
                    match: str = "substring") -> DataFrame:
    """Spread the entity struct over columns."""
    return keywords.withColumn(
        "_e", en.extract_entities("keyword", geo, gazetteer, match)
    ).select(*keywords.columns, "_e.*")


def entity_clusters(keywords: DataFrame, geo: str = "ae", gazetteer: tuple = lx.GAZETTEER,
                    match: str = "substring") -> DataFrame:
    """(location, keyword): each keyword under its district, region, country or 'global'."""
    entity = en.extract_entities("keyword", geo, gazetteer, match)
    tagged = keywords.select("keyword", entity.alias("e"))
    return tagged.select(en.location_key(F.col("e")).alias("location"), "keyword")


def gazetteer_matches(keywords: DataFrame, gazetteer: DataFrame, max_words: int) -> DataFrame:
    """(keyword, kind, display, region, type): first whole-word entry of each kind.

    For gazetteers kept as a table (kind, ord, key, display, region, type): keywords are
    opened into their 1 to ``max_words`` word phrases and meet the keys in an equi-join.
    ``max_words`` must cover the longest key.
    """
    grams = keywords.select(
        "keyword",
        F.explode(F.array_distinct(tx.ngrams(tx.words(F.lower("keyword")), 1, max_words))).alias("key"),
    )
    entries = gazetteer.withColumn("key", F.lower("key"))
    hits = grams.join(entries, "key")
    return hits.groupBy("keyword", "kind").agg(
        F.min_by(F.struct("display", "region", "type"), "ord").alias("e")
    ).select("keyword", "kind", "e.*")


def location_variations(keywords: DataFrame, **options) -> DataFrame:
    """(keyword, position, variation)."""
    return keywords.select(
        "keyword",
        F.posexplode(en.location_variations("keyword", **options)).alias("position", "variation"),
    )
