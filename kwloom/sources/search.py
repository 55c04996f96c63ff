"""Stored search responses: result lists, related questions, suggestions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions import text as tx

# --- fixed values: response shapes (rows, fields and total of each provider) ---
SERPAPI = (
    "organic_results array<struct<title:string,link:string,snippet:string>>, "
    "search_information struct<total_results:bigint>, "
    "related_questions array<struct<question:string>>"
)
BING = (
    "webPages struct<value:array<struct<name:string,url:string,snippet:string>>,"
    "totalEstimatedMatches:bigint>, "
    "relatedSearches struct<value:array<struct<text:string>>>"
)
FREE = "array<struct<title:string,href:string,body:string>>"


def _rows(part: DataFrame, array: Column, fields: tuple, total: Column, limit: int) -> DataFrame:
    title, url, snippet = fields
    return part.select(
        "query", "provider", total.alias("total_results"),
        F.posexplode(F.slice(array, 1, limit)).alias("position", "item"),
    ).select(
        "query",
        "provider",
        "position",
        *[
            F.coalesce(F.col("item")[source], F.lit("")).alias(name)
            for name, source in (("title", title), ("url", url), ("snippet", snippet))
        ],
        "total_results",
    )


def serp_results(responses: DataFrame, max_results: int = 10) -> DataFrame:
    """Result rows of (query, provider, response) for serpapi, bing and free responses."""
    no_total = F.lit(None).cast("bigint")

    def parsed(provider: str, shape: str) -> DataFrame:
        return responses.filter(F.col("provider") == provider).withColumn(
            "r", F.from_json("response", shape)
        )

    serp, bing, free = parsed("serpapi", SERPAPI), parsed("bing", BING), parsed("free", FREE)
    return (
        _rows(serp, F.col("r.organic_results"), ("title", "link", "snippet"),
              F.col("r.search_information.total_results"), max_results)
        .unionByName(
            _rows(bing, F.col("r.webPages.value"), ("name", "url", "snippet"),
                  F.col("r.webPages.totalEstimatedMatches"), max_results)
        )
        .unionByName(_rows(free, F.col("r"), ("title", "href", "body"), no_total, max_results))
    )


def related_questions(
    responses: DataFrame, question_words: Iterable[str] = lx.QUESTION_WORDS
) -> DataFrame:
    """(query, position, question); Bing's related searches only when they ask something."""
    asked = F.col("provider") == "serpapi"
    serp = responses.filter(asked).select(
        "query",
        F.posexplode(F.from_json("response", SERPAPI)["related_questions"]["question"]).alias(
            "position", "question"
        ),
    )
    bing = (
        responses.filter(F.col("provider") == "bing")
        .select(
            "query",
            F.posexplode(F.from_json("response", BING)["relatedSearches"]["value"]["text"]).alias(
                "position", "question"
            ),
        )
        .filter(tx.starts_with_any(tx.strip(F.lower("question")), question_words))
    )
    return (
        serp.unionByName(bing)
        .withColumn("question", tx.strip(F.lower("question")))
        .filter("question != ''")
    )


def suggestions(responses: DataFrame) -> DataFrame:
    """(query, lang, country, position, suggestion) from stored ``[query, [text, …]]``.

    Blank suggestions and the query itself are dropped; queries of under two characters
    give none.
    """
    listed = F.from_json(F.get_json_object("response", "$[1]"), "array<string>")
    return (
        responses.filter(F.length(tx.strip("query")) >= 2)
        .select("query", "lang", "country", F.posexplode(listed).alias("position", "suggestion"))
        .withColumn("suggestion", tx.strip(F.lower("suggestion")))
        .filter((F.col("suggestion") != "") & (F.col("suggestion") != F.lower("query")))
    )


def suggestion_languages(countries: DataFrame, country_col: str = "country") -> DataFrame:
    """Add ``languages``: the languages whose suggestions count in a country."""
    table = F.create_map(
        *[v for code, langs in lx.SUGGESTION_LANGUAGES.items()
          for v in (F.lit(code), tx.literal_array(langs))]
    )
    code = F.lower(F.col(country_col))
    return countries.withColumn(
        "languages", F.coalesce(F.try_element_at(table, code), tx.literal_array(["en"]))
    )
