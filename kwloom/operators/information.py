"""What a text adds over its competitors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kwloom import lexicon as lx
from kwloom.functions import text as tx
from kwloom.operators.common import cut_lineage, exploded, numbered, top_per_group


def _joints(parts: DataFrame) -> DataFrame:
    """(comparison_id, side, term): the phrases that run from one part of a side into the next.

    ``parts`` has (comparison_id, side, part, tokens), tokens at least one. A part meets the
    ends of the two before it by its number in the order of all parts, so that a side of any
    size is spread over the tasks and its text is never put together.
    """
    keys = ["comparison_id", "side"]
    ends = parts.select(
        *keys, "part", F.slice("tokens", 1, 2).alias("head"),
        F.slice("tokens", F.greatest(F.size("tokens") - 1, F.lit(1)), F.lit(2)).alias("tail"),
    )
    rows = numbered(ends, *keys, "part", "head", "tail")

    def earlier(by: int) -> DataFrame:
        return rows.select(*keys, (F.col("number") + by).alias("number"), F.col("tail").alias(f"tail_{by}"))

    nothing = tx.literal_array([])
    before = F.concat(F.coalesce("tail_2", nothing), F.col("tail_1"))
    met = rows.join(earlier(1), [*keys, "number"]).join(earlier(2), [*keys, "number"], "left")
    edge = met.select(*keys, "head", F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2)).alias("before"))
    last, first = F.element_at("before", -1), F.get("head", F.lit(0))
    phrases = F.array(
        F.concat_ws(" ", last, first),
        F.when(F.size("before") > 1, F.concat_ws(" ", F.get("before", F.lit(0)), last, first)),
        F.when(F.size("head") > 1, F.concat_ws(" ", last, first, F.get("head", F.lit(1)))),
    )
    return exploded(edge, F.array_compact(phrases), "term", *keys)


def term_weights(
    texts: DataFrame,
    max_features: int | None = 500,
    stopwords: Iterable[str] = lx.ENGLISH_STOPWORDS,
) -> DataFrame:
    """(comparison_id, term, mine, theirs): TF-IDF weights of the most frequent terms (None: of all).

    ``texts`` is (comparison_id, side, part, text) with side ``mine`` or ``theirs``; parts
    are the texts a side consists of, in their order. Each comparison is its own two-document
    corpus: phrases run on from one part into the next.
    """
    tokens = F.filter(tx.gram_tokens(tx.clean_text("text")), lambda t: ~t.isin(*stopwords))
    parts = texts.select("comparison_id", "side", "part", tokens.alias("tokens")).where(F.size("tokens") > 0)
    inside = exploded(parts, tx.ngrams(F.col("tokens"), 1, 3), "term", "comparison_id", "side")
    terms = inside.unionByName(_joints(parts))
    mine = F.count(F.when(F.col("side") == "mine", 1))
    theirs = F.count(F.when(F.col("side") == "theirs", 1))
    counts = terms.groupBy("comparison_id", "term").agg(mine.alias("a"), theirs.alias("b"))
    kept = counts
    if max_features is not None:
        kept = top_per_group(
            counts, ["comparison_id"], [F.desc(F.col("a") + F.col("b")), F.asc("term")], max_features
        )
    in_both = (F.col("a") > 0) & (F.col("b") > 0)
    idf = F.when(in_both, F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + F.lit(1.0))
    return kept.select(
        "comparison_id", "term", (F.col("a") * idf).alias("mine"), (F.col("b") * idf).alias("theirs")
    )


def information_gain(
    texts: DataFrame,
    top_n: int | None = 20,
    max_features: int | None = 500,
    stopwords: Iterable[str] = lx.ENGLISH_STOPWORDS,
    shown: int | None = 10,
) -> DataFrame:
    """Score, unique / common / missing concepts and advice per comparison.

    Sides are grouped by comparison, never paired text by text. ``max_features`` terms of a
    comparison, ``top_n`` concepts of a side and ``shown`` names of a list count; None counts all.
    """
    weights = cut_lineage(term_weights(texts, max_features, stopwords))

    def rank(side: str) -> Column:
        # terms a side lacks have weight 0 and rank behind all others
        return F.row_number().over(Window.partitionBy("comparison_id").orderBy(F.desc(side), F.asc("term")))

    concepts = weights.select(
        "comparison_id", "term", "mine", "theirs", rank("mine").alias("m"), rank("theirs").alias("t")
    )
    ours, rivals = F.col("mine") > 0, F.col("theirs") > 0
    if top_n is not None:
        ours, rivals = ours & (F.col("m") <= top_n), rivals & (F.col("t") <= top_n)

    def names(cond: Column) -> Column:
        # at most ``top_n`` concepts a side
        return F.array_sort(F.collect_list(F.when(cond, F.col("term"))))

    sets = concepts.groupBy("comparison_id").agg(
        names(ours & ~rivals).alias("unique"),
        names(ours & rivals).alias("common"),
        names(~ours & rivals).alias("missing"),
    )
    angle = weights.groupBy("comparison_id").agg(
        F.sum(F.col("mine") * F.col("theirs")).alias("dot"),
        F.sum(F.col("mine") * F.col("mine")).alias("mm"),
        F.sum(F.col("theirs") * F.col("theirs")).alias("tt"),
    )
    cosine = F.when(
        (F.col("mm") > 0) & (F.col("tt") > 0), F.col("dot") / F.sqrt(F.col("mm") * F.col("tt"))
    ).otherwise(F.lit(0.0))
    unique, common, missing = (F.size(c) for c in ("unique", "common", "missing"))
    score = (
        F.lit(0.4) * (F.lit(1.0) - F.col("similarity"))
        + F.lit(0.4) * (unique / F.greatest(unique + common, F.lit(1)))
        + F.lit(0.2) * (common / F.greatest(common + missing, F.lit(1)))
    )
    advice = tx.compact(
        F.when(
            missing > 5,
            F.concat(
                F.lit("Consider covering these topics: "), F.array_join(F.slice("missing", 1, 5), ", ")
            ),
        ),
        F.when(unique < 3, F.lit("Add more unique insights, data, or perspectives")),
        F.when(
            F.col("similarity") > 0.7,
            F.lit("Content is very similar to competitors - differentiate more"),
        ),
    )
    rivalled = texts.groupBy("comparison_id").agg(
        F.max((F.col("side") == "theirs").cast("int")).alias("rivalled")
    )
    nothing = tx.literal_array([])
    alone = F.col("rivalled") == 0
    return (
        rivalled.join(sets, "comparison_id", "left")
        .join(angle, "comparison_id", "left")
        .withColumns({c: F.coalesce(c, nothing) for c in ("unique", "common", "missing")})
        .withColumn("similarity", F.coalesce(cosine, F.lit(0.0)))
        .select(
            "comparison_id",
            F.when(alone, F.lit(1.0)).otherwise(tx.rounded(tx.clamp(score), 3)).alias("score"),
            *[
                F.when(alone, nothing).otherwise(F.col(c) if shown is None else F.slice(c, 1, shown)).alias(f"{c}_concepts")
                for c in ("unique", "common", "missing")
            ],
            F.when(alone, F.array(F.lit("No competitor content to compare")))
            .otherwise(advice)
            .alias("recommendations"),
        )
    )
