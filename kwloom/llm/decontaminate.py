"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Windows that share a five-word shingle with an item of their size are fingerprinted; a window
without one has similarity 0. Fingerprints are cut into one block more than the radius, so two
within the radius agree in a block at least: equal blocks fetch all of them. Candidates within
the radius are then compared exactly by their weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import stored

SHINGLE, THRESHOLD = 5, 0.8
#: Bits that may differ of 64, and with it the number of blocks. At similarity 0.8 at most one word
#: in 15 differs: 4 to 7 bits are expected.
RADIUS = 20
#: Shingles of the benchmark that are sent to all tasks; a larger benchmark is joined by shuffle.
SENT = 2_000_000


def words(text: str | Column) -> Column:
    """Words in lower case, cut at anything but letters, digits and marks."""
    text = F.col(text) if isinstance(text, str) else text
    clean = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))
    return F.when(clean != "", F.split(clean, " ")).otherwise(F.array().cast("array<string>"))


def shingles(tokens: str | Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words in order; of fewer words one hash of all."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    last = F.size(tokens) - size
    runs = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*(F.get(tokens, i + k) for k in range(size))),
    )
    whole = F.array(F.xxhash64(F.concat_ws(" ", tokens)))
    return F.when(last >= 0, runs).when(F.size(tokens) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def simhash(hashes: str | Column) -> Column:
    """64 bits: each is set where more than half of the hashes have it set."""
    hashes = F.col(hashes) if isinstance(hashes, str) else hashes

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("getbit", h, b).cast("int"))
        return F.when(votes * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b))
    )


def blocks(fingerprint: str | Column, radius: int = RADIUS) -> Column:
    """Array of (block, bits): the fingerprint in ``radius`` + 1 blocks of about one size."""
    value = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return F.array(*(
        F.struct(
            F.lit(i).alias("block"),
            F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("bits"),
        )
        for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ))


def weighted_similarity(a: str | Column, b: str | Column) -> Column:
    """Shared over all shingles of two arrays, each weighted by how often it occurs."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def count(of: Column, what: Column) -> Column:
        return F.size(F.filter(of, lambda x: x == what))

    shared = F.aggregate(
        F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x))
    )
    return shared / (F.size(a) + F.size(b) - shared)


def _items(benchmark: DataFrame, text_col: str, item_col: str) -> DataFrame:
    """(item_id, length, s, fingerprint): words, shingles and fingerprint of each distinct item."""
    return (
        benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w"))
        .where(F.col("item_id").isNotNull() & (F.size("w") > 0)).distinct()
        .select("item_id", F.size("w").alias("length"), shingles("w").alias("s"), _word_hashes("w").alias("v"))
        .select("item_id", "length", "s", simhash("v").alias("fingerprint"))
    )


def leaks(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    item_text_col: str = "text", item_col: str = "item_id", radius: int = RADIUS, threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, item_id, similarity, at): documents with a window similar to a benchmark item.

    One row per document and item: the best window's similarity (0.8 or more, ties to the
    earlier window) and its first word, counted from 0. Null and empty texts and items have no
    words and match nothing; an item or text shorter than a shingle is one shingle, and such an
    item is met by texts that are no longer than a shingle only. Repeated rows and ids give one
    row per document and item, null ids none. Extra columns are not read.
    """
    items = stored(_items(benchmark, item_text_col, item_col))
    spots = items.select("length", F.posexplode("s").alias("offset", "h")).distinct()
    # Sent to all tasks only while its counted size is bounded; the join is the same either way.
    if spots.count() <= SENT:
        spots = F.broadcast(spots)
    docs = df.select(F.col(id_col).alias("doc_id"), words(F.col(text_col).cast("string")).alias("w"))
    docs = docs.where(F.col("doc_id").isNotNull())
    places = stored(
        docs.select("doc_id", F.posexplode(shingles("w")).alias("place", "h")).join(spots, "h")
        .select("doc_id", "length", F.greatest(F.lit(0), F.col("place") - F.col("offset")).alias("at")).distinct()
    )
    windows = stored(
        docs.join(places, "doc_id").select("doc_id", "length", "at", F.slice("w", F.col("at") + 1, F.col("length")).alias("w"))
        .distinct()
        .select("doc_id", "length", "at", shingles("w").alias("s"), _word_hashes("w").alias("v"))
        .select("doc_id", "length", "at", "s", simhash("v").alias("fingerprint"))
    )
    left = windows.select("*", F.explode(blocks("fingerprint", radius)).alias("b"))
    right = items.select(
        "item_id", "length", F.col("s").alias("item_s"), F.col("fingerprint").alias("item_f"),
        F.explode(blocks("fingerprint", radius)).alias("b"),
    )
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_f"))) <= radius
    pairs = left.join(right, ["length", "b"]).where(near).dropDuplicates(["doc_id", "at", "fingerprint", "item_id"])
    best = F.max(F.struct(F.col("similarity"), (-F.col("at")).alias("before")))
    return (
        pairs.withColumn("similarity", weighted_similarity("s", "item_s")).where(F.col("similarity") >= threshold)
        .groupBy("doc_id", "item_id").agg(best.alias("best"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).alias("at"))
    )


def duckdb_sql(threshold: float = THRESHOLD) -> str:
    """``leaks`` over ``documents`` and ``benchmark`` in DuckDB SQL, without fingerprints."""

    def cut(table: str, key: str) -> str:
        clean = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))"
        return f"SELECT {key}, string_split({clean}, ' ') AS w FROM {table} WHERE {clean} <> ''"

    def grams(w: str) -> str:
        last = f"greatest(len({w}) - {SHINGLE - 1}, 1)"
        return f"list_transform(range(1, {last} + 1), lambda i: array_to_string({w}[i:i + {SHINGLE - 1}], ' '))"

    return f"""
WITH d AS ({cut('documents', 'doc_id')}),
i AS (SELECT item_id, len(w) AS length, {grams('w')} AS s FROM ({cut('benchmark', 'item_id')})),
dg AS (SELECT doc_id, unnest(s) AS g, generate_subscripts(s, 1) - 1 AS place FROM (SELECT doc_id, {grams('w')} AS s FROM d)),
ig AS (SELECT item_id, length, unnest(s) AS g, generate_subscripts(s, 1) - 1 AS shift FROM i),
h AS (SELECT DISTINCT doc_id, item_id, length, greatest(0, place - shift) AS pos FROM dg JOIN ig USING (g)),
v AS (SELECT doc_id, item_id, pos, {grams('v')} AS s FROM (SELECT h.*, w[pos + 1:pos + length] AS v FROM h JOIN d USING (doc_id))),
a AS (SELECT doc_id, item_id, pos, g, count(*) AS n FROM (SELECT doc_id, item_id, pos, unnest(s) AS g FROM v) GROUP BY ALL),
b AS (SELECT item_id, g, count(*) AS n FROM ig GROUP BY ALL),
c AS (SELECT doc_id, item_id, pos, sum(least(a.n, b.n))::BIGINT AS shared FROM a JOIN b USING (item_id, g) GROUP BY ALL),
r AS (SELECT doc_id, item_id, pos, shared / (len(v.s) + len(i.s) - shared) AS similarity
  FROM c JOIN v USING (doc_id, item_id, pos) JOIN i USING (item_id))
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(pos, (-similarity, pos))::INTEGER AS "at"
FROM r WHERE similarity >= {threshold} GROUP BY doc_id, item_id"""
