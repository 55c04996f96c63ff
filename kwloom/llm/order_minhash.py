"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles. Every sketch takes the shingles of least
hash, occurrence by occurrence, and keeps them in text order; documents that share one sketch
are candidates. An alignment of the shingle sequences within a band decides: aligned shingles
over all shingles of both (each aligned pair once) must reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwloom.llm.base import sent_if_small, sliced, stored
from kwloom.llm.components import components
from kwloom.llm.hashing import Words, mixed

SHINGLE = 5
THRESHOLD = 0.8
#: Sketches, and minima of each: at 0.8 a pair shares a given sketch with probability 0.8**4
#: about, and none of 24 with 0.59**24 = 3 in a million.
SKETCHES, MINIMA = 24, 4
#: Texts of a bucket with more texts are compared by their rare shingles, in blocks of about so many.
BUCKET, BLOCK = 16, 512
_SEEDS = np.random.default_rng(5).integers(1, 2**63, (2, SKETCHES, 1), dtype=np.uint64) | np.uint64(1)
#: Draws made at a time: all sketches of a text together, of long texts a few by a few.
DRAWS = 1 << 19
#: Bytes of text worked on at a time.
PIECE = 1 << 19


def normal(text: str | Column) -> Column:
    """Letters and digits in lower case, words one space apart; a text of other characters as it is."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))
    return F.when(words != "", words).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))


def shingles(words: Words, size: int) -> list[np.ndarray]:
    """The shingle hashes of each text in order; a text of fewer words is one shingle."""
    at, hashes = words.runs(size)
    of = words.doc[at]
    bounds = np.searchsorted(of, np.arange(len(words.per_doc) + 1))
    out = [hashes[bounds[i]:bounds[i + 1]] for i in range(len(words.per_doc))]
    first = np.cumsum(words.per_doc) - words.per_doc
    for i in np.flatnonzero((words.per_doc > 0) & (words.per_doc < size)):
        own = words.hashes[first[i]:first[i] + words.per_doc[i]]
        out[i] = mixed(np.array([int(sum(int(h) * (2 * j + 3) for j, h in enumerate(own))) % 2**64], dtype=np.uint64))
    return out


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often each entry has come before."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(ranked))
    out = np.empty(len(ranked), dtype=np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def label(hashes: np.ndarray) -> np.ndarray:
    """The shingles told apart by how often each has come before."""
    return mixed(hashes + occurrences(hashes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The order MinHash sketches of a shingle sequence; a short one is its own sketch."""
    labelled = label(hashes)
    take = min(MINIMA, len(labelled))
    step = max(1, min(SKETCHES, DRAWS // len(labelled)))
    parts = []
    for begin in range(0, SKETCHES, step):
        flip, spin = _SEEDS[:, begin:begin + step]
        drawn = (labelled[None, :] ^ flip) * spin
        drawn ^= drawn >> np.uint64(32)
        line = np.arange(len(drawn))
        chosen = np.empty((len(drawn), take), dtype=np.int64)
        for k in range(take):
            chosen[:, k] = drawn.argmin(axis=1)
            drawn[line, chosen[:, k]] = np.uint64(2**64 - 1)
        chosen.sort(axis=1)  # text order
        value = spin[:, 0].copy()
        for k in range(take):
            value = mixed(value ^ labelled[chosen[:, k]]) + np.uint64(1)
        parts.append(value)
    return np.concatenate(parts)


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether a common subsequence of ``need`` shingles exists.

    Common ends are taken off. The rest is aligned within a band around the diagonal that
    doubles until the answer is found; no alignment that is long enough leaves the last one.
    """
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, need = a[head:], b[head:], need - head
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b, need = a[:len(a) - tail], b[:len(b) - tail], need - tail
    if need <= 0:
        return True
    if min(len(a), len(b)) < need:
        return False
    widest = max(len(a), len(b)) - need
    band = min(widest, 32)
    while True:
        if _in_band(a, b, band) >= need:
            return True
        if band >= widest:
            return False
        band = min(widest, band * 4)


def _in_band(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence whose pairs are at most ``band`` positions apart."""
    width = 2 * band + 1
    there = np.zeros(len(a) + width, dtype=bool)
    near = np.zeros(len(a) + width, dtype=b.dtype)
    size = min(len(b), len(near) - band)
    near[band:band + size], there[band:band + size] = b[:size], True
    best = np.zeros(width + 1, dtype=np.int32)  # by the distance from the diagonal; the last stays 0
    for i, x in enumerate(a):
        step = best[:-1] + ((near[i:i + width] == x) & there[i:i + width])
        best[:-1] = np.maximum.accumulate(np.maximum(best[1:], step))
    return int(best.max())


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether aligned shingles make up ``threshold`` of the shingles of both."""
    need = int(np.ceil(threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    left, right = np.sort(a), np.sort(b)
    each = np.unique(left)
    in_a = np.searchsorted(left, each, "right") - np.searchsorted(left, each, "left")
    in_b = np.searchsorted(right, each, "right") - np.searchsorted(right, each, "left")
    return int(np.minimum(in_a, in_b).sum()) >= need and aligned(a, b, need)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """(id, digest, n, sketch): the number of shingles and the sketches of each text."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PIECE):
            parts = shingles(Words.of(batch.column("text")), size)
            values = [sketch(p).view(np.int64) for p in parts if len(p)]
            ends = np.cumsum([0, *(SKETCHES if len(p) else 0 for p in parts)])
            flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("digest"), pa.array(list(map(len, parts)), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["id", "digest", "n", "sketch"],
            )

    return docs.mapInArrow(run, f"id {kind}, digest binary, n int, sketch array<long>")


def candidate_pairs(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) of small buckets whose lengths allow the threshold; (id, block) of texts in large ones.

    ``texts`` has (id, n, sketch). Pairs of two texts in large buckets are left to :func:`crowded_links`.
    Counting combines before the shuffle, so a bucket of any size costs no task more than its rows. Texts
    are put in blocks by the least of their large buckets, which most near copies share.
    """
    keys = ["at", "value"]
    members = texts.select("id", "n", F.posexplode("sketch").alias("at", "value"))
    counted = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    full = members.join(counted.where("size > 1"), keys)
    large = full.where(F.col("size") > BUCKET).groupBy("id").agg(F.min(F.xxhash64("at", "value")).alias("group"))
    sizes = large.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    crowd = stored(large.join(sizes, "group").select("id", F.xxhash64("group", part).alias("block")))
    small = full.where(F.col("size") <= BUCKET).select("id", "n", *keys)
    other = small.select(F.col("id").alias("b"), F.col("n").alias("nb"), *keys)
    fits = F.least("na", "nb") >= F.ceil(F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9))
    pairs = (
        small.withColumnsRenamed({"id": "a", "n": "na"}).join(other, keys).where("a < b").where(fits)
        .select("a", "b").distinct()
    )
    in_crowd = crowd.select(F.col("id").alias("a"), F.lit(True).alias("crowd_a"))
    pairs = pairs.join(in_crowd, "a", "left").join(in_crowd.toDF("b", "crowd_b"), "b", "left")
    return pairs.where("crowd_a is null or crowd_b is null").select("a", "b"), crowd


def _labelled(texts: DataFrame, size: int) -> DataFrame:
    """(id, block, n, tokens): the labelled shingles of each text."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", PIECE):
            parts = [label(p) for p in shingles(Words.of(batch.column("text")), size)]
            lengths = np.array(list(map(len, parts)), dtype=np.int32)
            flat = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("block"), pa.array(lengths), pa.ListArray.from_arrays(ends, pa.array(flat))],
                names=["id", "block", "n", "tokens"],
            )

    return texts.select("id", "block", "text").mapInArrow(run, f"id {kind}, block long, n int, tokens array<long>")


def prefixes(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(token, id, block): the rarest labelled shingles of each of ``texts`` (id, block, text).

    Similar texts of n and m shingles share at least threshold * max(n, m) of them. So the first
    n - threshold * n + 1 of each, in one order, have one in common. The order is by frequency;
    a shingle that no other text has counts, but fetches nothing.
    """
    tokens = _labelled(texts, size).select("id", "block", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = tokens.join(shared, "token").groupBy("id", "block", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    take = F.size("own") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    return own.where(take > 0).select(
        "id", "block", F.explode(F.slice("own.token", F.lit(1), take.cast("int"))).alias("token")
    )


def crowded_links(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links among ``texts`` (id, block, text), all of them: (id, null, links) and (id, other, 0).

    Texts that share a rare shingle are compared, each pair of blocks at one place. The links are
    counted there; rows with ``other`` are only as many as join what the place links, so that no
    table grows with the square of a group.
    """
    kind = texts.schema["id"].dataType.simpleString()
    lists = stored(prefixes(texts, size, threshold).groupBy("token", "block").agg(F.collect_list("id").alias("ids")))
    right = lists.select("token", F.col("block").alias("j"), F.col("ids").alias("right"))
    met = stored(
        lists.select("token", F.col("block").alias("i"), F.col("ids").alias("left")).join(right, "token")
        .where("i < j or (i = j and size(left) > 1)").select("i", "j", "left", "right").distinct()
    )
    ids = met.select("i", "j", F.explode("left").alias("id")).union(met.select("i", "j", F.explode("right").alias("id")))
    sent = ids.distinct().join(texts.select("id", "text"), "id").withColumnsRenamed({"i": "of_i", "j": "of_j"})

    def run(met: pa.Table, sent: pa.Table) -> pa.Table:
        names = sent.column("id").to_pylist()
        at = {name: k for k, name in enumerate(names)}
        meet = np.zeros((len(names), len(names)), dtype=bool)
        for left, right in zip(met.column("left").to_pylist(), met.column("right").to_pylist(), strict=True):
            meet[np.ix_([at[x] for x in left], [at[x] for x in right])] = True
        degree, joined = linked(shingles(Words.of(sent.column("text").combine_chunks()), size), meet, threshold)
        some = np.flatnonzero(degree)
        rows = [(names[k], None, int(degree[k])) for k in some] + [(names[a], names[b], 0) for a, b in joined]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
        type_ = sent.schema.field("id").type
        return pa.table([pa.array(c, t) for c, t in zip(columns, (type_, type_, pa.int64()), strict=True)], names=["id", "other", "links"])

    return met.groupBy("i", "j").cogroup(sent.groupBy("of_i", "of_j")).applyInArrow(run, f"id {kind}, other {kind}, links long")


def linked(parts: list[np.ndarray], meet: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Similar texts among the pairs that ``meet`` marks: links of each, and pairs that join what is linked."""
    lengths = np.array(list(map(len, parts)))
    _, flat = np.unique(np.concatenate([label(p) for p in parts]), return_inverse=True)
    tokens = np.split(flat, np.cumsum(lengths)[:-1])
    place = np.full(len(flat), -1)
    degree, root, joined = np.zeros(len(parts), dtype=np.int64), list(range(len(parts))), []
    meet = np.triu(meet | meet.T, 1)
    for a in np.flatnonzero(meet.any(axis=1)):
        place[tokens[a]] = np.arange(lengths[a])
        need = np.ceil(threshold * (lengths[a] + lengths) / (1 + threshold) - 1e-9)
        for b in np.flatnonzero(meet[a] & (np.minimum(lengths[a], lengths) >= need)):
            common = place[tokens[b]]
            common = common[common >= 0]
            # common shingles in the same order are an alignment
            if len(common) < need[b] or not ((common[1:] > common[:-1]).all() or aligned(parts[a], parts[b], int(need[b]))):
                continue
            degree[a] += 1
            degree[b] += 1
            ends = []
            for x in (int(a), int(b)):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                ends.append(x)
            if ends[0] != ends[1]:
                root[max(ends)] = min(ends)
                joined.append((int(a), int(b)))
        place[tokens[a]] = -1
    return degree, joined


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts (id, text) are similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "left", PIECE):
            left = shingles(Words.of(batch.column("left")), size)
            right = shingles(Words.of(batch.column("right")), size)
            keep = pa.array([similar(x, y, threshold) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "left", "right").mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    size: int = SHINGLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, class_id, copy_of, n_links): one row per document with its near-duplicate class.

    Texts are compared in lower case by their letters and digits. Copies equal in that form are
    one text (``copy_of`` is the smallest id that has it); different texts are linked when
    similar, ``n_links`` counts the links of the document's text, and ``class_id`` is the
    smallest id reached over links. Null, empty and blank texts are a class of their own each,
    and so is each row with a null id (class null). A text shorter than a shingle is one
    shingle. Repeated rows of an id give one result row; of an id with several texts the one of
    least digest is compared. Ties go to the smaller id. Extra columns are not read.
    """
    docs = df.select(F.col(id_col).alias("id"), normal(F.col(text_col).cast("string")).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    known = docs.where(F.col("id").isNotNull())
    sketches = stored(
        _sketched(known, size)
        .groupBy("id").agg(F.min(F.struct(F.col("n").eqNullSafe(0).alias("none"), "digest", "n", "sketch")).alias("r"))
        .select("id", "r.digest", "r.n", "r.sketch")
    )
    reps = stored(
        sketches.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "sketch")).alias("r"))
        .select("digest", "r.id", "r.n", "r.sketch")
    )
    found, crowd = candidate_pairs(reps.select("id", "n", "sketch"), threshold)
    pairs = stored(found)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(crowd.select("id")).distinct()
    wanted = sent_if_small(stored(reps.select("id", "digest").join(ids, "id", "left_semi")))
    texts = stored(known.join(wanted, ["id", "digest"], "left_semi").select("id", "text").dropDuplicates(["id"]))
    links = stored(verified(pairs, texts, size, threshold))
    crowded = stored(crowded_links(texts.join(crowd, "id"), size, threshold))
    joined = links.union(crowded.where("other is not null").select("id", "other"))
    degree = (
        links.select(F.col("a").alias("id"), F.lit(1).alias("links")).union(links.select(F.col("b").alias("id"), F.lit(1)))
        .union(crowded.select("id", "links")).groupBy("id").agg(F.sum("links").alias("n_links"))
    )
    classes = (
        reps.select("digest", "id").join(components(joined), "id", "left").join(degree, "id", "left")
        .select(
            "digest", F.col("id").alias("copy_of"), F.coalesce("label", "id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
    alone = sketches.where("n = 0").select("id").union(docs.where(F.col("id").isNull()).select("id"))
    return (
        sketches.where("n > 0").join(classes, "digest").select("id", "class_id", "copy_of", "n_links")
        .union(alone.select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(0).cast("long")))
        .withColumnRenamed("id", id_col)
    )
