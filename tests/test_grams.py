"""Hashed n-grams against plain Python: counts, best terms, keyword frequencies, universal terms."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kwloom.operators import candidates, grams, universal

WORDS = ["villa", "design", "é", "a", "the", "garden", "wall", "straße", "日本", "x1", "of", "pool", "roof", "ab"]


def corpus(seed, n=60, sentences=4):
    rng = random.Random(seed)
    return [
        (i, "\n".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(rng.randint(0, sentences))))
        for i in range(n)
    ]


def of_tokens(tokens, lo, hi):
    return [" ".join(tokens[i:i + n]) for n in range(lo, hi + 1) for i in range(len(tokens) - n + 1)]


def long_tokens(text):
    return [t for t in text.split(" ") if len(t) >= 2]


def test_tokens_and_their_text():
    texts = pa.array(["a villa  design", None, "", " ", "é日 本 straße x", "tail", "b"])
    tokens = grams.Tokens.of(texts)
    first, size, h = tokens.grams(1, 3)
    assert tokens.text(first, size).to_pylist() == ["villa", "design", "é日", "straße", "tail", "villa design", "é日 straße"]
    assert tokens.row[first].tolist() == [0, 0, 4, 4, 5, 0, 4]
    assert (grams.Tokens.of(texts.slice(4, 2)).hashes == tokens.hashes[2:]).all()
    assert grams.token_hashes(["tail"])[0] == tokens.hashes[-1]
    assert len(set(h.tolist())) == 7
    none = grams.Tokens.of(pa.array([], pa.string()))
    assert [len(x) for x in none.grams(2, 3)] == [0, 0, 0]


def test_filter_passes_every_hash(spark):
    hashes = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "h long")
    found = grams.hash_filter(df)
    assert found.passes(hashes).all()
    assert found.passes(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)).mean() < 0.05
    assert not grams.hash_filter(df.limit(0)).passes(hashes).any()


@pytest.mark.parametrize("min_df", [1, 2, 4])
def test_ngram_counts(spark, monkeypatch, min_df):
    monkeypatch.setattr(grams, "CHUNK", 64)
    rows = [line for _, text in corpus(min_df) for line in text.split("\n") if " " in line]
    df = spark.createDataFrame([(x,) for x in rows], "sentence string").repartition(3)
    got = {r.ngram: (r["count"], r.df) for r in candidates.ngram_counts(df, (2, 3), min_df, (), ("the", "of")).collect()}
    lists = [of_tokens(long_tokens(x), 2, 3) for x in rows]
    count, of = Counter(g for x in lists for g in x), Counter(g for x in lists for g in set(x))
    edge = lambda g: {g.split()[0], g.split()[-1]} & {"the", "of"}
    assert got == {g: (count[g], n) for g, n in of.items() if n >= min_df and not edge(g)}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_best_terms(spark, k):
    rows = [(i, f"one two three {text} zz{i} yy{i} ww{i % 7} zz{i} yy{i}".replace("\n", " qq ")) for i, text in corpus(9 + k)]
    rows += [(100, None), (101, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = candidates.tfidf_top_terms(df, k, (2, 3), phrases=(), stopwords=("the",))
    got = sorted((r.doc_id, r["rank"], r.term, round(r.weight, 9)) for r in found.collect())
    bodies = {i: of_tokens(long_tokens(t), 2, 3) for i, t in rows if t and i != 101}
    of = Counter(g for x in bodies.values() for g in set(x))
    want = []
    for i, terms in bodies.items():
        weigh = {g: tf * (math.log((1 + len(bodies)) / (1 + of[g])) + 1) for g, tf in Counter(terms).items()}
        best = sorted(weigh, key=lambda g: (-weigh[g], g))[:2 * k]
        want += [(i, r, g, round(weigh[g], 9)) for r, g in enumerate(best, 1) if "the" not in (g.split()[0], g.split()[-1])]
    assert got == sorted(want)


def test_keyword_freq(spark):
    rows = corpus(5)
    keywords = ["villa", "villa design", "the garden wall", "a", "villa a design", "none here", "wall  wall", "", "a b c d e"]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kw = spark.createDataFrame([(x, 1) for x in keywords] + [(None, 2)], "keyword string, ord int")
    got = {r.keyword: r.freq for r in candidates.keyword_freq(kw, df).collect()}
    every = Counter(g for _, t in rows for g in of_tokens(long_tokens(" ".join(t.split())), 1, 3))
    assert got == {x: every.get(x, 0) for x in [*keywords, None]}
    assert got["villa"] > 0 and got["villa design"] > 0


@pytest.mark.parametrize("group", [1, 7, 2000])
def test_universal_terms(spark, monkeypatch, group):
    monkeypatch.setattr(universal, "GROUP", group)
    rows = [(i, f"{text} every {'most' if i % 5 else 'x'} {'half' if i % 2 else ''} every") for i, text in corpus(3, 50, 1)]
    rows += [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.term for r in universal.universal_terms(df, threshold=0.8, defaults=["listed"]).collect()}
    assert {"every", "most", "listed"} <= got and "half" not in got  # most has exactly four fifths
    assert {r.term for r in universal.universal_terms(df.limit(2), defaults=[]).collect()} == set()
    assert universal.universal_terms(df.where(F.lit(False)), defaults=["a"]).count() == 1


def test_a_filter_of_many_hashes_stays_thin(spark):
    found = grams.hash_filter(spark.range(16_000_000).select(F.xxhash64("id").alias("h")))
    other = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    assert found.passes(other).mean() < 0.03  # 0.14 with an eighth of the bits


@pytest.mark.parametrize("least", [1, 3])
def test_hashes_are_counted_by_slice(spark, monkeypatch, least):
    monkeypatch.setattr(grams, "CHUNK", 64)
    monkeypatch.setattr(grams, "HELD", 50)
    rows = [(t,) for _, t in corpus(7)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string").repartition(3)

    def every(tokens):
        first, _, h = tokens.grams(1, 2)
        at, _, of = grams.counted(h, tokens.row[first])
        return h[at], of

    table = grams.hash_counts(df, "t", every, least)
    tokens = grams.Tokens.of(pa.array([t for t, in rows], pa.string()))
    first, _, h = tokens.grams(1, 2)
    want = Counter(int(x) for x, _ in {(x, r) for x, r in zip(h.view(np.int64).tolist(), tokens.row[first].tolist(), strict=True)})
    got = table.collect()
    assert {r.h: r.df for r in got} == {x: n for x, n in want.items() if n >= least} and len(got) == len({r.h for r in got})
    # what crosses the shuffle are slices, not hashes
    assert "hashpartitioning(slice" in table._jdf.queryExecution().executedPlan().toString()
    assert grams.hash_counts(df.limit(0), "t", every).count() == 0
