"""Line dedup against brute force: over the given documents, on odd rows, and by both ways of probing."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwloom.llm import line_dedup as ld

SF = "/root/testdata/sf0.001"
LONG = "a line of at least forty code points, é😀, here"
ROWS = [
    (1, f"{LONG}\nshort"), (2, f"  {LONG.upper().replace('É', 'é')}\t\nmine"), (3, f"{LONG}\r\n{LONG}"), (4, f"x\n{LONG}"),
    (5, f"{LONG}\nlast"), (5, f"again\n{LONG}"), (6, None), (7, ""), (8, "\n\n"), (None, f"{LONG}\nno id"), (9, "y" * 39 + "\n" + "z" * 40),
    *[(i, "y" * 39 + "\n" + "z" * 40 + "\n" + "w" * 5000 + f"\n{LONG}x") for i in range(10, 14)], (14, "w" * 5000), (-3, "w" * 5000),
    (15, "q\x1f" + "é" * 38 + "\n" + "É" * 40), *[(i, "É" * 40) for i in range(16, 20)], (20, "é" * 40),
]


def brute(rows, least_chars=40, least_docs=5):
    """Distinct rows of (id, n_lines, n_dropped, kept), line by line."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                docs[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if i is None or len(have := docs.get(key(x), ())) < least_docs or max(have) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


@pytest.mark.parametrize("sent", [ld.SENT, 0])
def test_odd_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(ld, "PROBES", 2)
    rows = [(i, t, "clash", 1, 2) for i, t in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, k1 int, shard int").repartition(3)
    got = found(ld.dedup_lines(df, sent=sent, shard=2))
    assert got == brute(ROWS)
    assert sum(r[2] for r in got) > 10
    assert ld.dedup_lines(df.limit(0), sent=sent).count() == 0


@pytest.mark.parametrize("sent", [ld.SENT, 0])
def test_given_documents(spark, sent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = found(ld.dedup_lines(docs, least_chars=20, least_docs=2, sent=sent, shard=64))
    assert got == brute(rows, 20, 2)
    assert any(r[2] for r in got)


def test_a_line_of_very_many_documents(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(f"{LONG}\n{LONG}").alias("text"))
    for sent in (ld.SENT, 0):
        kept = ld.dedup_lines(docs, sent=sent).where("n_dropped < 2").collect()
        assert [tuple(r) for r in kept] == [(4999, 2, 0, f"{LONG}\n{LONG}")]


def test_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 2**63, (2, 20000), dtype=np.uint64)
    keys[0, :5000] = 7  # keys that differ in one half only
    keys[1, 5000:9000] = 9
    levels, at = ld.Shard.number(*keys)
    assert sorted(at) == list(range(20000))
    assert sum(8 * len(x) for x in levels) < 6 * 20000
    prints = np.empty_like(keys[1])
    prints[at] = keys[1]
    shard = ld.Shard.read([x.tobytes() for x in levels], prints.tobytes(), b"\0" * 4 * 20000, b"\0" * 8 * 20000)
    assert (shard.find(*keys) == at).all()
    other = np.random.default_rng(2).integers(0, 2**63, (2, 20000), dtype=np.uint64)
    assert (shard.find(*other) == -1).all()
