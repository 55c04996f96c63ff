"""The automaton against a plain search, and its cost by the length of the list."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kwloom import lexicon as lx
from kwloom.functions.literals import first_literals, needed


def test_first_listed_literal_of_each_group(spark):
    rng = random.Random(1)
    groups = [["".join(rng.choices("abé ", k=rng.randint(1, 4))) for _ in range(30)] for _ in range(4)] + [[], ["zz", ""], ["ab"] * 3]
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r.i: r.v for r in df.select("i", first_literals(F.col("t"), groups).alias("v")).collect()}
    for i, text in enumerate(texts):
        want = None if text is None else [next((k for k, x in enumerate(g) if x in text), None) for g in groups]
        assert got[i] == want


def test_cost_is_flat_in_the_list(spark):
    texts = spark.range(60_000).select(F.concat(F.lit("a keyword of some length, number "), F.col("id")).alias("t")).repartition(4).cache()
    texts.count()

    def seconds(n):
        groups = [[f"entry {k} of the list" for k in range(n)]]
        begun = time.perf_counter()
        texts.select(F.sum(F.size(first_literals(F.col("t"), groups)))).collect()
        return time.perf_counter() - begun

    seconds(70)
    assert seconds(10_000) < 4 * seconds(70) + 1
    texts.unpersist()


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        (r"\byears? of experience\b", [" of experience"]), (r"\bcase stud(?:y|ies)\b", ["case stud"]), (r"\bspeciali[sz]e\b", ["speciali"]),
        (r"(?:villa|wall)s?\s+x", ["villa", "wall"]), (r"\d+", None), (r"(?:a|\d)", None), (r"(?:abc)+d?", ["abc"]), (r"a|bc", ["a", "bc"]), (r"(", None),
    ],
)
def test_needed_literals(pattern, literals):
    assert needed(pattern) == literals


def test_needed_literals_are_in_every_match():
    samples = ["10 years of experience", "completed 12 projects", "case studies", "before  and after", "specialise", "iso 9001", "no hidden fees", "free quote"]
    for rules in lx.TRUST_PATTERNS.values():
        for pattern, _ in rules:
            for text in samples:
                if re.search(pattern, text):
                    assert any(x in text for x in needed(pattern))
