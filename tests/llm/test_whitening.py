"""Whitening against whole-number brute force and numpy, and on odd rows."""

import numpy as np
import pytest

from kwloom.llm import whitening as wh
from kwloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, n long, x int"


def brute(rows, components=16):
    """(n, {id: deviations}, eigenvalues, trace, distinct x) with Python's whole numbers."""
    xs = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted(set(x for _, x in xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    dims = len(sums)
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(dims)] for i in range(dims)])
    away = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in xs]
    return n, away, np.linalg.eigvalsh(v)[::-1][:components], np.trace(v), v, np.array(fit), np.array(sums)


def checked(got, rows, components=16):
    n, away, values, trace, v, _, sums = brute(rows, components)
    size = len(values)
    assert len(got) == size * len(rows)
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=str) == sorted(set(away), key=str)
    assert {r.n for r in got} == {n}
    explained = {r.component: r.explained for r in got}
    assert np.allclose([explained[k + 1] for k in range(size)], values / trace, rtol=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9
    # every row's coordinates invert to what an independent eigenvector gives, up to its sign
    _, vectors = np.linalg.eigh(v)
    vectors = vectors[:, ::-1][:, :size]
    for k in range(size):
        want = {}
        for i, x in rows:
            z = np.array([int(np.floor(64 * float(c))) + 1_000_000 - int(s) / n for c, s in zip(x, sums, strict=True)])
            want[i] = z @ vectors[:, k] / np.sqrt(values[k])
        have = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        sign = np.sign(sum(want[i] * have[i] for i in want))
        assert np.allclose([sign * have[i] for i in want], list(want.values()), atol=1e-8)


def test_query_on_the_given_embeddings(spark):
    got = QUERIES["op12_whitening"](spark, SF).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    checked(got, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist(), 5, 6) for i in range(40)]
    good += [(100 + i, good[0][1], 5, 6) for i in range(30)] + [good[1], (None, [9.0, -9.0, 0.5], 5, 6)]
    bad = [
        (200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 1.0, 2.0]), (204, [float("inf"), 1.0, 2.0]),
        (205, [1e300, 0.0, 0.0]), (206, [1.0, 2.0]),
    ]
    df = spark.createDataFrame([*good, *[(i, v, 5, 6) for i, v in bad]], KIND).repartition(5)
    got = wh.whiten(df).collect()
    rows = [(i, v) for i, v, *_ in good]
    assert len(got) == 3 * len(rows)
    once = list({str(r): r for r in rows}.values())
    checked([r for r in {str(r): r for r in got}.values()], once)
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.where("vec_id >= 200 and vec_id < 206")).count() == 0


def test_no_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (2, [1.0, 2.0], 0, 0)], KIND)
    got = wh.whiten(same).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)
    }
    two = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (2, [3.0, 2.0], 0, 0)], KIND)
    got = {(r.vec_id, r.component): r for r in wh.whiten(two).collect()}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None
    assert got[1, 1].explained == pytest.approx(1) and got[1, 1].identity_error < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**38 + i * i), float(-(2**37) - i)]) for i in range(9)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], KIND)
    got = {r.vec_id: r.deviation for r in wh.whiten(df).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in brute(rows)[1]}
    y = np.array([[2**33, -(2**33)], [2**34 + 1, 5]], dtype=np.int64)
    assert wh.squares(y).tolist() == [2**66 + (2**34 + 1) ** 2, 2**66 + 25, (2**34 + 6) ** 2]
