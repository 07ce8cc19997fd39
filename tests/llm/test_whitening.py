"""Whitening against exact fractions and a plain decomposition, on small and odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import whitening

KIND = "vec_id long, embedding array<double>, label int, x string, white int, i int"
R = random.Random(5)


def vectors():
    rows = [(k, [100 + R.gauss(0, s) for s in (3, 2, 1, 0.5, 0.2, 0.1)]) for k in range(300)]
    rows += [(400 + k, rows[7][1]) for k in range(200)]  # copies count once in the fit
    odd = [None, [None] * 6, [1.0, 2.0, None, 4.0, 5.0, 6.0], [math.nan] * 6, [math.inf, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, -math.inf]]
    rows += [(700 + k, v) for k, v in enumerate(odd)]
    rows += [(None, [99.0] * 6), (3, [99.5] * 6), (3, [99.5] * 6), (800, [-0.0] * 6), (801, [100.0, 100.0])]
    return rows


def good(rows):
    out = [(i, [math.floor(c * 256) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    most = max((len(x) for _, x in out), default=0)
    return [(i, x + [0] * (most - len(x))) for i, x in out]


def plain(rows):
    """n, S, covariance (fractions) over the distinct vectors."""
    fit = sorted({tuple(x) for _, x in good(rows)})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(v, n) for v in s]
    return fit, s, [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]


def made(spark, rows, kind=KIND):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3) for i, v in rows], kind)


def test_against_fractions(spark):
    rows = vectors()
    got = whitening.whiten(made(spark, rows)).collect()
    fit, s, cov = plain(rows)
    n, kept = len(fit), good(rows)
    assert len(got) == 4 * len(kept)
    e, u = np.linalg.eigh(np.array(cov, dtype=np.float64))
    trace = float(sum(cov[i][i] for i in range(6)))
    want = {}
    for i, x in kept:
        want.setdefault(i, []).append(x)
    signs = {}
    for r in got:
        xs = want[r.vec_id]
        assert r.n == n and r.deviation in [sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for x in xs]
        k = -r.component
        assert abs(r.explained - e[k] / trace) <= 1e-9 * r.explained and r.identity_error < 1e-9
        score = [float(np.array([float(a - Fraction(b, n)) for a, b in zip(x, s, strict=True)]) @ u[:, k]) / math.sqrt(e[k]) for x in xs]
        best = min(score, key=lambda v: abs(abs(v) - abs(r.whitened)))
        assert abs(abs(best) - abs(r.whitened)) < 1e-7
        if abs(best) > 1e-3:
            signs.setdefault(k, set()).add(best * r.whitened > 0)
    assert all(len(v) == 1 for v in signs.values())


def test_sums_are_exact(spark):
    """Far from zero, where doubles lose the scatter altogether, and beyond 64 bits."""
    for big in (1 << 40, 1 << 62):
        x = np.array([[big + R.randint(-5, 5), -big + R.randint(-9, 9), R.randint(-(1 << 30), 1 << 30)] for _ in range(50)])
        shift = x[0]
        s, c = whitening.cross(whitening.less(x, shift))
        y = [[int(a) - int(b) for a, b in zip(row, shift, strict=True)] for row in x]
        assert [int(v) for v in s] == [sum(r[i] for r in y) for i in range(3)]
        assert [[int(v) for v in r] for r in c] == [[sum(r[i] * r[j] for r in y) for j in range(3)] for i in range(3)]
    rows = [(k, [2.0**44 + R.randint(0, 3), 2.0**44 + R.randint(0, 30), 5.0]) for k in range(40)]
    got = whitening.whiten(made(spark, rows)).collect()
    fit, s, cov = plain(rows)
    e = np.linalg.eigvalsh(np.array(cov, dtype=np.float64))
    assert all(abs(r.explained - e[-r.component] / float(sum(cov[i][i] for i in range(3)))) < 1e-9 for r in got if r.component < 3)
    assert {r.whitened for r in got if r.component == 3} == {None} and {r.identity_error for r in got} == {None}


def test_any_order_gives_the_same(spark):
    rows = vectors()
    x = made(spark, rows).where("size(embedding) = 6").where(whitening.usable(F.col("embedding"))).select(whitening.scaled(F.col("embedding")).alias("x")).distinct()
    one, many = whitening.fit(x.repartition(1)), whitening.fit(x.repartition(13))
    assert one["n"] == many["n"] and (one["sums"] == many["sums"]).all() and (one["vectors"] == many["vectors"]).all() and (one["eigenvalues"] == many["eigenvalues"]).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])], [(1, [math.nan])]])
def test_nothing_usable(spark, rows):
    assert whitening.whiten(made(spark, rows)).collect() == []


def test_one_vector_and_few_dimensions(spark):
    got = whitening.whiten(made(spark, [(1, [1.5, 2.0]), (2, [1.5, 2.0]), (None, [1.5, 2.0])])).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(i, c) for i in (0, 1, 2) for c in (1, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    got = whitening.whiten(made(spark, [(1, [-1.0]), (2, [1.0]), (3, [1e300])])).collect()
    assert {r.n for r in got} == {3} and {r.deviation for r in got} == {None}  # beyond 64 bits


def test_query_has_whole_table(spark, tmp_path):
    rows = [(k, [R.gauss(0, 1 + c) for c in range(8)]) for k in range(60)]
    spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 240 and got.where("identity_error < 0.0001").count() == 240
