"""Whitening against exact sums and a plain eigendecomposition."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np

from shelfspark.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n double")


def test_block_scatter_is_exact():
    rnd = random.Random(5)
    for low, high, rows in ((-300, 300, 200), (0, 0, 5), (7, 7, 70), (-(1 << 30), 1 << 30, 65), (-(1 << 45), 1 << 61, 3), (-5, 900, 1)):
        x = np.array([[rnd.randint(low, high) for _ in range(5)] for _ in range(rows)], np.int64)
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(5)] for i in range(5)]
        assert whitening.block_scatter(x).tolist() == want


def test_whiten_like_numpy(spark):
    rnd = random.Random(6)
    scale = [0.9, 0.5, 0.3, 0.1, 0.05, 0.02]
    rows = [(i, [float(np.float32(rnd.gauss(0.2, s))) for s in scale]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(600)] + [(None, rows[3][1]), (5, rows[5][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1, 1, 1, 1]), (2003, [math.nan] + [0.0] * 5), (2004, [math.inf] + [0.0] * 5), (2005, [1.0, 2.0])]
    got = whitening.whiten(table(spark, [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows + bad]).repartition(7)).collect()
    ints = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in ints}), object)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.array([[float(Fraction(int(n * (fit[:, i] * fit[:, j]).sum() - sums[i] * sums[j]), n * n)) for j in range(6)] for i in range(6)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in rows for k in (1, 2, 3, 4))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    x_of = dict(ints)
    for r in got:
        if r.vec_id is None:
            continue
        x = x_of[r.vec_id]
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))
        want = (np.array(x, float) - sums.astype(float) / n) @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12
    signs = {np.sign(r.whitened * ((np.array(x_of[r.vec_id], float) - sums.astype(float) / n) @ vectors[:, r.component - 1])) * r.component for r in got if r.vec_id is not None and abs(r.whitened) > 1e-6}
    assert len({abs(s) for s in signs}) == len(signs)


def test_few_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    line = whitening.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in line) == [
        (1, 1, 2, 2 * 256**2, 1.0, 1.0), (2, 1, 2, 2 * 256**2, 1.0, 1.0)]
    ids = whitening.whiten(table(spark, [((1 << 62) + 1, [0.0, 0.0]), (None, [1.0, 1.0]), (-(1 << 61) - 1, [1.0, 0.0])]).coalesce(1)).collect()
    assert Counter(r.vec_id for r in ids) == Counter({(1 << 62) + 1: 2, None: 2, -(1 << 61) - 1: 2})
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [1.0, 1.0])])).collect()
    assert [r.deviation for r in huge] == [None, None]
