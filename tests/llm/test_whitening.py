"""Whitening against plain exact arithmetic and a plain eigensolver."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from riskspark.llm import whitening


def plain_matrix(vectors):
    """n * sum(x x') - S S' of the integer entries, in Python integers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    return x, s, [[n * sum(row[i] * row[j] for row in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def plain_polynomial(matrix):
    """Faddeev and LeVerrier, exact, constant term first."""
    d = len(matrix)
    c, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][l] * m[l][j] for l in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(matrix[i][l] * m[l][i] for l in range(d)) for i in range(d)) / k)
    return [int(v) for v in reversed(c)]


def test_polynomial_is_exact(spark):
    rng = random.Random(4)
    for d in (1, 2, 5, 9):
        vectors = [[rng.uniform(-3, 3) for _ in range(d)] for _ in range(30)]
        _, _, matrix = plain_matrix(vectors)
        assert whitening.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)
    # a zero below the diagonal, repeated roots, a zero matrix
    for matrix in ([[2, 0, 0], [0, 2, 0], [0, 0, 5]], [[0, 0], [0, 0]], [[1, 1], [1, 1]]):
        assert whitening.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)


def test_roots_and_null_spaces():
    # (x - 5)^2 (x - 5 - 2^-40) (x - 1) x, scaled to integers
    close = 5 * (1 << 40) + 1
    roots = [5 << 40, 5 << 40, close, 1 << 40, 0]
    polynomial = [1]
    for r in roots:
        polynomial = [a - r * b for a, b in zip([0, *polynomial], [*polynomial, 0])]
    assert [(float(r), m) for r, m in whitening.largest_roots(polynomial, 9)] == [(close, 1), (5 << 40, 2), (1 << 40, 1)]
    assert whitening.largest_roots([0, 0, 0, 1], 3) == []
    matrix = [[2, 0, 0], [0, 2, 0], [0, 0, 5]]
    pair = np.array(whitening.null_space(matrix, Fraction(2), 2))
    assert np.allclose(pair @ pair.T, np.eye(2), atol=1e-15) and np.allclose(pair[:, 2], 0, atol=1e-15)


def check(rows, vectors, ids, count=32):
    x, s, matrix = plain_matrix(vectors)
    n, d = len(x), len(s)
    values, axes = np.linalg.eigh(np.array(matrix, dtype=np.float64) / n / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(count, d)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id) == sorted(ids) and len(rows) == n * k
    trace = sum(matrix[i][i] for i in range(d)) / n / n
    signs = None
    for i, row in zip(ids, x):
        got = by_id[i]
        assert sorted(got) == list(range(1, k + 1))
        centred = np.array([n * a - b for a, b in zip(row, s)], dtype=object)
        assert {(r.n, r.deviation) for r in got.values()} == {(n, sum(v * v for v in centred))}
        assert all(r.identity_error < 1e-9 for r in got.values())
        w = np.array([got[c].whitened for c in range(1, k + 1)])
        plain = (centred / n).astype(np.float64) @ axes[:, :k] / np.sqrt(values[:k])
        if signs is None:
            signs = np.sign(w * plain)
        assert np.allclose(w, plain * signs, atol=1e-8)
        assert np.allclose([got[c].explained for c in range(1, k + 1)], values[:k] / trace, rtol=1e-10)


@pytest.mark.parametrize("d", [3, 40])
def test_equals_a_plain_eigensolver(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(90, d)) @ rng.normal(size=(d, d))).tolist()
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, vector string, n int")
    check(whitening.whiten(docs).collect(), vectors, list(range(90)))


def test_nulls_and_corner_cases(spark):
    schema = "vec_id long, embedding array<double>"
    good = [[1.0, 2.0], [2.0, 0.5], [0.25, 4.0], [0.25, 4.0]]
    bad = [None, [1.0, None], [math.nan, 1.0], [1.0, math.inf], [-math.inf, 1.0]]
    docs = spark.createDataFrame(list(enumerate(good + bad)), schema)
    check(whitening.whiten(docs).collect(), good, [0, 1, 2, 3])
    # shorter vectors end in zeros, a null id stays, repeated rows count each
    docs = spark.createDataFrame([(None, [1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [])], schema)
    rows = whitening.whiten(docs).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2
    assert all(r.identity_error < 1e-9 for r in rows)
    # no variance, no vectors, no entries
    for some in ([(1, [1.0, 1.0])], [(1, [2.0]), (2, [2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(some, schema)).count() == 0
    assert whitening.whiten(docs.where("false")).count() == 0
    # entries that fit no long, a deviation that fits none
    rows = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [-1e300, 1.0])], schema)).collect()
    assert {r.deviation for r in rows if r.vec_id == 1} == {whitening.LONG_MAX} and len(rows) == 6


def test_repeated_eigenvalues(spark):
    vectors = [[a, b, c] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 4.0)]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = whitening.whiten(docs).collect()
    assert len(rows) == 24 and all(r.identity_error < 1e-12 for r in rows)
    explained = {r.component: r.explained for r in rows}
    assert np.allclose([explained[c] for c in (1, 2, 3)], [16 / 18, 1 / 18, 1 / 18], rtol=1e-12)
