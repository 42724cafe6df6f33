"""Whitening against a dense eigensolver."""

import math

import numpy as np
import pytest

from sextant.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long"


def _expected(rows, k):
    good = [
        (i, v) for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    x = np.floor(np.array([np.float32(v) for _, v in good], np.float64) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [i for i, _ in good], ((n * x - total) ** 2).sum(axis=1), centred @ vectors[:, :k] / np.sqrt(
        values[:k]
    ), values / values.sum()


@pytest.mark.parametrize("width", [3, 12, 70])
def test_whitened_vectors_match_a_dense_solver(spark, width):
    rng = np.random.default_rng(width)
    mix = rng.standard_normal((width, width)) * np.linspace(1, 0.1, width)
    vectors = (rng.standard_normal((300, width)) @ mix * 0.1).tolist()
    rows = list(enumerate(vectors))
    rows += [(1, vectors[0]), (None, vectors[1]), (7, vectors[7])]
    bad = [
        (900, None), (901, [None, *vectors[0][1:]]), (902, [float("nan"), *vectors[0][1:]]),
        (903, [float("-inf"), *vectors[0][1:]]), (904, []), (905, vectors[0][:-1]),
    ]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows + bad], SCHEMA).repartition(3)
    k = min(8, width)
    ids, deviation, whitened, explained = _expected(rows, k)
    found = whitening.whiten(docs).collect()
    assert len(found) == len(rows) * k
    assert {r["n"] for r in found} == {len(rows)}
    assert max(r["identity_error"] for r in found) < 1e-10
    sign = {}
    by_key = {}
    for r in found:
        by_key.setdefault((r["vec_id"], r["component"]), []).append(r)
    for row, vec_id in enumerate(ids):
        for c in range(k):
            near = min(
                by_key[(vec_id, c + 1)],
                key=lambda r: abs(abs(r["whitened"]) - abs(whitened[row, c])) + abs(r["deviation"] - deviation[row]),
            )
            assert near["deviation"] == deviation[row]
            assert abs(abs(near["whitened"]) - abs(whitened[row, c])) < 1e-9
            assert near["explained"] == pytest.approx(explained[c], rel=1e-10)
            if abs(whitened[row, c]) > 1e-3:
                sign.setdefault(c, set()).add(near["whitened"] * whitened[row, c] > 0)
    assert all(len(s) == 1 for s in sign.values())


def test_without_spread_there_are_no_components(spark):
    def whitened(rows):
        return whitening.whiten(spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA)).count()

    assert whitened([]) == 0
    assert whitened([(1, None)]) == 0
    assert whitened([(1, [])]) == 0
    assert whitened([(1, [0.5, 0.25])]) == 0
    assert whitened([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == 0
    # One direction only.
    assert whitened([(i, [0.1 * i, 0.2, 0.3]) for i in range(5)]) == 5


def test_equal_eigenvalues_and_flat_directions():
    rng = np.random.default_rng(1)
    for values in ([5.0] * 6 + [1.0] * 50, [3.0, 2.0, 1.0] + [0.0] * 40, [1.0] * 9):
        q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
        matrix = (q * np.array(values)) @ q.T
        found, vectors = whitening.largest_pairs(lambda u, m=matrix: m @ u, len(values), 8)
        assert np.allclose(found, values[:8], atol=1e-12)
        assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-11
        assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_exact_deviations_beyond_machine_integers():
    x = np.array([[2**40, 1], [0, 3]], np.int64)
    found = whitening.deviations(x, 2**20, x.sum(axis=0))
    assert found.dtype == object and found[0, 0] == 2**60 - 2**40
