"""Inertia, eigenpairs and whitened rows against numpy's eigensolver."""

import numpy as np
import pytest

from quarry.llm.whitening import inertia, leading_components, packed, unpacked, whiten


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_counts_and_eigenpairs(n):
    rng = np.random.default_rng(n)
    for kind in range(4):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        e = np.sort(rng.random(n))[::-1] * 10.0 ** (kind * 2 - 3)
        if kind == 1:
            e[: min(n, 3)] = e[0]                                  # one value three times
        if kind == 2:
            e[1:] = 0                                              # one direction only
        if kind == 3 and n > 2:
            e[1] = e[0] * (1 - 1e-9)                               # two values close by
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        for s in rng.random(4) * e[0]:
            w = np.linalg.eigvalsh(a - s * np.eye(n))
            if np.abs(w).min() > 1e-9 * e[0]:
                assert inertia(a - s * np.eye(n)) == ((w > 0).sum(), (w < 0).sum())
        found = leading_components(a, 4)
        want = np.linalg.eigvalsh(a)[::-1]
        assert len(found) == min(4, n, int((want > 1e-12 * np.trace(a)).sum()))
        assert np.allclose([c.value for c in found], want[: len(found)], rtol=1e-10)
        v = np.column_stack([c.vector for c in found])
        assert np.abs(v.T @ v - np.eye(len(found))).max() < 1e-9
        for i, c in enumerate(found, 1):
            assert c.above_low >= i > c.above_high and np.linalg.norm(a @ c.vector - c.value * c.vector) < 1e-11 * e[0]


def test_indefinite_matrices_with_zero_diagonals():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.integers(-2, 3, (9, 9)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0)
        w = np.linalg.eigvalsh(a)
        if np.abs(w).min() > 1e-9:
            assert inertia(a) == ((w > 0).sum(), (w < 0).sum())


def test_keys_are_equal_for_equal_vectors():
    x = np.array([[0, 0, 0], [1, 0, 0], [1, 0, 40_000], [-5, 7, 0]])
    assert (unpacked(packed(x), 3) == x).all()
    assert packed(x)[1] == packed(x[1:2, :1])[0] and packed(x)[0] == packed(np.zeros((1, 0), dtype=np.int64))[0]


def plain(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    values, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:4]
    w = (x - s / n) @ v[:, order] / np.sqrt(values[order])
    return n, ((n * x - s) ** 2).sum(axis=1), w, values[order] / values.sum()


def rows_of(out):
    got = {}
    for r in out.collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in got.items()}


def check(out, ids, vectors):
    n, deviation, w, explained = plain(vectors)
    got = rows_of(out)
    assert out.count() == len(ids) * w.shape[1]
    order = [got[i, d] for i, d in zip(ids, deviation.tolist())]
    mine = np.array([[r["whitened"] for r in rs[: w.shape[1]]] for rs in order])
    sign = np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w * sign).max() < 1e-9
    assert all(r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
               for rs in order for r in rs)


def test_rows_against_numpy_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(9)
    v = (rng.standard_normal((300, 12)) * np.linspace(2, 0.2, 12)).astype(np.float32)
    v[200:] = v[0]                                                 # a third is one vector
    data = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] * 12)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").repartition(7)
    check(whiten(df), list(range(300)), v)


def test_ragged_null_ids_and_clashing_names(spark):
    data = [(1, [1.0, 2.0], 5), (None, [0.5], 6), (3, [], 7), (4, [1.0, -1.0], 8), (4, [0.25, 3.0, 0.0], 9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, key int")
    check(whiten(df), [1, None, 3, 4, 4], [[1, 2], [0.5, 0], [0, 0], [1, -1], [0.25, 3]])


@pytest.mark.parametrize("data", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])], [(1, [0.0]), (2, [0.0])]])
def test_without_variance_no_rows(spark, data):
    assert whiten(spark.createDataFrame(data, "vec_id long, embedding array<float>")).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0]), (3, [3e15]), (4, [1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whiten(df, 1).collect()}
    assert got[1] is None and set(got) == {1, 2, 3, 4}
