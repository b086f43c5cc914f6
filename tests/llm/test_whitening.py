import numpy as np
import pytest

from chainloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long"


def brute(vectors, components=8):
    """Covariance and its eigenvectors, directly."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1][:components], columns[:, ::-1][:, :components]
    return ((n * x - sums).astype(object) ** 2).sum(axis=1), centred @ columns / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)).astype(np.float32)
    vectors[7] = vectors[8]
    odd = [(900, None, 1, 1), (901, [], 1, 1), (902, [1.0] * 11 + [None], 1, 1), (903, [1.0] * 11 + [float("nan")], 1, 1), (904, [float("inf")] * 12, 1, 1), (905, [1.0] * 5, 1, 1)]
    rows = [(None if i == 5 else i // 2, v.tolist(), 1, 1) for i, v in enumerate(vectors)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(7)).toPandas()
    deviation, whitened, explained = brute(vectors)
    assert len(got) == 8 * 300 and set(got.n) == {300} and got.vec_id.isna().sum() == 8
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for k in range(8):
        mine = got[got.component == k + 1]
        assert sorted(mine.deviation) == sorted(deviation.tolist())
        assert np.allclose(mine.explained, explained[k], rtol=1e-9)
        want = whitened[:, k]
        near = min(np.abs(np.sort(mine.whitened) - np.sort(s * want)).max() for s in (1, -1))
        assert near < 1e-9
    by_id = got[got.component == 1].set_index("vec_id").deviation
    assert sorted(by_id.loc[10].tolist()) == sorted(deviation[20:22].tolist())


@pytest.mark.parametrize("make", ["plain", "low rank", "equal values", "graded", "blocks", "one", "two", "wide"])
def test_solver(make):
    rng = np.random.default_rng(1)
    x = {
        "plain": lambda: rng.normal(size=(200, 40)),
        "low rank": lambda: rng.normal(size=(50, 3)) @ rng.normal(size=(3, 10)),
        "equal values": lambda: np.linalg.qr(rng.normal(size=(32, 32)))[0] * 5,
        "graded": lambda: rng.normal(size=(100, 12)) * 10.0 ** -np.arange(12),
        "blocks": lambda: np.diag([3.0, 3, 3, 2, 2, 1]),
        "one": lambda: rng.normal(size=(30, 1)),
        "two": lambda: rng.normal(size=(30, 2)),
        "wide": lambda: rng.normal(size=(6, 20)),
    }[make]()
    r = whitening.folded(np.zeros((x.shape[1], x.shape[1])), x)
    values, vectors = whitening.leading(r, 8)
    s2 = np.zeros(x.shape[1])
    s2[: min(x.shape)] = np.linalg.svd(x, compute_uv=False) ** 2
    real = values > s2[0] * (x.shape[1] * whitening.EPS) ** 2
    assert np.allclose(values[real], s2[: len(values)][real], rtol=1e-11)
    assert real.sum() == min(8, np.linalg.matrix_rank(x))
    v = vectors[:, real]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-11
    assert np.abs(x.T @ (x @ v) - v * values[real]).max() < 1e-12 * s2[0]


def test_small_values_keep_their_digits():
    a, b = np.array([1.0, 1e-5, 1e-9, 1e-14]), np.array([1e-3, 1e-8, 1e-12])
    from fractions import Fraction

    product = Fraction(1)
    for x in a:
        product *= Fraction(float(x)) ** 2
    found = whitening.dqds(a, b)
    times = Fraction(1)
    for x in found:
        times *= Fraction(float(x))
    assert abs(float(times / product) - 1) < 1e-13  # the determinant, though the values span 28 orders of magnitude


def test_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, 1) for i in range(4)], SCHEMA)
    rows = whitening.whiten(same).collect()
    assert len(rows) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in rows)
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(same.limit(1)).count() == 2
    huge = spark.createDataFrame([(1, [1e30, 0.0], 1, 1), (2, [-1e30, 5.0], 1, 1), (3, [0.0, 1.0], 1, 1)], SCHEMA)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None, *(r.deviation for r in whitening.whiten(huge).collect() if r.vec_id == 3)}
