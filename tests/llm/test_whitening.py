"""op13 against numpy's eigenvectors, and block Lanczos on operators where it breaks down."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from quorumlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 3, "mine") for i, v in enumerate(vectors)]


def expected(vectors, components=32):
    """The whitened values by numpy's own decomposition, for vectors that are all usable."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening(spark):
    r = np.random.default_rng(1)
    good = r.standard_normal((300, 40)) * np.linspace(3, 0.2, 40)
    hard = [None, [], [None] * 40, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [1.0] * 39, [1.0, None]]
    docs = spark.createDataFrame(rows_of([*good, *hard]), SCHEMA).repartition(5)
    out = whitening.whiten(docs, components=12, block=5).toPandas()
    deviation, whitened, explained = expected(good, 12)
    assert len(out) == 300 * 12 and set(out["n"]) == {300} and set(out["component"]) == set(range(1, 13))
    got = np.zeros((300, 12))
    got[out["vec_id"], out["component"] - 1] = out["whitened"]
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < 1e-9
    assert (out["deviation"].to_numpy() == deviation[out["vec_id"]]).all()
    share = out.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share / explained - 1).max() < 1e-10
    error = out["identity_error"].unique()
    cov = got - got.mean(axis=0)
    assert len(error) == 1 and error[0] < 1e-10 and np.abs(cov.T @ cov / 300 - np.eye(12)).max() < 1e-10


def test_more_components_than_there_are(spark):
    """Three directions among eight dimensions: eigenvalues of nothing are left out, whatever was asked for."""
    r = np.random.default_rng(2)
    base = np.zeros((60, 8))
    base[:, [1, 4, 6]] = r.integers(-50, 50, (60, 3)) / 8
    out = whitening.whiten(spark.createDataFrame(rows_of([*base, base[0], base[0]]), SCHEMA)).toPandas()
    assert set(out["component"]) == {1, 2, 3} and len(out) == 62 * 3 and set(out["n"]) == {62}
    assert out["explained"].groupby(out["component"]).first().sum() == pytest.approx(1.0, abs=1e-12)


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame(rows_of([[1.0, 2.0]] * 4), SCHEMA)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0 and whitening.whiten(spark.createDataFrame(rows_of([None, []]), SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame(rows_of([[1.0], [2.0], [4.0]]), SCHEMA)).toPandas()
    assert len(one) == 3 and set(one["component"]) == {1}


def test_what_does_not_fit_is_an_error(spark):
    of = lambda c: spark.createDataFrame([(1, [c, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        whitening.whiten(of(1e17))
    with pytest.raises(PythonException, match="a deviation does not fit"):
        whitening.whiten(of(1e16))
    assert whitening._deviations(np.array([[1 << 31, 1], [3, 4]])).tolist() == [(1 << 62) + 1, 25]
    with pytest.raises(OverflowError):
        whitening._deviations(np.array([[1 << 31, 1 << 31, 1 << 31]]))


@pytest.mark.parametrize("block", [1, 3, 16])
@pytest.mark.parametrize("values", [[5.0] * 20 + [3.0] * 5 + [1.0, 0.5] + [0.0] * 13, [7.0] + [0.0] * 39, list(np.geomspace(100, 1e-6, 40)), [1.0] * 40])
def test_lanczos(values, block):
    """Multiple eigenvalues and closed Krylov spaces make it restart; nothing is missed."""
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.standard_normal((40, 40)))
    a = (q * values) @ q.T
    found, vectors = whitening.block_lanczos(lambda b: a @ b, 40, 30, block)
    want = np.sort(values)[::-1][:30]
    assert np.abs(found - want).max() < 1e-12 * want[0] * 40
    assert np.abs(a @ vectors - vectors * found).max() < 1e-12 * want[0] * 40 and np.abs(vectors.T @ vectors - np.eye(30)).max() < 1e-12


def test_lanczos_stops_early():
    """A spectrum that falls off needs far fewer products than the whole space."""
    r, calls = np.random.default_rng(5), []
    q, _ = np.linalg.qr(r.standard_normal((400, 400)))
    values = 1.0 / np.arange(1, 401) ** 2
    a = (q * values) @ q.T
    found, _ = whitening.block_lanczos(lambda b: (calls.append(1), a @ b)[1], 400, 32, 16)
    assert len(calls) < 20 and np.abs(found - values[:32]).max() < 1e-13
