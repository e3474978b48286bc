import math
from fractions import Fraction

import numpy as np
import plain
import pytest

from ticketloom.llm import catalog, whitening


def brute(rows, scale=1024, k=8):
    """(ids, whitened by numpy in doubles, exact deviations, explained) of rows (id, list)."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    q = [[math.floor(scale * x) for x in v] + [0] * (width - len(v)) for _, v in kept]
    n = len(q)
    x = [[a + 100000 for a in v] for v in q]
    sums = [sum(col) for col in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return [i for i, _ in kept], centred @ vectors[:, order] / np.sqrt(values[order]), deviations, (
        values[order] / np.trace(cov))


def check(found, rows, k=8):
    ids, want, deviations, explained = brute(rows, k=k)
    assert len(found) == len(ids) * want.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in found}
    for c in range(want.shape[1]):
        ours = np.array([got[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(ours @ want[:, c])
        np.testing.assert_allclose(ours * sign, want[:, c], rtol=1e-6, atol=1e-8)
        for i, d in zip(ids, deviations):
            r = got[i, c + 1]
            assert r["n"] == len(ids) and r["deviation_exact"] == str(d)
            assert r["deviation"] == (d if d < 1 << 63 else None)
            assert abs(r["explained"] - explained[c]) <= 1e-9 * explained[c]
            assert 0 <= r["identity_error"] < 1e-9


@pytest.mark.parametrize("sf", [plain.SF, plain.SF01])
def test_given_tables(spark, sf):
    found = catalog.op13_refined_whitening(spark, sf)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                             "identity_error", "deviation_exact"]
    check(found.collect(), [(r["vec_id"], r["embedding"]) for r in plain.rows("embeddings", sf)])


KIND = "vec_id long, embedding array<double>"


def test_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLICE_ROWS", 7)
    rng = np.random.default_rng(5)
    stretch = np.array([9.0, 7, 5, 4, 3, 2.5, 2, 1.5, 1, 0.5])
    rows = [(i, list(map(float, rng.normal(size=10) * stretch + 50))) for i in range(120)]
    rows += [(200, [1.0, 2.0]), (201, []), (202, None), (203, [None, 1.0]), (204, [float("nan")]),
             (205, [1.0, float("-inf")]), (None, [3.0] * 10)]
    df = spark.createDataFrame([(*r, 5) for r in rows], KIND + ", component int").repartition(6)
    check(whitening.digest(df).collect(), rows)
    whole, other = whitening.fit(df, "embedding"), whitening.fit(df.coalesce(1), "embedding")
    assert whole.n == other.n and whole.sums == other.sums  # exact sums: the partitions leave no trace
    assert (whole.values == other.values).all() and (whole.vectors == other.vectors).all()


def test_large_components_and_deviations_that_are_no_long(spark):
    rng = np.random.default_rng(6)
    rows = [(i, list(map(float, rng.normal(size=9) * 1e8 * np.arange(1, 10)))) for i in range(60)]
    df = spark.createDataFrame(rows + [(99, [1e13])], KIND)
    found = whitening.digest(df).collect()
    assert all(r["deviation"] is None for r in found)
    check(found, rows)


def test_few_rows_dimensions_and_variance(spark):
    def run(rows):
        return whitening.digest(spark.createDataFrame(rows, KIND)).collect()

    assert run([(1, [1.0, 2.0])]) == [] and run([(1, [])]) == [] and run([(1, None)]) == []
    assert run([(i, [0.5, 0.25]) for i in range(5)]) == []
    one = run([(i, [float(i % 2), 3.0]) for i in range(10)])
    assert len(one) == 10 and {abs(round(r["whitened"], 12)) for r in one} == {1.0}
    assert {(r["component"], r["explained"], r["n"]) for r in one} == {(1, 1.0, 10)}
    repeated = run([(7, [0.0, 1.0])] * 3 + [(8, [1.0, 0.0])])
    assert len(repeated) == 4
    assert whitening.digest(spark.createDataFrame([], KIND)).collect() == []


@pytest.mark.parametrize("values", [
    list(range(40, 0, -1)),
    [1 + 1e-9 * i for i in range(20)] + [1e-6 * i for i in range(20)],
    [3.0] * 5 + [2 + 1e-12 * i for i in range(10)] + [1.0, 0.0, 0.0],
    [1e6, 1.0, 1 - 1e-8, 1e-3],
])
def test_refinement_reaches_double_precision(values):
    rng = np.random.default_rng(8)
    n = len(values)
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    q = q.astype(np.longdouble)
    for _ in range(3):  # orthogonal in extended precision
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    size = max(values)
    assert np.abs(found - sorted(values, reverse=True)).max() <= 4e-16 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-15
    v = vectors.astype(np.longdouble)
    assert np.abs(a @ v - v * found).max() < 4e-16 * size
    # single eigenvalues: the vectors too are right, as far as the matrix's own last bit decides them
    for i, value in enumerate(values):
        gap = min([abs(value - w) for j, w in enumerate(values) if j != i])
        if gap > 1e-7 * size:
            at = int(np.abs(found - value).argmin())
            assert abs(abs(float(v[:, at] @ q[:, i])) - 1) < 1e-15
            assert np.abs(np.abs(v[:, at]) - np.abs(q[:, i])).max() < 1e-15 + 2.0 ** -63 * n * size / gap
