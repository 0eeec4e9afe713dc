import numpy as np
import pytest

from lexiforge.llm.whitening import leading_components, leading_values, sturm_count, tridiagonal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x long, component string, n int"


def reference(rows, components=4):
    """Everything by plain numpy on one machine."""
    x = {}
    for i, (v, e) in enumerate(rows):
        if e is not None and all(c is not None and np.isfinite(c) for c in e):
            x[i] = np.floor(256 * np.float64(np.array(e, np.float32))).astype(int)
    d = max(map(len, x.values()))
    x = {i: np.pad(v, (0, d - len(v))) for i, v in x.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(0)
    cov = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        for k in range(components):
            out[rows[i][0], k + 1] = (n, sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)),
                                      (v - fit.mean(0)) @ vectors[:, k] / np.sqrt(values[k]), values[k] / np.trace(cov))
    return out


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [1, .7, .5, .3, .2, .1]
    rows = [(i, base[i % 250].tolist()) for i in range(300)]
    rows += [(900, None), (901, [0.1, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [0.5, -0.25])]
    df = spark.createDataFrame([(i, e, 1, 2, "c", 3) for i, e in rows], SCHEMA)
    want, got = reference(rows), {(r["vec_id"], r["component"]): r for r in whiten(df).collect()}
    assert set(want) == set(got)
    flip = [np.sign(got[0, k]["whitened"] * want[0, k][2]) for k in range(1, 5)]
    for key, (n, deviation, z, share) in want.items():
        g = got[key]
        assert (g["n"], g["deviation"]) == (n, deviation)
        assert abs(g["whitened"] - z * flip[key[1] - 1]) < 1e-9 and abs(g["explained"] / share - 1) < 1e-9
        assert 0 <= g["identity_error"] < 1e-9


def test_eigenvectors_of_close_and_equal_values():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    for values in ([5, 5, 5, 5] + [1] * 26, [5, 5 - 1e-13, 5 - 1e-9, 4] + list(np.linspace(3, 0, 26)), [2, 0, 0, 0] + [0] * 26, [3] * 30):
        a = (q * np.array(values, float)) @ q.T
        a = (a + a.T) / 2
        e, u = leading_components(a, 4)
        k = sum(v > 0 for v in values[:4])
        assert len(e) >= k and np.allclose(e[:k], values[:k], atol=1e-13 * 30)
        assert np.abs(a @ u.T - u.T * e).max() < 1e-12 and np.abs(u @ u.T - np.eye(len(u))).max() < 1e-13


def test_bisection_counts():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    diag, off, _ = tridiagonal(a)
    want = np.linalg.eigvalsh(a)
    assert sturm_count(diag, off, want + 1e-9).tolist() == list(range(1, 13))
    assert np.allclose(leading_values(diag, off, 12), want[::-1], atol=1e-12)
    assert leading_components(np.diag([3.0, 1.0]), 4)[0].tolist() == [3.0, 1.0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5]), (None, [0.5])], [(1, [])]])
def test_no_variance_gives_no_rows(spark, rows):
    df = spark.createDataFrame([(i, e, 1, 2, "c", 3) for i, e in rows], SCHEMA)
    out = whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_exact_deviation_of_great_numbers(spark):
    rows = [(k, [float(k) * 2 ** 20, 1.0]) for k in range(3)] + [(None, [2.0 ** 45, 0.0]), (None, [2.0 ** 45, 0.0])]
    df = spark.createDataFrame([(i, e, 1, 2, "c", 3) for i, e in rows], SCHEMA)
    got = whiten(df).collect()
    x = [[int(256 * c) for c in e] for _, e in rows[:4]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert sum(r["vec_id"] is None for r in got) == 2 * len({r["component"] for r in got})
    assert {r["vec_id"]: r["deviation"] for r in got} == {0: None if want[0] >= 2 ** 63 else want[0], 1: None if want[1] >= 2 ** 63 else want[1],
                                                          2: None if want[2] >= 2 ** 63 else want[2], None: None}
