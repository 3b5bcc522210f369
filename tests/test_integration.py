from statistics import NormalDist

import numpy as np
import pytest

from sparkloom.operators import integrate


def rows(spark, m):
    return spark.createDataFrame([(f"g{i:02d}", [float(x) for x in r]) for i, r in enumerate(m)], "gene string, vec array<double>")


def long(spark, matrices):
    return spark.createDataFrame([(name, f"g{i:02d}", f"c{j:02d}", float(v)) for name, m in matrices.items() for i, row in enumerate(m) for j, v in enumerate(row) if v], "dataset string, gene string, cell string, value double")


def array(df, key="gene"):
    return np.array([r["vec"] for r in df.orderBy(key).collect()])


def slow_rows(gram, right, sweeps=20_000):
    """Coordinate descent until it rests."""
    x = np.zeros_like(right)
    for _ in range(sweeps):
        before = x.copy()
        for j in np.flatnonzero(gram.diagonal() > 0):  # a factor that nothing uses stays 0
            x[:, j] = np.maximum(0, x[:, j] + (right[:, j] - x @ gram[:, j]) / gram[j, j])
        if np.abs(x - before).max() < 1e-14:
            break
    return x


def test_nonnegative_rows():
    rng = np.random.default_rng(1)
    for k in (1, 3, 8):
        a = rng.random((20, k))
        right = rng.normal(size=(200, 20)) @ a
        right[0] = 0
        assert np.allclose(integrate.nonnegative_rows(a.T @ a, right), slow_rows(a.T @ a, right), atol=1e-7)
    assert (integrate.nonnegative_rows(np.zeros((2, 2)), np.zeros((3, 2))) == 0).all()


@pytest.fixture(scope="module")
def datasets():
    rng = np.random.default_rng(3)
    shared = rng.random((14, 3)) * (rng.random((14, 3)) < 0.6)
    out = {}
    for name, n in (("ctrl", 17), ("stim", 12)):
        own = rng.random((14, 3)) * (rng.random((14, 3)) < 0.2)
        out[name] = (shared + own) @ (rng.random((3, n)) * (rng.random((3, n)) < 0.7)) + 0.02 * rng.random((14, n))
    return out


@pytest.mark.parametrize("block_rows", [6, 1000])
def test_alternating_least_squares(spark, datasets, block_rows):
    rng, k, weight = np.random.default_rng(5), 3, 5.0
    w, vs = rng.random((14, k)), [rng.random((14, k)) for _ in datasets]
    turns = 4 if block_rows == 6 else 12
    h, found_w, found_v, objectives = integrate.integrative(long(spark, datasets), k, weight, turns, 0.0, starts=(rows(spark, w), [rows(spark, v) for v in vs]), block_rows=block_rows)
    expected, hs, es = [], [], list(datasets.values())
    for _ in range(turns):
        hs = [slow_rows((w + v).T @ (w + v) + weight * v.T @ v, e.T @ (w + v)) for e, v in zip(es, vs, strict=True)]
        vs = [slow_rows((1 + weight) * x.T @ x, e @ x - w @ (x.T @ x)) for e, x in zip(es, hs, strict=True)]
        w = slow_rows(sum(x.T @ x for x in hs), sum(e @ x - v @ (x.T @ x) for e, x, v in zip(es, hs, vs, strict=True)))
        expected.append(sum(((e - (w + v) @ x.T) ** 2).sum() + weight * ((v @ x.T) ** 2).sum() for e, x, v in zip(es, hs, vs, strict=True)))
    assert objectives == pytest.approx(expected, rel=1e-6)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(objectives, objectives[1:], strict=False))
    assert np.abs(array(found_w) - w).max() < 1e-5 and all(np.abs(array(found_v[n]) - v).max() < 1e-5 for n, v in zip(datasets, vs, strict=True))
    for name, x in zip(datasets, hs, strict=True):
        assert np.abs(array(h.filter(h.dataset == name), "cell") - x).max() < 1e-5


def test_stop_rule_and_random_start(spark, datasets):
    _, _, _, objectives = integrate.integrative(long(spark, datasets), 2, max_iter=30, tolerance=0.2)
    assert 2 <= len(objectives) < 30 and all(b <= a for a, b in zip(objectives, objectives[1:], strict=False))


def test_quantiles_are_aligned(spark):
    rng = np.random.default_rng(2)
    sizes, cells = {"a": 60, "b": 45}, []
    for name, n in sizes.items():
        for c in range(n):
            vec = np.abs(rng.normal(size=2)) * (1 if name == "a" else 3)
            vec[c % 2] += 8 * (1 if name == "a" else 3)
            cells.append((name, f"{c:03d}", [float(x) for x in vec]))
    df = spark.createDataFrame(cells, "dataset string, cell string, vec array<double>")
    got = {(r["dataset"], r["cell"]): (r["cluster"], r["vec"]) for r in integrate.quantile_aligned(df, n_quantiles=10, least_cells=15).collect()}
    assert len(got) == len(cells) and all(got[n, c][0] == int(c) % 2 for n, c, _ in cells)
    points = np.linspace(0, 1, 11)
    for cluster in (0, 1):
        for factor in (0, 1):
            mine = {n: np.array([v[factor] for m, c, v in cells if m == n and int(c) % 2 == cluster]) for n in sizes}
            moved = np.array([got["b", c][1][factor] for m, c, _ in cells if m == "b" and int(c) % 2 == cluster])
            same = np.array([got["a", c][1][factor] for m, c, _ in cells if m == "a" and int(c) % 2 == cluster])
            assert np.allclose(same, mine["a"])
            assert np.allclose(moved, np.interp(mine["b"], np.quantile(mine["b"], points), np.quantile(mine["a"], points)))
    few = integrate.quantile_aligned(df, n_quantiles=10, least_cells=1000)
    assert {(r["dataset"], r["cell"]): r["vec"] for r in few.collect()} == {(n, c): v for n, c, v in cells}


def test_gene_selection_and_scaling(spark):
    rng = np.random.default_rng(4)
    counts = {}
    for name, n in (("a", 80), ("b", 50)):
        m = rng.poisson(3.0, (30, n)).astype(float)
        m[:4] *= rng.choice([0, 12], (4, n))  # varies much more than its mean explains
        counts[name] = m
    df = long(spark, counts)
    shares = long(spark, {n: m / m.sum(axis=0) for n, m in counts.items()})
    got = {r["gene"] for r in integrate.variable_genes(shares, raw=df).collect()}
    expected = set()
    for m in counts.values():
        s, c, n = m / m.sum(axis=0), (1 / m.sum(axis=0)).mean(), m.shape[1]
        mean, var = s.mean(axis=1), s.var(axis=1, ddof=1)
        upper = mean + NormalDist().inv_cdf(1 - 0.99 / 30 / 2) * np.sqrt(mean * c / n)
        expected |= {f"g{i:02d}" for i in np.flatnonzero((var / c > upper) & (np.log10(var) > np.log10(mean * c) + 0.1))}
    assert got == expected and {f"g{i:02d}" for i in range(4)} <= got and len(got) < 30
    scaled = {(r["dataset"], r["gene"], r["cell"]): r["value"] for r in integrate.scaled_by_gene(df).collect()}
    m = counts["b"]
    rms = np.sqrt((m**2).sum(axis=1) / (m.shape[1] - 1))
    assert all(scaled["b", f"g{i:02d}", f"c{j:02d}"] == pytest.approx(m[i, j] / rms[i]) for i in range(30) for j in range(50) if m[i, j])
