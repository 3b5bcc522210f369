import numpy as np
import pytest

from sparkloom.operators import blocked, factor_variants, factorize, linalg
from sparkloom.plans import pipelines

EPS = 1e-5


def positive(m):
    return (np.abs(m) + m) / 2


def coo(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v], "i int, j int, v double")


def rows(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "gene int, vec array<double>")


def array(df):
    return np.array([r["vec"] for r in df.orderBy("gene").collect()])


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    g = np.repeat(np.eye(3), 6, axis=0)

    def network():
        a = g @ g.T * (rng.random((18, 18)) < 0.8) + 0.05 * rng.random((18, 18))
        return (a + a.T) / 2

    return [network() for _ in range(3)], g @ rng.random((3, 8)), rng.random((18, 3)), rng.random((8, 2))


def dense_fit(nets, e, g1, g2, turns, stale=False, every=10, tolerance=1e-3):
    """The model with dense residuals."""
    first, last, trace = g1.copy(), None, []
    for t in range(1, turns + 1):
        inverse = np.linalg.inv(g1.T @ g1)
        s = [inverse @ g1.T @ a @ g1 @ inverse for a in nets]
        objective = sum(((a - g1 @ x @ g1.T) ** 2).sum() for a, x in zip(nets, s, strict=True))
        if e is not None:
            project = np.linalg.inv(first.T @ first) @ first.T if stale else inverse @ g1.T
            se = project @ e @ g2 @ np.linalg.inv(g2.T @ g2)
            objective += ((e - g1 @ se @ g2.T) ** 2).sum()
        if t == 1 or t % every == 0:
            trace.append((t, objective))
            if last is not None and abs(last - objective) <= tolerance * abs(last):
                break
            last = objective
        num = den = 0
        for p, q in [(a @ g1 @ x.T, x @ g1.T @ g1 @ x.T) for a, x in zip(nets, s, strict=True)] + ([(e @ g2 @ se.T, se @ g2.T @ g2 @ se.T)] if e is not None else []):
            num, den = num + positive(p) + g1 @ positive(-q), den + positive(-p) + g1 @ positive(q)
        g1 = g1 * np.sqrt((num + EPS) / (den + EPS)) + EPS
        if e is not None:
            p, q = e.T @ g1 @ se, se.T @ g1.T @ g1 @ se
            g2 = g2 * np.sqrt((positive(p) + g2 @ positive(-q) + EPS) / (positive(-p) + g2 @ positive(q) + EPS)) + EPS
    return g1, g2, trace


@pytest.mark.parametrize(("block_rows", "turns", "every", "tolerance"), [(5, 12, 3, 0.12), (1000, 200, 10, 1e-3)])
def test_batched_fits_equal_dense_ones(spark, planted, monkeypatch, block_rows, turns, every, tolerance):
    monkeypatch.setattr(factorize, "TEST_EVERY", every)
    monkeypatch.setattr(factorize, "TOLERANCE", tolerance)
    nets, e, g1, g2 = planted
    models = [factorize.Model("all", (0, 1, 2), 3, 2), factorize.Model("one", (1,), 3, 2), factorize.Model("alone", (), 3, 2, True, True), factorize.Model("networks", (0, 2), 3, 2, False)]
    found = factorize.fit(models, [coo(spark, a) for a in nets], coo(spark, e), [rows(spark, g1)] * 4, [rows(spark, g2)] * 3 + [None], turns, block_rows)
    ends = set()
    for m, f in zip(models, found, strict=True):
        want1, want2, trace = dense_fit([nets[i] for i in m.networks], e if m.expression else None, g1, g2, turns, m.stale_projection, every, tolerance)
        assert [t for t, *_ in f.trace] == [t for t, _ in trace]
        assert [o for _, o, _ in f.trace] == pytest.approx([o for _, o in trace], rel=1e-9)
        assert np.abs(array(f.g1) - want1).max() < 1e-6
        assert m.expression or f.g2 is None
        if m.expression:
            assert np.abs(array(f.g2) - want2).max() < 1e-6 and f.s_expression.shape == (3, 2)
        ends.add(trace[-1][0])
    assert len(ends) > 1 and min(ends) < turns  # they stop by their rule, at different turns


def test_combinations_equal_single_fits(spark, planted):
    nets, e, *_ = planted
    named = {n: coo(spark, a) for n, a in zip(("PPI", "GI", "MI"), nets, strict=True)}
    genes, cells = spark.range(18).selectExpr("cast(id as int) as gene"), spark.range(8).selectExpr("cast(id as int) as gene")
    chosen = [("PPI", "GI", "MI"), ("GI",), ()]
    found = factorize.combined(named, chosen, coo(spark, e), genes, cells, 3, 2, max_iter=60)
    assert list(found) == ["PPI+GI+MI", "GI", "EXP"]
    u, _, v = np.linalg.svd(e, full_matrices=False)
    for names, f in zip(chosen, found.values(), strict=True):
        mine = [nets[list(named).index(n)] for n in names]
        g1 = np.abs(u[:, :3]) + EPS + (np.abs(np.linalg.svd(sum(mine))[0][:, :3]) if mine else 0)
        want1, want2, trace = dense_fit(mine, e, g1, np.abs(v[:2].T) + EPS, 60)
        assert [t for t, *_ in f.trace] == [t for t, _ in trace]
        assert [o for _, o, _ in f.trace] == pytest.approx([o for _, o in trace], rel=1e-6)
        assert np.abs(array(f.g1) - want1).max() < 1e-6 and np.abs(array(f.g2) - want2).max() < 1e-6


@pytest.mark.parametrize("block_rows", [7, 100])
def test_singular_vectors(spark, block_rows):
    rng = np.random.default_rng(2)
    a = rng.random((20, 12)) * (rng.random((20, 12)) < 0.4)
    a[3] = a[4] = 0
    u, values, v = linalg.truncated_svd(coo(spark, a), 4, block_rows=block_rows)
    left, s, right = np.linalg.svd(a, full_matrices=False)
    assert values == pytest.approx(list(s[:4]))
    present = sorted(set(np.nonzero(a)[0].tolist()))
    assert [r["gene"] for r in u.orderBy("gene").collect()] == present
    assert np.abs(array(u) - np.abs(left[present, :4])).max() < 1e-6
    assert np.abs(array(v.withColumnRenamed("cell", "gene")) - np.abs(right[:4].T)).max() < 1e-6
    low = np.outer(np.arange(1.0, 21), np.arange(1.0, 4))
    u, values, v = linalg.truncated_svd(coo(spark, low), 3, block_rows=block_rows)
    assert values == pytest.approx([np.linalg.norm(low)]) and len(u.first()["vec"]) == 1


@pytest.mark.parametrize("held", [linalg.HELD_BYTES, 0])
def test_singular_vectors_of_a_flat_spectrum(spark, monkeypatch, held):
    monkeypatch.setattr(linalg, "HELD_BYTES", held)
    rng = np.random.default_rng(4)
    a = rng.random((150, 90)) * (rng.random((150, 90)) < 0.2)
    u, values, v = linalg.truncated_svd(coo(spark, a if held else a.T), 4, block_rows=60)
    left, s, right = np.linalg.svd(a if held else a.T, full_matrices=False)
    # Values that hardly change from pass to pass do not show that they are found.
    assert values == pytest.approx(list(s[:4]), rel=1e-12)
    assert np.abs(array(u) - np.abs(left[:, :4])).max() < 1e-6
    assert np.abs(array(v.withColumnRenamed("cell", "gene")) - np.abs(right[:4].T)).max() < 1e-6


def test_tiles_add_up_repeated_entries(spark):
    entries = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 2, 5.0), (None, 1, 1.0), (1, 1, None), (9, 1, 1.0)], "i int, j int, v double")
    keys = blocked.index(spark.createDataFrame([(0,), (1,), (2,), (None,)], "gene int"), 2)
    assert keys.count() == 3 and blocked.squares(blocked.tiles([entries], keys, keys)) == {0: 34.0}
    rng = np.random.default_rng(1)
    for share in (0.01, 0.9):
        m = rng.random((300, 40)) * (rng.random((300, 40)) < share)
        ra, ca = np.nonzero(m)
        x = rng.random((40, 3))
        places, out = blocked.product(ra, ca, m[ra, ca], 300, x)
        whole = np.zeros((300, 3))
        whole[places] = out
        assert np.allclose(whole, m @ x)


def test_given_basis(spark, planted):
    _, e, g1, _ = planted
    start = np.random.default_rng(9).random((8, 3))
    found, trace = factor_variants.partial_factor(coo(spark, e), rows(spark, g1), rows(spark, start), 40)
    n, errors = start, [np.linalg.norm(e - g1 @ start.T)]
    for turn in range(1, 41):
        n = n * (e.T @ g1 / (n @ (g1.T @ g1) + EPS)) + EPS
        if turn == 1 or turn % 10 == 0:
            errors.append(np.linalg.norm(e - g1 @ n.T))
    assert np.abs(array(found) - n).max() < 1e-9 and [x for _, x, _ in trace] == pytest.approx(errors)
    assert all(a >= b - 1e-3 for a, b in zip(errors, errors[1:], strict=False))


def test_laplacian_term(spark, planted):
    nets, e, g1, g2 = planted
    a = (nets[0][:8, :8] > 0.3).astype(float)
    np.fill_diagonal(a, 0)
    laplacian = np.diag(a.sum(axis=0)) - a
    terms = {}
    for gamma in (0.0, 0.5):
        found, s, trace = factor_variants.laplacian_factor(coo(spark, e), coo(spark, laplacian), rows(spark, g1), 2, gamma, rows(spark, g2), 12)
        d, gram, errors = g2, g1.T @ g1, []
        for turn in range(13):
            middle = np.linalg.inv(gram) @ g1.T @ e @ d @ np.linalg.inv(d.T @ d)
            if turn <= 1 or turn % 10 == 0 or turn == 12:
                errors.append(((e - g1 @ middle @ d.T) ** 2).sum() + gamma * np.trace(d.T @ laplacian @ d))
            if turn < 12:
                p, q = e.T @ g1 @ middle, middle.T @ gram @ middle
                d = d * np.sqrt((positive(p) + d @ positive(-q) + gamma * positive(-laplacian) @ d) / (positive(-p) + d @ positive(q) + gamma * positive(laplacian) @ d + EPS)) + EPS
        assert np.abs(array(found) - d).max() < 1e-6 and np.allclose(s, middle)
        assert [o for _, o, *_ in trace] == pytest.approx(errors)
        terms[gamma] = trace[-1][3]
    assert terms[0.5] < terms[0.0]


def test_one_basis_for_all(spark, planted):
    nets, e, g1, _ = planted
    nets, rng = nets[:2], np.random.default_rng(3)
    b, p = rng.random((18, 3)), rng.random((8, 2))
    gs, s, sn = [rng.random((18, 3)) for _ in nets], rng.random((2, 3)), [rng.random((3, 3)) for _ in nets]
    starts = {"B": rows(spark, b), "P": rows(spark, p), "G": [rows(spark, g) for g in gs], "S": s, "S_networks": sn}
    found, trace = factor_variants.orthonormal_factor(coo(spark, e), [coo(spark, a) for a in nets], 2, 3, starts, 4)
    x, errors = e.T, []
    scaled = lambda y, up, down: y * np.sqrt(up / (down + EPS)) + EPS
    for _ in range(4):
        up = x.T @ p @ s + sum(a.T @ g @ m for a, g, m in zip(nets, gs, sn, strict=True))
        b = scaled(b, up, b @ (b.T @ up))
        p = scaled(p, x @ b @ s.T, p @ s @ b.T @ b @ s.T)
        s = scaled(s, p.T @ x @ b, p.T @ p @ s @ b.T @ b)
        gs = [scaled(g, a @ b @ m.T, g @ m @ b.T @ b @ m.T) for a, g, m in zip(nets, gs, sn, strict=True)]
        sn = [scaled(m, g.T @ a @ b, g.T @ g @ m @ b.T @ b) for a, g, m in zip(nets, gs, sn, strict=True)]
        errors.append(np.linalg.norm(x - p @ s @ b.T) + sum(np.linalg.norm(a - g @ m @ b.T) for a, g, m in zip(nets, gs, sn, strict=True)))
    assert np.abs(array(found["B"]) - b).max() < 1e-8 and np.abs(array(found["P"]) - p).max() < 1e-8
    assert all(np.abs(array(f) - g).max() < 1e-8 for f, g in zip(found["G"], gs, strict=True))
    assert np.allclose(found["S"], s) and all(np.allclose(y, m) for y, m in zip(found["S_networks"], sn, strict=True))
    assert [o for _, o in trace] == pytest.approx([errors[0], errors[-1]]) and trace[-1][1] < trace[0][1]
    spread = lambda m: np.abs(m.T @ m - np.eye(3)).sum()
    assert spread(b) < spread(rng.random((18, 3)))  # columns of the basis tend to be orthonormal


def test_refits_go_on_from_the_full_model(spark, planted):
    nets, e, *_ = planted
    named = {n: coo(spark, a) for n, a in zip(("PPI", "GI", "MI"), nets, strict=True)}
    tests = spark.createDataFrame([(g, g % 2) for g in (0, 1, 6, 7, 12, 13)], "gene int, fold int")
    gone = pipelines.without_genes(named["MI"], tests.filter("fold = 0"))
    assert {r["i"] for r in gone.collect()} | {r["j"] for r in gone.collect()} == set(range(18)) - {0, 6, 12}
    fits, full = pipelines.masked_refits(named, "MI", coo(spark, e), tests, 2, 3, 2)
    assert list(fits) == ["none", "masked 0", "masked 1"]
    start1, start2 = array(full.g1), array(full.g2)
    for name, f in fits.items():
        mine = nets[:2]
        if name != "none":
            m, out = nets[2].copy(), [g for g in (0, 1, 6, 7, 12, 13) if g % 2 == int(name[-1])]
            m[out] = 0
            m[:, out] = 0
            mine = [*mine, m]
        want1, want2, trace = dense_fit(mine, e, start1, start2, 1000)
        assert np.abs(array(f.g1) - want1).max() < 1e-6 and np.abs(array(f.g2) - want2).max() < 1e-6
        assert [t for t, *_ in f.trace] == [t for t, _ in trace]


def test_sums_of_many_tasks_meet_before_the_driver(spark):
    size, tasks = 1 << 13, 100
    parts = spark.range(tasks).repartition(tasks).select("id").mapInArrow(lambda batches: sent(batches, size), "kind int, data binary")
    rows = parts.select("data")
    made = blocked.condensed(rows, size, tasks)
    # Before, up to 32 MB reached the driver in each pass.
    assert made.count() * size * 8 <= 1 << 20 and made.count() < tasks
    assert np.array_equal(blocked.summed(parts, size, tasks), np.full(size, sum(range(tasks)), dtype=float))


def sent(batches, size):
    import pyarrow as pa

    for batch in batches:
        for k in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([blocked.SUMS], pa.int32()), pa.array([np.full(size, float(k)).tobytes()], pa.binary())], ["kind", "data"])


def test_singular_vectors_of_many_equal_parts(spark):
    import warnings

    rng = np.random.default_rng(6)
    part = rng.random((7, 5)) + 0.1
    a = np.kron(np.eye(40), part)
    # Forty values are the largest one: no column lies below the wanted ones. Before, passes went on to their limit.
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="singular values")
        u, values, v = linalg.truncated_svd(coo(spark, a), 4, max_iter=40, block_rows=90)
    left, s, right = np.linalg.svd(part)
    assert values == pytest.approx([s[0]] * 4, rel=1e-9)
    # Any vectors of the largest value are right: in each part they are multiples of the part's own.
    for found, own in ((array(u), left[:, 0]), (array(v.withColumnRenamed("cell", "gene")), right[0])):
        for x in found.T:
            each = x.reshape(40, -1)
            assert np.abs(each - np.outer(each @ np.abs(own), np.abs(own))).max() < 1e-6
        assert (found**2).sum(axis=0) == pytest.approx(np.ones(4))


def test_networks_of_more_blocks_are_cut_once(spark, planted, monkeypatch):
    nets, e, *_ = planted
    monkeypatch.setattr(blocked, "BLOCK_ROWS", 8)
    cuts, cut = [], blocked.tiles
    monkeypatch.setattr(blocked, "tiles", lambda matrices, *rest, **kept: cuts.append(len(matrices)) or cut(matrices, *rest, **kept))
    named = {n: coo(spark, a) for n, a in zip(("PPI", "GI"), nets, strict=False)}
    genes, cells = spark.range(18).selectExpr("cast(id as int) as gene"), spark.range(8).selectExpr("cast(id as int) as gene")
    found = factorize.combined(named, [("PPI", "GI"), ("GI",)], coo(spark, e), genes, cells, 3, 2, max_iter=2)
    assert cuts == [1, 2, 1]  # the expression for its decomposition, both networks, the expression for the fit
    u, _, v = np.linalg.svd(e, full_matrices=False)
    for mine, f in zip((nets[:2], nets[1:2]), found.values(), strict=True):
        g1 = np.abs(u[:, :3]) + EPS + np.abs(np.linalg.svd(sum(mine))[0][:, :3])
        want1, want2, _ = dense_fit(mine, e, g1, np.abs(v[:2].T) + EPS, 2)
        assert np.abs(array(f.g1) - want1).max() < 1e-6 and np.abs(array(f.g2) - want2).max() < 1e-6
    few = spark.range(17).selectExpr("cast(id as int) as gene")
    assert factorize._beyond(list(named.values()), few) and not factorize._beyond(list(named.values()), genes)
