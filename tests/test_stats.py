import math
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import stats, vectors


def exact_tail(M, K, N, X):
    return sum(math.comb(K, i) * math.comb(M - K, N - i) for i in range(max(X, 0), min(K, N) + 1) if N - i <= M - K) / math.comb(M, N)


def test_hypergeometric_tail(spark):
    rng = random.Random(1)
    rows = [(10, 0, 5, 0), (10, 5, 10, 5), (10, 5, 0, 0), (10, 10, 10, 10), (20, 5, 4, 6), (7, 5, 6, 4)]
    for _ in range(150):
        M = rng.randint(1, 400)
        K, N = rng.randint(0, M), rng.randint(0, M)
        rows.append((M, K, N, rng.randint(0, min(K, N))))
    got = spark.createDataFrame(rows, "M long, K long, N long, X long").select("*", stats.hypergeom_sf(F.col("M"), F.col("K"), F.col("N"), F.col("X")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(exact_tail(r["M"], r["K"], r["N"], r["X"]), rel=1e-9, abs=1e-300), r


def test_normal_tail(spark):
    zs = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.999, 3.0, 3.001, 6.0, 10.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_sf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)) / 2, rel=1e-10)


def test_bh(spark):
    for ps in ([0.01, 0.04, 0.03, 0.2, 0.2, 1.0], [0.05], []):
        got = {r["i"]: r["p_adj"] for r in stats.adjusted_bh(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", ties=["i"]).collect()}
        order = sorted(range(len(ps)), key=lambda i: ps[i])
        low = 1.0
        for k in range(len(ps), 0, -1):
            low = min(low, ps[order[k - 1]] * len(ps) / k)
            assert got[order[k - 1]] == pytest.approx(low)


def test_mann_whitney(spark):
    rng = random.Random(2)
    a, b = [rng.randint(0, 9) for _ in range(30)], [rng.randint(0, 12) for _ in range(40)]
    rows = [(float(x), True) for x in a] + [(float(x), False) for x in b]
    df = spark.createDataFrame(rows, "v double, side boolean")
    u = sum((x > y) + (x == y) / 2 for x in a for y in b)
    for alternative, wanted in (("greater", u), ("less", len(a) * len(b) - u)):
        r = stats.mann_whitney(df, "v", "side", alternative=alternative).first()
        assert r["u1"] == u
        n1, n2 = len(a), len(b)
        n = n1 + n2
        ties = sum(c**3 - c for c in [sum(1 for x, _ in rows if x == v) for v in {x for x, _ in rows}])
        z = (wanted - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
        assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2)
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, side boolean")
    assert stats.mann_whitney(same, "v", "side").first()["p"] is None


def test_exact_u(spark):
    a, b = [1.5, 4.0, 9.0], [0.5, 2.0, 3.0, 7.0]
    u = sum(x > y for x in a for y in b)
    every = [sum(x > y for x in c for y in set(range(7)) - set(c)) for c in combinations(range(7), 3)]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b], "v double, side boolean")
    assert stats.mann_whitney_exact(df, "v", "side") == pytest.approx(sum(x >= u for x in every) / len(every))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_average_ranks(spark, values):
    got = {r["i"]: r["avg_rank"] for r in stats.average_ranks(spark.createDataFrame(list(enumerate(values)), "i int, v int"), "v").collect()}
    for i, v in enumerate(values):
        assert float(got[i]) == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2


def test_vectors(spark):
    a, b = [1.0, 2.0, -2.0], [0.0, 4.0, 1.0]
    x, y = F.array(*map(F.lit, a)), F.array(*map(F.lit, b))
    r = spark.range(1).select(
        vectors.euclidean(x, y), vectors.manhattan(x, y), vectors.cosine_distance(x, y), vectors.hard_cluster(x), vectors.softmax(x), vectors.angular_distance(x, F.array(*[F.lit(0.0)] * 3))
    ).first()
    assert r[0] == pytest.approx(math.sqrt(1 + 4 + 9)) and r[1] == 6 and r[2] == pytest.approx(1 - 6 / (3 * math.sqrt(17))) and r[3] == 1
    assert r[4] == pytest.approx([math.exp(v) / sum(map(math.exp, a)) for v in a]) and r[5] == 0


def test_exact_u_by_group(spark):
    rows = [("small", x, True) for x in (1.5, 4.0, 9.0)] + [("small", x, False) for x in (0.5, 2.0, 3.0, 7.0)]
    rows += [("tied", 1.0, True), ("tied", 1.0, False), ("tied", 2.0, True)] + [("large", float(i), i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double, side boolean")
    every = [sum(x > y for x in c for y in set(range(7)) - set(c)) for c in combinations(range(7), 3)]
    for alternative, u in (("greater", 8), ("less", 4)):
        got = {r["g"]: r for r in stats.mann_whitney(df, "v", "side", ["g"], alternative).collect()}
        assert got["small"]["p"] == pytest.approx(sum(x >= u for x in every) / len(every))
        for g in ("tied", "large"):
            assert got[g]["p"] == pytest.approx(math.erfc(got[g]["z"] / math.sqrt(2)) / 2)


def test_quantiles_by_ranges(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k % 3, rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 9), 5.0, 5.0, -1e300])) for k in range(3000)] + [(None, 1.5), (None, 2.5), (7, None), (8, float("inf")), (8, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    points = [0.0, 0.05, 0.5, 0.9, 1.0]
    monkeypatch.setattr(stats, "SORTED_ROWS", 40)
    got = {r["g"]: (r["n"], r["quantiles"]) for r in stats.quantiles(df, "v", points, ["g"]).collect()}
    assert set(got) == {0, 1, 2, None, 8}
    for g, (n, found) in got.items():
        mine = sorted(v for h, v in rows if h == g and v is not None)
        assert n == len(mine)
        for p, x in zip(points, found, strict=True):
            low = math.floor(p * (n - 1))
            high = math.ceil(p * (n - 1))
            if mine[low] == mine[high]:
                assert x == mine[low]
            elif g != 8:  # there, between 1 and infinity
                assert x == pytest.approx(mine[low] + (mine[high] - mine[low]) * (p * (n - 1) - low))
    whole = sorted(v for _, v in rows if v is not None)
    (one,) = stats.quantiles(df, "v", [0.25]).collect()
    low = (len(whole) - 1) // 4
    assert one["n"] == len(whole) and one["quantiles"][0] == pytest.approx(whole[low] + (whole[low + 1] - whole[low]) * ((len(whole) - 1) / 4 - low))
    assert stats.quantiles(df.filter("v > 1e301 and g = 1"), "v", [0.5], ["g"]).count() == 0


def test_ranks_over_a_whole_table(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([float(rng.randint(0, 40)), rng.random() * 1e6, -3.0])) for i in range(2000)]
    got = {r["id"]: r["avg_rank"] for r in stats.average_ranks(spark.createDataFrame(rows, "id int, v double"), "v").collect()}
    ordered = sorted(v for _, v in rows)
    first, last = {}, {}
    for k, v in enumerate(ordered, 1):
        first.setdefault(v, k)
        last[v] = k
    assert got == {i: (first[v] + last[v]) / 2 for i, v in rows}
    plan = stats.average_ranks(spark.createDataFrame(rows, "id int, v double"), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert all("_section" in line for line in plan.splitlines() if "Window" in line)


@pytest.mark.parametrize("cells", [(10**7, 5 * 10**6, 4 * 10**6, 2 * 10**6 + 900), (10**7, 5 * 10**6, 4 * 10**6, 10**6), (2000, 1000, 900, 480), (5000, 3, 4000, 2)])
def test_tails_of_many_terms(spark, cells):
    M, K, N, X = cells
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    expected = sum(math.exp(ln(K, x) + ln(M - K, N - x) - ln(M, N)) for x in range(X, min(K, N, X + 60_000) + 1)) if X > 1_500_000 or M < 10**6 else 1.0
    p = spark.range(1).select(stats.hypergeom_sf(*[F.lit(x) for x in cells]).alias("p")).first()["p"]
    assert p == pytest.approx(expected, rel=1e-5)


def test_markers_from_counts_of_values(spark, monkeypatch):
    import numpy as np

    from sparkloom.plans import pipelines

    rng = np.random.default_rng(8)
    rows = [(g, f"{g}-{c}", float(v)) for g in range(6) for c, v in enumerate(rng.integers(1, 5, 30) + (g == 2))] + [(1, "1-90", None), (9, "9-1", 2.0)]
    sides = [(cell, "in" if k % 3 == 0 else "out") for k, (_, cell, _) in enumerate(rows)] + [("0-1", None)]
    expression, metadata = spark.createDataFrame(rows, "gene int, cell string, value double"), spark.createDataFrame(sides, "cell string, cond string")
    written, write = {}, pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    found = pipelines.marker_test(expression, metadata, "in")
    long = expression.join(metadata, "cell").withColumn("inside", F.col("cond") == "in")
    want = {r["gene"]: r["p"] for r in stats.mann_whitney(long, "value", "inside", ["gene"]).collect() if r["p"] is not None}
    got = {r["gene"]: r for r in found.collect()}
    assert {g: r["p"] for g, r in got.items()} == want and len(want) >= 6
    for g in range(6):
        logs = {s: [np.log1p(v) for (h, cell, v), (_, side) in zip(rows, sides, strict=False) if h == g and side == s and v is not None] for s in ("in", "out")}
        assert got[g]["log_fc"] == pytest.approx(np.mean(logs["in"]) - np.mean(logs["out"]))
    # The join is made once, however often the test and the adjustment look at its counts.
    assert list(written) == ["values", "tested"] and written["values"].count() == len({(g, v) for g, _, v in rows})
