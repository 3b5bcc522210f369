import inspect
import math
import random
import time
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stats
from sparkloom.operators import aggregates, cluster, enrichment, factorize, graph, linalg, lloyd, movement, relational, resample, sets


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


PAIRS = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("g", "g"), ("d", "h")]


def test_relabelling_and_induction(spark):
    walk = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y")], "id string, symbol string")
    got = {tuple(r) for r in relational.relabelled_edges(edges_of(spark, PAIRS), walk).collect()}
    assert got == {("X", "X"), ("X", "Y"), ("Y", "d"), ("e", "f"), ("g", "g"), ("d", "h")}
    genes = spark.createDataFrame([("a",), ("b",), ("c",)], "gene string")
    simple = relational.canonical_edges(edges_of(spark, PAIRS))
    assert {tuple(r) for r in relational.induced(simple, genes).collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    assert {tuple(r) for r in relational.masked(simple, genes).collect()} == {("e", "f"), ("g", "g"), ("d", "h")}


def test_missing_key_is_an_error(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        relational.checked_inner(left, right, "k").collect()
    assert relational.checked_inner(left.filter("k = 1"), right, "k").count() == 1


def test_graph(spark):
    links = edges_of(spark, PAIRS)
    near = defaultdict(set)
    for a, b in PAIRS:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    seen, queue = {"a": 0}, deque("a")
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in seen:
                seen[y] = seen[x] + 1
                queue.append(y)
    del seen["a"]
    assert {r["gene"]: r["d"] for r in graph.path_lengths(links, "a").collect()} == seen
    assert {r["gene"]: r["component"] for r in graph.connected_components(links).collect()} == dict.fromkeys("abcdh", "a") | dict.fromkeys("ef", "e")
    assert {r["gene"] for r in graph.largest_component(links).collect()} == set("abcdh")
    got = {r["gene"]: (r["triangles"], round(r["coefficient"], 6)) for r in graph.clustering_coefficients(links).collect()}
    assert got["a"] == (1, 1.0) and got["c"] == (1, round(1 / 3, 6)) and got["e"] == (0, 0.0)
    r = graph.density(links).first()
    assert (r["nodes"], r["edges"]) == (8, 7) and r["density"] == pytest.approx(14 / 56)
    assert graph.path_lengths(links, "nobody").count() == 0
    long_path = edges_of(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)])
    assert {r["component"] for r in graph.connected_components(long_path).collect()} == {"n000"}


def test_sets(spark):
    named = spark.createDataFrame([("A", 1), ("A", 2), ("B", 2), ("B", 3), ("B", 2)], "name string, gene int")
    assert [r["gene"] for r in sets.in_all(named).collect()] == [2]
    assert {(r["names"], r["n"]) for r in sets.venn_regions(named).collect()} == {("A", 1), ("B", 1), ("A&B", 1)}
    rows = spark.createDataFrame([(i, float(i // 3)) for i in range(20)], "gene int, v double")
    want = spark.range(1).select(F.lit(7).alias("n"))
    assert sorted(r["gene"] for r in sets.top_n(rows, want, "v").collect()) == [12, 13, 15, 16, 17, 18, 19]
    assert sorted(r["gene"] for r in sets.top_n(rows, want, "v", descending=False).collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_enrichment(spark):
    clusters = spark.createDataFrame([(c, 10 * c + i) for c in range(4) for i in range(10)], "cluster int, gene int")
    known = spark.createDataFrame([(i,) for i in range(8)] + [(15,), (35,)], "gene int")
    rows = {r["cluster"]: r for r in enrichment.cluster_enrichment(clusters, known).collect()}
    assert rows[0]["enriched"] and not rows[1]["enriched"] and rows[2]["X"] == 0 and rows[2]["fold"] == 0 and rows[2]["p_adj"] is None
    s = enrichment.enrichment_summary(enrichment.cluster_enrichment(clusters, known)).first()
    assert (s["share_clusters"], s["share_genes"]) == (0.25, 0.8)
    terms = spark.createDataFrame([(i, "t") for i in range(9)] + [(15, "t"), (16, "u"), (26, "u"), (1, "single"), (1, "t")], "gene int, term string")
    usable = enrichment.usable_annotations(terms)
    assert {r["term"] for r in usable.select("term").distinct().collect()} == {"t", "u"}
    tested = {(r["cluster"], r["term"]): r for r in enrichment.term_enrichment(clusters, usable).collect()}
    assert (tested[0, "t"]["K"], tested[0, "t"]["N"], tested[0, "t"]["X"], tested[0, "t"]["M"]) == (10, 9, 9, 12)


def test_dispersion_and_rand(spark):
    rng = random.Random(3)
    runs = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    assigned = spark.createDataFrame([(r, c, g) for r, run in enumerate(runs) for g, c in enumerate(run)], "run int, cluster int, gene int")
    c = np.mean([[[a == b for b in run] for a in run] for run in runs], axis=0)
    assert aggregates.dispersion(assigned).first()["rho"] == pytest.approx((4 * (c - 0.5) ** 2).mean())
    alike = np.mean([(runs[0][i] == runs[0][j]) == (runs[1][i] == runs[1][j]) for i in range(12) for j in range(i)])
    one = aggregates.rand_index(assigned.filter("run = 0"), assigned.filter("run = 1")).first()["rand"]
    assert one == pytest.approx(alike)
    pairs = {(r["a"], r["b"]): r["rand"] for r in aggregates.run_pairs_rand(assigned).collect()}
    assert len(pairs) == 6 and pairs[0, 1] == pytest.approx(alike)


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 1, 9.99, 10, -1, 11)], "v double")
    bounds = spark.range(1).select(F.lit(0.0).alias("lo"), F.lit(10.0).alias("hi"))
    assert {r["bin"]: r["n"] for r in aggregates.histogram(rows, "v", bounds, bins=10).collect()} == {0: 1, 1: 1, 9: 2}
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in aggregates.histogram(flat, "v").collect()] == [(0, 2)]


def test_movement_and_norm(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((40, 5)), rng.random((35, 4))
    frame = lambda m: spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "gene int, vec array<double>")
    far = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    d1, d2 = far(a) / np.linalg.norm(far(a)), far(b) / np.linalg.norm(far(b))
    assert movement.distance_norm(frame(a)).first()["norm"] == pytest.approx(np.linalg.norm(far(a)))
    x, y = d1[:35, :35], d2
    wanted = {"euclidean": np.sqrt(((x - y) ** 2).sum(1)), "manhattan": np.abs(x - y).sum(1), "cosine": 1 - (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))}
    for kind, values in wanted.items():
        got = {r["gene"]: r["moved"] for r in movement.movement(frame(a), frame(b), kind).collect()}
        assert [got[i] for i in range(35)] == pytest.approx(list(values), abs=1e-7)


def test_nearest(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "gene int, vec array<double>")
    targets = points.filter("gene in (1, 3)").select(F.col("gene").alias("target"), F.col("vec").alias("t_vec"))
    from sparkloom.functions.vectors import euclidean

    got = {r["gene"]: (r["dist"], r["nearest"]) for r in relational.nearest_in(points, targets, euclidean).collect()}
    assert got == {0: (1.0, 1), 1: (0.0, 1), 2: (1.0, 1), 3: (0.0, 3), 4: (1.0, 3), 5: (2.0, 3)}


def test_clusters_and_folds(spark):
    points = spark.createDataFrame([(i, [float(i // 10 * 100 + i % 3), 1.0]) for i in range(30)], "gene int, vec array<double>")
    got, cost = cluster.k_means(points, 3, n_init=4)
    groups = defaultdict(set)
    for r in got.collect():
        groups[r["cluster"]].add(r["gene"] // 10)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]] and cost < 30
    genes = spark.createDataFrame([(i,) for i in range(23)], "gene int")
    folds = defaultdict(list)
    for r in resample.folds(genes, 5).collect():
        folds[r["fold"]].append(r["gene"])
    assert sorted(len(f) for f in folds.values()) == [3, 5, 5, 5, 5] and sorted(sum(folds.values(), [])) == list(range(23))
    p = resample.permutation_test([10, 10], [5, 5], 10, 3, 2000, 1, spark).first()["p"]
    exact = sum(math.comb(5, k) * math.comb(5, 5 - k) for k in range(3, 6)) / math.comb(10, 5)
    assert p == pytest.approx(exact, abs=0.04)


def test_paths_longer_than_64(spark):
    chain = edges_of(spark, [(str(i), str(i + 1)) for i in range(66)]).coalesce(1)
    assert {r["gene"]: r["d"] for r in graph.path_lengths(chain, "0").collect()} == {str(i): i for i in range(1, 67)}


def test_registered_jobs_are_whole(spark, monkeypatch):
    from sparkloom.plans import registry

    class Stop(Exception):
        pass

    def caught(module, name, run):
        real, seen = getattr(module, name), {}

        def spy(*args, **kwargs):
            bound = inspect.signature(real).bind(*args, **kwargs)
            bound.apply_defaults()
            seen.update(bound.arguments)
            raise Stop

        monkeypatch.setattr(module, name, spy)
        with pytest.raises(Stop):
            run(spark, "/root/testdata/sf0.001")
        monkeypatch.setattr(module, name, real)
        return seen

    got = caught(resample, "permutation_test", registry.QUERIES["permutation_p"])
    assert len(got["pools"]) == 7 and got["reps"] == 10_000 and got["shared"] <= min(got["pools"])
    assert caught(cluster, "k_means", registry.QUERIES["kmeans"])["n_init"] == 10
    assert caught(lloyd, "cluster_all", registry.QUERIES["p19_robustness"])["n_init"] == 10
    assert caught(cluster, "k_medoids", registry.QUERIES["kmedoids"])["max_iter"] is None
    assert caught(factorize, "combined", registry.QUERIES["nmtf_expr"])["max_iter"] == 1000


def test_k_medoids_are_medoids(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(10 * (i % 3), 1.0), rng.gauss(0, 1.0)]) for i in range(90)]
    found = {r["gene"]: r["medoid"] for r in cluster.k_medoids(spark.createDataFrame(rows, "gene long, vec array<double>"), 3).collect()}
    where = dict(rows)
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(where[a], where[b], strict=True)) ** 0.5
    for medoid in set(found.values()):
        members = [g for g, m in found.items() if m == medoid]
        cost = {g: sum(far(g, h) for h in members) for g in members}
        assert found[medoid] == medoid and cost[medoid] <= min(cost.values()) + 1e-9
    assert all(far(g, m) <= min(far(g, o) for o in set(found.values())) + 1e-9 for g, m in found.items())


def test_summed_distances_move_a_vector_a_few_times(spark, monkeypatch):
    assert cluster._group_count(60_000) == 4 and cluster._group_count(300) == 1
    monkeypatch.setattr(cluster, "LEAST_ROWS", 8)
    rng = np.random.default_rng(4)
    x, w, of = rng.random((70, 3)), rng.integers(1, 4, 70).astype(float), [5] * 60 + [7] * 10
    frame = spark.createDataFrame([(of[i], i, x[i].tolist(), float(w[i])) for i in range(70)], "medoid long, gene long, vec array<double>, weight double")
    got = {r["gene"]: r["s"] for r in cluster.summed_distances(frame, {5: 60, 7: 10}).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) * (np.array(of)[:, None] == np.array(of)[None])
    assert len(got) == 70 and all(got[i] == pytest.approx(far[i] @ w) for i in range(70))


def test_adjusted_p_values_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, rng.choice([0.0, 1e-300, 1.0, 0.04, round(rng.random(), 2)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, family int, p double")

    def brute(ps):
        ranked, least, out = sorted(ps, reverse=True), 1.0, {}
        for k, p in enumerate(ranked):
            least = min(least, p * len(ps) / (len(ps) - k))
            out[p] = least
        return out

    whole = brute([r[2] for r in rows])
    assert all(abs(r["p_adj"] - whole[r["p"]]) < 1e-12 for r in stats.adjusted_bh(df, "p").collect())
    each = {f: brute([r[2] for r in rows if r[1] == f]) for f in (0, 1)}
    found = stats.adjusted_bh(df, "p", ["family"]).collect()
    assert len(found) == 120 and all(abs(r["p_adj"] - each[r["family"]][r["p"]]) < 1e-12 for r in found)


def test_restarts_and_runs_share_passes(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(5, 3)) * 20
    x = middle[rng.integers(0, 5, 300)] + rng.normal(size=(300, 3))
    y = rng.normal(size=(300, 2))
    rows = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "gene int, vec array<double>")
    found, costs = lloyd.cluster_all([rows(x), rows(y)], [3, 2], [(0, 5, "x/0"), (0, 5, "x/1"), (1, 3, "y/0"), (1, 400, "y/1")], n_init=6)
    got = defaultdict(dict)
    for r in found.collect():
        got[r["run"]][r["gene"]] = r["cluster"]
    assert set(got) == set(costs) == {"x/0", "x/1", "y/0", "y/1"} and all(len(g) == 300 for g in got.values())
    assert costs["y/1"] == pytest.approx(0, abs=1e-9)  # more clusters than points
    for run, g in got.items():
        points, own = (x if run[0] == "x" else y), np.array([g[i] for i in range(300)])
        centres = {c: points[own == c].mean(axis=0) for c in set(own.tolist())}
        d = np.array([[((p - m) ** 2).sum() for m in centres.values()] for p in points])
        assert (np.array(list(centres))[d.argmin(axis=1)] == own).mean() > 0.99  # Lloyd has come to rest
        assert costs[run] == pytest.approx(sum(((points[own == c] - m) ** 2).sum() for c, m in centres.items()), rel=1e-6, abs=1e-9)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows(x).select(array_to_vector("vec").alias("features"))
    theirs = min(KMeans(k=5, seed=s, initMode="random", maxIter=300).fit(ready).summary.trainingCost for s in range(3))
    assert min(costs["x/0"], costs["x/1"]) <= theirs * 1.001


def test_dispersion_by_pairs(spark):
    rng = random.Random(4)
    rows = [(net, run, rng.randint(0, 3), gene) for net in ("a", "b") for run in range(5) for gene in range(25)]
    got = {r["nets"]: r["rho"] for r in aggregates.dispersion(spark.createDataFrame(rows, "nets string, run int, cluster int, gene int"), ["nets"]).collect()}
    for net in ("a", "b"):
        own = {(run, gene): c for n, run, c, gene in rows if n == net}
        c = [[sum(own[r, i] == own[r, j] for r in range(5)) / 5 for j in range(25)] for i in range(25)]
        assert got[net] == pytest.approx(sum(4 * (v - 0.5) ** 2 for line in c for v in line) / 625)


def test_ppmi_of_ten_steps(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(40, 41), (41, 42), (50, 50), (None, 3)]
    frame = spark.createDataFrame(edges, "src int, dst int")
    a = np.zeros((60, 60))
    for i, j in edges:
        if i is not None and i != j:
            a[i, j] = a[j, i] = 1
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    total = sum(np.linalg.matrix_power(p, k) for k in range(1, 11))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(total * total.sum() / (total.sum(1)[:, None] * total.sum(0)[None]))
    wanted = {(i, j): value[i, j] for i, j in zip(*np.nonzero(value > 1e-9), strict=True)}
    # Few source rows a task; all in one; a join a step.
    for options in ({"cells": 100}, {}, {"walk_links": 0}):
        got = {(r["i"], r["j"]): r["v"] for r in graph.ppmi(frame, **options).filter("v > 1e-9").collect()}
        assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    assert {r["v"] for r in graph.ppmi(frame, binary=True).collect()} == {1.0}
    assert graph.ppmi(frame.limit(0)).count() == 0


def test_ppmi_over_several_tiles(spark, monkeypatch):
    from sparkloom.operators import blocked

    whole = blocked.index
    monkeypatch.setattr(blocked, "index", lambda keys, rows=7: whole(keys, rows))
    rng = random.Random(2)
    frame = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(90)], "src int, dst int")
    rows = lambda df: {(r["i"], r["j"]): r["v"] for r in df.filter("v > 1e-9").collect()}
    got, wanted = rows(graph.ppmi(frame, 6, cells=200)), rows(graph.ppmi(frame, 6, walk_links=0))
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)


def test_ppmi_walks_between_classes_of_equal_neighbours(spark, monkeypatch):
    edges = [(h, 100 * h + leaf) for h in range(1, 4) for leaf in range(1, 60)] + [(1, 2), (2, 3)]
    frame = spark.createDataFrame(edges, "src int, dst int")
    walked, real = [], graph._ppmi_by_rows
    monkeypatch.setattr(graph, "_ppmi_by_rows", lambda walk, *rest: walked.append(walk.select("i").distinct().count()) or real(walk, *rest))
    a = np.zeros((400, 400))
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    total = sum(np.linalg.matrix_power(p, k) for k in range(1, 5))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log(total * total.sum() / (total.sum(1)[:, None] * total.sum(0)[None]))
    wanted = {(i, j): value[i, j] for i, j in zip(*np.nonzero(value > 1e-9), strict=True)}
    got = {(r["i"], r["j"]): r["v"] for r in graph.ppmi(frame, 4).filter("v > 1e-9").collect()}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    assert walked == [6]  # three hubs, and the leaves of each


def test_nearest_with_pruned_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.random((12, 4)) * 50
    make = lambda n: centres[rng.integers(0, 12, n)] + rng.normal(0, 0.5, (n, 4))
    t, p = make(600), make(300)
    t[100:180] = t[5]  # a hot vector
    p[7] = t[5]
    points = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)] + [(900, None), (901, [1.0, None, 2.0, 3.0])], "gene int, vec array<double>")
    targets = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(t)] + [(-1, None)], "target int, t_vec array<double>")
    far = np.sqrt(((p[:, None] - t[None]) ** 2).sum(2))
    got = {r["gene"]: (r["dist"], r["nearest"]) for r in relational.nearest_euclidean(points, targets, block_rows=16).collect()}
    assert sorted(got) == list(range(300))
    assert all(got[i][1] == far[i].argmin() and got[i][0] == pytest.approx(far[i].min()) for i in range(300))
    assert got[7] == (0.0, 5)
    # Most blocks are never met.
    single = targets.filter("t_vec is not null").groupBy("t_vec").agg(F.min("target").alias("target"))
    seen, blocks = relational.ringed(points.filter("gene < 300"), single, 32, 16)
    first = spark.createDataFrame([(i, (got[i][0], got[i][1])) for i in got], "gene int, _best struct<dist: double, nearest: int>")
    pairs = relational.left_to_visit(first, seen, blocks.select("_pivot", "_ring", "_low", "_high")).count() + 300
    assert pairs < 0.25 * 300 * blocks.count()
    assert relational.nearest_euclidean(points.limit(0), targets, block_rows=16).count() == 0
    assert relational.nearest_euclidean(points, targets.limit(0)).count() == 0


def vectors_of(spark, rows, name="gene", vec="vec"):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} int, {vec} array<double>")


def test_nearest_of_many_wide_targets(spark, monkeypatch):
    # No pair of a point and a target is a row: as rows, these twelve million pairs took minutes.
    rng = np.random.default_rng(8)
    p, t = rng.normal(0, 1, (6000, 48)), rng.normal(0, 1, (2000, 48))
    began = time.perf_counter()
    got = {r["gene"]: (r["dist"], r["nearest"]) for r in relational.nearest_euclidean(vectors_of(spark, p), vectors_of(spark, t, "target", "t_vec")).collect()}
    assert time.perf_counter() - began < 60
    far = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (t * t).sum(1)[None] - 2 * p @ t.T, 0))
    assert all(got[i][1] == far[i].argmin() and got[i][0] == pytest.approx(far[i].min()) for i in range(6000))
    # Ties go to the smaller name, also over several groups of targets and for points that are not finite.
    monkeypatch.setattr(relational, "SEARCH_BYTES", 4000)
    t, p = rng.integers(0, 9, (700, 3)), rng.integers(0, 9, (300, 3)).astype(float)
    p[5, 0], p[6, 1] = np.nan, np.inf
    got = {r["gene"]: (r["dist"], r["nearest"]) for r in relational.nearest_euclidean(vectors_of(spark, p), vectors_of(spark, t, "target", "t_vec"), block_rows=64).collect()}
    far = np.sqrt(((p[:, None] - t[None]) ** 2).sum(2))
    assert all(got[i] == (far[i].min(), far[i].argmin()) for i in range(300) if i not in (5, 6))
    assert math.isnan(got[5][0]) and got[6][0] == math.inf and got[5][1] == got[6][1] == 0


def test_pairwise_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(movement, "TILE", (16, 32))
    rng = np.random.default_rng(9)
    v = [[float(x) for x in row] for row in rng.normal(0, 1, (90, 5))]
    # Multiples have a cosine that rounds to more than 1, which gave NaN half chords; copies, zeros and vectors that lack something.
    v += [[3 * x for x in row] for row in v[:40]] + [v[0], [0.0] * 5, None, [1.0, None, 0.0, 0.0, 0.0]]
    points = spark.createDataFrame(list(enumerate(v)), "gene int, vec array<double>")
    a, b = points.toDF("i", "x"), points.toDF("j", "y")
    for distance in movement.KINDS:
        found = {(r["i"], r["j"]): r["dist"] for r in movement.pairwise(points, distance, places=5).collect()}
        rows = a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(distance(F.col("x"), F.col("y")), 5).alias("dist")).collect()
        wanted = {(r["i"], r["j"]): 0.0 if r["dist"] is not None and math.isnan(r["dist"]) else r["dist"] for r in rows}
        assert set(found) == set(wanted) and len(found) == len(v) * (len(v) - 1) // 2
        assert all(found[k] == (None if w is None else pytest.approx(w, abs=1.1e-5)) for k, w in wanted.items()), movement.KINDS[distance]


def test_movement_deals_each_gene_to_few_tasks(spark):
    rng = np.random.default_rng(10)
    n, seen = 9000, []
    rows = vectors_of(spark, rng.random((n, 2)))

    def count(a, b):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([len(a[0]) if a is b else len(a[0]) + len(b[0])])], ["n"])

    seen = [r["n"] for r in movement.met(rows, ["vec"], n, count, "n long").collect()]
    assert sum(seen) == 12 * n and len(seen) == 78
    a, b = rng.random((700, 3)), rng.random((700, 3))
    a[3] = a[4]
    far = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    x, y = far(a) / np.linalg.norm(far(a)), far(b) / np.linalg.norm(far(b))
    got = {r["gene"]: r["moved"] for r in movement.movement(vectors_of(spark, a), vectors_of(spark, b)).collect()}
    assert [got[i] for i in range(700)] == pytest.approx(list(np.sqrt(((x - y) ** 2).sum(1))), rel=1e-9)


def test_comembership_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PIECE", 4)
    rng = random.Random(3)
    rows = [(run, rng.randrange(2), gene) for run in range(3) for gene in range(120)] + [(0, 0, 7), (0, 1, 7), (1, 9, 500), (None, 0, 1)]
    got = [tuple(r) for r in aggregates.comembership(spark.createDataFrame(rows, "run int, cluster int, gene int")).collect()]
    held = defaultdict(set)
    for run, k, gene in rows:
        if run is not None:
            held[gene].add((run, k))
    wanted = {(i, j): len({run for run, _ in held[i] & held[j]}) for i in held for j in held if i < j and held[i] & held[j]}
    assert {(i, j): n for i, j, n in got} == wanted and len(got) == len(wanted)
    # Pairs are the last thing made: no exchange follows the two explodes.
    found = aggregates.comembership(spark.createDataFrame(rows, "run int, cluster int, gene int"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")] and plan[: plan.index("RepartitionByExpression")].count("Generate") == 2
