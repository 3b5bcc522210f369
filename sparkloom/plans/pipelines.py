"""The pipeline's questions as compositions of the operators.

Each function takes canonical DataFrames; the thin functions in ``QUERIES``
bind them to the driver's tables. Plots are returned as the table they show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import stats
from sparkloom.operators import aggregates, enrichment, factor_variants, factorize, graph, integrate, linalg, lloyd, movement, relational, resample, sets
from sparkloom.plans.bindings import Tables
from sparkloom.session import materialize

#: Network combinations of the main experiment: all, each alone, pairs, triples, expression only.
NETWORKS = ("PPI", "GI", "MI", "COEX")


def combinations() -> list[tuple[str, ...]]:
    """The 16 sets of networks that are fused with the expression matrix."""
    from itertools import combinations as choose

    return [c for size in (4, 1, 0, 2, 3) for c in choose(NETWORKS, size)]


def condition_network(edges: DataFrame, walk: DataFrame, backbone: DataFrame, expression: DataFrame, metadata: DataFrame, cond) -> tuple[DataFrame, DataFrame]:
    """(edges, expression) of one condition: genes of the backbone that its cells express."""
    active = relational.without_zero_rows(relational.cells_of(expression, metadata, cond))
    genes = active.select("gene").distinct()
    own = relational.induced(relational.induced(relational.relabelled_edges(edges, walk), backbone), genes)
    kept = graph.degrees(own).select("gene")
    return own, active.join(kept, "gene", "left_semi")


def clusterings(embeddings: dict[str, DataFrame], widths: dict[str, int], runs: int = 10, n_init: int = 10, seed: int = 1) -> DataFrame:
    """nets, run, cluster, gene of repeated k-means on the rows of each factor, with as many clusters as it has columns.

    The factors have the same genes; all runs and restarts of all of them share
    their passes.
    """
    names = list(embeddings)
    plans = [(i, widths[n], f"{n}/{run}") for i, n in enumerate(names) for run in range(runs)]
    found, _ = lloyd.cluster_all([embeddings[n] for n in names], [widths[n] for n in names], plans, n_init, seed)
    return found.select(F.substring_index("run", "/", 1).alias("nets"), F.substring_index("run", "/", -1).cast("int").alias("run"), "cluster", "gene")


def best_enriched_run(assigned: DataFrame, known: DataFrame, alpha: float = 0.05) -> DataFrame:
    """run, share_genes, share_clusters of the run whose enriched clusters hold most known genes."""
    runs = assigned.select("run").distinct()
    tested = enrichment.cluster_enrichment(assigned, known.select("gene").crossJoin(F.broadcast(runs)), alpha, by=["run"])  # tens of runs
    found = enrichment.enrichment_summary(tested, ["run"])
    return aggregates.best_run(found.withColumn("_all", F.lit(0)), ["_all"], "share_genes", "run").drop("_all")


def initial_predictions(clusters: DataFrame, known: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Unknown genes of the enriched clusters (for each value of ``by``, which both inputs have)."""
    keys = list(by or [])
    tested = enrichment.cluster_enrichment(clusters, known, alpha, by=keys).filter("enriched").select(*keys, "cluster")
    return clusters.join(tested, [*keys, "cluster"], "left_semi").select(*keys, "gene").distinct().join(known, [*keys, "gene"], "left_anti")


def projected(factor: DataFrame, middle) -> DataFrame:
    """The embedding G1 S."""
    return linalg.times_small(factor, middle)


def ranked_movement(first: DataFrame, second: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gene, moved, predicted) and the rank test of predictions against the rest."""
    moved = movement.movement(first, second).join(predicted.select("gene").withColumn("_p", F.lit(True)), "gene", "left").withColumn("predicted", F.coalesce("_p", F.lit(False))).drop("_p")
    return moved, stats.mann_whitney(moved, "moved", "predicted")


def core_predictions(staged: DataFrame) -> DataFrame:
    """gene, mean_moved of the genes predicted in every stage; ``staged`` (name, gene, moved)."""
    core = sets.in_all(staged)
    return staged.join(core, "gene", "left_semi").groupBy("gene").agg(F.avg("moved").alias("mean_moved"))


def with_core(named: DataFrame, core: str = "core") -> DataFrame:
    """Named gene sets, and what they all share as one more set."""
    return named.select("name", "gene").distinct().unionByName(sets.in_all(named).select(F.lit(core).alias("name"), "gene"))


def literature_validation(universe: DataFrame, predicted: DataFrame, known: DataFrame, evidence: DataFrame) -> DataFrame:
    """name, M, K, N, X, fold, p_evidence, n1, n2, u1, z, p: a row for each stage and one for the core.

    ``universe`` and ``predicted`` (name, gene) are the genes and the predictions
    of each stage; the core's are those that all stages share. Predictions are
    compared with the other genes of their stage, known ones apart, among genes
    with an ``evidence`` row: share with any evidence (M to p_evidence, null below
    fold 1) and rank test of citations (n1 to p). Stages without predictions have
    no row.
    """
    asked = with_core(predicted).withColumn("_side", F.lit(True))
    background = with_core(universe).join(known.select("gene"), "gene", "left_anti")
    every = background.withColumn("_side", F.lit(False)).unionByName(asked).groupBy("name", "gene").agg(F.max("_side").alias("side"))
    backed = (F.col("pubmed") > 0) | (F.coalesce("source", F.lit("")) != "")
    rows = materialize(every.join(evidence.select("gene", "pubmed", backed.alias("backed")), "gene").join(asked.select("name").distinct(), "name", "left_semi"), "validated")
    counts = rows.groupBy("name").agg(F.count("*").alias("M"), F.count_if("backed").alias("K"), F.count_if("side").alias("N"), F.count_if(F.col("backed") & F.col("side")).alias("X"))
    cells = (F.col("M"), F.col("K"), F.col("N"), F.col("X"))
    fold = stats.fold_enrichment(*cells)
    shares = counts.select("name", *cells, fold.alias("fold"), F.when(fold >= 1, stats.hypergeom_sf(*cells)).alias("p_evidence"))
    cited = rows.withColumn("cites", F.log10(F.col("pubmed") + 1))
    return shares.join(stats.mann_whitney(cited, "cites", "side", ["name"]), "name")


def core_against_list(predicted: DataFrame, listed: DataFrame, evidence: DataFrame) -> DataFrame:
    """only_listed, both, only_core: genes of a list that have an evidence row, against the core of the predictions."""
    found = sets.venn_counts(sets.intersection(listed, evidence), sets.in_all(predicted))
    return found.select(F.col("only_a").alias("only_listed"), "both", F.col("only_b").alias("only_core"))


def neighbour_enrichment(edges: DataFrame, predicted: DataFrame, target=None) -> DataFrame:
    """M, K, N, X, fold, p: predictions among the first neighbours of a node (the one of largest degree by default)."""
    if target is None:
        target = graph.degrees(edges).orderBy(F.desc("degree"), "gene").first()["gene"]
    near = graph.neighbours(edges, target).withColumn("_k", F.lit(1))
    nodes = graph.degrees(edges).select("gene").join(near, "gene", "left").join(predicted.select("gene").distinct().withColumn("_n", F.lit(1)), "gene", "left")
    one = nodes.agg(F.count("*").alias("M"), F.count("_k").alias("K"), F.count("_n").alias("N"), F.count_if(F.col("_k").isNotNull() & F.col("_n").isNotNull()).alias("X"))
    cells = (F.col("M"), F.col("K"), F.col("N"), F.col("X"))
    return one.select("M", "K", "N", "X", stats.fold_enrichment(*cells).alias("fold"), stats.hypergeom_sf(*cells).alias("p"))


def path_length_profile(edges: DataFrame, predicted: DataFrame, target) -> DataFrame:
    """predicted, d, n, share: distances to the target of predictions and of all others."""
    lengths = graph.path_lengths(edges, target).join(predicted.select("gene").withColumn("_p", F.lit(True)), "gene", "left").withColumn("predicted", F.coalesce("_p", F.lit(False)))
    counts = lengths.groupBy("predicted", "d").agg(F.count("*").alias("n"))
    totals = counts.groupBy("predicted").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "predicted").select("predicted", "d", "n", (F.col("n") / F.col("_t")).alias("share"))


def shared_terms(named: DataFrame, annotations: DataFrame, names: tuple[str, str], alpha: float = 0.05) -> DataFrame:
    """term, kind: terms enriched in both sets or in one of them only; ``named`` (name, gene)."""
    tested = enrichment.term_enrichment(named.withColumnRenamed("name", "cluster"), annotations, alpha).filter("enriched")
    flags = tested.groupBy("term").agg(F.max(F.col("cluster") == names[0]).alias("a"), F.max(F.col("cluster") == names[1]).alias("b"))
    return flags.select("term", F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), f"only {names[0]}").otherwise(f"only {names[1]}").alias("kind"))


def group_sizes(terms: DataFrame, hierarchy: DataFrame, n: int = 10) -> DataFrame:
    """subgroup, n of the most frequent subgroups of some terms; each term's first place counts."""
    placed = relational.first_match(terms, hierarchy, "term", ["subgroup"])
    return placed.groupBy("subgroup").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subgroup").limit(n)


def rank_selection(statistics: DataFrame) -> DataFrame:
    """nets, k1, k2, rho (mean of both factors) in descending order, with its rank."""
    from pyspark.sql import Window

    rho = (F.col("rho_g1") + F.col("rho_g2")) / 2
    order = Window.partitionBy("nets").orderBy(F.desc("rho"), "k1", "k2")
    return statistics.withColumn("rho", rho).withColumn("rank", F.row_number().over(order)).select("nets", "k1", "k2", "rho", "rank")


def nearest_baseline(points: DataFrame, known: DataFrame, n: DataFrame) -> DataFrame:
    """gene, dist, nearest: the unknown genes that lie nearest to known ones, as many as ``n`` says."""
    targets = points.join(known, "gene", "left_semi").select(F.col("gene").alias("target"), F.col("vec").alias("t_vec"))
    unknown = points.join(known, "gene", "left_anti")
    return sets.top_n(relational.nearest_euclidean(unknown, targets), n, "dist", descending=False)


def marker_test(expression: DataFrame, metadata: DataFrame, cond) -> DataFrame:
    """gene, log_fc, p, p_adj: rank test of each gene's values in one condition against the others."""
    long = expression.join(metadata, "cell").withColumn("inside", F.col("cond") == cond)
    # Values repeat: their counts are all that the test and the means need, and the join is made once.
    by_value = long.groupBy("gene", "value").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b"))
    counts = materialize(by_value, "values")
    log = F.log1p("value")
    mean = lambda n: F.try_divide(F.sum(F.when(F.col(n) > 0, log * F.col(n))), F.sum(F.when(log.isNotNull(), F.col(n))))
    means = counts.groupBy("gene").agg(mean("a").alias("a"), mean("b").alias("b"))
    tested = stats.mann_whitney_counts(counts, "value", ["gene"]).filter("p is not null")
    rows = materialize(tested.join(means, "gene").select("gene", (F.col("a") - F.col("b")).alias("log_fc"), "p"), "tested")
    return stats.adjusted_bh(rows, "p", ties=["gene"])


def integrated_markers(counts: DataFrame, k: int, alpha: float = 0.05, least_change: float = 3.0, max_iter: int = 30) -> DataFrame:
    """cluster, dataset, gene, log_fc, p, p_adj: what tells datasets apart inside the clusters of their joint factorisation.

    ``counts`` (dataset, gene, cell, value). Variable genes are scaled and
    factorised together, cells aligned by quantiles and put into clusters; in
    each, the values of a dataset's cells are tested against the others' by
    gene, with zeros, adjusted by cluster and dataset, and kept below ``alpha``
    and above ``least_change`` (in logarithms of the means' ratio).
    """
    counts = materialize(counts.filter("value <> 0"), "counts")
    chosen = integrate.variable_genes(counts)
    scaled = materialize(integrate.scaled_by_gene(counts.join(chosen, "gene", "left_semi")), "scaled")
    h, *_ = integrate.integrative(scaled, k, max_iter=max_iter)
    cells = materialize(integrate.quantile_aligned(h).select("dataset", "cell", "cluster"), "clustered-cells")
    sides = cells.select("cluster", "dataset").distinct().withColumnRenamed("dataset", "side")
    # A gene's zeros are not rows: each side's number of cells says how many there are.
    present = counts.join(cells, ["dataset", "cell"]).join(sides, "cluster").withColumn("inside", F.col("dataset") == F.col("side"))
    sizes = cells.join(sides, "cluster").groupBy("cluster", "side").agg(F.count_if(F.col("dataset") == F.col("side")).alias("in"), F.count_if(F.col("dataset") != F.col("side")).alias("out"))
    by_value = present.groupBy("cluster", "side", "gene", "value").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b"))
    seen = by_value.groupBy("cluster", "side", "gene").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    zeros = seen.join(sizes, ["cluster", "side"]).select("cluster", "side", "gene", F.lit(0.0).alias("value"), (F.col("in") - F.col("a")).alias("a"), (F.col("out") - F.col("b")).alias("b"))
    keys = ["cluster", "side", "gene"]
    tested = stats.mann_whitney_counts(by_value.select(*keys, F.col("value").cast("double").alias("value"), "a", "b").unionByName(zeros).filter("a + b > 0"), "value", keys, "two-sided")
    logs = present.groupBy(*keys).agg(F.sum(F.when(F.col("inside"), F.log1p("value")).otherwise(0.0)).alias("x"), F.sum(F.when(~F.col("inside"), F.log1p("value")).otherwise(0.0)).alias("y"))
    change = logs.join(sizes, ["cluster", "side"]).select(*keys, (F.col("x") / F.col("in") - F.try_divide("y", "out")).alias("log_fc"))
    rows = tested.filter("p is not null").join(change, keys).select(*keys, "log_fc", "p")
    adjusted = stats.adjusted_bh(rows, "p", ["cluster", "side"])
    return adjusted.filter((F.col("p_adj") < alpha) & (F.col("log_fc") > least_change)).withColumnRenamed("side", "dataset")


def cross_validated(clusters: DataFrame, known: DataFrame, n_folds: int = 5, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """fold, n_test, hit, share, ratio: known genes left out that enriched clusters still predict."""
    parts = resample.folds(known, n_folds, seed)
    runs = clusters.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("run"))  # n_folds rows
    train = parts.crossJoin(F.broadcast(runs)).filter("fold <> run").select("run", "gene")
    predicted = initial_predictions(clusters.crossJoin(F.broadcast(runs)), train, alpha, ["run"]).withColumnRenamed("run", "fold")
    return resample.fold_ratios(parts, clusters.select("gene").distinct(), predicted)


def correct_clusters(clusters: DataFrame, annotations: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """fold, n: (gene, cluster) hits of the fold's genes that have an enriched term of their cluster; ``tests`` (fold, gene)."""
    tested = enrichment.term_enrichment(clusters, annotations, alpha).filter("enriched").select("cluster", "term")
    pairs = clusters.join(tests.select("fold", "gene"), "gene").join(annotations, "gene").join(tested, ["cluster", "term"], "left_semi")
    hits = pairs.select("fold", "gene", "cluster").distinct().groupBy("fold").agg(F.count("*").alias("n"))
    return tests.select("fold").distinct().join(hits, "fold", "left").select("fold", F.coalesce("n", F.lit(0)).alias("n"))


def masked_edges(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """fold, edges: how many edges are left when the genes of a fold are masked."""
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("gene"))
    gone = ends.join(tests.select("fold", "gene"), "gene").select("fold", "src", "dst").distinct().groupBy("fold").agg(F.count("*").alias("gone"))
    whole = edges.agg(F.count("*").alias("whole"))
    met = tests.select("fold").distinct().join(gone, "fold", "left").crossJoin(F.broadcast(whole))  # one row
    return met.select("fold", (F.col("whole") - F.coalesce("gone", F.lit(0))).alias("edges"))


def supplier_expression(t: Tables) -> DataFrame:
    """i (supplier), j (year), v: hundreds of pieces."""
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.year("l_shipdate").cast("long").alias("j")).agg((F.sum("l_quantity") / 100).alias("v"))


def supplier_network(t: Tables, priority: str | None = None) -> DataFrame:
    """i, j, v: suppliers of one order (of some priority)."""
    items = t.read("lineitem")
    if priority is not None:
        items = items.join(t.read("orders").filter(F.col("o_orderpriority") == priority), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    items = items.select("l_orderkey", "l_suppkey").distinct()
    pairs = items.select("l_orderkey", F.col("l_suppkey").alias("src")).join(items.select("l_orderkey", F.col("l_suppkey").alias("dst")), "l_orderkey").filter("src < dst")
    return linalg.adjacency(relational.as_canonical(pairs.select("src", "dst").distinct()))


def fused(t: Tables, networks: dict[str, DataFrame], chosen: list[tuple[str, ...]], k1: int = 4, k2: int = 3, max_iter: int = 1000) -> dict[str, factorize.Factors]:
    """The fits of some combinations of networks with the suppliers' expression, from singular vectors to their stop rule."""
    expression = materialize(supplier_expression(t), "expression")
    networks = {name: materialize(a, "network") for name, a in networks.items()}
    genes, cells = expression.select(F.col("i").alias("gene")).distinct(), expression.select(F.col("j").alias("gene")).distinct()
    return factorize.combined(networks, chosen, expression, genes, cells, k1, k2, max_iter)


def nmtf_trace(t: Tables, joint: bool) -> DataFrame:
    """iteration, error of a factorisation of the driver tables from singular vectors, to its stop rule."""
    networks = {"orders": supplier_network(t)} if joint else {}
    (model,) = fused(t, networks, [tuple(networks)]).values()
    return t.spark.createDataFrame([(i, round(e, 6)) for i, _, e in model.trace], "iteration int, error double")


#: Orders of these priorities stand for the four networks.
PRIORITIES = dict(zip(NETWORKS, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), strict=True))


def p2_network_combinations(t: Tables) -> DataFrame:
    """nets, iteration, error: all 16 combinations of four networks with the expression matrix."""
    found = fused(t, {n: supplier_network(t, p) for n, p in PRIORITIES.items()}, combinations())
    return t.spark.createDataFrame([(n, i, round(e, 6)) for n, f in found.items() for i, _, e in f.trace], "nets string, iteration int, error double")


# -- bound to the driver's tables ------------------------------------------------------------------


def rounded(rows: DataFrame, **places: int) -> DataFrame:
    """The same columns, some of them rounded."""
    return rows.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in rows.columns])


TEST = {"u1": 4, "z": 6, "p": 6}


def p1_condition_networks(t: Tables) -> DataFrame:
    """nodes, edges, density of the network of one condition."""
    metadata = t.read("supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("cond"))
    walk = t.spark.createDataFrame([], "id long, symbol string")
    genes = t.read("part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").cast("string").alias("gene"))
    expression = t.expression().withColumn("gene", F.col("gene").cast("string"))
    own, _ = condition_network(t.together(), walk, genes, expression, metadata, 3)
    return rounded(graph.density(own), density=9)


def without_genes(network: DataFrame, genes: DataFrame) -> DataFrame:
    """The entries (i, j, v) of a network whose two ends are not among some genes."""
    gone = genes.select("gene").distinct()
    return network.join(gone.withColumnRenamed("gene", "i"), "i", "left_anti").join(gone.withColumnRenamed("gene", "j"), "j", "left_anti").select("i", "j", "v")


def masked_refits(networks: dict[str, DataFrame], masked: str, expression: DataFrame, tests: DataFrame, n_folds: int, k1: int, k2: int) -> tuple[dict[str, factorize.Factors], factorize.Factors]:
    """({"none": ..., "masked 0": ..., ...}, the full model): fits without one network, and with its rows and columns of each fold's genes left out.

    All go on from the full model's factors, in the same passes.
    """
    genes, cells = expression.select(F.col("i").alias("gene")).distinct(), expression.select(F.col("j").alias("gene")).distinct()
    (full,) = factorize.combined(networks, [tuple(networks)], expression, genes, cells, k1, k2).values()
    first, second = materialize(full.g1, "full-genes"), materialize(full.g2, "full-cells")
    others = [n for n in networks if n != masked]
    own = tuple(range(len(others)))
    models = [factorize.Model("none", own, k1, k2)] + [factorize.Model(f"masked {f}", (*own, len(others) + f), k1, k2) for f in range(n_folds)]
    parts = [materialize(without_genes(networks[masked], tests.filter(F.col("fold") == f)), "masked") for f in range(n_folds)]
    found = factorize.fit(models, [networks[n] for n in others] + parts, expression, [first] * len(models), [second] * len(models))
    return {m.name: f for m, f in zip(models, found, strict=True)}, full


def _suppliers_fused(t: Tables) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """Four networks of suppliers, their expression, known suppliers, and the brands of what came back to them as annotations."""
    networks = {n: materialize(supplier_network(t, p), "network") for n, p in PRIORITIES.items()}
    known = t.read("supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("gene"))
    items = t.read("lineitem").filter("l_returnflag = 'R'").join(t.read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return networks, materialize(supplier_expression(t), "expression"), known, items.select(F.col("l_suppkey").alias("gene"), F.col("p_brand").alias("term")).distinct()


def p18_masked_refits(t: Tables, n_folds: int = 5) -> DataFrame:
    """kind, p0, p1, p2: whiskers over folds of the test genes' hits, with all of the third network, none, or the fold masked in it."""
    networks, expression, known, annotations = _suppliers_fused(t)
    tests = materialize(resample.folds(known, n_folds, 1), "folds")
    fits, full = masked_refits(networks, "MI", expression, tests, n_folds, 4, 3)
    embeddings = {"full": full.g1} | {n: f.g1 for n, f in fits.items()}
    assigned = clusterings(embeddings, dict.fromkeys(embeddings, 4), runs=1)
    rows = None
    for name in embeddings:
        mine = assigned.filter(F.col("nets") == name).select("cluster", "gene")
        own = tests if not name.startswith("masked") else tests.filter(F.col("fold") == int(name.split()[1]))
        hits = correct_clusters(mine, annotations, own, 0.9).select(F.lit(name.split()[0]).alias("kind"), "fold", F.col("n").cast("double").alias("n"))
        rows = hits if rows is None else rows.unionByName(hits)
    return aggregates.percentiles(rows, "n", by=["kind"])


def p20_ablation(t: Tables) -> DataFrame:
    """nets, enriched, predicted, kept: enriched clusters and predictions with all networks and without the third; kept by both."""
    networks, expression, known, _ = _suppliers_fused(t)
    genes, cells = expression.select(F.col("i").alias("gene")).distinct(), expression.select(F.col("j").alias("gene")).distinct()
    whole = tuple(networks)
    found = factorize.combined(networks, [whole, tuple(n for n in whole if n != "MI")], expression, genes, cells, 4, 3)
    embeddings = {n: materialize(projected(f.g1, f.s_expression), "embedding") for n, f in found.items()}
    assigned = materialize(clusterings(embeddings, dict.fromkeys(embeddings, 3), runs=1).select("nets", "cluster", "gene"), "clusters")
    each = known.join(genes, "gene", "left_semi").crossJoin(F.broadcast(assigned.select("nets").distinct()))  # two rows
    tested = enrichment.cluster_enrichment(assigned, each, 0.5, by=["nets"]).filter("enriched").groupBy("nets").agg(F.count("*").alias("enriched"))
    predicted = materialize(initial_predictions(assigned, each, 0.5, ["nets"]), "predictions")
    both = predicted.groupBy("gene").agg(F.count("*").alias("c"))
    counts = predicted.join(both, "gene").groupBy("nets").agg(F.count("*").alias("predicted"), F.count_if(F.col("c") == 2).alias("kept"))
    every = assigned.select("nets").distinct().join(tested, "nets", "left").join(counts, "nets", "left")
    return every.select("nets", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("enriched", "predicted", "kept")])


def p9_core_test(t: Tables, reps: int = 10_000) -> DataFrame:
    """core, p: the genes predicted in every stage (returned in every year), and how often draws of as many from each stage's genes share so many."""
    pools = {r["name"]: r["count"] for r in t.stages().groupBy("name").count().collect()}  # one row a stage
    predicted = t.read("lineitem").filter("l_returnflag = 'R'").select(F.year("l_shipdate").alias("name"), F.col("l_partkey").alias("gene")).distinct()
    picks = {r["name"]: r["count"] for r in predicted.groupBy("name").count().collect()}
    names = sorted(picks)
    shared = sets.in_all(t.stages().filter(F.col("name").isin(names))).count()
    core = sets.in_all(predicted).count()
    test = resample.permutation_test([pools[n] for n in names], [picks[n] for n in names], shared, core, reps, 7, t.spark)
    return test.select(F.lit(core).cast("long").alias("core"), "p")


def p3_clusterings(t: Tables) -> DataFrame:
    """nets, run, clusters, genes, largest: ten clusterings of the suppliers' embedding of each combination of networks."""
    found = fused(t, {n: supplier_network(t, p) for n, p in PRIORITIES.items()}, combinations())
    assigned = clusterings({n: f.g1 for n, f in found.items()}, {n: f.s_expression.shape[0] for n, f in found.items()})
    sizes = assigned.groupBy("nets", "run", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("nets", "run").agg(F.count("*").alias("clusters"), F.sum("n").alias("genes"), F.max("n").alias("largest"))


def p13_fitted_ranks(t: Tables) -> DataFrame:
    """nets, k1, k2, rho, rank: dispersion of ten clusterings of both factors over a grid of sizes, fitted together."""
    expression, network = materialize(supplier_expression(t), "expression"), materialize(supplier_network(t), "network")
    genes, cells = expression.select(F.col("i").alias("gene")).distinct(), expression.select(F.col("j").alias("gene")).distinct()
    grid = [(k1, k2) for k1 in (3, 4, 5) for k2 in (2, 3)]
    models = [factorize.Model(f"{a} {b}", (0,), a, b) for a, b in grid]
    left, right = factorize.svd_pair(expression, genes, cells, max(a for a, _ in grid))
    cut = lambda f, k: f.select("gene", F.slice("vec", 1, k).alias("vec"))
    fits = factorize.fit(models, [network], expression, [cut(left, a) for a, _ in grid], [cut(right, b) for _, b in grid])
    rows = None
    for side, of in (("rho_g1", [f.g1 for f in fits]), ("rho_g2", [f.g2 for f in fits])):
        sizes = {m.name: (m.k1 if side == "rho_g1" else m.k2) for m in models}
        assigned = clusterings({m.name: f for m, f in zip(models, of, strict=True)}, sizes)
        found = aggregates.dispersion(assigned, ["nets"]).withColumnRenamed("rho", side)
        rows = found if rows is None else rows.join(found, "nets")
    split = F.split("nets", " ")
    table = rows.select(F.lit("orders").alias("nets"), split[0].cast("int").alias("k1"), split[1].cast("int").alias("k2"), "rho_g1", "rho_g2")
    return rounded(rank_selection(table), rho=6)


def _suppliers_given(t: Tables, k: int) -> tuple[DataFrame, DataFrame]:
    """The suppliers' expression, and the absolute singular vectors of their network as a given basis."""
    expression = materialize(supplier_expression(t), "expression")
    return expression, materialize(factorize.svd_factor([supplier_network(t)], expression.select(F.col("i").alias("gene")).distinct(), k), "basis")


def partial_nmf(t: Tables) -> DataFrame:
    """iteration, relative error: years in a basis of suppliers that is given."""
    expression, basis = _suppliers_given(t, 4)
    _, trace = factor_variants.partial_factor(expression, basis)
    return t.spark.createDataFrame([(i, round(e, 6)) for i, _, e in trace], "iteration int, error double")


def laplacian_nmf(t: Tables, turns: int = 20) -> DataFrame:
    """iteration, error, term: years that follow each other are kept close by a Laplacian term."""
    expression, basis = _suppliers_given(t, 4)
    years = expression.select(F.col("j").alias("src"), (F.col("j") + 1).alias("dst")).distinct()
    laplacian = graph.laplacian(years.join(years.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    _, _, trace = factor_variants.laplacian_factor(expression, laplacian, basis, 3, 0.1, max_iter=turns)
    return t.spark.createDataFrame([(i, round(e, 6), round(x, 6)) for i, _, e, x in trace], "iteration int, error double, term double")


def orthonormal_nmf(t: Tables, turns: int = 4) -> DataFrame:
    """iteration, error: one basis for the suppliers' expression and two of their networks."""
    networks = [materialize(supplier_network(t, p), "network") for p in list(PRIORITIES.values())[:2]]
    _, trace = factor_variants.orthonormal_factor(supplier_expression(t), networks, 3, 4, max_iter=turns)
    return t.spark.createDataFrame([(i, round(e, 4)) for i, e in trace], "iteration int, error double")


def p4_best_run(t: Tables) -> DataFrame:
    parts = t.read("part").select("p_size", F.col("p_partkey").alias("gene"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("run"))
    assigned = parts.select("run", ((F.col("p_size") * (F.col("run") + 1) + F.col("run")) % 40).alias("cluster"), "gene")
    return rounded(best_enriched_run(assigned, t.known(), 0.2).select("run", "share_clusters", "share_genes"), share_clusters=6, share_genes=6)


def p5_annotation_profile(t: Tables) -> DataFrame:
    """Whiskers over clusters of the share of a cluster's terms that are enriched in it."""
    tested = enrichment.term_enrichment(t.clusters(), t.annotations(), 0.9)
    shares = tested.groupBy("cluster").agg(F.avg(F.col("enriched").cast("double")).alias("share"))
    return rounded(aggregates.percentiles(shares, "share"), p0=6, p1=6, p2=6)


def p6_initial_predictions(t: Tables) -> DataFrame:
    return initial_predictions(t.clusters(), t.known(), 0.2)


def _stages(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.vectors()
    halves = [v.select("gene", F.slice("vec", at, 32).alias("vec")) for at in (1, 33)]
    return ranked_movement(halves[0], halves[1], v.filter("label < 3").select("gene"))


def p8_stage_movement(t: Tables) -> DataFrame:
    """How far predictions and other genes moved, as shares of 50 bins."""
    return rounded(aggregates.histogram(_stages(t)[0], "moved", by=["predicted"], scale="sum"), height=6)


def p8_stage_test(t: Tables) -> DataFrame:
    """The rank test of the predictions' movement against that of other genes."""
    return rounded(_stages(t)[1], **TEST)


def p9_core_predictions(t: Tables) -> DataFrame:
    staged = t.read("lineitem").filter("l_returnflag = 'R'").groupBy(F.year("l_shipdate").alias("name"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("moved"))
    return rounded(core_predictions(staged.filter("name < 1999")), mean_moved=6).orderBy(F.desc("mean_moved"), "gene")


def p10_literature(t: Tables) -> DataFrame:
    predicted = p6_initial_predictions(t)
    cited = t.evidence().select(F.log10(F.col("pubmed") + 1).alias("cites"), "gene").join(predicted.withColumn("side", F.lit(True)), "gene", "left").withColumn("side", F.coalesce("side", F.lit(False)))
    return rounded(stats.mann_whitney(cited, "cites", "side"), **TEST)


def _stage_predictions(t: Tables) -> DataFrame:
    """name (year), gene: parts that came back in a year, known ones apart."""
    back = t.read("lineitem").filter("l_returnflag = 'R'").select(F.year("l_shipdate").alias("name"), F.col("l_partkey").alias("gene")).distinct()
    return back.join(t.known(), "gene", "left_anti").select(F.col("name").cast("string").alias("name"), "gene")


def p10_stage_validation(t: Tables) -> DataFrame:
    """Evidence and citations of each year's predictions and of their core."""
    universe = t.stages().select(F.col("name").cast("string").alias("name"), "gene")
    found = literature_validation(universe, _stage_predictions(t), t.known(), t.evidence())
    return rounded(found, fold=6, p_evidence=6, **TEST)


def p10_core_venn(t: Tables) -> DataFrame:
    """The core of the years' predictions against the parts of small size."""
    return core_against_list(_stage_predictions(t), t.read("part").filter("p_size <= 10").select(F.col("p_partkey").alias("gene")), t.evidence())


def p11_path_profile(t: Tables) -> DataFrame:
    links = t.together()
    target = graph.degrees(links).orderBy(F.desc("degree"), "gene").first()["gene"]
    return rounded(path_length_profile(links, t.known(), target), share=6)


def p12_shared_terms(t: Tables) -> DataFrame:
    named = t.read("part").filter("p_type in ('PROMO', 'ECONOMY')").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("gene"))
    return shared_terms(named, t.annotations(), ("PROMO", "ECONOMY"), 1.0)


def p13_rank_selection(t: Tables) -> DataFrame:
    rows = t.read("part").groupBy(F.col("p_brand").alias("nets"), (F.col("p_size") % 5).alias("k1"), (F.col("p_size") % 3).alias("k2")).agg((F.avg("p_retailprice") / 2000).alias("rho_g1"), (F.avg("p_size") / 50).alias("rho_g2"))
    return rounded(rank_selection(rows), rho=6)


def p14_nearest_baseline(t: Tables) -> DataFrame:
    v = t.vectors()
    known = v.filter("label = 0").select("gene")
    return rounded(nearest_baseline(v, known, known.agg(F.count("*").alias("n"))), dist=5)


def p15_movement_baseline(t: Tables) -> DataFrame:
    """Genes whose movement (times 10,000) is at or above the 90th percentile."""
    moved, _ = _stages(t)
    cut = stats.quantiles(moved, "moved", [0.9]).select(F.get("quantiles", F.lit(0)).alias("c"))
    return moved.crossJoin(F.broadcast(cut)).filter("moved >= c").select("gene", F.round(F.col("moved") * 10000, 3).alias("moved"))  # one row


def p16_marker_test(t: Tables) -> DataFrame:
    items = t.read("lineitem").select(F.col("l_partkey").alias("gene"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell"), F.col("l_quantity").alias("value"))
    metadata = t.read("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell"), F.col("l_returnflag").alias("cond"))
    return marker_test(items, metadata, "R").filter("p_adj < 1")


def p16_integrated_markers(t: Tables) -> DataFrame:
    """The 20 first markers (by adjusted p) of returned against other items over suppliers, by their joint factorisation."""
    items = t.read("lineitem").withColumn("dataset", F.when(F.col("l_returnflag") == "R", "returned").otherwise("kept"))
    counts = items.groupBy("dataset", F.col("l_partkey").cast("string").alias("gene"), F.col("l_suppkey").cast("string").alias("cell")).agg(F.sum("l_quantity").cast("double").alias("value"))
    found = integrated_markers(counts, 5, 0.5, 0.0)
    return found.orderBy("p_adj", F.desc("log_fc"), "gene", "cluster", "dataset").limit(20).select("dataset", "cluster", "gene", F.round("log_fc", 6).alias("log_fc"), F.round("p_adj", 6).alias("p_adj"))


def p17_cross_validation(t: Tables) -> DataFrame:
    return rounded(cross_validated(t.clusters(), t.known(), 5, 0.3), share=6, ratio=6)


def p18_masked_contribution(t: Tables) -> DataFrame:
    """fold, edges left when the genes of a fold are masked, and the hits of its genes."""
    parts = resample.folds(t.known(), 5, 1)
    return masked_edges(t.together(), parts).join(correct_clusters(t.clusters(), t.annotations(), parts, 0.9), "fold")


def p19_robustness(t: Tables) -> DataFrame:
    """Median and spread of Rand indices over clusterings of several sizes."""
    width = len(t.vectors().select("vec").first()["vec"])
    assigned, _ = lloyd.cluster_all([t.vectors()], [width], [(0, k, run) for run, k in enumerate((8, 10, 12))], n_init=10, seed=100)
    pairs = aggregates.run_pairs_rand(assigned.select("run", "cluster", "gene"))
    return aggregates.centre_and_spread(pairs.withColumn("_all", F.lit("all")).withColumnRenamed("_all", "which"), "rand", ["which"])


QUERIES = {f.__name__: f for f in (
    p1_condition_networks, p2_network_combinations, p3_clusterings, p9_core_test, p18_masked_refits, p20_ablation, p13_fitted_ranks, partial_nmf, laplacian_nmf, orthonormal_nmf, p4_best_run, p5_annotation_profile, p6_initial_predictions, p8_stage_movement, p8_stage_test, p9_core_predictions, p10_literature, p10_stage_validation, p10_core_venn, p11_path_profile,
    p12_shared_terms, p13_rank_selection, p14_nearest_baseline, p15_movement_baseline, p16_marker_test, p16_integrated_markers, p17_cross_validation, p18_masked_contribution, p19_robustness,
)}
