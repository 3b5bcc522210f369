"""Integrative factorisation of several datasets: shared and own gene factors, and aligned cells.

Minimise sum_i |E_i' - H_i (W + V_i)'|^2 + lambda |H_i V_i'|^2 with W, V_i, H_i >= 0
for datasets E_i over the same genes. Alternating least squares: with k x k Gram
matrices known, each row (a cell's H, a gene's W and V_i) is a small
non-negative least squares problem of its own, solved exactly for a block of
rows at a time. A turn is two jobs on matrices in blocks (see ``blocked``): over
cells, then over genes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import quantiles
from sparkloom.operators import blocked
from sparkloom.operators.factorize import random_factor
from sparkloom.session import discard, materialize

LAMBDA = 5.0
#: A dataset's cells of a cluster are aligned if it has so many there, and the reference, too.
LEAST_CELLS = 20
QUANTILES = 50


def nonnegative_rows(gram, right):
    """x >= 0 with least x' gram x - 2 x' b for each row b: block principal pivoting, rows with one pattern solved together."""
    import numpy as np

    n, k = right.shape
    gram = gram + np.eye(k) * 1e-12 * max(np.trace(gram) / k, 1e-300)
    x, y = np.zeros((n, k)), -right.copy()
    passive = np.zeros((n, k), dtype=bool)
    fewest, tries = np.full(n, k + 1), np.full(n, 3)
    tolerance = 1e-12 * max(np.abs(right).max(initial=0.0), 1e-300)
    for _ in range(100 * k):
        wrong = (passive & (x < 0)) | (~passive & (y < -tolerance))
        count = wrong.sum(axis=1)
        rows = np.flatnonzero(count)
        if not len(rows):
            break
        # All wrong ones change sides while that helps; else, to be sure to end, the last one alone.
        better = count[rows] < fewest[rows]
        fewest[rows[better]], tries[rows[better]] = count[rows[better]], 3
        tries[rows[~better]] -= 1
        one = rows[~better & (tries[rows] < 0)]
        change = wrong[rows]
        if len(one):
            last = k - 1 - wrong[one][:, ::-1].argmax(axis=1)
            only = np.zeros((len(one), k), dtype=bool)
            only[np.arange(len(one)), last] = True
            change[np.isin(rows, one)] = only
        passive[rows] ^= change
        patterns, of = np.unique(passive[rows], axis=0, return_inverse=True)
        for p, pattern in enumerate(patterns):
            mine, at = rows[of.ravel() == p], np.flatnonzero(pattern)
            x[mine] = 0
            if len(at):
                x[np.ix_(mine, at)] = np.linalg.solve(gram[np.ix_(at, at)], right[np.ix_(mine, at)].T).T
            y[mine] = x[mine] @ gram - right[mine]
            y[np.ix_(mine, at)] = 0
    return np.maximum(x, 0)


def variable_genes(counts: DataFrame, spread: float = 0.1, alpha: float = 0.99, raw: DataFrame | None = None) -> DataFrame:
    """gene: those of some dataset whose variance is above what their mean explains; ``counts`` (dataset, gene, cell, value), zeros left out.

    With c the mean of 1 / (a cell's total in ``raw``, or in ``counts``), a gene is kept if var / c is above
    the upper bound of its mean, and log10 var above log10 mean + log10 c + ``spread``.
    """
    from statistics import NormalDist

    per_cell = (counts if raw is None else raw).groupBy("dataset", "cell").agg(F.sum("value").alias("total"))
    sizes = per_cell.filter("total > 0").groupBy("dataset").agg(F.avg(1 / F.col("total")).alias("c"), F.count("*").alias("n"))
    moments = counts.groupBy("dataset", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n_genes = moments.groupBy("dataset").agg(F.count("*").alias("m")).collect()  # one row a dataset
    bounds = counts.sparkSession.createDataFrame([(r["dataset"], NormalDist().inv_cdf(1 - alpha / r["m"] / 2)) for r in n_genes], counts.select("dataset", F.lit(0.0).alias("z")).schema)
    met = moments.join(F.broadcast(sizes), "dataset").join(F.broadcast(bounds), "dataset")  # one row a dataset
    mean = F.col("s") / F.col("n")
    met = met.filter("n > 1").withColumn("mean", mean).withColumn("var", (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))
    upper = F.col("mean") + F.col("z") * F.sqrt(F.col("mean") * F.col("c") / F.col("n"))
    keep = (F.col("var") / F.col("c") > upper) & (F.log10("var") > F.log10("mean") + F.log10("c") + spread)
    return met.filter(keep).select("gene").distinct()


def scaled_by_gene(counts: DataFrame) -> DataFrame:
    """The same rows, values divided by their gene's root mean square over the dataset's cells (less one), not centred."""
    cells = counts.groupBy("dataset").agg(F.count_distinct("cell").alias("n"))
    squares = counts.groupBy("dataset", "gene").agg(F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(cells), "dataset")  # one row a dataset
    rms = squares.filter("q > 0").select("dataset", "gene", F.sqrt(F.col("q") / F.greatest(F.col("n") - 1, F.lit(1))).alias("rms"))
    return counts.join(rms, ["dataset", "gene"]).select("dataset", "gene", "cell", (F.col("value") / F.col("rms")).alias("value"))


def integrative(values: DataFrame, k: int, weight: float = LAMBDA, max_iter: int = 30, tolerance: float = 1e-6, seed: int = 0, starts: tuple | None = None, block_rows: int = blocked.BLOCK_ROWS):
    """((dataset, cell, vec) with H, (gene, vec) with W, {dataset: (gene, vec) with V}, objectives) of ``values`` (dataset, gene, cell, value).

    Each objective is after a whole turn (H, then V, then W); it never rises.
    The fit ends when it changes by less than ``tolerance``, relatively.
    ``starts`` gives W and the list of V, in the order of the datasets' names.
    """
    import numpy as np

    names = sorted(r["dataset"] for r in values.select("dataset").distinct().collect())  # few datasets
    n = len(names)
    genes = blocked.index(values.select("gene"), block_rows)
    keyed, cells, first = [], None, 0
    made = []
    for i, name in enumerate(names):
        mine = values.filter(F.col("dataset") == name)
        own = blocked.index(mine.select(F.col("cell").alias("gene")), block_rows)
        shift = first
        first += own.agg(F.max("block")).first()[0] + 1
        # Blocks of cells are numbered on through the datasets.
        own = own.withColumn("block", (F.col("block") + shift).cast("int"))
        made.append(blocked.tiles([mine.select(F.col("gene").alias("i"), F.col("cell").alias("j"), F.col("value").alias("v"))], genes, own, first=i))
        keyed.append(own.withColumn("dataset", F.lit(name)))
        start = blocked.packed([own.select("gene", F.array(F.lit(float(i)), *[F.lit(0.0)] * k).alias("vec"))], [k + 1], own)
        cells = start if cells is None else cells.unionAll(start)
    cells = materialize(cells, "cells")
    tiles = reduce(DataFrame.unionAll, made)
    norms = {a: s for t in made for a, s in blocked.squares(t).items()}
    w, vs = starts if starts else (random_factor(genes.select("gene"), k, seed), [random_factor(genes.select("gene"), k, seed + 1 + i) for i in range(n)])
    state = blocked.packed([w, *vs], [k] * (n + 1), genes)
    wide, square = k * (n + 1), k * k
    part = [slice(i * k, (i + 1) * k) for i in range(n + 1)]

    def grams(x):
        both = [x[:, part[0]] + x[:, part[i + 1]] for i in range(n)]
        return np.concatenate([m.ravel() for i in range(n) for m in (both[i].T @ both[i], x[:, part[i + 1]].T @ x[:, part[i + 1]])])

    found = materialize(blocked.block_sums(blocked.own(state), grams, wide, 2 * n * square), "sums")
    own = blocked.summed(found, 2 * n * square).reshape(n, 2, k, k)
    discard(found)
    objectives: list[float] = []
    for _ in range(max_iter):
        left = [own[i, 0] + weight * own[i, 1] for i in range(n)]

        def of_cells(x, held, left=left):
            i = int(x[0, 0])
            h = nonnegative_rows(left[i], held[i])
            sums = np.zeros((n, k, k))
            sums[i] = h.T @ h
            return np.concatenate([x[:, :1], h], axis=1), sums.ravel()

        both = blocked.mapped(blocked.own(state), lambda x: np.concatenate([x[:, part[0]] + x[:, part[i + 1]] for i in range(n)], axis=1), wide)
        parts = blocked.mapped(blocked.own(cells), lambda x: x, k + 1).unionAll(blocked.products(tiles, both, {i: [slice(i * k, (i + 1) * k)] for i in range(n)}, transposed=True))
        new = materialize(blocked.gathered(parts, k + 1, dict.fromkeys(range(n), k), of_cells, n * square), "cells")
        among = blocked.summed(new, n * square).reshape(n, k, k)
        discard(cells)
        cells = new

        def of_genes(x, held, among=among):
            new = x.copy()
            for i in range(n):
                new[:, part[i + 1]] = nonnegative_rows((1 + weight) * among[i], held[i] - x[:, part[0]] @ among[i])
            new[:, part[0]] = nonnegative_rows(among.sum(axis=0), sum(held[i] - new[:, part[i + 1]] @ among[i] for i in range(n)))
            crossed = [[(held[i] * (new[:, part[0]] + new[:, part[i + 1]])).sum()] for i in range(n)]
            return new, np.concatenate([grams(new), *crossed])

        hs = blocked.mapped(blocked.own(cells), lambda x: x[:, 1:], k + 1)
        parts = blocked.mapped(blocked.own(state), lambda x: x, wide).unionAll(blocked.products(tiles, hs, {i: [slice(0, k)] for i in range(n)}))
        new = materialize(blocked.gathered(parts, wide, dict.fromkeys(range(n), k), of_genes, 2 * n * square + n), "genes")
        sums = blocked.summed(new, 2 * n * square + n)
        discard(state)
        state, own = new, sums[: 2 * n * square].reshape(n, 2, k, k)
        crossed = sums[2 * n * square :]
        objectives.append(float(sum(norms.get(i, 0.0) - 2 * crossed[i] + (among[i] * (own[i, 0] + weight * own[i, 1])).sum() for i in range(n))))
        if len(objectives) > 1 and abs(objectives[-2] - objectives[-1]) <= tolerance * (objectives[-2] + objectives[-1]) / 2:
            break
    for t in made:
        discard(t)
    h = [blocked.unpacked(blocked.own(cells), of.drop("dataset"), k + 1, slice(1, k + 1)).select(F.lit(name).alias("dataset"), F.col("gene").alias("cell"), "vec") for name, of in zip(names, keyed, strict=True)]
    each = [blocked.unpacked(blocked.own(state), genes, wide, s) for s in part]
    return reduce(DataFrame.unionAll, h), each[0], dict(zip(names, each[1:], strict=True)), objectives


def quantile_aligned(cells: DataFrame, reference: str | None = None, n_quantiles: int = QUANTILES, least_cells: int = LEAST_CELLS) -> DataFrame:
    """dataset, cell, cluster, vec: cells in the cluster of their largest scaled factor, each factor's values moved to the reference's distribution.

    A factor is scaled by its root mean square over the dataset. In a cluster
    that the reference and a dataset have ``least_cells`` of, the dataset's
    values of a factor go through the piecewise linear map of its quantiles to
    the reference's; a factor that is constant on one side becomes 0; values of
    other clusters stay. The reference is the dataset with most cells.
    """
    long = cells.select("dataset", "cell", F.posexplode("vec").alias("factor", "value"))
    rms = long.groupBy("dataset", "factor").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    scaled = long.join(F.broadcast(rms), ["dataset", "factor"])  # datasets times factors
    best = scaled.groupBy("dataset", "cell").agg(F.max_by("factor", F.struct(F.when(F.col("rms") > 0, F.col("value") / F.col("rms")).otherwise(0.0).alias("v"), (-F.col("factor")).alias("f"))).alias("cluster"))
    labelled = materialize(long.join(best, ["dataset", "cell"]), "labelled-cells")
    if reference is None:
        counts = cells.groupBy("dataset").count().orderBy(F.desc("count"), "dataset").first()
        reference = counts["dataset"] if counts else None
    points = [q / n_quantiles for q in range(n_quantiles + 1)]
    curves = quantiles(labelled, "value", points, ["dataset", "cluster", "factor"])
    curves = materialize(curves.filter(F.col("n") >= least_cells), "curves")  # datasets times clusters times factors
    target = curves.filter(F.col("dataset") == reference).select("cluster", "factor", F.col("quantiles").alias("to"))
    maps = curves.filter(F.col("dataset") != reference).select("dataset", "cluster", "factor", F.col("quantiles").alias("from")).join(target, ["cluster", "factor"])
    joined = labelled.join(F.broadcast(maps), ["dataset", "cluster", "factor"], "left")
    flat = (F.array_min("from") == F.array_max("from")) | (F.array_min("to") == F.array_max("to"))
    # The last point at or below the value; of equal points of a curve the last one counts.
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(n_quantiles)), lambda q: F.get("from", q) <= F.col("value")))
    x0, x1, y0, y1 = (F.get(c, a) for c in ("from", "to") for a in (at, at + 1))
    moved = F.when(at.isNull(), F.get("to", F.lit(0))).when((at == n_quantiles) | (x1 == x0), y0).otherwise(y0 + (F.col("value") - x0) / (x1 - x0) * (y1 - y0))
    value = F.when(F.col("from").isNull(), F.col("value")).when(flat, F.lit(0.0)).otherwise(moved)
    rows = joined.select("dataset", "cell", "cluster", "factor", value.alias("value"))
    return rows.groupBy("dataset", "cell", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("factor", "value"))), lambda x: x["value"]).alias("vec"))
