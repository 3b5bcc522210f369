"""k-means with restarts, k-medoids, and the tables they give."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lloyd import cluster_all


def k_means(points: DataFrame, k: int, n_init: int = 10, seed: int = 1, init: str = "random", max_iter: int = 300) -> tuple[DataFrame, float]:
    """(gene, cluster) of the cheapest of ``n_init`` restarts, and its cost.

    ``points`` (gene, vec). The key goes along, so equal vectors are never
    confused. All restarts share their passes (see ``lloyd``); another
    ``init`` than random is MLlib's, restart after restart.
    """
    if init == "random":
        width = len(points.select("vec").first()["vec"])
        found, costs = cluster_all([points], [width], [(0, k, 0)], n_init, seed, max_iter)
        return found.select("gene", "cluster"), costs[0]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = points.select("gene", array_to_vector(F.col("vec").cast("array<double>")).alias("features")).persist()
    best, cost = None, float("inf")
    for turn in range(n_init):
        model = KMeans(k=k, seed=seed + turn, initMode=init, maxIter=max_iter, tol=1e-4, featuresCol="features", predictionCol="cluster").fit(ready)
        if model.summary.trainingCost < cost:
            best, cost = model, model.summary.trainingCost
    out = best.transform(ready).select("gene", "cluster")
    ready.unpersist()
    return out, cost


def repeated_k_means(points: DataFrame, k: int, runs: int = 10, n_init: int = 10, seed: int = 1) -> DataFrame:
    """run, cluster, gene of independent clusterings, in the same passes."""
    width = len(points.select("vec").first()["vec"])
    return cluster_all([points], [width], [(0, k, run) for run in range(runs)], n_init, seed)[0]


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """run, cluster, size with empty clusters present."""
    runs = assigned.select("run").distinct()
    every = runs.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    sizes = assigned.groupBy("run", "cluster").agg(F.count("*").alias("size"))
    return every.join(sizes, ["run", "cluster"], "left").select("run", "cluster", F.coalesce("size", F.lit(0)).alias("size"))


#: Groups of a cluster's members whose pairs are dealt to tasks, members of a group at least (but for the last) and at most.
GROUPS, LEAST_ROWS, GROUP_ROWS = 4, 512, 1 << 16


def k_medoids(points: DataFrame, k: int, seed: int = 1, max_iter: int | None = None) -> DataFrame:
    """gene, medoid: alternating assignment and choice of the best medoid.

    Medoids (k rows) are broadcast. A cluster's new medoid is the member whose
    distances to all members add up to least; a cluster whose members have been
    seen keeps the medoid found then. It ends when the medoids have been seen
    before (they stay, or would go round); ``max_iter`` is a bound on request.
    Equal vectors are one member with a weight, named by their smallest gene.
    """
    from sparkloom.functions.vectors import euclidean
    from sparkloom.session import discard, materialize

    every = points.select("gene", F.col("vec").cast("array<double>").alias("vec"))
    x = materialize(every.groupBy("vec").agg(F.min("gene").alias("gene"), F.count("*").cast("double").alias("weight")).select("gene", "vec", "weight"), "members")
    medoids = every.orderBy(F.xxhash64("gene", F.lit(seed)), "gene").limit(k).collect()  # k rows

    def assigned(rows, used):
        choices = F.array(*[F.struct(F.lit(m["gene"]).alias("medoid"), F.array(*[F.lit(float(v)) for v in m["vec"]]).alias("v")) for m in used])
        nearest = F.array_min(F.transform(choices, lambda c: F.struct(euclidean(F.col("vec"), c["v"]).alias("d"), c["medoid"].alias("medoid"))))
        return rows.select("*", nearest["medoid"].alias("medoid"))

    seen, found, used = set(), {}, medoids
    for _ in count() if max_iter is None else range(max_iter):
        used = medoids
        names = frozenset(m["gene"] for m in used)
        if names in seen:
            break
        seen.add(names)
        own = assigned(x, used)
        marks = [F.bit_xor(F.xxhash64("gene", F.lit(m))).alias(f"m{m}") for m in range(2)]
        clusters = {r["medoid"]: tuple(r)[1:] for r in own.groupBy("medoid").agg(F.count("*").alias("n"), *marks).collect()}  # k rows
        new = {medoid: mark for medoid, mark in clusters.items() if mark not in found}
        if new:
            sums = summed_distances(own.filter(F.col("medoid").isin(list(new))), {medoid: mark[0] for medoid, mark in new.items()}).withColumn("s", F.round("s", 9))
            best = {r["medoid"]: r["b"] for r in sums.groupBy("medoid").agg(F.min_by("gene", F.struct("s", "gene")).alias("b")).collect()}  # k rows
            vectors = {r["gene"]: r for r in x.filter(F.col("gene").isin(list(best.values()))).select("gene", "vec").collect()}  # k rows
            found |= {mark: vectors[best[medoid]] for medoid, mark in new.items()}
        medoids = [found[mark] for mark in clusters.values()]
    discard(x)
    return assigned(every, used).select("gene", "medoid")


def _group_count(n: int) -> int:
    return max(min(GROUPS, -(-n // LEAST_ROWS)), -(-n // GROUP_ROWS))


def summed_distances(members: DataFrame, sizes: dict) -> DataFrame:
    """medoid, gene, s: the sum of a member's distances to all members of its cluster, by their weight.

    ``members`` (medoid, gene, vec, weight), ``sizes`` by medoid. A cluster's members are
    dealt to a few groups, of which every two meet in one task, so a vector is
    moved ``GROUPS`` times (in a larger cluster size / ``GROUP_ROWS``), and each
    distance is made once; no distance is ever a row.
    """
    from sparkloom.operators.movement import TILE, distances

    groups = {medoid: _group_count(n) for medoid, n in sizes.items()}
    n = F.coalesce(*[F.when(F.col("medoid") == F.lit(medoid), F.lit(g)) for medoid, g in groups.items()])
    dealt = members.withColumn("_n", n).withColumn("_g", F.pmod(F.xxhash64("gene"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def meet(table):
        import numpy as np
        import pyarrow as pa

        g, o = table.column("_g").to_numpy(), table.column("_o").to_numpy()
        low, same = np.minimum(g, o)[0], bool((g == o)[0])
        sides = []
        for mine in (g == low,) if same else (g == low, g != low):
            part = table.filter(pa.array(mine)).combine_chunks()
            x = part.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            sides.append((part, x, part.column("weight").to_numpy(), np.zeros(part.num_rows)))
        (_, x, wx, sx), (_, y, wy, sy) = sides[0], sides[-1]
        for r in range(0, len(x), TILE[0]):
            for c in range(0, len(y), TILE[1]) if len(y) else ():
                here, there = slice(r, r + TILE[0]), slice(c, c + TILE[1])
                far = distances(x[here], y[there])
                sx[here] += far @ wy[there]
                if not same:
                    sy[there] += wx[here] @ far
        return pa.concat_tables([pa.table({"medoid": part.column("medoid"), "gene": part.column("gene"), "s": pa.array(s)}) for part, _, _, s in sides])

    least, most = F.least("_g", "_o"), F.greatest("_g", "_o")
    met = dealt.withColumn("_a", least).withColumn("_b", most).repartition(max(1, sum(g * (g + 1) // 2 for g in groups.values())), "medoid", "_a", "_b")
    sums = met.groupBy("medoid", "_a", "_b").applyInArrow(meet, f"medoid {kinds['medoid']}, gene {kinds['gene']}, s double")
    return sums.groupBy("medoid", "gene").agg(F.sum("s").alias("s"))


def soft_clusters(factors: DataFrame, threshold: float, softmaxed: bool = False) -> DataFrame:
    """gene, cluster, share for every entry whose share of its row reaches the threshold."""
    from sparkloom.functions.vectors import shares, softmax

    value = softmax(F.col("vec")) if softmaxed else shares(F.col("vec"))
    return factors.select("gene", F.posexplode(value).alias("cluster", "share")).filter(F.col("share") >= threshold)
