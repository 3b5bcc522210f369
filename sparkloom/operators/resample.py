"""Folds, samples and permutation tests that repeat exactly for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(key: Column, seed: int = 0) -> Column:
    """A number in [0, 2^31 - 1) that any engine can compute from an integer key."""
    return F.pmod((key.cast("long") + seed) * 48271 % 2147483647 * 69621 % 2147483647, F.lit(2147483647))


def folds(genes: DataFrame, n_folds: int, seed: int = 0) -> DataFrame:
    """fold, gene: shuffled chunks of floor(n / folds) + 1 genes.

    Places are counted by hash range first, so the shuffle sorts no set in one task.
    """
    width = 2147483647 // 1024 + 1
    drawn = genes.select("gene").distinct().withColumn("r", spread(F.col("gene"), seed)).withColumn("b", F.floor(F.col("r") / width).cast("int"))
    counts = drawn.groupBy("b").agg(F.count("*").alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # 1024 rows
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("b").orderBy("r", "gene")) - 1
    return drawn.join(F.broadcast(based), "b").withColumn("k", rank).select(F.floor(F.col("k") / (F.floor(F.col("total") / n_folds) + 1)).cast("int").alias("fold"), "gene")


def fold_ratios(tests: DataFrame, universe: DataFrame, predicted: DataFrame) -> DataFrame:
    """fold, n_test, hit, share and the ratio to the share in the background (universe without the fold's genes).

    ``predicted`` (gene), or (fold, gene) if each fold has predictions of its own.
    """
    keys = ["fold"] if "fold" in predicted.columns else []
    marked = predicted.select(*keys, "gene").distinct().withColumn("_p", F.lit(1))
    t = tests.join(marked, [*keys, "gene"], "left").groupBy("fold").agg(F.count("*").alias("n_test"), F.count("_p").alias("hit"))
    genes = universe.select("gene").distinct()
    n = genes.agg(F.count("*").alias("n"))
    h = marked.join(genes, "gene", "left_semi").groupBy(*keys).agg(F.count("*").alias("h"))
    whole = t.crossJoin(F.broadcast(n))  # one row
    met = whole.join(h, keys, "left") if keys else whole.crossJoin(F.broadcast(h))  # one row a fold, or one
    found = F.coalesce("h", F.lit(0))
    rest = F.try_divide((found - F.col("hit")).cast("double"), F.col("n") - F.col("n_test"))
    return met.select("fold", "n_test", "hit", (F.col("hit") / F.col("n_test")).alias("share"), F.coalesce(F.try_divide(F.col("hit") / F.col("n_test"), rest), F.lit(0.0)).alias("ratio"))


def permutation_test(pools: list[int], picks: list[int], shared: int, observed: int, reps: int = 10_000, seed: int = 0, spark=None) -> DataFrame:
    """One row, p: (1 + repetitions with an intersection of at least ``observed``) / (1 + reps).

    Each repetition draws ``picks[s]`` genes without replacement from each
    stage's pool of ``pools[s]`` genes, of which the same ``shared`` genes are
    in all pools, and counts genes drawn in all stages. Counts of common genes
    follow from draws without replacement, so no set is moved. Repetitions are
    dealt over tasks and depend on seed and number only.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hits = []
            for rep in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, rep])
                left = shared
                for pool, pick in zip(pools, picks, strict=True):
                    # Of the genes still common to all stages so far, how many this stage draws.
                    left = int(rng.hypergeometric(left, pool - left, pick)) if pool else 0
                hits.append(left >= observed)
            yield pa.RecordBatch.from_pydict({"hit": pa.array(hits, pa.bool_())})

    return spark.range(reps).mapInArrow(run, "hit boolean").agg(((F.count_if("hit") + 1) / (F.count("*") + 1)).alias("p"))
