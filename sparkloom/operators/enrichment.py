"""Over-representation: clusters against a gene set, terms against clusters, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.stats import adjusted_bh, fold_enrichment, hypergeom_sf


def usable_annotations(annotations: DataFrame, universe: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Distinct (gene, term) inside the universe, without terms of fewer than ``least`` genes."""
    rows = annotations.select("gene", "term").distinct()
    if universe is not None:
        rows = rows.join(universe.select("gene"), "gene", "left_semi")
    common = rows.groupBy("term").agg(F.count("*").alias("_k")).filter(F.col("_k") >= least).select("term")
    return rows.join(common, "term", "left_semi").select("gene", "term")


def contingency(clusters: DataFrame, genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """cluster, M, K, N, X: all genes, marked genes, the cluster's genes, its marked genes.

    ``by``: columns of both inputs (a run, a fold) that keep their tests apart.
    """
    keys = list(by or [])
    marked = clusters.select(*keys, "cluster", "gene").distinct().join(genes.select(*keys, "gene").distinct().withColumn("_in", F.lit(1)), [*keys, "gene"], "left")
    each = marked.groupBy(*keys, "cluster").agg(F.count("*").alias("N"), F.count("_in").alias("X"))
    whole = marked.groupBy(*keys, "gene").agg(F.max("_in").alias("_in")).groupBy(*keys).agg(F.count("*").alias("M"), F.count("_in").alias("K"))
    met = each.join(whole, keys) if keys else each.crossJoin(F.broadcast(whole))  # one row
    return met.select(*keys, "cluster", "M", "K", "N", "X")


def cluster_enrichment(clusters: DataFrame, genes: DataFrame, alpha: float = 0.05, bh_over: str = "passing", by: list[str] | None = None) -> DataFrame:
    """cluster, M, K, N, X, fold, p, p_adj, enriched (after the columns ``by``, which keep tests apart).

    By default only clusters with fold >= 1 and p <= alpha are adjusted (the
    others keep a null p_adj); ``bh_over="all"`` adjusts over all clusters.
    """
    rows = contingency(clusters, genes, by).select(
        "*", fold_enrichment(F.col("M"), F.col("K"), F.col("N"), F.col("X")).alias("fold"), hypergeom_sf(F.col("M"), F.col("K"), F.col("N"), F.col("X")).alias("p")
    )
    if bh_over == "all":
        return adjusted_bh(rows, "p", by, ties=["cluster"]).withColumn("enriched", (F.col("p_adj") <= alpha) & (F.col("fold") >= 1))
    passing = (F.col("fold") >= 1) & (F.col("p") <= alpha)
    tested = adjusted_bh(rows.filter(passing), "p", by, ties=["cluster"])
    rest = rows.filter(~passing).withColumn("p_adj", F.lit(None).cast("double"))
    return tested.unionByName(rest).withColumn("enriched", F.coalesce(F.col("p_adj") <= alpha, F.lit(False)))


def enrichment_summary(tested: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of clusters enriched, share of marked genes in them, mean fold (null for none); one row, or one for each value of ``by``."""
    return tested.groupBy(*(by or [])).agg(
        F.try_divide(F.count_if("enriched").cast("double"), F.count("*")).alias("share_clusters"),
        F.try_divide(F.sum(F.when(F.col("enriched"), F.col("X")).otherwise(0)).cast("double"), F.max("K")).alias("share_genes"),
        F.avg(F.when(F.col("enriched"), F.col("fold"))).alias("mean_fold"),
    )


def term_counts(clusters: DataFrame, annotations: DataFrame) -> DataFrame:
    """cluster, term, M, K, N, X over the annotated genes of the clusters."""
    member = clusters.select("cluster", "gene").distinct()
    known = member.join(annotations.select("gene").distinct(), "gene", "left_semi")
    sizes = known.groupBy("cluster").agg(F.count("*").alias("N"))
    met = known.join(annotations.select("gene", "term").distinct(), "gene")
    hits = met.groupBy("cluster", "term").agg(F.count("*").alias("X"))
    totals = met.groupBy("term").agg(F.countDistinct("gene").alias("K"))
    whole = known.agg(F.countDistinct("gene").alias("M"))
    return hits.join(sizes, "cluster").join(totals, "term").crossJoin(F.broadcast(whole)).select("cluster", "term", "M", "K", "N", "X")  # one row


def term_enrichment(clusters: DataFrame, annotations: DataFrame, alpha: float = 0.05) -> DataFrame:
    """cluster, term, M, K, N, X, p, p_adj, enriched; adjusted over all (cluster, term) pairs."""
    rows = term_counts(clusters, annotations).withColumn("p", hypergeom_sf(F.col("M"), F.col("K"), F.col("N"), F.col("X")))
    return adjusted_bh(rows, "p", ties=["cluster", "term"]).withColumn("enriched", F.col("p_adj") <= alpha)


def enriched_genes(clusters: DataFrame, annotations: DataFrame, tested: DataFrame) -> DataFrame:
    """Genes with a term that is enriched in their own cluster."""
    pairs = clusters.select("cluster", "gene").distinct().join(annotations.select("gene", "term").distinct(), "gene")
    return pairs.join(tested.filter("enriched").select("cluster", "term"), ["cluster", "term"], "left_semi").select("gene").distinct()


def evidence_enrichment(universe: DataFrame, evidence: DataFrame, predicted: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: M, K, N, X, fold, p; p is null if fold < 1.

    ``evidence`` (gene, pubmed, source): a gene counts if it is cited or has a source.
    """
    backed = evidence.filter((F.col("pubmed") > 0) | (F.coalesce("source", F.lit("")) != "")).select("gene").distinct().withColumn("_e", F.lit(1))
    rows = universe.select("gene").distinct().join(backed, "gene", "left").join(predicted.select("gene").distinct().withColumn("_p", F.lit(1)), "gene", "left")
    one = rows.agg(F.count("*").alias("M"), F.count("_e").alias("K"), F.count("_p").alias("N"), F.count_if(F.col("_e").isNotNull() & F.col("_p").isNotNull()).alias("X"))
    fold = fold_enrichment(F.col("M"), F.col("K"), F.col("N"), F.col("X"))
    return one.select("M", "K", "N", "X", fold.alias("fold"), F.when(fold >= 1, hypergeom_sf(F.col("M"), F.col("K"), F.col("N"), F.col("X"))).alias("p"))
