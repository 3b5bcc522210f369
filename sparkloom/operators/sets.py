"""Set operations on gene sets and lists of sets (columns: gene, and name for lists)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.stats import rows_before


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gene").distinct().join(b.select("gene"), "gene", "left_semi")


def union(*sets: DataFrame) -> DataFrame:
    return concatenated(*sets).distinct()


def concatenated(*sets: DataFrame) -> DataFrame:
    """All rows of all sets; a gene is there as often as it occurs."""
    out = sets[0].select("gene")
    for s in sets[1:]:
        out = out.unionAll(s.select("gene"))
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("gene").distinct().join(b.select("gene"), "gene", "left_anti")


def in_all(named: DataFrame) -> DataFrame:
    """Genes that are in every named set; one aggregation, however many sets."""
    n = named.agg(F.countDistinct("name").alias("n"))
    counts = named.groupBy("gene").agg(F.countDistinct("name").alias("k"))
    return counts.join(F.broadcast(n), counts["k"] == n["n"]).select("gene")  # n is one row


def venn_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, both, only_b of two sets."""
    flags = a.select("gene").distinct().withColumn("a", F.lit(1)).unionByName(b.select("gene").distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    each = flags.groupBy("gene").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(
        F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("a").isNull()).alias("only_b")
    )


def venn_regions(named: DataFrame) -> DataFrame:
    """names (sorted list of the sets) and how many genes are in exactly those."""
    each = named.groupBy("gene").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return each.groupBy(F.concat_ws("&", "names").alias("names")).agg(F.count("*").alias("n"))


def ordered_distinct(rows: DataFrame, order: str) -> DataFrame:
    """Each gene once, at its first place."""
    return rows.groupBy("gene").agg(F.min(order).alias(order))


def leave_one_out(named: DataFrame, names: list) -> DataFrame:
    """fold, role, gene: for each name the others train and it tests."""
    folds = F.explode(F.array(*[F.lit(n) for n in names])).alias("fold")
    return named.select("gene", "name", folds).select("fold", F.when(F.col("fold") == F.col("name"), "test").otherwise("train").alias("role"), "gene")


def top_n(rows: DataFrame, n: DataFrame, by: str, descending: bool = True, tie: str = "gene") -> DataFrame:
    """The first n rows by value; n is a one-row frame (the size of another set).

    The cut value comes from counts by value, sorted by sections, so only the ties at the cut are ordered.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    cut = rows_before(counts, by, "_n", descending=descending)
    met = rows.join(cut, by).crossJoin(F.broadcast(n.toDF("_want")))  # one row
    tied = Window.partitionBy(by).orderBy(tie)
    whole = met.filter(F.col("_before") + F.col("_n") <= F.col("_want"))
    part = met.filter((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") > F.col("_want"))).withColumn("_k", F.row_number().over(tied)).filter(F.col("_before") + F.col("_k") <= F.col("_want")).drop("_k")
    return whole.unionByName(part).select(rows.columns)
