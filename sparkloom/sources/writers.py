"""Sinks: edge lists, delimited tables, factors, sparse triples, Hive-partitioned Parquet, text lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_list(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.mode("overwrite").csv(path, sep=" ", header=False)


def delimited(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").csv(path, sep=sep, header=True)


def factor(rows: DataFrame, path: str, k: int, headers: bool = True) -> None:
    """A (gene, vec) factor as one tab-separated column an entry."""
    entries = [F.col("vec")[c].alias(str(c)) for c in range(k)]
    if headers:
        wide = rows.select(F.col("gene").alias(""), *entries)
    else:
        wide = rows.select("gene", *entries)
    wide.write.mode("overwrite").csv(path, sep="\t", header=headers)


def triples(matrix: DataFrame, path: str, square: bool = False) -> None:
    """Positive entries; of a square matrix those above the diagonal."""
    rows = matrix.filter("v > 0")
    (rows.filter("i < j") if square else rows).select("i", "j", "v").write.mode("overwrite").csv(path, sep="\t")


def clusters(assigned: DataFrame, path: str) -> None:
    assigned.select("gene", "cluster").write.mode("overwrite").csv(path, sep="\t")


def partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet with one folder a key, the layout that later reads prune by."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def report(rows: DataFrame, path: str) -> None:
    """A small summary table as text lines ``column: value``, a block a row."""
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    rows.select(text.alias("value")).write.mode("overwrite").text(path)
