"""The canonical tables of the analytics, bound to the driver's tables (and the same in SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import as_canonical

#: Rows of lineitem for each task of ``Tables.together``.
TOGETHER_ROWS = 1_000_000


class Tables:
    """Canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def annotations(self) -> DataFrame:
        """Nations to whose suppliers a part was returned."""
        items = self.read("lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
        home = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        return items.join(home, "l_suppkey").select(F.col("l_partkey").alias("gene"), F.col("s_nationkey").alias("term")).distinct()

    def clusters(self) -> DataFrame:
        return self.read("part").select(F.col("p_size").alias("cluster"), F.col("p_partkey").alias("gene"))

    def universe(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("gene"))

    def known(self) -> DataFrame:
        return self.read("part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("gene"))

    def edges(self) -> DataFrame:
        """Parts and their suppliers; supplier ids are moved out of the parts' range."""
        return self.read("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst")).distinct()

    def together(self) -> DataFrame:
        """Different parts in one urgent order.

        An order's pairs are many times its items, so orders are dealt to a
        number of tasks that grows with the items, and that Spark does not lower
        for the few bytes which items have.
        """
        urgent = self.read("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
        items = self.read("lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey")
        tasks = max(8, self.read("lineitem").count() // TOGETHER_ROWS)
        parts = items.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
        later = F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("dst")
        pairs = parts.filter("size(parts) > 1").select("parts", F.posexplode("parts").alias("at", "src")).select("src", later)
        return as_canonical(pairs.repartition(tasks, "src", "dst").distinct())

    def expression(self) -> DataFrame:
        return self.read("lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell")).agg(F.sum("l_quantity").alias("value"))

    def stages(self) -> DataFrame:
        """name (year of shipping), gene."""
        return self.read("lineitem").select(F.year("l_shipdate").alias("name"), F.col("l_partkey").alias("gene")).distinct()

    def conditions(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_partkey").alias("gene")).distinct()

    def evidence(self) -> DataFrame:
        """Cited once for each returned item; one type of part is a source of its own."""
        cited = self.read("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("pubmed"))
        parts = self.read("part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise("").alias("source"))
        return parts.join(cited, "gene", "left").select("gene", F.coalesce("pubmed", F.lit(0)).alias("pubmed"), "source")

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("gene"), F.col("embedding").alias("vec"), "label")

    def crosswalk(self) -> DataFrame:
        """Names of the nations outside region 0, so that some keys miss."""
        return self.read("nation").filter("n_regionkey <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("symbol"))


SQL = {
    "annotations": "annotations AS (SELECT DISTINCT l_partkey AS gene, s_nationkey AS term FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R')",
    "clusters": "clusters AS (SELECT p_size AS cluster, p_partkey AS gene FROM part)",
    "universe": "universe AS (SELECT p_partkey AS gene FROM part)",
    "known": "known AS (SELECT p_partkey AS gene FROM part WHERE p_type = 'PROMO')",
    "edges": "edges AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem)",
    "both": "both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)",
    "together": "together AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey JOIN orders ON o_orderkey = a.l_orderkey WHERE o_orderpriority = '1-URGENT')",
    "expression": "expression AS (SELECT l_partkey AS gene, l_suppkey AS cell, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)",
    "stages": "stages AS (SELECT DISTINCT year(l_shipdate) AS name, l_partkey AS gene FROM lineitem)",
    "conditions": "conditions AS (SELECT DISTINCT l_returnflag AS name, l_partkey AS gene FROM lineitem)",
    "evidence": "evidence AS (SELECT p_partkey AS gene, coalesce(c, 0) AS pubmed, CASE WHEN p_type = 'ECONOMY' THEN p_type ELSE '' END AS source FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey)",
    "vectors": "vectors AS (SELECT vec_id AS gene, embedding::DOUBLE[] AS vec, label FROM embeddings)",
    "crosswalk": "crosswalk AS (SELECT n_nationkey AS id, n_name AS symbol FROM nation WHERE n_regionkey <> 0)",
}


def sql(*names: str, recursive: bool = False) -> str:
    """The WITH clause that defines canonical tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL[n] for n in names)
