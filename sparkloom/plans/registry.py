"""All queries of the analytics library by name, with the SQL that checks them.

Doubles are rounded on both sides, p-values as -log10, because results are
compared by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import stats, vectors
from sparkloom.operators import aggregates, cluster, enrichment, factorize, graph, linalg, movement, relational, resample, sets
from sparkloom.plans import pipeline_sql, pipelines
from sparkloom.plans.bindings import Tables, sql
from sparkloom.plans.pipeline_sql import TAIL
from sparkloom.streaming import windows

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def nlog(p: Column | str) -> Column:
    """-log10 of a p-value at four places; values below 1e-200 count as that."""
    return F.round(-F.log10(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(1e-200))), 4)


#: Adding 0.0 makes -0.0 (the logarithm of exactly 1) the 0.0 that it equals.
NLOG = "(round(-log10(greatest({}, 1e-200)), 4) + 0.0)"


# -- scans, projections, filters ------------------------------------------------------------------


@query("SELECT p_partkey AS gene, upper(p_brand) AS brand FROM part WHERE p_name <> '' AND p_size <= 10 AND p_type LIKE '%O%'")
def scan_filter_project(t):
    return t.read("part").filter("p_name <> '' AND p_size <= 10 AND contains(p_type, 'O')").select(F.col("p_partkey").alias("gene"), F.upper("p_brand").alias("brand"))


@query(sql("annotations", "crosswalk") + " SELECT gene, symbol AS term FROM annotations JOIN crosswalk ON id = term")
def crosswalk_inner(t):
    return relational.translated(t.annotations(), "term", t.crosswalk(), "drop")


@query(sql("annotations", "crosswalk") + " SELECT gene, coalesce(symbol, 'none') AS term FROM annotations LEFT JOIN crosswalk ON id = term")
def crosswalk_left_default(t):
    return relational.translated(t.annotations(), "term", t.crosswalk(), "default", F.lit("none"))


@query("SELECT DISTINCT least(s, d) AS src, greatest(s, d) AS dst FROM (SELECT coalesce(a.n_name, x.s_nationkey::VARCHAR) AS s, coalesce(b.n_name, c.c_nationkey::VARCHAR) AS d "
       "FROM supplier x JOIN customer c ON c.c_custkey = x.s_suppkey LEFT JOIN nation a ON a.n_nationkey = x.s_nationkey AND a.n_regionkey <> 0 LEFT JOIN nation b ON b.n_nationkey = c.c_nationkey AND b.n_regionkey <> 0)")
def relabelled_network(t):
    pairs = t.read("supplier").join(t.read("customer"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return relational.relabelled_edges(pairs, t.crosswalk())


@query(sql("together", "known") + " SELECT src, dst FROM together WHERE src IN (SELECT gene FROM known) AND dst IN (SELECT gene FROM known)")
def induced_subgraph(t):
    return relational.induced(t.together(), t.known())


@query(sql("together", "known") + " SELECT src, dst FROM together WHERE src NOT IN (SELECT gene FROM known) AND dst NOT IN (SELECT gene FROM known)")
def masked_subgraph(t):
    return relational.masked(t.together(), t.known())


@query("WITH e AS (SELECT l_partkey AS gene, l_suppkey AS cell, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS value FROM lineitem GROUP BY 1, 2) "
       "SELECT gene, cell, value FROM e WHERE gene IN (SELECT gene FROM e GROUP BY gene HAVING sum(value) <> 0)")
def zero_row_drop(t):
    value = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("value")
    return relational.without_zero_rows(t.read("lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("cell")).agg(value)).select("gene", "cell", "value")


@query(sql("expression") + ", m AS (SELECT s_suppkey AS cell, s_nationkey AS cond FROM supplier) SELECT gene, e.cell, value FROM expression e JOIN m USING (cell) WHERE cond = 7")
def condition_cells(t):
    return relational.cells_of(t.expression(), t.read("supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("cond")), 7).select("gene", "cell", "value")


@query("SELECT p_partkey AS gene, CASE p_type WHEN 'PROMO' THEN 'known' WHEN 'ECONOMY' THEN 'listed' ELSE p_type END AS label, CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0.0 END AS high, "
       "greatest(p_size - 25.0, 0.0) AS above, greatest(25.0 - p_size, 0.0) AS below FROM part")
def label_map_and_parts(t):
    x = F.col("p_size") - 25.0
    return t.read("part").select(
        F.col("p_partkey").alias("gene"), relational.labelled(F.col("p_type"), {"PROMO": "known", "ECONOMY": "listed"}).alias("label"), relational.binarised(F.col("p_retailprice") - 1000).alias("high"),
        vectors.positive_part(x).alias("above"), vectors.negative_part(x).alias("below"),
    )


# -- joins and sets ---------------------------------------------------------------------------------


@query(sql("clusters", "known") + " SELECT cluster, gene FROM clusters WHERE gene NOT IN (SELECT gene FROM known)")
def known_anti(t):
    return t.clusters().join(t.known(), "gene", "left_anti").select("cluster", "gene")


@query(sql("clusters", "known") + " SELECT cluster, gene FROM clusters WHERE gene IN (SELECT gene FROM known)")
def known_semi(t):
    return t.clusters().join(t.known(), "gene", "left_semi").select("cluster", "gene")


@query("WITH a AS (SELECT l_partkey AS gene, sum(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS gene, sum(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) "
       "SELECT coalesce(a.gene, b.gene) AS gene, a, b FROM a FULL JOIN b ON a.gene = b.gene")
def label_full_outer(t):
    side = lambda flag, name: t.read("lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias(name))
    return side("A", "a").join(side("R", "b"), "gene", "full_outer")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def checked_lookup(t):
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return relational.checked_inner(t.read("lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey")


@query("SELECT n_nationkey AS id, c_custkey, c_name FROM nation JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) ON c_nationkey = n_nationkey AND k = 1")
def first_match_lookup(t):
    customers = t.read("customer").select(F.col("c_nationkey").alias("id"), "c_custkey", "c_name")
    return relational.first_match(t.read("nation").select(F.col("n_nationkey").alias("id")), customers, "id", ["c_custkey"])


@query(sql("stages") + " SELECT gene FROM stages GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT name) FROM stages)")
def nway_intersection(t):
    return sets.in_all(t.stages())


@query(sql("known", "annotations") + " SELECT gene FROM known UNION SELECT gene FROM annotations")
def union_distinct(t):
    return sets.union(t.known(), t.annotations())


@query(sql("known", "annotations") + " SELECT DISTINCT gene FROM annotations WHERE gene NOT IN (SELECT gene FROM known)")
def difference(t):
    return sets.difference(t.annotations(), t.known())


@query(sql("known", "annotations") + " SELECT gene FROM known INTERSECT SELECT gene FROM annotations WHERE term < 12")
def intersection(t):
    return sets.intersection(t.known(), t.annotations().filter("term < 12").select("gene"))


@query(sql("known", "conditions") + " SELECT gene FROM known UNION ALL SELECT gene FROM conditions")
def multiset_concat(t):
    return sets.concatenated(t.known(), t.conditions())


@query("SELECT l.p_partkey AS gene, r.p_partkey AS partner, l.place FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS place FROM part) l JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS place FROM part WHERE p_size < 30) r USING (place)")
def positional_zip(t):
    parts = t.read("part")
    left, right = parts.select("p_retailprice", F.col("p_partkey").alias("gene")), parts.filter("p_size < 30").select("p_name", F.col("p_partkey").alias("partner"))
    return relational.zipped(left, right, ["p_retailprice", "gene"], ["p_name", "partner"]).select("gene", "partner", "place")


@query(sql("expression") + " SELECT gene, cell, value FROM expression WHERE cell NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def delete_condition(t):
    metadata = t.read("supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("cond"))
    return relational.cells_not_of(t.expression(), metadata, 3).select("gene", "cell", "value")


@query(sql("expression", "known") + " SELECT gene AS i, cell AS j, value AS v FROM expression WHERE gene IN (SELECT gene FROM known) AND cell IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def submatrix(t):
    matrix = t.expression().select(F.col("gene").alias("i"), F.col("cell").alias("j"), F.col("value").alias("v"))
    return relational.submatrix(matrix, t.known().select(F.col("gene").alias("i")), t.read("supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("j")))


@query(sql("known", "annotations") + ", f AS (SELECT gene, max(a) AS a, max(b) AS b FROM (SELECT gene, 1 AS a, 0 AS b FROM known UNION ALL SELECT gene, 0, 1 FROM annotations) GROUP BY gene) "
       "SELECT count(*) FILTER (b = 0) AS only_a, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 0) AS only_b FROM f")
def venn_counts(t):
    return sets.venn_counts(t.known(), t.annotations())


@query(sql("conditions") + " SELECT names, count(*) AS n FROM (SELECT gene, string_agg(name, '&' ORDER BY name) AS names FROM conditions GROUP BY gene) GROUP BY names")
def venn_regions(t):
    return sets.venn_regions(t.conditions())


@query("SELECT l_partkey AS gene, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def ordered_distinct(t):
    return sets.ordered_distinct(t.read("lineitem").select(F.col("l_partkey").alias("gene"), "l_orderkey"), "l_orderkey")


# -- aggregations ---------------------------------------------------------------------------------------


@query(sql("annotations") + " SELECT gene, term FROM annotations WHERE term IN (SELECT term FROM annotations GROUP BY term HAVING count(*) > 1)")
def annotation_load(t):
    return enrichment.usable_annotations(t.annotations())


CONTINGENCY = sql("clusters", "known") + """, c AS (
  SELECT cluster, (SELECT count(*) FROM clusters) AS m, (SELECT count(*) FROM clusters WHERE gene IN (SELECT gene FROM known)) AS k,
         count(*) AS n, count(*) FILTER (gene IN (SELECT gene FROM known)) AS x FROM clusters GROUP BY cluster)"""


@query(CONTINGENCY + " SELECT cluster, m, k, n, x, round(coalesce((x::DOUBLE / nullif(n, 0)) / nullif(k::DOUBLE / m, 0), 0), 6) AS fold FROM c")
def contingency_fold(t):
    rows = enrichment.contingency(t.clusters(), t.known())
    return rows.select("cluster", F.col("M").alias("m"), F.col("K").alias("k"), F.col("N").alias("n"), F.col("X").alias("x"), r6(stats.fold_enrichment(F.col("M"), F.col("K"), F.col("N"), F.col("X"))).alias("fold"))


@query(CONTINGENCY + f" SELECT cluster, {NLOG.format(TAIL)} AS nlog_p FROM c")
def hypergeom_sf(t):
    rows = enrichment.contingency(t.clusters(), t.known())
    return rows.select("cluster", nlog(stats.hypergeom_sf(F.col("M"), F.col("K"), F.col("N"), F.col("X"))).alias("nlog_p"))


@query("WITH p AS (SELECT p_partkey AS gene, p_brand AS family, ((p_partkey * 7919) % 10007 + 1) / 10008.0 AS p FROM part), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, gene) AS k, count(*) OVER (PARTITION BY family) AS m FROM p) "
       "SELECT gene, round(least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM r")
def bh_adjust(t):
    rows = t.read("part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("family"), (((F.col("p_partkey") * 7919) % 10007 + 1) / 10008.0).alias("p"))
    return stats.adjusted_bh(rows, "p", ["family"], ties=["gene"]).select("gene", r6("p_adj").alias("p_adj"))


TERMS = sql("clusters", "annotations") + f""", known_genes AS (SELECT DISTINCT cluster, gene FROM clusters WHERE gene IN (SELECT gene FROM annotations)),
h AS (SELECT cluster, term, count(*) AS x FROM known_genes JOIN annotations USING (gene) GROUP BY ALL),
s AS (SELECT cluster, count(*) AS n FROM known_genes GROUP BY cluster),
q AS (SELECT term, count(DISTINCT gene) AS k FROM known_genes JOIN annotations USING (gene) GROUP BY term),
c AS (SELECT h.cluster, h.term, (SELECT count(DISTINCT gene) FROM known_genes) AS m, k, n, x FROM h JOIN s USING (cluster) JOIN q USING (term)),
p AS (SELECT *, {TAIL} AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p, cluster, term) AS i, count(*) OVER () AS tests FROM p),
a AS (SELECT *, least(1.0, min(p * tests / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM r)"""


@query(TERMS + f" SELECT cluster, term, k, n, x, {NLOG.format('p')} AS nlog_p, {NLOG.format('p_adj')} AS nlog_p_adj FROM a")
def term_enrichment(t):
    rows = enrichment.term_enrichment(t.clusters(), t.annotations())
    return rows.select("cluster", "term", F.col("K").alias("k"), F.col("N").alias("n"), F.col("X").alias("x"), nlog("p").alias("nlog_p"), nlog("p_adj").alias("nlog_p_adj"))


CLUSTER_TEST = CONTINGENCY + f""", p AS (SELECT *, coalesce((x::DOUBLE / n) / nullif(k::DOUBLE / m, 0), 0) AS fold, {TAIL} AS p FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY p, cluster) AS i, count(*) OVER () AS tests FROM p WHERE fold >= 1 AND p <= 0.2),
a AS (SELECT *, least(1.0, min(p * tests / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM r)"""


@query(CLUSTER_TEST + f" SELECT p.cluster, round(p.fold, 6) AS fold, {NLOG.format('p.p')} AS nlog_p, CASE WHEN a.p_adj IS NOT NULL THEN {NLOG.format('a.p_adj')} END AS nlog_p_adj, coalesce(a.p_adj <= 0.2, false) AS enriched FROM p LEFT JOIN a USING (cluster)")
def cluster_enrichment(t):
    rows = enrichment.cluster_enrichment(t.clusters(), t.known(), alpha=0.2)
    return rows.select("cluster", r6("fold").alias("fold"), nlog("p").alias("nlog_p"), F.when(F.col("p_adj").isNotNull(), nlog("p_adj")).alias("nlog_p_adj"), "enriched")


@query(CLUSTER_TEST + " SELECT round(count(a.p_adj)::DOUBLE / count(*), 6) AS share_clusters, round(sum(CASE WHEN a.p_adj <= 0.2 THEN p.x ELSE 0 END)::DOUBLE / max(p.k), 6) AS share_genes, round(avg(CASE WHEN a.p_adj <= 0.2 THEN p.fold END), 6) AS mean_fold FROM p LEFT JOIN (SELECT * FROM a WHERE p_adj <= 0.2) a USING (cluster)")
def enrichment_summary(t):
    rows = enrichment.enrichment_summary(enrichment.cluster_enrichment(t.clusters(), t.known(), alpha=0.2))
    return rows.select(*[r6(c).alias(c) for c in rows.columns])


@query(TERMS + " SELECT DISTINCT gene FROM known_genes JOIN annotations USING (gene) JOIN a USING (cluster, term) WHERE p_adj <= 0.9")
def enriched_genes(t):
    tested = enrichment.term_enrichment(t.clusters(), t.annotations(), alpha=0.9)
    return enrichment.enriched_genes(t.clusters(), t.annotations(), tested)


@query(TERMS + " SELECT cluster, round(CASE WHEN count(*) > 1 THEN -sum(x::DOUBLE / n * ln(x::DOUBLE / n)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM c GROUP BY cluster")
def entropy_mne(t):
    rows = enrichment.term_counts(t.clusters(), t.annotations()).select("cluster", "term", F.col("X").alias("n"), F.col("N").alias("size"))
    return aggregates.normalised_entropy(rows).select("cluster", r6("entropy").alias("entropy"))


@query("SELECT cond, run, pct FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY pct DESC, run) AS k FROM (SELECT p_brand AS cond, p_size % 10 AS run, round(avg(CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0 END), 6) AS pct FROM part GROUP BY 1, 2)) WHERE k = 1")
def best_run_argmax(t):
    rows = t.read("part").groupBy(F.col("p_brand").alias("cond"), (F.col("p_size") % 10).alias("run")).agg(r6(F.avg(F.when(F.col("p_type") == "PROMO", 1.0).otherwise(0.0))).alias("pct"))
    return aggregates.best_run(rows, ["cond"], "pct", "run")


@query("SELECT p_brand AS cond, round(quantile_cont(p_retailprice, 0.1587), 6) AS p0, round(quantile_cont(p_retailprice, 0.5), 6) AS p1, round(quantile_cont(p_retailprice, 0.8413), 6) AS p2 FROM part GROUP BY 1")
def percentiles_whiskers(t):
    rows = aggregates.percentiles(t.read("part").withColumnRenamed("p_brand", "cond"), "p_retailprice", by=["cond"])
    return rows.select("cond", *[r6(f"p{k}").alias(f"p{k}") for k in range(3)])


@query("SELECT p_brand AS cond, round(median(p_retailprice), 6) AS median, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS std_pop FROM part GROUP BY 1")
def median_popstd(t):
    rows = aggregates.centre_and_spread(t.read("part").withColumnRenamed("p_brand", "cond"), "p_retailprice", ["cond"])
    return rows.select("cond", *[r6(c).alias(c) for c in ("median", "mean", "std_pop")])


BINS = "least(floor(({0} - lo) / ((hi - lo) / 50)), 49)::INTEGER"


@query(f"WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_type <> 'PROMO') SELECT p_type = 'PROMO' AS side, {BINS.format('p_retailprice')} AS bin, count(*) AS n FROM part, b WHERE p_retailprice BETWEEN lo AND hi GROUP BY 1, 2")
def histogram50_bg(t):
    parts = t.read("part").withColumn("side", F.col("p_type") == "PROMO")
    bounds = parts.filter(~F.col("side")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return aggregates.histogram(parts, "p_retailprice", bounds, by=["side"])


@query(f"WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), c AS (SELECT {BINS.format('p_retailprice')} AS bin, count(*) AS n FROM part, b GROUP BY 1) SELECT bin, n, round(n::DOUBLE / max(n) OVER (), 6) AS height FROM c")
def histogram50_both(t):
    rows = aggregates.histogram(t.read("part"), "p_retailprice", scale="max")
    return rows.select("bin", "n", r6("height").alias("height"))


@query("SELECT l_linenumber, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM lineitem WHERE l_linenumber <> 0 GROUP BY 1")
def bincount_rel(t):
    rows = aggregates.relative_bins(t.read("lineitem"), "l_linenumber")
    return rows.select("l_linenumber", "n", r6("share").alias("share"))


@query("SELECT p_size, round(avg(CASE WHEN p_type = 'ECONOMY' THEN p_retailprice END), 4) AS \"ECONOMY\", round(avg(CASE WHEN p_type = 'PROMO' THEN p_retailprice END), 4) AS \"PROMO\" FROM part GROUP BY 1")
def pivot_grid(t):
    rows = t.read("part").groupBy("p_size", "p_type").agg(F.round(F.avg("p_retailprice"), 4).alias("v"))
    return aggregates.grid(rows, "p_size", "p_type", "v", ["ECONOMY", "PROMO"])


RUNS = "runs AS (SELECT label + 0 AS cluster, 0 AS run, vec_id AS gene FROM embeddings UNION ALL SELECT vec_id % 7, 1, vec_id FROM embeddings UNION ALL SELECT (label + vec_id % 2) % 10, 2, vec_id FROM embeddings)"


def _runs(t):
    v = t.vectors()
    one = v.select(F.lit(0).alias("run"), F.col("label").cast("long").alias("cluster"), "gene")
    two = v.select(F.lit(1).alias("run"), (F.col("gene") % 7).alias("cluster"), "gene")
    three = v.select(F.lit(2).alias("run"), ((F.col("label") + F.col("gene") % 2) % 10).cast("long").alias("cluster"), "gene")
    return one.unionByName(two).unionByName(three)


@query(f"WITH {RUNS} SELECT a.gene AS i, b.gene AS j, count(*) AS runs FROM runs a JOIN runs b ON a.run = b.run AND a.cluster = b.cluster AND a.gene < b.gene GROUP BY 1, 2")
def connectivity(t):
    return aggregates.comembership(_runs(t))


@query(f"WITH {RUNS}, g AS (SELECT DISTINCT gene FROM runs), c AS (SELECT x.gene AS i, y.gene AS j, (SELECT count(DISTINCT run) FROM runs) AS r FROM g x, g y), "
       "m AS (SELECT a.gene AS i, b.gene AS j, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.cluster = b.cluster GROUP BY 1, 2) SELECT round(avg(4 * pow(coalesce(n, 0)::DOUBLE / r - 0.5, 2)), 6) AS rho FROM c LEFT JOIN m USING (i, j)")
def consensus_dispersion(t):
    rows = aggregates.dispersion(_runs(t))
    return rows.select(r6("rho").alias("rho"))


@query(f"WITH {RUNS}, p AS (SELECT (x.cluster = y.cluster) AS s, (u.cluster = v.cluster) AS w FROM runs x JOIN runs y ON x.run = 0 AND y.run = 0 AND x.gene < y.gene JOIN runs u ON u.run = 2 AND u.gene = x.gene JOIN runs v ON v.run = 2 AND v.gene = y.gene) SELECT round(avg(CASE WHEN s = w THEN 1.0 ELSE 0.0 END), 6) AS rand FROM p")
def rand_index(t):
    runs = _runs(t)
    rows = aggregates.rand_index(runs.filter("run = 0"), runs.filter("run = 2"))
    return rows.select(r6("rand").alias("rand"))


@query(f"WITH {RUNS}, c AS (SELECT x.run AS a, y.run AS b, x.cluster AS p, y.cluster AS q, count(*)::DOUBLE AS n FROM runs x JOIN runs y USING (gene) WHERE x.run < y.run GROUP BY ALL), "
       "s AS (SELECT a, b, sum(n * n) AS cc, sum(n) AS t FROM c GROUP BY 1, 2), r AS (SELECT a, b, sum(n * n) AS rr FROM (SELECT a, b, p, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1, 2), k AS (SELECT a, b, sum(n * n) AS kk FROM (SELECT a, b, q, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1, 2) "
       "SELECT a, b, round((t * (t - 1) / 2 + cc - (rr + kk) / 2) / (t * (t - 1) / 2), 6) AS rand FROM s JOIN r USING (a, b) JOIN k USING (a, b)")
def run_pairs_rand(t):
    rows = aggregates.run_pairs_rand(_runs(t))
    return rows.select("a", "b", r6("rand").alias("rand"))


# -- windows and ranks ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS avg_rank FROM part")
def average_ranks(t):
    return stats.average_ranks(t.read("part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("""WITH r AS (SELECT p_type = 'PROMO' AS side, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS k FROM part),
s AS (SELECT count(*) FILTER (side)::DOUBLE AS n1, count(*) FILTER (NOT side)::DOUBLE AS n2, sum(k) FILTER (side) AS r1 FROM r),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::BIGINT AS c FROM part GROUP BY p_size))
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(r1 - n1 * (n1 + 1) / 2, 4) AS u1,
  round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, t""")
def mwu_u_z(t):
    rows = stats.mann_whitney(t.read("part").select("p_size", (F.col("p_type") == "PROMO").alias("side")), "p_size", "side")
    return rows.select("n1", "n2", F.round("u1", 4).alias("u1"), r6("z").alias("z"))


@query(pipeline_sql.ORACLES["mwu_p"])
def mwu_p(t):
    rows = t.read("part").select("p_size", (F.col("p_type") == "PROMO").alias("side"))
    both = [stats.mann_whitney(rows, "p_size", "side", alternative=a).select(F.lit(a).alias("alternative"), r6("p").alias("p")) for a in ("greater", "less")]
    return both[0].unionByName(both[1])


@query(sql("known", "expression") + ", v AS (SELECT gene, sum(value) AS value FROM expression GROUP BY 1) SELECT gene, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, gene) AS k FROM v) WHERE k <= (SELECT count(*) FROM known)")
def topn_by_size(t):
    rows = t.expression().groupBy("gene").agg(F.sum("value").alias("value"))
    return sets.top_n(rows, t.known().agg(F.count("*").alias("n")), "value")


@query("SELECT l_partkey AS gene, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, gene LIMIT 10")
def top10(t):
    return t.read("lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene").limit(10)


@query("SELECT p_partkey AS gene FROM part WHERE p_retailprice <= (SELECT quantile_cont(p_retailprice, 0.05) FROM part) OR p_retailprice >= (SELECT quantile_cont(p_retailprice, 0.95) FROM part)")
def percentile_cut(t):
    cut = stats.quantiles(t.read("part"), "p_retailprice", [0.05, 0.95]).select(F.col("quantiles").alias("c"))
    return t.read("part").crossJoin(F.broadcast(cut)).filter((F.col("p_retailprice") <= F.col("c")[0]) | (F.col("p_retailprice") >= F.col("c")[1])).select(F.col("p_partkey").alias("gene"))  # one row


# -- vectors ---------------------------------------------------------------------------------------------------


SUM = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: {}))"
DOTS = "list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec))"
PAIRS = " FROM vectors a JOIN vectors b ON a.gene < b.gene WHERE a.label < 2 AND b.label < 2"


def _pairs(t, distance):
    return movement.pairwise(t.vectors().filter("label < 2"), distance, places=5)


@query(sql("vectors") + f" SELECT a.gene AS i, b.gene AS j, round(sqrt({SUM.format('(p[1] - p[2]) * (p[1] - p[2])')}), 5) AS dist" + PAIRS)
def pairwise_euclid(t):
    return _pairs(t, vectors.euclidean)


@query(sql("vectors") + f" SELECT a.gene AS i, b.gene AS j, round({SUM.format('abs(p[1] - p[2])')}, 5) AS dist" + PAIRS)
def pairwise_manhattan(t):
    return _pairs(t, vectors.manhattan)


@query(sql("vectors") + f" SELECT a.gene AS i, b.gene AS j, round(1 - {DOTS}, 5) AS dist" + PAIRS)
def pairwise_cosine(t):
    return _pairs(t, vectors.cosine_distance)


@query(sql("vectors") + f" SELECT a.gene AS i, b.gene AS j, round(acos(least(greatest({DOTS}, -1.0), 1.0)) / pi(), 5) AS dist" + PAIRS)
def pairwise_angular(t):
    return _pairs(t, vectors.angular_distance)


@query(sql("vectors") + f" SELECT a.gene AS i, b.gene AS j, round(sqrt((1 - {DOTS}) / 2), 5) AS dist" + PAIRS)
def pairwise_half_chord(t):
    return _pairs(t, vectors.half_chord)


@query(sql("vectors") + ", d AS (SELECT a.gene, b.gene AS nearest, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM vectors a, vectors b WHERE a.label <> 0 AND b.label = 0) "
       "SELECT gene, round(dist, 5) AS dist, nearest FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY dist, nearest) AS k FROM d) WHERE k = 1")
def nearest_neighbor(t):
    v = t.vectors()
    targets = v.filter("label = 0").select(F.col("gene").alias("target"), F.col("vec").alias("t_vec"))
    return relational.nearest_euclidean(v.filter("label <> 0"), targets).select("gene", F.round("dist", 5).alias("dist"), "nearest")


@query("""WITH v AS (SELECT p_partkey AS gene, p_size::DOUBLE AS x, p_retailprice AS y, p_type = 'PROMO' AS known FROM part),
d AS (SELECT a.gene, b.gene AS nearest, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM v a, v b WHERE NOT a.known AND b.known)
SELECT gene, round(min(dist), 5) AS dist, arg_min(nearest, {dist: dist, nearest: nearest}) AS nearest FROM d GROUP BY gene""")
def nearest_known_part(t):
    v = t.read("part").select(F.col("p_partkey").alias("gene"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("vec"), "p_type")
    targets = v.filter("p_type = 'PROMO'").select(F.col("gene").alias("target"), F.col("vec").alias("t_vec"))
    return relational.nearest_euclidean(v.filter("p_type <> 'PROMO'"), targets).select("gene", F.round("dist", 5).alias("dist"), "nearest")


@query(sql("vectors") + ", d AS (SELECT list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS s FROM vectors a, vectors b) SELECT round(sqrt(sum(s)), 3) AS norm FROM d")
def distance_norm(t):
    return movement.distance_norm(t.vectors()).select(F.round("norm", 3).alias("norm"))


@query("""WITH a AS (SELECT vec_id AS gene, embedding[1:32]::DOUBLE[] AS vec FROM embeddings), b AS (SELECT vec_id AS gene, embedding[33:64]::DOUBLE[] AS vec FROM embeddings),
d AS (SELECT x.gene AS i, y.gene AS j, sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM a x, a y),
e AS (SELECT x.gene AS i, y.gene AS j, sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM b x, b y),
n AS (SELECT (SELECT sqrt(sum(d * d)) FROM d) AS n1, (SELECT sqrt(sum(d * d)) FROM e) AS n2)
SELECT i AS gene, round(10000 * sqrt(sum(pow(d.d / n1 - e.d / n2, 2))), 3) AS moved FROM d JOIN e USING (i, j), n GROUP BY i""")
def movement_ranking(t):
    v = t.vectors()
    first, second = v.select("gene", F.slice("vec", 1, 32).alias("vec")), v.select("gene", F.slice("vec", 33, 32).alias("vec"))
    return movement.movement(first, second).select("gene", F.round(F.col("moved") * 10000, 3).alias("moved"))


@query("SELECT vec_id AS gene, list_position(embedding, list_max(embedding)) - 1 AS cluster FROM embeddings")
def argmax_hard(t):
    return t.vectors().select("gene", vectors.hard_cluster(F.col("vec")).cast("int").alias("cluster"))


@query("WITH v AS (SELECT vec_id AS gene, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS vec FROM embeddings), e AS (SELECT gene, unnest(range(len(vec)))::INTEGER AS cluster, unnest(vec) / list_sum(vec) AS share FROM v) SELECT gene, cluster, round(share, 6) AS share FROM e WHERE share >= 0.04")
def soft_share(t):
    v = t.vectors().select("gene", F.transform("vec", lambda x: F.abs(x.cast("double"))).alias("vec"))
    return cluster.soft_clusters(v, 0.04).select("gene", "cluster", r6("share").alias("share"))


@query("WITH v AS (SELECT vec_id AS gene, embedding::DOUBLE[] AS vec FROM embeddings), x AS (SELECT gene, list_transform(vec, lambda q: exp(q - list_max(vec))) AS e FROM v), s AS (SELECT gene, unnest(range(len(e)))::INTEGER AS cluster, unnest(e) / list_sum(e) AS share FROM x) SELECT gene, cluster, round(share, 6) AS share FROM s WHERE share >= 0.02")
def softmax_share(t):
    return cluster.soft_clusters(t.vectors(), 0.02, softmaxed=True).select("gene", "cluster", r6("share").alias("share"))


# -- graphs ------------------------------------------------------------------------------------------------------


@query(sql("edges", "both") + " SELECT src AS gene, count(*) AS degree FROM both_ways GROUP BY 1")
def degree(t):
    return graph.degrees(t.edges())


@query(sql("edges", "both") + ", n AS (SELECT count(DISTINCT src)::DOUBLE AS n FROM both_ways), e AS (SELECT count(*) AS e FROM edges) SELECT n::BIGINT AS nodes, e AS edges, round(2.0 * e / (n * (n - 1)), 9) AS density FROM n, e")
def graph_density(t):
    return graph.density(t.edges()).select("nodes", "edges", F.round("density", 9).alias("density"))


@query("WITH RECURSIVE edges AS (SELECT DISTINCT p_partkey AS src, 1000000000 + p_size * 100 + floor(p_retailprice)::BIGINT % 10 AS dst FROM part), both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), "
       "w AS (SELECT 1::BIGINT AS gene, 0 AS d UNION SELECT dst, d + 1 FROM w JOIN both_ways ON src = gene WHERE d < 12) SELECT gene, min(d) AS d FROM w GROUP BY gene HAVING min(d) > 0")
def bfs_lengths(t):
    links = t.read("part").select(F.col("p_partkey").alias("src"), (F.lit(1_000_000_000) + F.col("p_size") * 100 + F.floor("p_retailprice").cast("long") % 10).alias("dst"))
    return graph.path_lengths(links, 1)


@query(sql("together", "known") + f""", b AS (SELECT src, dst FROM together UNION ALL SELECT dst, src FROM together), nodes AS (SELECT DISTINCT src AS gene FROM b), hub AS (SELECT src FROM b GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
f AS (SELECT DISTINCT dst AS gene FROM b WHERE src = (SELECT src FROM hub)), c AS (SELECT (SELECT count(*) FROM nodes) AS m, (SELECT count(*) FROM f) AS k, (SELECT count(*) FROM nodes WHERE gene IN (SELECT gene FROM known)) AS n, (SELECT count(*) FROM f WHERE gene IN (SELECT gene FROM known)) AS x)
SELECT m, k, n, x, round((x::DOUBLE / n) / (k::DOUBLE / m), 6) AS fold, {NLOG.format(TAIL)} AS nlog_p FROM c""")
def first_neighbor_enrichment(t):
    rows = pipelines.neighbour_enrichment(t.together(), t.known())
    return rows.select(F.col("M").alias("m"), F.col("K").alias("k"), F.col("N").alias("n"), F.col("X").alias("x"), r6("fold").alias("fold"), nlog("p").alias("nlog_p"))


@query("WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_orderkey // 5 * 5 AS b FROM lineitem WHERE l_orderkey // 5 * 5 <> l_orderkey), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a AS gene, a AS c FROM b UNION SELECT w.gene, b.b FROM w JOIN b ON b.a = w.c) SELECT gene, min(c) AS component FROM w GROUP BY gene")
def components(t):
    links = t.read("lineitem").select(F.col("l_orderkey").alias("src"), (F.floor(F.col("l_orderkey") / 5) * 5).cast("long").alias("dst"))
    return graph.connected_components(links)


@query(sql("together") + ", b AS (SELECT src, dst FROM together UNION ALL SELECT dst, src FROM together), d AS (SELECT src AS gene, count(*) AS degree FROM b GROUP BY 1), t AS (SELECT x.src AS gene, count(*) AS n FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN together e ON e.src = x.dst AND e.dst = y.dst GROUP BY 1) "
       "SELECT d.gene, coalesce(n, 0) AS triangles, round(coalesce(2.0 * coalesce(n, 0) / nullif(degree * (degree - 1), 0), 0), 6) AS coefficient FROM d LEFT JOIN t USING (gene)")
def clustering_coef(t):
    return graph.clustering_coefficients(t.together()).select("gene", "triangles", r6("coefficient").alias("coefficient"))


@query(sql("together") + ", b AS (SELECT src, dst FROM together UNION ALL SELECT dst, src FROM together), d AS (SELECT src AS gene, count(*) AS degree FROM b GROUP BY 1), t AS (SELECT x.src AS gene, count(*) AS n FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN together e ON e.src = x.dst AND e.dst = y.dst GROUP BY 1) "
       "SELECT round(avg(coalesce(2.0 * coalesce(n, 0) / nullif(degree * (degree - 1), 0), 0)), 8) AS average FROM d LEFT JOIN t USING (gene)")
def average_clustering(t):
    return graph.average_clustering(t.together()).select(F.round("average", 8).alias("average"))


@query(sql("together") + ", b AS (SELECT src AS i, dst AS j, -1.0::DOUBLE AS v FROM together UNION ALL SELECT dst, src, -1.0 FROM together) SELECT i, j, v FROM b UNION ALL SELECT i, i, count(*)::DOUBLE FROM b GROUP BY i")
def laplacian(t):
    return graph.laplacian(t.together())


NATIONS = "edges AS (SELECT DISTINCT c_nationkey AS src, 100 + s_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND l_linenumber = 1 AND year(l_shipdate) = 1996)"


def _nations(t):
    items = t.read("lineitem").filter("l_returnflag = 'R' AND l_linenumber = 1 AND year(l_shipdate) = 1996")
    rows = items.join(t.read("orders").filter("o_orderpriority = '1-URGENT'"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t.read("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select(F.col("c_nationkey").alias("src"), (F.col("s_nationkey") + 100).alias("dst")).distinct()


@query(f"WITH {NATIONS}, b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), w AS (SELECT src AS i, dst AS j, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS v FROM b), p AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM w x JOIN w y ON y.i = x.j GROUP BY 1, 2), "
       "m AS (SELECT i, j, sum(v) AS v FROM (SELECT * FROM w UNION ALL SELECT * FROM p) GROUP BY 1, 2), s AS (SELECT *, sum(v) OVER (PARTITION BY i) AS r, sum(v) OVER (PARTITION BY j) AS c, sum(v) OVER () AS t FROM m) SELECT i, j, round(ln(v * t / (r * c)), 5) AS v FROM s WHERE ln(v * t / (r * c)) > 0.00001")
def ppmi_2step(t):
    return graph.ppmi(_nations(t), 2).filter("v > 0.00001").select("i", "j", F.round("v", 5).alias("v"))


#: Suppliers in their nations, nations in their regions.
PLACES = """WITH edges AS (SELECT s_suppkey AS src, 1000000000 + s_nationkey AS dst FROM supplier UNION SELECT 1000000000 + n_nationkey, 2000000000 + n_regionkey FROM nation),
b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), w AS (SELECT src AS i, dst AS j, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS v FROM b), p1 AS (SELECT * FROM w)"""
STEPS = "".join(f", p{k} AS (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM p{k - 1} x JOIN w y ON y.i = x.j GROUP BY 1, 2)" for k in range(2, 11))


@query(PLACES + STEPS + ", m AS (SELECT i, j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, 11)) + ") GROUP BY 1, 2), "
       "s AS (SELECT *, sum(v) OVER (PARTITION BY i) AS r, sum(v) OVER (PARTITION BY j) AS c, sum(v) OVER () AS t FROM m) SELECT i, j, round(ln(v * t / (r * c)), 5) AS v FROM s WHERE ln(v * t / (r * c)) > 0.00001")
def ppmi_10step(t):
    home = t.read("supplier").select(F.col("s_suppkey").cast("long").alias("src"), (F.col("s_nationkey") + F.lit(1_000_000_000)).cast("long").alias("dst"))
    nations = t.read("nation").select((F.col("n_nationkey") + F.lit(1_000_000_000)).cast("long").alias("src"), (F.col("n_regionkey") + F.lit(2_000_000_000)).cast("long").alias("dst"))
    return graph.ppmi(home.unionAll(nations)).filter("v > 0.00001").select("i", "j", F.round("v", 5).alias("v"))


@query("WITH p AS (SELECT p_size AS i, p_type AS j, count(*)::DOUBLE AS v FROM part GROUP BY 1, 2), s AS (SELECT *, sum(v) OVER (PARTITION BY i) AS r, sum(v) OVER (PARTITION BY j) AS c, sum(v) OVER () AS t FROM p) SELECT i, j, round(ln(v * t / (r * c)), 6) AS v FROM s WHERE ln(v * t / (r * c)) > 0.0000001")
def ppmi_bipartite(t):
    pairs = t.read("part").groupBy(F.col("p_size").alias("i"), F.col("p_type").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return graph.bipartite_ppmi(pairs).filter("v > 0.0000001").select("i", "j", r6("v").alias("v"))


@query(sql("together") + ", f AS (SELECT p_partkey AS gene, p_size / 50.0 AS a, p_retailprice / 1000.0 AS b FROM part) SELECT round(sum(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)), 4) AS trace FROM together JOIN f x ON x.gene = src JOIN f y ON y.gene = dst")
def trace_regulariser(t):
    factors = t.read("part").select(F.col("p_partkey").alias("gene"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 1000.0).alias("vec"))
    return graph.trace_regulariser(t.together(), factors).select(F.round("trace", 4).alias("trace"))


@query(sql("together") + ", a AS (SELECT src AS i, dst AS j FROM together UNION ALL SELECT dst, src FROM together) SELECT a.i AS gene, round(sum(p_size)::DOUBLE, 4) AS c0, round(sum(p_retailprice), 4) AS c1 FROM a JOIN part ON p_partkey = a.j GROUP BY 1")
def sparse_times_factor(t):
    factor = t.read("part").select(F.col("p_partkey").alias("gene"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("vec"))
    return linalg.times_factor(linalg.adjacency(t.together()), factor, 2).select("gene", F.round(F.col("vec")[0], 4).alias("c0"), F.round(F.col("vec")[1], 4).alias("c1"))


@query("SELECT p_partkey AS gene, round(0.5 * p_size - 2 * p_retailprice / 1000, 6) AS c0, round(0.25 * p_size + p_retailprice / 1000, 6) AS c1, round(p_retailprice / 1000, 6) AS c2 FROM part")
def p7_embedding(t):
    import numpy as np

    factor = t.read("part").select(F.col("p_partkey").alias("gene"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000).alias("vec"))
    middle = np.array([[0.5, 0.25, 0.0], [-2.0, 1.0, 1.0]])
    return pipelines.projected(factor, middle).select("gene", *[F.round(F.col("vec")[k], 6).alias(f"c{k}") for k in range(3)])


@query(f"WITH {NATIONS}, a AS (SELECT src AS i, dst AS j, src + dst AS v FROM edges UNION ALL SELECT dst, src, src - dst FROM edges) SELECT x.i, y.j, sum(x.v * y.v)::BIGINT AS v FROM a x JOIN a y ON y.i = x.j GROUP BY 1, 2")
def sparse_square(t):
    links = _nations(t)
    matrix = links.select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("src") + F.col("dst")).alias("v")).unionAll(links.select("dst", "src", F.col("src") - F.col("dst")))
    return linalg.sparse_product(matrix, matrix).select("i", "j", F.col("v").cast("long").alias("v"))


# -- folds and permutations --------------------------------------------------------------------------------------


FOLDS = "SELECT gene, floor((row_number() OVER (ORDER BY r, gene) - 1) / (floor(count(*) OVER () / 5) + 1))::INTEGER AS fold FROM (SELECT gene, (((gene + 3) * 48271 % 2147483647) * 69621) % 2147483647 AS r FROM known)"


@query(sql("known") + f" {FOLDS}")
def cv_folds(t):
    return resample.folds(t.known(), 5, seed=3).select("gene", "fold")


@query(sql("known", "universe", "annotations") + f", f AS ({FOLDS}), p AS (SELECT DISTINCT gene FROM annotations WHERE term < 5), s AS (SELECT fold, count(*) AS n_test, count(*) FILTER (gene IN (SELECT gene FROM p)) AS hit FROM f GROUP BY fold), "
       "u AS (SELECT count(*) AS n, count(*) FILTER (gene IN (SELECT gene FROM p)) AS h FROM universe) SELECT fold, n_test, hit, round(hit::DOUBLE / n_test, 6) AS share, round(coalesce((hit::DOUBLE / n_test) / nullif((h - hit)::DOUBLE / (n - n_test), 0), 0), 6) AS ratio FROM s, u")
def cv_fold_ratio(t):
    predicted = t.annotations().filter("term < 5").select("gene")
    rows = resample.fold_ratios(resample.folds(t.known(), 5, seed=3), t.universe(), predicted)
    return rows.select("fold", "n_test", "hit", r6("share").alias("share"), r6("ratio").alias("ratio"))


@query(sql("conditions") + ", n AS (SELECT DISTINCT name AS fold FROM conditions WHERE name IN ('A', 'N', 'R')) SELECT fold, CASE WHEN fold = name THEN 'test' ELSE 'train' END AS role, gene FROM conditions, n")
def leave_one_out(t):
    return sets.leave_one_out(t.conditions(), ["A", "N", "R"])


@query()
def permutation_p(t):
    pools = {r["name"]: r["count"] for r in t.stages().groupBy("name").count().collect()}  # one row a stage
    shared = sets.in_all(t.stages()).count()
    names = sorted(pools)
    # Each stage draws a third of its pool; compared with the count that chance gives.
    return resample.permutation_test([pools[n] for n in names], [max(1, pools[n] // 3) for n in names], shared, max(1, shared // 3 ** len(names)), 10_000, 7, t.spark)


# -- evidence ----------------------------------------------------------------------------------------------------


@query(sql("universe", "evidence", "annotations") + f""", p AS (SELECT DISTINCT gene FROM annotations WHERE term < 8), e AS (SELECT gene FROM evidence WHERE pubmed > 0 OR source <> ''),
c AS (SELECT count(*) AS m, count(*) FILTER (gene IN (SELECT gene FROM e)) AS k, count(*) FILTER (gene IN (SELECT gene FROM p)) AS n, count(*) FILTER (gene IN (SELECT gene FROM e) AND gene IN (SELECT gene FROM p)) AS x FROM universe)
SELECT m, k, n, x, round((x::DOUBLE / n) / (k::DOUBLE / m), 6) AS fold, CASE WHEN (x::DOUBLE / n) / (k::DOUBLE / m) >= 1 THEN {NLOG.format(TAIL)} END AS nlog_p FROM c""")
def evidence_enrichment(t):
    rows = enrichment.evidence_enrichment(t.universe(), t.evidence(), t.annotations().filter("term < 8").select("gene").distinct())
    return rows.select(F.col("M").alias("m"), F.col("K").alias("k"), F.col("N").alias("n"), F.col("X").alias("x"), r6("fold").alias("fold"), F.when(F.col("p").isNotNull(), nlog("p")).alias("nlog_p"))


# -- nested data and events --------------------------------------------------------------------------------------


@query("SELECT event_id, (props->>'k')::INTEGER AS k FROM events")
def json_hierarchy(t):
    return t.read("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(t):
    return windows.tumbling(t.read("events")).withColumn("total", F.round("total", 4))


@query("SELECT date_trunc('hour', ts) - to_hours(k::INTEGER) AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def window_sliding(t):
    return windows.sliding(t.read("events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(t):
    return windows.sessions(t.read("events"))


# -- models without an oracle --------------------------------------------------------------------------------------


@query()
def kmeans(t):
    assigned, _ = cluster.k_means(t.vectors(), 10, n_init=10)
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"))


@query()
def kmedoids(t):
    return cluster.k_medoids(t.vectors(), 10).groupBy("medoid").agg(F.count("*").alias("size"))


@query()
def truncated_svd(t):
    matrix = t.expression().select(F.col("gene").alias("i"), F.col("cell").alias("j"), F.col("value").alias("v"))
    _, values, _ = linalg.truncated_svd(matrix, 5)
    return t.spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(values)], "k int, value double")


@query()
def nmtf_joint(t):
    return pipelines.nmtf_trace(t, joint=True)


@query()
def nmtf_expr(t):
    return pipelines.nmtf_trace(t, joint=False)


for _name, _run in pipelines.QUERIES.items():
    query(pipeline_sql.ORACLES.get(_name))(_run)
