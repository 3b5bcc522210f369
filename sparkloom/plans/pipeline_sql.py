"""SQL for the pipeline's compositions, on the driver's tables."""

from __future__ import annotations

from sparkloom.plans.bindings import sql

#: Upper tail of the hypergeometric distribution.
TAIL = """least(1.0, list_sum(list_transform(range(x::BIGINT, least(k, n)::BIGINT + 1), lambda i:
  exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(m - k + 1) - lgamma(n - i + 1) - lgamma(m - k - n + i + 1)
      - lgamma(m + 1) + lgamma(n + 1) + lgamma(m - n + 1)))))"""


def normal_tail(z: str) -> str:
    """P(Z > z) by the series z^(2k+1) / (2k+1)!!, to about 1e-15; 0 or 1 from 8 on."""
    half = f"""greatest(0.0, 0.5 - exp(-{z} * {z} / 2) / 2.5066282746310002 * list_sum(list_transform(range(0, 200), lambda k:
      exp((2 * k + 1) * ln(greatest(abs({z}), 1e-30)) - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1)))))"""
    half = f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE {half} END"
    return f"CASE WHEN {z} >= 0 THEN {half} WHEN {z} < 0 THEN 1 - {half} END"


def rank_test(rows: str, alternative: str = "greater") -> str:
    """n1, n2, u1, z, p of ``rows`` (value, side), with ties and the correction of a half; no exact tails."""
    u = "u1" if alternative == "greater" else "n1 * n2 - u1"
    return f"""r AS (SELECT side, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM {rows}),
s AS (SELECT count(*) FILTER (side)::DOUBLE AS n1, count(*) FILTER (NOT side)::DOUBLE AS n2, sum(k) FILTER (side) AS r1 FROM r),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::BIGINT AS c FROM {rows} GROUP BY value)),
u AS (SELECT n1, n2, ties, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s, t),
z AS (SELECT n1, n2, u1, ({u} - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM u),
ranked AS (SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(u1, 4) AS u1, round(z, 6) AS z, round({normal_tail("z")}, 6) AS p FROM z)"""


def rank_tests(rows: str) -> str:
    """``rank_test`` for each name of ``rows`` (name, value, side)."""
    return f"""r AS (SELECT name, side, rank() OVER (PARTITION BY name ORDER BY value) + (count(*) OVER (PARTITION BY name, value) - 1) / 2.0 AS k FROM {rows}),
s AS (SELECT name, count(*) FILTER (side)::DOUBLE AS n1, count(*) FILTER (NOT side)::DOUBLE AS n2, sum(k) FILTER (side) AS r1 FROM r GROUP BY name),
t AS (SELECT name, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT name, value, count(*)::BIGINT AS c FROM {rows} GROUP BY name, value) GROUP BY name),
u AS (SELECT name, n1, n2, ties, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s JOIN t USING (name)),
z AS (SELECT name, n1, n2, u1, (u1 - n1 * n2 / 2 - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM u),
ranked AS (SELECT name, n1::BIGINT AS n1, n2::BIGINT AS n2, round(u1, 4) AS u1, round(z, 6) AS z, round({normal_tail("z")}, 6) AS p FROM z)"""


def enriched(alpha: float) -> str:
    """pv (all tests) and en (the adjusted ones) by run, from cl (run, cluster, gene) and kn (run, gene)."""
    return f"""mk AS (SELECT DISTINCT cl.run, cl.cluster, cl.gene, kn.gene IS NOT NULL AS inside FROM cl LEFT JOIN (SELECT DISTINCT run, gene FROM kn) kn ON kn.run = cl.run AND kn.gene = cl.gene),
ev AS (SELECT run, count(DISTINCT gene) AS m, count(DISTINCT CASE WHEN inside THEN gene END) AS k FROM mk GROUP BY run),
ct AS (SELECT mk.run, cluster, any_value(m) AS m, any_value(k) AS k, count(*) AS n, count(*) FILTER (inside) AS x FROM mk JOIN ev USING (run) GROUP BY mk.run, cluster),
pv AS (SELECT *, coalesce((x::DOUBLE / n) / nullif(k::DOUBLE / m, 0), 0) AS fold, {TAIL} AS p FROM ct),
rk AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p, cluster) AS i, count(*) OVER (PARTITION BY run) AS tests FROM pv WHERE fold >= 1 AND p <= {alpha}),
ad AS (SELECT *, least(1.0, min(p * tests / i) OVER (PARTITION BY run ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM rk),
en AS (SELECT * FROM ad WHERE p_adj <= {alpha})"""


def terms(clusters: str = "clusters") -> str:
    """a: (cluster, term) tests with p and p_adj, from clusters and annotations."""
    return f"""known_genes AS (SELECT DISTINCT cluster, gene FROM {clusters} WHERE gene IN (SELECT gene FROM annotations)),
h AS (SELECT cluster, term, count(*) AS x FROM known_genes JOIN annotations USING (gene) GROUP BY ALL),
q AS (SELECT cluster, count(*) AS n FROM known_genes GROUP BY cluster),
g AS (SELECT term, count(DISTINCT gene) AS k FROM known_genes JOIN annotations USING (gene) GROUP BY term),
c AS (SELECT h.cluster, h.term, (SELECT count(DISTINCT gene) FROM known_genes) AS m, k, n, x FROM h JOIN q USING (cluster) JOIN g USING (term)),
p AS (SELECT *, {TAIL} AS p FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY p, cluster, term) AS i, count(*) OVER () AS tests FROM p),
a AS (SELECT *, least(1.0, min(p * tests / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM o)"""


def folded(seed: int) -> str:
    """f: fold and gene of the known genes in five folds."""
    return (
        "f AS (SELECT gene, floor((row_number() OVER (ORDER BY r, gene) - 1) / (floor(count(*) OVER () / 5) + 1))::INTEGER AS fold "
        f"FROM (SELECT gene, (((gene + {seed}) * 48271 % 2147483647) * 69621) % 2147483647 AS r FROM known))"
    )


#: gene, moved between the two halves of each vector.
MOVED = """first AS (SELECT vec_id AS gene, embedding[1:32]::DOUBLE[] AS vec FROM embeddings), second AS (SELECT vec_id AS gene, embedding[33:64]::DOUBLE[] AS vec FROM embeddings),
d AS (SELECT x.gene AS i, y.gene AS j, sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM first x, first y),
e AS (SELECT x.gene AS i, y.gene AS j, sqrt(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM second x, second y),
n AS (SELECT (SELECT sqrt(sum(d * d)) FROM d) AS n1, (SELECT sqrt(sum(d * d)) FROM e) AS n2),
moved AS (SELECT i AS gene, sqrt(sum(pow(d.d / n1 - e.d / n2, 2))) AS moved FROM d JOIN e USING (i, j), n GROUP BY i)"""
PREDICTED = sql("clusters", "known") + f", cl AS (SELECT 0 AS run, * FROM clusters), kn AS (SELECT 0 AS run, gene FROM known), {enriched(0.2)}, initial AS (SELECT DISTINCT gene FROM clusters JOIN en USING (cluster) WHERE gene NOT IN (SELECT gene FROM known))"
STAGED = sql("stages", "known", "evidence") + """, back AS (SELECT DISTINCT year(l_shipdate) AS name, l_partkey AS gene FROM lineitem WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT gene FROM known)),
core AS (SELECT gene FROM back GROUP BY gene HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM back)),
asked AS (SELECT name::VARCHAR AS name, gene FROM back UNION ALL SELECT 'core', gene FROM core)"""
BOTH = "both_ways AS (SELECT src, dst FROM together UNION ALL SELECT dst, src FROM together)"

ORACLES = {
    "p1_condition_networks": sql("together") + """, act AS (SELECT l_partkey AS gene FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3 GROUP BY 1 HAVING sum(l_quantity) <> 0),
ok AS (SELECT gene FROM act JOIN part ON p_partkey = gene WHERE p_type <> 'PROMO'), own AS (SELECT * FROM together WHERE src IN (SELECT gene FROM ok) AND dst IN (SELECT gene FROM ok)),
n AS (SELECT count(DISTINCT gene) AS nodes FROM (SELECT src AS gene FROM own UNION ALL SELECT dst FROM own)), e AS (SELECT count(*) AS edges FROM own)
SELECT nodes, edges, round(coalesce(2.0 * edges / nullif(nodes::DOUBLE * (nodes - 1), 0), 0), 9) AS density FROM n, e""",
    "p4_best_run": sql("known") + f""", runs AS (SELECT unnest([0, 1, 2]) AS run), cl AS (SELECT run, (p_size * (run + 1) + run) % 40 AS cluster, p_partkey AS gene FROM part, runs), kn AS (SELECT run, gene FROM known, runs), {enriched(0.2)},
su AS (SELECT pv.run, count(en.p_adj)::DOUBLE / count(*) AS share_clusters, sum(CASE WHEN en.p_adj IS NOT NULL THEN pv.x ELSE 0 END)::DOUBLE / max(pv.k) AS share_genes FROM pv LEFT JOIN en USING (run, cluster) GROUP BY pv.run)
SELECT run::INTEGER AS run, round(share_clusters, 6) AS share_clusters, round(share_genes, 6) AS share_genes FROM su ORDER BY su.share_genes DESC, run LIMIT 1""",
    "p5_annotation_profile": sql("clusters", "annotations") + f""", {terms()}, w AS (SELECT cluster, avg(CASE WHEN p_adj <= 0.9 THEN 1.0 ELSE 0.0 END) AS share FROM a GROUP BY cluster)
SELECT round(quantile_cont(share, 0.1587), 6) AS p0, round(quantile_cont(share, 0.5), 6) AS p1, round(quantile_cont(share, 0.8413), 6) AS p2 FROM w""",
    "p6_initial_predictions": PREDICTED + " SELECT gene FROM initial",
    "p8_stage_movement": f"""WITH {MOVED}, v AS (SELECT gene, moved, label < 3 AS predicted FROM moved JOIN embeddings ON vec_id = gene), b AS (SELECT min(moved) AS lo, max(moved) AS hi FROM v),
h AS (SELECT predicted, CASE WHEN hi = lo THEN 0 ELSE least(floor((moved - lo) / ((hi - lo) / 50)), 49) END::INTEGER AS bin, count(*) AS n FROM v, b GROUP BY 1, 2)
SELECT predicted, bin, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY predicted), 6) AS height FROM h""",
    "p8_stage_test": f"WITH {MOVED}, v AS (SELECT moved AS value, label < 3 AS side FROM moved JOIN embeddings ON vec_id = gene), {rank_test('v')} SELECT * FROM ranked",
    "p9_core_predictions": """WITH g AS (SELECT year(l_shipdate) AS name, l_partkey AS gene, sum(l_quantity) AS moved FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) < 1999 GROUP BY 1, 2)
SELECT gene, round(avg(moved), 6) AS mean_moved FROM g GROUP BY gene HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM g)""",
    "p10_literature": PREDICTED.replace("WITH ", f"WITH {sql('evidence').removeprefix('WITH ')}, ", 1) + f", v AS (SELECT pubmed AS value, gene IN (SELECT gene FROM initial) AS side FROM evidence), {rank_test('v')} SELECT * FROM ranked",
    "p10_stage_validation": STAGED + f""", others AS (SELECT name::VARCHAR AS name, gene FROM stages UNION ALL SELECT 'core', gene FROM stages GROUP BY gene HAVING count(DISTINCT name) = (SELECT count(DISTINCT name) FROM stages)),
every AS (SELECT name, gene, bool_or(side) AS side FROM (SELECT name, gene, false AS side FROM others WHERE gene NOT IN (SELECT gene FROM known) UNION ALL SELECT name, gene, true FROM asked) GROUP BY ALL),
v AS (SELECT name, pubmed AS value, side, pubmed > 0 OR source <> '' AS backed FROM every JOIN evidence USING (gene) WHERE name IN (SELECT name FROM asked)), {rank_tests('v')},
c AS (SELECT name, count(*) AS m, count(*) FILTER (backed) AS k, count(*) FILTER (side) AS n, count(*) FILTER (backed AND side) AS x FROM v GROUP BY name),
f AS (SELECT *, coalesce((x::DOUBLE / n) / nullif(k::DOUBLE / m, 0), 0) AS fold FROM c)
SELECT name, m AS M, k AS K, n AS N, x AS X, round(fold, 6) AS fold, CASE WHEN fold >= 1 THEN round({TAIL}, 6) END AS p_evidence, n1, n2, u1, ranked.z, ranked.p FROM f JOIN ranked USING (name)""",
    "p10_core_venn": STAGED + """, listed AS (SELECT gene FROM part JOIN evidence ON gene = p_partkey WHERE p_size <= 10)
SELECT count(*) FILTER (gene NOT IN (SELECT gene FROM core)) AS only_listed, count(*) FILTER (gene IN (SELECT gene FROM core)) AS both, (SELECT count(*) FROM core WHERE gene NOT IN (SELECT gene FROM listed)) AS only_core FROM listed""",
    "p11_path_profile": sql("together", "known", recursive=True) + f""", {BOTH}, hub AS (SELECT src FROM both_ways GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
w AS (SELECT src AS gene, 0 AS d FROM hub UNION SELECT dst, d + 1 FROM w JOIN both_ways ON src = gene WHERE d < 30), m AS (SELECT gene, min(d) AS d FROM w GROUP BY gene HAVING min(d) > 0),
c AS (SELECT gene IN (SELECT gene FROM known) AS predicted, d, count(*) AS n FROM m GROUP BY 1, 2) SELECT predicted, d, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY predicted), 6) AS share FROM c""",
    "p12_shared_terms": sql("annotations") + f""", named AS (SELECT p_type AS cluster, p_partkey AS gene FROM part WHERE p_type IN ('PROMO', 'ECONOMY')), {terms('named')}
SELECT term, CASE WHEN count(DISTINCT cluster) = 2 THEN 'shared' ELSE 'only ' || min(cluster) END AS kind FROM a WHERE p_adj <= 1 GROUP BY term""",
    "p13_rank_selection": """WITH s AS (SELECT p_brand AS nets, p_size % 5 AS k1, p_size % 3 AS k2, (avg(p_retailprice) / 2000 + avg(p_size) / 50) / 2 AS rho FROM part GROUP BY 1, 2, 3)
SELECT nets, k1, k2, round(rho, 6) AS rho, row_number() OVER (PARTITION BY nets ORDER BY rho DESC, k1, k2) AS rank FROM s""",
    "p14_nearest_baseline": sql("vectors") + """, d AS (SELECT a.gene, b.gene AS nearest, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist FROM vectors a, vectors b WHERE a.label <> 0 AND b.label = 0),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY dist, nearest) AS k FROM d) WHERE k = 1)
SELECT gene, round(dist, 5) AS dist, nearest FROM (SELECT *, row_number() OVER (ORDER BY dist, gene) AS i FROM m) WHERE i <= (SELECT count(*) FROM vectors WHERE label = 0)""",
    "p15_movement_baseline": f"WITH {MOVED} SELECT gene, round(10000 * moved, 3) AS moved FROM moved WHERE moved >= (SELECT quantile_cont(moved, 0.9) FROM moved)",
    "p17_cross_validation": sql("clusters", "known") + f""", {folded(0)}, folds AS (SELECT DISTINCT fold AS run FROM f), cl AS (SELECT run, cluster, gene FROM clusters, folds), kn AS (SELECT run, gene FROM f, folds WHERE fold <> run), {enriched(0.3)},
pr AS (SELECT DISTINCT run, gene FROM cl JOIN en USING (run, cluster) WHERE (run, gene) NOT IN (SELECT (run, gene) FROM kn)),
u AS (SELECT run, (SELECT count(DISTINCT gene) FROM clusters) AS n, (SELECT count(*) FROM pr WHERE pr.run = folds.run) AS h FROM folds),
s AS (SELECT fold, count(*) AS n_test, count(*) FILTER ((fold, gene) IN (SELECT (run, gene) FROM pr)) AS hit FROM f GROUP BY fold)
SELECT fold, n_test, hit, round(hit::DOUBLE / n_test, 6) AS share, round(coalesce((hit::DOUBLE / n_test) / nullif((h - hit)::DOUBLE / (n - n_test), 0), 0), 6) AS ratio FROM s JOIN u ON run = fold""",
    "p18_masked_contribution": sql("clusters", "known", "annotations", "together") + f""", {folded(1)}, {terms()}, folds AS (SELECT DISTINCT fold FROM f),
hit AS (SELECT DISTINCT fold, gene, cluster FROM f JOIN clusters USING (gene) JOIN annotations USING (gene) JOIN a USING (cluster, term) WHERE p_adj <= 0.9),
cut AS (SELECT fold, (SELECT count(*) FROM together) - count(DISTINCT (src, dst)) AS edges FROM folds LEFT JOIN (SELECT fold AS x, src, dst FROM f JOIN together ON gene = src OR gene = dst) ON x = fold GROUP BY fold)
SELECT fold, edges, (SELECT count(*) FROM hit WHERE hit.fold = cut.fold) AS n FROM cut""",
    "mwu_p": "WITH v AS (SELECT p_size AS value, p_type = 'PROMO' AS side FROM part), g AS (WITH " + rank_test("v") + " SELECT 'greater' AS alternative, p FROM ranked), l AS (WITH " + rank_test("v", "less") + " SELECT 'less' AS alternative, p FROM ranked) SELECT * FROM g UNION ALL SELECT * FROM l",
}
