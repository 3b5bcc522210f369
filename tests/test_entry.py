import os

import duckdb
import pytest

import __spark_entry__
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"


def canonical(rows):
    """Rows as text; -0.0 is the 0.0 that it equals."""
    return sorted(tuple(repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


def compare(spark, name, run, oracle):
    df = run(spark, SF)
    columns = sorted(df.columns)
    got = canonical(tuple(r) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    found = con.sql(oracle)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == canonical(tuple(r[k] for k in at) for r in found.fetchall()), name


#: A query of each family; the driver runs all of them.
FAMILIES = ["crosswalk_left_default", "induced_subgraph", "label_full_outer", "venn_regions", "contingency_fold", "term_enrichment", "cluster_enrichment", "histogram50_both", "consensus_dispersion", "average_ranks", "mwu_u_z", "topn_by_size", "nearest_neighbor", "graph_density", "components", "clustering_coef", "cv_folds", "window_session", "p4_best_run", "p17_cross_validation", "p18_masked_contribution", "positional_zip", "submatrix", "pairwise_angular", "sparse_square", "p10_stage_validation", "p10_core_venn", "nearest_known_part", "ppmi_10step"]


@pytest.mark.parametrize("name", FAMILIES)
def test_queries_match_sql(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLES[name])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pairs_of_an_order_are_dealt_by_size(spark, monkeypatch):
    from sparkloom.operators import relational
    from sparkloom.plans import bindings

    monkeypatch.setattr(bindings, "TOGETHER_ROWS", 500)
    t = bindings.Tables(spark, SF)
    tasks = t.read("lineitem").count() // 500
    links = t.together()
    # Before, tasks were merged by the bytes of the items, however many pairs they made.
    assert links.rdd.getNumPartitions() == tasks > 8
    assert relational.canonical_edges(links) is links and relational.canonical_edges(links.filter("src > 5")) is not links
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    assert canonical(tuple(r) for r in links.select("src", "dst").collect()) == canonical(con.sql(bindings.sql("together") + " SELECT src, dst FROM together").fetchall())
