import json
import zipfile

from pyspark.sql import functions as F

from sparkloom.sources import readers, writers
from sparkloom.streaming import windows


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_readers(spark, tmp_path):
    assert {tuple(r) for r in readers.edge_list(spark, put(tmp_path, "e", "b a\na  b\n# no\nc c\nx\n")).collect()} == {("a", "b"), ("c", "c")}
    assert {tuple(r) for r in readers.edge_list(spark, put(tmp_path, "t", "a x\tb\n"), tab=True).collect()} == {("a x", "b")}
    walk = readers.crosswalk(spark, put(tmp_path, "g", "#tax\tGeneID\tSymbol\n9\t1\tA\n9\t2\tB\n9\t1\tC\n"))
    assert {tuple(r) for r in walk.collect()} == {("1", "C"), ("2", "B")}
    path = put(tmp_path, "m.csv", "gene,c1,c2\ng1,0,2.5\ng2,1,0\n")
    wanted = {("g1", "c2", 2.5), ("g2", "c1", 1.0)}
    assert {tuple(r) for r in readers.wide_matrix(spark, path).collect()} == wanted
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.write(path, "m.csv")
    assert {tuple(r) for r in readers.zipped_matrix(spark, str(tmp_path / "m.zip")).collect()} == wanted
    assert {tuple(r) for r in readers.cell_metadata(spark, put(tmp_path, "d", '"cell","cond"\n"x","A"\n')).collect()} == {("x", "A")}
    listed = readers.annotation_list(spark, put(tmp_path, "a", "1 t\n2 t\n1 t\n2 u\n3 t\n"), walk)
    assert {tuple(r) for r in listed.collect()} == {("C", "t"), ("B", "t")}
    names = readers.pathway_names(spark, put(tmp_path, "n", "path:hsa1\tGly - Homo sapiens (human)\n"))
    assert [tuple(r) for r in names.collect()] == [("hsa1", "Gly")]
    tree = {"name": "r", "children": [{"name": "G", "children": [{"name": "S", "children": [{"name": "01 Gly [PATH:hsa01]"}, {"name": "02 none"}]}]}]}
    assert [tuple(r) for r in readers.pathway_hierarchy(spark, put(tmp_path, "h.json", json.dumps(tree))).collect()] == [("G", "S", "hsa01", "Gly")]
    terms = readers.ontology(spark, put(tmp_path, "o", "format\n\n[Term]\nid: X:1\nname: one thing\nis_a: X:0 ! root\n\n[Typedef]\nid: q\n"))
    assert [(r["id"], r["name"], r["parents"]) for r in terms.collect()] == [("X:1", "one thing", ["X:0"])]
    assert [tuple(r) for r in readers.similarity_triples(spark, put(tmp_path, "s", "7\t12\t0.5\n")).collect()] == [("GO:0000007", "GO:0000012", 0.5)]
    genes = spark.createDataFrame([(f"g{i}",) for i in range(20)], "gene string")
    assert [r["idx"] for r in readers.numbered(genes).orderBy("gene").collect()] == list(range(20))


def test_writers_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    writers.edge_list(edges, str(tmp_path / "edges"))
    assert {tuple(r) for r in readers.edge_list(spark, str(tmp_path / "edges")).collect()} == {("a", "b"), ("b", "c")}
    factor = spark.createDataFrame([("a", [1.0, 2.0])], "gene string, vec array<double>")
    writers.factor(factor, str(tmp_path / "f"), 2)
    assert [tuple(r) for r in readers.factor_matrix(spark, str(tmp_path / "f")).collect()] == [("a", [1.0, 2.0])]
    matrix = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "c", 0.0)], "i string, j string, v double")
    writers.triples(matrix, str(tmp_path / "x"), square=True)
    assert [tuple(r) for r in readers.weighted_triples(spark, str(tmp_path / "x")).collect()] == [("a", "b", 1.0)]
    writers.partitioned(edges.withColumn("cond", F.lit("A")), str(tmp_path / "p"), ["cond"])
    assert spark.read.parquet(str(tmp_path / "p")).filter("cond = 'A'").count() == 2


def test_streaming_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = windows.stream_tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("daily")) == key(windows.tumbling(events, "1 day"))


def test_other_readers_and_writers(spark, tmp_path):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    pairs = put(tmp_path, "pairs", "a;b\nb;c\nb;a\nd\n")
    assert rows(readers.square_pairs(spark, pairs)) == [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)]
    order = spark.createDataFrame([("a",), ("b",)], "gene string")
    assert rows(readers.square_pairs(spark, pairs, order=order)) == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert rows(readers.rectangular_pairs(spark, pairs, rows_in=order)) == [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)]
    assert rows(readers.id_names(spark, put(tmp_path, "names", "1\tone\tmore\n2\ttwo\n"))) == [("1", "one"), ("2", "two")]
    assert rows(readers.gene_list(spark, put(tmp_path, "genes", "genes\n x \n\ny\n"), "genes")) == [("x",), ("y",)]
    (tmp_path / "A").mkdir()
    put(tmp_path / "A", "run1.tsv", "nets\tk1\tk2\trho1\trho2\nPPI\t2\t3\t0.5\t0.25\n")
    statistics = readers.run_statistics(spark, str(tmp_path / "A" / "*.tsv"))
    assert rows(readers.keyed_by_path(statistics, r"/([^/]+)/run(\d+)", ["cond", "run"])) == [("PPI", 2, 3, 0.5, 0.25, "A", "1")]
    factor = spark.createDataFrame([("g", [1.0, 2.5])], "gene string, vec array<double>").coalesce(1)
    for headers, wanted in ((True, ["\t0\t1", "g\t1.0\t2.5"]), (False, ["g\t1.0\t2.5"])):
        writers.factor(factor, str(tmp_path / f"f{headers}"), 2, headers)
        lines = [r["value"] for r in spark.read.text(str(tmp_path / f"f{headers}")).collect()]
        assert [x.replace('""', "") for x in lines] == wanted
    writers.clusters(spark.createDataFrame([("g", 3)], "gene string, cluster int"), str(tmp_path / "c"))
    writers.lines(order, "gene", str(tmp_path / "l"))
    writers.report(spark.createDataFrame([(1, None)], "n int, what string"), str(tmp_path / "r"))
    writers.delimited(order, str(tmp_path / "d"))
    text = lambda name: sorted(r["value"] for r in spark.read.text(str(tmp_path / name)).collect())
    assert (text("c"), text("l"), text("r")) == (["g\t3"], ["a", "b"], ["n: 1", "what: "])
    assert rows(spark.read.csv(str(tmp_path / "d"), header=True)) == [("a",), ("b",)]
