"""Readers of the file shapes the analytics work on; every one returns a canonical DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.relational import canonical_edges, unique_crosswalk


def edge_list(spark: SparkSession, path: str, tab: bool = False) -> DataFrame:
    """src, dst: the undirected simple graph of a file of pairs.

    Fields are cut at blanks, or at tabs only (names may then hold spaces).
    Lines with fewer than two fields and comment lines are left out.
    """
    fields = F.split(F.col("value"), "\t") if tab else F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(fields.alias("f")).filter(F.size("f") >= 2)
    return canonical_edges(rows.select(F.trim(F.col("f")[0]).alias("src"), F.trim(F.col("f")[1]).alias("dst")))


def weighted_triples(spark: SparkSession, path: str, sep: str = "\t", binary: bool = False) -> DataFrame:
    """i, j, v; ``binary`` turns every positive value into 1."""
    rows = spark.read.csv(path, sep=sep, schema="i string, j string, v double")
    return rows.withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0)) if binary else rows


def square_pairs(spark: SparkSession, path: str, sep: str = ";", order: DataFrame | None = None) -> DataFrame:
    """i, j, v = 1 in both directions; with ``order`` (gene) only pairs inside it."""
    rows = spark.read.csv(path, sep=sep, schema="i string, j string").filter("j is not null")
    if order is not None:
        rows = rows.join(order.select(F.col("gene").alias("i")), "i", "left_semi").join(order.select(F.col("gene").alias("j")), "j", "left_semi")
    return rows.select("i", "j").unionAll(rows.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().withColumn("v", F.lit(1.0))


def rectangular_pairs(spark: SparkSession, path: str, sep: str = ";", rows_in: DataFrame | None = None) -> DataFrame:
    """i, j, v = 1 of distinct pairs, with ``rows_in`` (gene) only its rows."""
    rows = spark.read.csv(path, sep=sep, schema="i string, j string").filter("j is not null").distinct()
    if rows_in is not None:
        rows = rows.join(rows_in.select(F.col("gene").alias("i")), "i", "left_semi")
    return rows.select("i", "j", F.lit(1.0).alias("v"))


def similarity_triples(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """i, j, v with numeric term ids written as seven digits after ``GO:``."""
    rows = spark.read.csv(path, sep=sep, schema="i long, j long, v double")
    return rows.select(F.format_string("GO:%07d", "i").alias("i"), F.format_string("GO:%07d", "j").alias("j"), "v")


def crosswalk(spark: SparkSession, path: str, id_at: int = 1, symbol_at: int = 2) -> DataFrame:
    """id, symbol from a tab-separated file with a header; the last line of an id wins."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t"))
    kept = rows.filter(F.size("f") > max(id_at, symbol_at)).select(F.col("f")[id_at].alias("id"), F.col("f")[symbol_at].alias("symbol"), "line")
    first = rows.agg(F.min("line").alias("line"))
    return unique_crosswalk(kept.join(F.broadcast(first), "line", "left_anti"), "line")  # one row


def wide_matrix(spark: SparkSession, path: str, sep: str = ",", keep_zeros: bool = False) -> DataFrame:
    """gene, cell, value in long form from a wide file whose first column is the gene."""
    wide = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    first, *cells = wide.columns
    long = wide.select(F.col(f"`{first}`").alias("gene"), F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(f"`{c}`").cast("double").alias("value")) for c in cells])).alias("c"))
    out = long.select("gene", "c.cell", "c.value")
    return out if keep_zeros else out.filter(F.isnan("value") | (F.col("value") != 0))


def zipped_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """gene, cell, value from zip archives of wide files.

    Spark has no codec for zip; each archive is opened by one task, line by
    line, so an archive is the unit of work and is never held whole.
    """
    def lines(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        with archive.open(name) as raw:
                            rows = csv.reader(io.TextIOWrapper(raw, "utf-8"), delimiter=sep)
                            cells = next(rows, [""])[1:]
                            for row in rows:
                                found = [(c, float(v)) for c, v in zip(cells, row[1:], strict=False) if v and float(v) != 0]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array([row[0]] * len(found), pa.string()), pa.array([c for c, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], ["gene", "cell", "value"]
                                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "gene string, cell string, value double")


def cell_metadata(spark: SparkSession, path: str) -> DataFrame:
    """cell, cond from a quoted file with a header."""
    rows = spark.read.csv(path, header=True, quote='"')
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("cell"), F.col(f"`{rows.columns[1]}`").alias("cond"))


def factor_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """gene, vec from a file with a header and an index column."""
    wide = spark.read.csv(path, sep=sep, header=True)
    first, *columns = wide.columns
    return wide.select(F.col(f"`{first}`").alias("gene"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("vec"))


def gene_list(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """gene: one name a line; with ``header`` the line with that text is left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("gene")).filter("gene <> ''")
    return rows.filter(F.col("gene") != header) if header else rows


def annotation_list(spark: SparkSession, path: str, walk: DataFrame | None = None, universe: DataFrame | None = None, tab: bool = False) -> DataFrame:
    """gene, term: ids translated (unknown ones dropped), inside the universe, terms of two genes or more."""
    from sparkloom.operators.enrichment import usable_annotations
    from sparkloom.operators.relational import translated

    fields = F.split("value", "\t") if tab else F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") >= 2).select(F.trim(F.col("f")[0]).alias("gene"), F.trim(F.col("f")[1]).alias("term"))
    return usable_annotations(translated(rows, "gene", walk, "drop") if walk is not None else rows, universe)


def pathway_names(spark: SparkSession, path: str) -> DataFrame:
    """term, name from lines like ``path:xyz00010<tab>Name - Homo sapiens (human)``."""
    rows = spark.read.csv(path, sep="\t", schema="id string, title string")
    return rows.select(F.element_at(F.split("id", ":"), -1).alias("term"), F.regexp_replace(F.substring_index("title", "Homo", 1), r"[\s-]+$", "").alias("name"))


def id_names(spark: SparkSession, path: str) -> DataFrame:
    """id, name of a tab-separated file without a header; further columns are left out."""
    return spark.read.csv(path, sep="\t", schema="id string, name string")


def pathway_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """grp, subgroup, term, name of the leaves marked PATH in a nested JSON file."""
    leaf = "struct<name:string>"
    schema = f"name string, children array<struct<name:string,children:array<struct<name:string,children:array<{leaf}>>>>>"
    top = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("children").alias("a"))
    low = top.select("a.name", F.explode("a.children").alias("b")).select(F.col("name").alias("grp"), F.col("b.name").alias("subgroup"), F.explode("b.children").alias("c"))
    title = F.col("c.name")
    return low.filter(title.contains("PATH")).select(
        "grp", "subgroup", F.regexp_extract(title, r"\[PATH:([^\]]+)\]", 1).alias("term"), F.trim(F.regexp_extract(title, r"^\S+\s+(.*?)\s*\[PATH", 1)).alias("name")
    )


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """id, name, parents of the term stanzas of an OBO file."""
    stanzas = spark.read.text(path, lineSep="\n\n").filter(F.col("value").contains("[Term]"))
    return stanzas.select(
        F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1).alias("id"), F.regexp_extract("value", r"(?m)^name:\s*(.*)$", 1).alias("name"),
        F.regexp_extract_all("value", F.lit(r"(?m)^is_a:\s*(\S+)"), F.lit(1)).alias("parents"),
    )


def run_statistics(spark: SparkSession, pattern: str) -> DataFrame:
    """nets, k1, k2, rho_g1, rho_g2 of many small tab-separated files with a header."""
    return spark.read.csv(pattern, sep="\t", header=True, schema="nets string, k1 int, k2 int, rho_g1 double, rho_g2 double")


def keyed_by_path(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Adds columns taken from the path of each row's file by a regular expression's groups."""
    return rows.select("*", *[F.regexp_extract(F.input_file_name(), pattern, k + 1).alias(n) for k, n in enumerate(names)])


def numbered(genes: DataFrame) -> DataFrame:
    """gene, idx from 0 in sorted order; counts by range bucket, so no task sorts everything."""
    marked = genes.select("gene").distinct().repartitionByRange("gene").withColumn("part", F.spark_partition_id())
    from sparkloom.session import materialize

    marked = materialize(marked, "numbered")  # fixes the partition numbers
    counts = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = Window.partitionBy("part").orderBy("gene")
    return marked.join(F.broadcast(based), "part").select("gene", (F.col("base") + F.row_number().over(place) - 1).alias("idx"))
