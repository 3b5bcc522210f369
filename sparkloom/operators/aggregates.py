"""Aggregations: percentiles, histograms, entropies, best runs, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.stats import quantiles
from sparkloom.session import materialize

WHISKERS = (0.1587, 0.5, 0.8413)


def percentiles(rows: DataFrame, value: str, shares=WHISKERS, by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as the columns p0, p1, ..."""
    found = quantiles(rows, value, [float(s) for s in shares], by)
    return found.select(*(by or []), *[F.col("quantiles")[k].alias(f"p{k}") for k in range(len(shares))])


def centre_and_spread(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, mean and population standard deviation."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"))


def best_run(rows: DataFrame, by: list[str], value: str, run: str) -> DataFrame:
    """The first run with the largest value in each family."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), run)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def relative_bins(rows: DataFrame, value: str, skip=0) -> DataFrame:
    """Counts by integer value and their share, without the bin ``skip``."""
    counts = rows.filter(F.col(value) != skip).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("_total")).alias("share"))  # one row


def histogram(rows: DataFrame, value: str, bounds: DataFrame | None = None, bins: int = 50, by: list[str] | None = None, scale: str = "count") -> DataFrame:
    """Equal-width bins from 0; the last one holds its right edge.

    ``bounds``: a one-row frame (lo, hi), by default those of all rows. Values
    outside are dropped. ``scale``: count, max (largest bin is 1) or sum.
    """
    keys = list(by or [])
    if bounds is None:
        bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    met = rows.crossJoin(F.broadcast(bounds.select(F.col("lo").cast("double").alias("_lo"), F.col("hi").cast("double").alias("_hi"))))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    x = F.col(value).cast("double")
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((x - F.col("_lo")) / width), F.lit(bins - 1)))
    counts = met.filter((x >= F.col("_lo")) & (x <= F.col("_hi"))).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    if scale == "count":
        return counts
    whole = (F.max if scale == "max" else F.sum)("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counts.withColumn("height", F.col("n") / whole)


def normalised_entropy(labelled: DataFrame) -> DataFrame:
    """cluster, entropy of the terms of each cluster, over ln(number of terms); 0 for at most one term.

    ``labelled`` (cluster, term, n, size): n genes of the cluster have the term, size is the cluster's.
    """
    p = F.col("n") / F.col("size")
    sums = labelled.groupBy("cluster").agg(F.count("*").alias("d"), F.sum(p * F.log(p)).alias("s"))
    return sums.select("cluster", F.when(F.col("d") > 1, -F.col("s") / F.log(F.col("d").cast("double"))).otherwise(0.0).alias("entropy"))


def grid(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """Long to wide; a missing cell is null. Columns come in the order given."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def sorted_grid(rows: DataFrame, row: str, column: str, value: str, columns: list, descending: bool = False) -> DataFrame:
    """The grid with its rows in order of their label and its columns in order of theirs."""
    found = grid(rows, row, column, value, sorted(columns, reverse=descending))
    return found.orderBy(F.desc(row) if descending else F.asc(row))


#: Genes of a piece of a class; two pieces give up to the square of that many pairs.
PIECE = 1024


def comembership(assigned: DataFrame) -> DataFrame:
    """i, j (i < j), runs: in how many runs two genes share a cluster.

    ``assigned`` (run, cluster, gene). The pairs of a cluster are what this
    measure is; the work is the number of its rows, or the sum of squared cluster sizes if genes differ.
    Genes with the same clusters in all runs are a class. Runs are counted
    for classes, and pieces of two classes are spelled out to pairs of genes, which
    are never shuffled.
    """
    placed = assigned.filter("run is not null and cluster is not null and gene is not null")
    held = placed.groupBy("gene").agg(F.sort_array(F.collect_set(F.struct("run", "cluster"))).alias("places"))
    held = materialize(held, "memberships")
    named = materialize(held.join(held.groupBy("places").agg(F.min("gene").alias("class")), "places"), "classes")
    number = F.floor((F.row_number().over(Window.partitionBy("class", "salt").orderBy("gene")) - 1) / PIECE)
    # Large classes are cut at random first, so that no task orders a whole class.
    salted = named.join(named.groupBy("class").agg(F.floor(F.count("*") / (16 * PIECE)).alias("more")), "class").withColumn("salt", F.pmod(F.xxhash64("gene"), F.col("more") + 1))
    pieces = materialize(salted.withColumn("piece", number).groupBy("class", "salt", "piece").agg(F.collect_list("gene").alias("genes")), "pieces")
    one = named.filter(F.col("gene") == F.col("class")).select("class", F.explode("places").alias("place"))
    a, b = one.select(F.col("class").alias("a"), "place"), one.select(F.col("class").alias("b"), "place")
    shared = a.join(b, "place").filter("a <= b").groupBy("a", "b").agg(F.count_distinct("place.run").alias("runs"))
    # Which piece is which is known by class, salt and number; only these are dealt before genes are fetched.
    key = pieces.select("class", F.struct("salt", "piece").alias("at"))
    met = shared.join(key.select(F.col("class").alias("a"), F.col("at").alias("p")), "a").join(key.select(F.col("class").alias("b"), F.col("at").alias("q")), "b").filter("a < b or p <= q")
    spark = assigned.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = met.repartition(tasks, "a", "b", "p", "q")
    side = lambda c, at, name: pieces.select(F.col("class").alias(c), F.struct("salt", "piece").alias(at), F.col("genes").alias(name))
    full = dealt.join(side("a", "p", "_x"), ["a", "p"]).join(side("b", "q", "_y"), ["b", "q"])
    pairs = full.select("runs", ((F.col("a") == F.col("b")) & (F.col("p") == F.col("q"))).alias("same"), F.explode("_x").alias("x"), "_y").select("runs", "same", "x", F.explode("_y").alias("y"))
    return pairs.filter("not same or x < y").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "runs")


def dispersion(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by`` and rho: the mean over ordered pairs of genes of 4 (c - 1/2)^2, c the share of runs together.

    For genes that every run puts into one cluster. No pair of genes is formed:
    the sum of c over pairs is that of squared cluster sizes, and the sum of c^2
    that of squared cells of the contingency tables of all pairs of runs.
    """
    keys = list(by or [])
    rows = assigned.select(*keys, "run", "cluster", "gene").distinct()
    sizes = rows.groupBy(*keys).agg(F.count_distinct("gene").cast("double").alias("g"), F.count_distinct("run").cast("double").alias("r"))
    square = F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))
    once = rows.groupBy(*keys, "run", "cluster").agg(F.count("*").cast("double").alias("n")).groupBy(*keys).agg(square.alias("s1"))
    other = rows.select(*keys, "gene", F.col("run").alias("run_b"), F.col("cluster").alias("cluster_b"))
    cells = rows.join(other, [*keys, "gene"]).groupBy(*keys, "run", "run_b", "cluster", "cluster_b").agg(F.count("*").cast("double").alias("n"))
    twice = cells.groupBy(*keys).agg(square.alias("s2"))
    met = sizes.join(once, keys).join(twice, keys) if keys else sizes.crossJoin(F.broadcast(once)).crossJoin(F.broadcast(twice))  # one row each
    pairs, r = F.col("g") * F.col("g"), F.col("r")
    return met.select(*keys, F.try_divide(pairs + 4 * F.try_divide(F.col("s2"), r * r) - 4 * F.try_divide(F.col("s1"), r), pairs).alias("rho"))


def rand_index(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, rand: the share of pairs that two clusterings treat alike, from their contingency table."""
    cells = a.select("gene", F.col("cluster").alias("x")).join(b.select("gene", F.col("cluster").alias("y")), "gene").groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    rows, columns = cells.groupBy("x").agg(F.sum("n").alias("n")), cells.groupBy("y").agg(F.sum("n").alias("n"))
    squares = lambda df, name: df.agg(F.sum(F.col("n") * F.col("n")).alias(name), *([F.sum("n").alias("all")] if name == "cc" else []))
    one = squares(cells, "cc").crossJoin(squares(rows, "rr")).crossJoin(squares(columns, "kk"))  # one row each
    pairs = F.col("all") * (F.col("all") - 1) / 2
    return one.select(F.try_divide(pairs + F.col("cc") - (F.col("rr") + F.col("kk")) / 2, pairs).alias("rand"))


def run_pairs_rand(assigned: DataFrame) -> DataFrame:
    """a, b (a < b), rand for every two runs, from one contingency aggregation.

    Runs are few (tens to hundreds); genes meet themselves in the other run.
    """
    x = assigned.select(F.col("run").alias("a"), "gene", F.col("cluster").alias("x"))
    y = assigned.select(F.col("run").alias("b"), "gene", F.col("cluster").alias("y"))
    cells = x.join(y, "gene").filter("a < b").groupBy("a", "b", "x", "y").agg(F.count("*").cast("double").alias("n"))
    square = F.sum(F.col("n") * F.col("n"))
    cc = cells.groupBy("a", "b").agg(square.alias("cc"), F.sum("n").alias("all"))
    rr = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(square.alias("rr"))
    kk = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(square.alias("kk"))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    return cc.join(rr, ["a", "b"]).join(kk, ["a", "b"]).select("a", "b", F.try_divide(pairs + F.col("cc") - (F.col("rr") + F.col("kk")) / 2, pairs).alias("rand"))
