"""Graph operators on undirected edges (src, dst)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocked
from sparkloom.operators.relational import both_ways, canonical_edges
from sparkloom.session import cut_lineage, materialize


def degrees(edges: DataFrame) -> DataFrame:
    """gene, degree over distinct edges (a loop counts once)."""
    return both_ways(canonical_edges(edges)).groupBy(F.col("src").alias("gene")).agg(F.count("*").alias("degree"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density 2E / (n (n - 1))."""
    simple = canonical_edges(edges)
    nodes = both_ways(simple).agg(F.countDistinct("src").alias("nodes"))
    return nodes.crossJoin(simple.agg(F.count("*").alias("edges"))).select(  # one row each
        "nodes", "edges", F.coalesce(F.try_divide(F.col("edges").cast("double") * 2, F.col("nodes").cast("double") * (F.col("nodes") - 1)), F.lit(0.0)).alias("density")
    )


def neighbours(edges: DataFrame, node) -> DataFrame:
    return both_ways(canonical_edges(edges, keep_loops=False)).filter(F.col("src") == node).select(F.col("dst").alias("gene")).distinct()


def path_lengths(edges: DataFrame, source, max_depth: int | None = None) -> DataFrame:
    """gene, d: fewest edges from the source; the source and what cannot be reached are left out.

    Runs until no new node is found, or to ``max_depth`` if the caller wants a horizon. One join a level: the frontier's neighbours without what has been seen.
    Both are written in the shared folder at each level.
    """
    links = cut_lineage(both_ways(canonical_edges(edges, keep_loops=False)))
    kind = links.schema["src"].dataType
    seen = links.sparkSession.range(1).select(F.lit(source).cast(kind).alias("gene"), F.lit(0).alias("d"))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = links.join(frontier.select(F.col("gene").alias("src")), "src").select(F.col("dst").alias("gene")).distinct()
        frontier = cut_lineage(reached.join(seen, "gene", "left_anti").withColumn("d", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen.filter("d > 0")


def connected_components(edges: DataFrame) -> DataFrame:
    """gene, component (its smallest node): large-star and small-star steps by turns."""
    work = cut_lineage(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        both = work.unionAll(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = cut_lineage(small.filter("u <> v").distinct())
        roots = new.select(F.col("v").alias("u")).distinct()
        if not new.join(roots, "u", "left_semi").limit(1).count() and not new.groupBy("u").count().filter("count > 1").limit(1).count():
            return new.select(F.col("u").alias("gene"), F.col("v").alias("component")).unionAll(new.select(F.col("v").alias("gene"), F.col("v").alias("component")).distinct())
        work = new


def component_sizes(edges: DataFrame) -> DataFrame:
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("n"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The genes of the largest component, the smaller name on a tie."""
    labels = cut_lineage(connected_components(edges))
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top), "component", "left_semi").select("gene")  # one row


def clustering_coefficients(edges: DataFrame) -> DataFrame:
    """gene, triangles, coefficient of every node with an edge.

    Triangles are found from edges directed to the end of larger degree, so a
    hub does not pair up all its neighbours.
    """
    simple = canonical_edges(edges, keep_loops=False)
    deg = degrees(simple)
    ends = simple.join(deg.select(F.col("gene").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("gene").alias("dst"), F.col("degree").alias("dd")), "dst")
    forward = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = ends.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("b"))
    x, y = out, out.select("a", F.col("b").alias("c"))
    wedges = x.join(y, "a").filter("b < c")
    closed = wedges.join(simple.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    each = closed.select(F.explode(F.array("a", "b", "c")).alias("gene")).groupBy("gene").agg(F.count("*").alias("triangles"))
    t = F.coalesce("triangles", F.lit(0))
    return deg.join(each, "gene", "left").select(
        "gene", t.alias("triangles"), F.coalesce(F.try_divide(2 * t.cast("double"), F.col("degree").cast("double") * (F.col("degree") - 1)), F.lit(0.0)).alias("coefficient")
    )


def average_clustering(edges: DataFrame) -> DataFrame:
    """One row, average: the mean clustering coefficient of the nodes with an edge."""
    return clustering_coefficients(edges).agg(F.avg("coefficient").alias("average"))


def laplacian(edges: DataFrame) -> DataFrame:
    """i, j, v of D - A, both triangles and the diagonal."""
    links = both_ways(canonical_edges(edges, keep_loops=False))
    diagonal = links.groupBy("src").agg(F.count("*").cast("double").alias("v")).select(F.col("src").alias("i"), F.col("src").alias("j"), "v")
    return links.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("v")).unionAll(diagonal)


#: Links of a walk that every task may hold (16 bytes each, both directions).
WALK_LINKS = 5_000_000
#: Numbers of the dense rows that a task of a walk holds at a time.
WALK_CELLS = 3_000_000
#: Pairs of nodes that a task spells out.
SPELLED_ROWS = 50_000_000


def ppmi(edges: DataFrame, steps: int = 10, binary: bool = False, walk_links: int = WALK_LINKS, cells: int = WALK_CELLS) -> DataFrame:
    """i, j, v: positive pointwise mutual information of random walks of 1 to ``steps`` steps.

    The walk matrices are summed over the steps. A task holds the sparse
    transition matrix in tiles and walks with a few source rows at a time to the
    end, so no power of the matrix is shuffled; the sums of the columns are a
    walk of all rows at once, which each task makes too. A count shows whether
    the links fit a task; beyond ``walk_links`` each step is a join and a sum.
    Nodes with the same neighbours have the same rows and columns, so walks are
    between classes of them, and pairs of nodes are spelled out last. Without
    edges there are no rows.
    """
    links = cut_lineage(both_ways(canonical_edges(edges, keep_loops=False)).filter("src is not null and dst is not null"))
    members = _twins(links)
    sizes = cut_lineage(members.groupBy("class").agg(F.count("*").cast("double").alias("size")))
    # A class walks as its first member does: to a class with the share of its neighbours there.
    firsts = links.join(sizes.select(F.col("class").alias("src")), "src")
    steps_of = firsts.join(members.select(F.col("gene").alias("dst"), F.col("class").alias("j")), "dst").groupBy(F.col("src").alias("i"), "j").agg(F.count("*").alias("n"))
    degree = steps_of.groupBy("i").agg(F.sum("n").cast("double").alias("d"))
    walk = cut_lineage(steps_of.join(degree, "i").select("i", "j", (F.col("n") / F.col("d")).alias("v")))
    scored = _ppmi_by_rows(walk, sizes, steps, cells) if walk.count() <= walk_links else _ppmi_by_joins(walk, sizes, steps)
    spelled = _spelled(scored, members, sizes)
    return spelled.withColumn("v", F.lit(1.0)) if binary else spelled


def _twins(links: DataFrame) -> DataFrame:
    """gene, class: the smallest node with the same neighbours (their number, and 128 bits of their hashes); written."""
    hashes = [F.bit_xor(F.xxhash64("dst", F.lit(seed))).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    nodes = links.groupBy("src").agg(F.count("*").alias("n"), *hashes)
    # A join, as a window would hold a class in one task.
    first = nodes.groupBy("n", "a", "b").agg(F.min("src").alias("class"))
    return materialize(nodes.join(first, ["n", "a", "b"]).select(F.col("src").alias("gene"), "class"), "twins")


def _spelled(scored: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """i, j, v of nodes from those of classes, dealt to tasks by the number of pairs."""
    scored = cut_lineage(scored)
    of = lambda side: sizes.select(F.col("class").alias(side), F.col("size").alias(f"n_{side}"))
    pairs = scored.join(of("i"), "i").join(of("j"), "j").agg(F.coalesce(F.sum(F.col("n_i") * F.col("n_j")), F.lit(0.0)).alias("n")).first()["n"]
    tasks = max(scored.sparkSession.sparkContext.defaultParallelism, -(-int(pairs) // SPELLED_ROWS))
    left = scored.join(members.select(F.col("class").alias("i"), F.col("gene").alias("_i")), "i").select("_i", "j", "v").repartition(tasks, "_i", "j")
    return left.join(members.select(F.col("class").alias("j"), F.col("gene").alias("_j")), "j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), "v")


def _ppmi_by_rows(walk: DataFrame, sizes: DataFrame, steps: int, cells: int) -> DataFrame:
    """i, j, v > 0 of classes from walks with some source rows in each task."""
    nodes = blocked.index(walk.select(F.col("i").alias("gene")))
    n = nodes.count()
    rows = max(1, cells // max(1, n))  # of a task
    tiles = blocked.tiles([walk, sizes.select(F.col("class").alias("i"), F.col("class").alias("j"), F.col("size").alias("v"))], nodes, nodes)

    def run(table):
        import numpy as np
        import pyarrow as pa

        part, held = table.column("part")[0].as_py(), table.sort_by("rb").to_pylist()
        sizes = {t["rb"]: t["n_rows"] for t in held}  # every node has a link, so every block has a tile
        first = dict(zip(sorted(sizes), np.cumsum([0, *[sizes[b] for b in sorted(sizes)]]), strict=False))
        whole = [(t["net"], first[t["rb"]], t["n_rows"], first[t["cb"]], t["n_columns"], *blocked.entries(t["n"], t["ra"], t["ca"], t["v"])) for t in held]
        entries = [e for net, *e in whole if net == 0]
        here = np.arange(part * rows, min(n, (part + 1) * rows))

        # The last column walks with all nodes at once: its sum over the steps are the column sums.
        at = np.zeros((n, len(here) + 1))
        at[here, np.arange(len(here))] = 1.0
        for net, row, _, _, _, ra, _, size in whole:
            if net == 1:
                at[row + ra, -1] = size
        total = np.zeros_like(at)
        for _ in range(steps):
            new = np.zeros_like(at)
            for row, n_rows, column, n_columns, ra, ca, v in entries:
                places, out = blocked.product(ca, ra, v, n_columns, at[row : row + n_rows])
                new[column + places] += out
            at = new
            total += at
        sums, total = total[:, -1], total[:, :-1]
        with np.errstate(divide="ignore"):
            value = np.log(total * (sums.sum() / sums)[:, None] / total.sum(axis=0))
        j, i = np.nonzero(value > 0)
        edges_of = np.array([first[b] for b in sorted(sizes)])
        block_of = lambda x: np.searchsorted(edges_of, x, side="right") - 1
        names = np.array(sorted(sizes), dtype=np.int32)
        i_all = here[i]
        i_block, j_block = block_of(i_all), block_of(j)
        return pa.table({
            "ib": pa.array(names[i_block], pa.int32()), "ia": pa.array((i_all - edges_of[i_block]).astype(np.int32)),
            "jb": pa.array(names[j_block], pa.int32()), "ja": pa.array((j - edges_of[j_block]).astype(np.int32)), "v": pa.array(value[j, i]),
        })

    parts = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // rows) - 1)))))
    found = parts.select("part", "net", "rb", "cb", "n_rows", "n_columns", "n", "ra", "ca", "v").groupBy("part").applyInArrow(run, "ib int, ia int, jb int, ja int, v double")
    # No more nodes than links, of which a count has shown that they are few.
    sides = [F.broadcast(nodes.select(F.col("block").alias(f"{s}b"), F.col("at").alias(f"{s}a"), F.col("gene").alias(s))) for s in "ij"]
    return found.join(sides[0], ["ib", "ia"]).join(sides[1], ["jb", "ja"]).select("i", "j", "v")


def _ppmi_by_joins(walk: DataFrame, sizes: DataFrame, steps: int) -> DataFrame:
    """i, j, v > 0 of classes; each step is one join and sum over the sparse matrix."""
    power, total = walk, walk
    for _ in range(steps - 1):
        power = cut_lineage(power.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(walk.select(F.col("i").alias("k"), "j", "v"), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("v")).alias("v")))
        total = cut_lineage(total.unionAll(power).groupBy("i", "j").agg(F.sum("v").alias("v")))
    rows = total.groupBy("i").agg(F.sum("v").alias("r"))
    sized = total.join(sizes.select(F.col("class").alias("i"), "size"), "i")
    columns = sized.groupBy("j").agg(F.sum(F.col("v") * F.col("size")).alias("c"))
    whole = sized.agg(F.sum(F.col("v") * F.col("size")).alias("s"))
    value = F.log(F.col("v") * F.col("s") / (F.col("r") * F.col("c")))
    return total.join(rows, "i").join(columns, "j").crossJoin(F.broadcast(whole)).select("i", "j", value.alias("v")).filter("v > 0")  # one row


def bipartite_ppmi(pairs: DataFrame) -> DataFrame:
    """i, j, v of the positive pointwise mutual information of weighted pairs (i, j, v)."""
    rows = pairs.groupBy("i").agg(F.sum("v").alias("r"))
    columns = pairs.groupBy("j").agg(F.sum("v").alias("c"))
    whole = pairs.agg(F.sum("v").alias("s"))
    value = F.log(F.col("v") * F.col("s") / (F.col("r") * F.col("c")))
    return pairs.join(rows, "i").join(columns, "j").crossJoin(F.broadcast(whole)).select("i", "j", value.alias("v")).filter("v > 0")  # one row


def trace_regulariser(edges: DataFrame, factors: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: gamma * tr(F' L F), the sum over edges of squared differences of the factor rows."""
    a = factors.select(F.col("gene").alias("src"), F.col("vec").alias("x"))
    b = factors.select(F.col("gene").alias("dst"), F.col("vec").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return canonical_edges(edges, keep_loops=False).join(a, "src").join(b, "dst").agg((gamma * F.coalesce(F.sum(square), F.lit(0.0))).alias("trace"))
