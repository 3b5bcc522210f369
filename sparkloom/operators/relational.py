"""Projections, filters and joins on canonical tables.

Canonical columns: edges (src, dst); crosswalk (id, symbol); annotations
(gene, term); clusters (cluster, gene); gene sets (gene).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_edges(edges: DataFrame, keep_loops: bool = True) -> DataFrame:
    """Undirected simple edges: src <= dst, each once. What is known to be so is not made distinct again."""
    out = edges if getattr(edges, CANONICAL, False) else as_canonical(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    return out if keep_loops else as_canonical(out.filter("src <> dst"))


CANONICAL = "_sparkloom_canonical"


def as_canonical(edges: DataFrame) -> DataFrame:
    """The same frame (src, dst), known to hold canonical edges; what is derived from it is not."""
    setattr(edges, CANONICAL, True)
    return edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends (a loop once)."""
    return edges.select("src", "dst").unionAll(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def unique_crosswalk(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One symbol an id; of several the last by ``order`` (or the largest symbol) wins."""
    last = Window.partitionBy("id").orderBy(F.desc(order or "symbol"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("id", "symbol")


def translated(df: DataFrame, column: str, crosswalk: DataFrame, unmapped: str = "keep", default: Column | None = None) -> DataFrame:
    """Replaces ids by symbols. ``unmapped``: keep the id, drop the row, or put ``default``."""
    names = df.columns
    walk = crosswalk.select(F.col("id").alias("_id"), F.col("symbol").alias("_symbol"))
    met = df.join(walk, F.col(column) == F.col("_id"), "inner" if unmapped == "drop" else "left")
    value = F.col("_symbol") if unmapped == "drop" else F.coalesce("_symbol", F.col(column).cast("string") if unmapped == "keep" else default)
    return met.select(*[value.alias(c) if c == column else F.col(c) for c in names])


def relabelled_edges(edges: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Both ends translated, unmapped ids kept, edges that became equal merged."""
    return canonical_edges(translated(translated(edges, "src", crosswalk), "dst", crosswalk))


def induced(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """The edges with both ends in the set."""
    return edges.join(genes.select(F.col("gene").alias("src")), "src", "left_semi").join(genes.select(F.col("gene").alias("dst")), "dst", "left_semi").select(edges.columns)


def masked(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """The edges with no end in the set."""
    return edges.join(genes.select(F.col("gene").alias("src")), "src", "left_anti").join(genes.select(F.col("gene").alias("dst")), "dst", "left_anti").select(edges.columns)


def without_zero_rows(expression: DataFrame) -> DataFrame:
    """Genes whose values do not add up to 0 (a NaN sum is kept)."""
    kept = expression.groupBy("gene").agg(F.sum("value").alias("s")).filter(F.isnan("s") | (F.col("s") != 0)).select("gene")
    return expression.join(kept, "gene", "left_semi")


def cells_of(expression: DataFrame, metadata: DataFrame, cond) -> DataFrame:
    """The columns (cells) of one condition."""
    return expression.join(metadata.filter(F.col("cond") == cond).select("cell"), "cell", "left_semi")


def cells_not_of(expression: DataFrame, metadata: DataFrame, cond) -> DataFrame:
    """All columns (cells) but those of one condition; cells without a condition stay."""
    return expression.join(metadata.filter(F.col("cond") == cond).select("cell"), "cell", "left_anti")


def submatrix(matrix: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The entries (i, j, v) whose row is in ``rows`` (i) and whose column is in ``columns`` (j)."""
    return matrix.join(rows.select("i").distinct(), "i", "left_semi").join(columns.select("j").distinct(), "j", "left_semi").select(matrix.columns)


def placed(rows: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Numbers rows from 0 in an order; each task sorts one range of it, and counts by range give the first number."""
    from sparkloom.session import cut_lineage

    held = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = held.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(*order)
    return held.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(bases), "_part").select(*rows.columns, (F.col("_base") + F.col("_k") - 1).alias(out))


def zipped(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two tables paired by their place in each one's order; the longer one's rest is left out."""
    return placed(a, order_a).join(placed(b, order_b), "place")


def checked_inner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which a missing key is an error, raised when the rows are read."""
    met = left.join(right.withColumn("_there", F.lit(True)), key, "left")
    return met.filter(F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_there")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Inner join with the first matching row of ``right`` by ``order``."""
    first = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    return left.join(first, key)


def nearest_in(points: DataFrame, targets: DataFrame, distance, block_rows: int = 256) -> DataFrame:
    """gene, dist, nearest: for every point the closest target, the smaller name on a tie.

    points (gene, vec), targets (target, t_vec). Targets are dealt to blocks of
    about ``block_rows`` vectors by their hash; every block meets every point
    and gives its best, so rows made are points x blocks. The blocks are
    broadcast if a count shows that they are few; more are joined by their
    number. Points without targets are left out.
    """
    n = targets.count()
    n_blocks = max(1, -(-n // block_rows))
    blocks = (
        targets.withColumn("_block", F.pmod(F.xxhash64("target"), F.lit(n_blocks)).cast("int"))
        .groupBy("_block").agg(F.collect_list(F.struct("target", "t_vec")).alias("_targets"))
    )
    asked = points.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    best = F.array_min(F.transform("_targets", lambda t: F.struct(distance(F.col("vec"), t["t_vec"]).alias("dist"), t["target"].alias("nearest"))))
    met = asked.join(F.broadcast(blocks) if n <= 10_000 else blocks, "_block").select("gene", best.alias("_best"))
    return met.groupBy("gene").agg(F.min("_best").alias("_best")).select("gene", F.col("_best.dist").alias("dist"), F.col("_best.nearest").alias("nearest"))


def nearest_euclidean(points: DataFrame, targets: DataFrame, block_rows: int = 256, max_pivots: int = 64) -> DataFrame:
    """gene, dist, nearest as ``nearest_in`` by Euclidean distance, with blocks of targets left out that a bound rules out.

    Equal targets are one. Some targets are pivots, the others belong to the
    nearest pivot; blocks are runs of about ``block_rows`` targets in the order of
    their distance to it, so a block is a ring of known radii. Points meet the
    blocks in the order of a bound, in numpy, as long as it is not above what they
    have found. Points and targets without a vector or with a null in it are left
    out; all have the same number of components.
    """
    from sparkloom.functions.vectors import euclidean
    from sparkloom.session import materialize

    points = points.filter("vec is not null and not exists(vec, x -> x is null)")
    single = materialize(targets.filter("t_vec is not null and not exists(t_vec, x -> x is null)").groupBy("t_vec").agg(F.min("target").alias("target")), "nearest-targets")
    endless = lambda v: F.exists(v, lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usual = single.filter(~endless("t_vec"))
    n = usual.count()
    if n <= 2 * block_rows:
        return nearest_in(points, single, euclidean, block_rows)
    n_columns = len(usual.select("t_vec").first()["t_vec"])
    _, blocks = target_rings(usual, min(max_pivots, -(-n // block_rows)), block_rows)
    # Numbers that are not finite have no bounds; such points meet every target.
    rest = nearest_in(points.filter(endless("vec")), single, euclidean, block_rows)
    return _by_rings(points.filter(~endless("vec")), blocks, n, n_columns).unionByName(rest)


#: Tasks of a search by rings; each holds the targets of its group, at most so many bytes of vectors.
SEARCH_TASKS = 48
SEARCH_BYTES = 64 << 20
#: Points of a task that are compared with a ring at once.
SEARCH_ROWS = 512


def _by_rings(points: DataFrame, blocks: DataFrame, n: int, n_columns: int) -> DataFrame:
    """gene, dist, nearest: every task holds rings of targets and gets a part of the points.

    Points of a part come in the order of their first component and meet the
    rings in the order of their bounds, as long as a bound is not above what has
    been found. Products of matrices tell which targets may be nearest; the
    distance to these is summed up component by component.
    """
    groups = max(1, -(-n * n_columns * 8 // SEARCH_BYTES))
    gene, target = points.schema["gene"].dataType, blocks.schema["_targets"].dataType.elementType["target"].dataType
    lone = lambda kind: F.lit(None).cast(kind)
    rings = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(SEARCH_TASKS - 1))).alias("_part"), F.pmod(F.xxhash64("_pivot", "_ring"), F.lit(groups)).cast("int").alias("_group"), F.lit(0).alias("_side"), lone("double").alias("_first"),
        lone(gene).alias("gene"), lone("array<double>").alias("vec"), F.col("_targets.target").alias("targets"), F.flatten("_targets.t_vec").cast("array<double>").alias("t_vecs"),
    )
    asked = points.select("gene", F.col("vec").cast("array<double>").alias("vec")).select(
        F.pmod(F.xxhash64("gene"), F.lit(SEARCH_TASKS)).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(1).alias("_side"), F.get("vec", 0).alias("_first"),
        "gene", "vec", lone(blocks.select("_targets.target").schema[0].dataType).alias("targets"), lone("array<double>").alias("t_vecs"),
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here, held, rings = None, [], None

        def prepared():
            names = pa.concat_arrays([t for t, _ in held])
            order = pc.sort_indices(names).to_numpy()
            rank = np.empty(len(names), dtype=np.int64)
            rank[order] = np.arange(len(names))
            edges = np.cumsum([0, *[len(t) for t, _ in held]])
            vecs = [v for _, v in held]
            centres = np.array([v.mean(axis=0) for v in vecs])
            radii = np.array([np.sqrt(((v - c) ** 2).sum(1).max()) for v, c in zip(vecs, centres, strict=True)])
            return names.take(pa.array(order)), rank, edges, vecs, [(v * v).sum(1) for v in vecs], centres, radii

        def exact(x, y):
            total = np.zeros(len(x))
            for k in range(x.shape[1]):
                total += (x[:, k] - y[:, k]) ** 2
            return np.sqrt(total)

        def search(x):
            names, rank, edges, vecs, squares, centres, radii = rings
            own = (x * x).sum(1)
            away = np.sqrt(np.maximum(own[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))
            slack = 1e-6 * (np.sqrt(own)[:, None] + np.sqrt((centres * centres).sum(1))[None] + radii[None])
            bounds = away - radii[None] - slack
            best, place = np.full(len(x), np.inf), np.full(len(x), len(names))
            for ring in np.argsort(bounds.min(axis=0), kind="stable"):
                mine = np.flatnonzero(bounds[:, ring] <= best)
                if not len(mine):
                    continue
                y, whole = vecs[ring], len(mine) == len(x)
                near = x if whole else x[mine]
                square = squares[ring][None] - 2 * near @ y.T
                own_here = own[mine]
                may = 1e-12 * (own_here + squares[ring].max())
                limit = np.minimum(square.min(axis=1), best[mine] ** 2 - own_here) + may
                p, t = np.nonzero(square <= limit[:, None])
                if not len(p):
                    continue
                far, at = exact(near[p], y[t]), rank[edges[ring] + t]
                first = np.lexsort((at, far, p))
                first = first[np.diff(p[first], prepend=-1) > 0]
                p, far, at = mine[p[first]], far[first], at[first]
                better = (far < best[p]) | ((far == best[p]) & (at < place[p]))
                best[p[better]], place[p[better]] = far[better], at[better]
            return best, names.take(pa.array(place))

        for batch in batches:
            keys = batch.column("_part").to_numpy().astype(np.int64) * groups + batch.column("_group").to_numpy()
            cuts = np.flatnonzero(np.diff(keys * 2 + batch.column("_side").to_numpy(), prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                part = batch.slice(a, b - a)
                if keys[a] != here:
                    here, held, rings = keys[a], [], None
                if part.column("_side")[0].as_py() == 0:
                    for k in range(part.num_rows):
                        names = part.column("targets")[k].values
                        held.append((names, part.column("t_vecs")[k].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)))
                    continue
                if rings is None:
                    if not held:
                        continue
                    rings = prepared()
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                for at in range(0, len(x), SEARCH_ROWS):
                    dist, names = search(x[at : at + SEARCH_ROWS])
                    yield pa.RecordBatch.from_arrays([part.column("gene").slice(at, SEARCH_ROWS), pa.array(dist), names], ["gene", "dist", "nearest"])

    order = ["_part", "_group", "_side", "_first"]
    dealt = rings.unionByName(asked).repartition(SEARCH_TASKS * groups, "_part", "_group").sortWithinPartitions(*order)
    found = dealt.mapInArrow(run, f"gene {gene.simpleString()}, dist double, nearest {target.simpleString()}")
    best = found.groupBy("gene").agg(F.min(F.struct("dist", "nearest")).alias("_best"))
    return best.select("gene", F.col("_best.dist").alias("dist"), F.col("_best.nearest").alias("nearest"))


def target_rings(targets: DataFrame, n_pivots: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The pivots (one row) and the blocks (_pivot, _ring) of targets with radii. Written."""
    from sparkloom.functions.vectors import euclidean
    from sparkloom.session import materialize

    chosen = targets.orderBy(F.xxhash64("t_vec"), "target").limit(n_pivots)
    pivots = materialize(chosen.agg(F.collect_list("t_vec").alias("_pivots")), "nearest-pivots")  # one row of n_pivots vectors
    away = F.transform("_pivots", lambda p, k: F.struct(euclidean(F.col("t_vec"), p).alias("far"), k.alias("pivot")))
    near = targets.crossJoin(F.broadcast(pivots)).withColumn("_near", F.array_min(away))
    order = placed(near.select("target", "t_vec", F.col("_near.pivot").alias("_pivot"), F.col("_near.far").alias("_far")), ["_pivot", "_far", "target"])
    return pivots, materialize(
        order.withColumn("_ring", F.floor(F.col("place") / block_rows)).groupBy("_pivot", "_ring")
        .agg(F.min("_far").alias("_low"), F.max("_far").alias("_high"), F.collect_list(F.struct("target", "t_vec")).alias("_targets")), "nearest-blocks",
    )


def ringed(points: DataFrame, targets: DataFrame, n_pivots: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points with their distances to the pivots and their first block; blocks (_pivot, _ring) with radii and targets. Written."""
    from sparkloom.functions.vectors import euclidean
    from sparkloom.session import materialize

    pivots, blocks = target_rings(targets, n_pivots, block_rows)
    away = lambda v: F.transform("_pivots", lambda p, k: F.struct(euclidean(F.col(v), p).alias("far"), k.alias("pivot")))
    rings = blocks.select("_pivot", "_ring", "_low", "_high")
    far = points.crossJoin(F.broadcast(pivots)).select("gene", "vec", away("vec").alias("_away")).withColumn("_near", F.array_min("_away"))
    # Rings of the nearest pivot only: a row a block of it, without the vectors.
    met = far.select("gene", F.col("_near.pivot").alias("_pivot"), F.col("_near.far").alias("_d")).join(rings, "_pivot")
    first = met.groupBy("gene").agg(F.min(F.struct(bound().alias("bound"), "_pivot", "_ring")).alias("_f"))
    return materialize(far.join(first, "gene").select("gene", "vec", "_away", F.struct("_f._pivot", "_f._ring").alias("_first")), "nearest-points"), blocks


def bound() -> Column:
    """What a target in a ring (_low to _high from the pivot) is at least away from a point at distance _d from the pivot, less what rounding may add."""
    return F.greatest(F.col("_d") - F.col("_high"), F.col("_low") - F.col("_d"), F.lit(0.0)) - (F.col("_d") + F.col("_high")) * 1e-12


def left_to_visit(first: DataFrame, seen: DataFrame, rings: DataFrame) -> DataFrame:
    """gene, vec, _pivot, _ring: the blocks that may hold a target as near as the one found first."""
    reach = rings.groupBy("_pivot").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    asked = first.select("gene", F.col("_best.dist").alias("_found")).join(seen, "gene").select("gene", "vec", "_found", "_first", F.explode("_away").alias("_a"))
    asked = asked.select("gene", "vec", "_found", "_first", F.col("_a.pivot").alias("_pivot"), F.col("_a.far").alias("_d"))
    # The whole region of a pivot first (a row a pivot), then its rings.
    near = asked.join(F.broadcast(reach), "_pivot").filter(bound() <= F.col("_found")).drop("_low", "_high")
    return near.join(rings, "_pivot").filter((bound() <= F.col("_found")) & ((F.col("_pivot") != F.col("_first._pivot")) | (F.col("_ring") != F.col("_first._ring")))).select("gene", "vec", "_pivot", "_ring")


def labelled(column: Column, labels: dict, default: Column | None = None) -> Column:
    """A literal map of values."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), default if default is not None else column)


def binarised(value: Column) -> Column:
    return F.when(value > 0, 1.0).otherwise(0.0)
