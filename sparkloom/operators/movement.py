"""Pairwise distances, their norm in closed form, and movement between two conditions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.session import materialize


def distance_norm(points: DataFrame) -> DataFrame:
    """One row, norm: the Frobenius norm of all pairwise Euclidean distances.

    The sum of squared distances is 2 n sum |x|^2 - 2 |sum x|^2; no pair is formed.
    """
    long = points.select("gene", F.posexplode("vec").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    by_axis = long.groupBy("k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return by_axis.agg(F.sqrt(F.greatest(F.lit(0.0), 2 * F.max("n") * F.sum("q") - 2 * F.sum(F.col("s") * F.col("s")))).alias("norm"))


#: Groups of rows whose pairs are dealt to tasks, and rows of a group at most.
GROUPS, GROUP_ROWS = 12, 1 << 16
#: Rows and columns of the products that a task holds at once.
TILE = (256, 1024)


def met(points: DataFrame, columns: list[str], n: int, work: Callable, schema: str) -> DataFrame:
    """Every two groups of rows meet in one task: ``work(a, b)`` yields record batches.

    Each row goes to as many tasks as there are groups, so what is shuffled grows
    with the rows. ``a`` and ``b`` are (genes, arrays of the columns) of a group; with
    itself a group meets once, and then ``a`` is ``b``. Groups have up to ``GROUP_ROWS``
    rows or so. Rows without a gene are left out, as are rows with vectors that are null or hold
    a null; of a column all vectors have the same length.
    """
    groups = max(min(GROUPS, -(-n // TILE[0])), -(-n // GROUP_ROWS), 1)
    whole = points.filter("gene is not null").select("gene", *[F.col(c).cast("array<double>").alias(c) for c in columns]).filter(" and ".join(f"{c} is not null and not exists({c}, x -> x is null)" for c in columns))
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = whole.withColumn("_g", F.pmod(F.xxhash64("gene"), F.lit(groups)).cast("int")).withColumn("_o", other)
    paired = dealt.select((F.least("_g", "_o") * groups + F.greatest("_g", "_o")).alias("_pair"), "_g", "gene", *columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(pair, held):
            table = pa.Table.from_batches(held)
            at, lengths = table.column("_g").to_numpy(), []
            sides = []
            for g in dict.fromkeys(divmod(pair, groups)):
                own = table.filter(pa.array(at == g)).combine_chunks()
                lengths.append(own.num_rows)
                if own.num_rows:
                    genes = own.column("gene").combine_chunks()
                    sides.append((genes, [own.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1) for c in columns]))
            if all(lengths):
                yield from work(sides[0], sides[-1])

        here, held = None, []
        for batch in batches:
            pairs = batch.column("_pair").to_numpy()
            cuts = np.flatnonzero(np.diff(pairs, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                if pairs[a] != here:
                    if held:
                        yield from done(int(here), held)
                    here, held = pairs[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(int(here), held)

    return paired.repartition(groups * (groups + 1) // 2, "_pair").sortWithinPartitions("_pair").mapInArrow(run, schema)


def _tile_distances(kind: str) -> Callable:
    """The distances of some rows to others as an array, for a kind in ``KINDS``."""

    def far(x, y):
        import numpy as np

        if kind == "manhattan":
            out = np.zeros((len(x), len(y)))
            for k in range(x.shape[1]):
                out += np.abs(x[:, k, None] - y[None, :, k])
            return out
        if kind == "euclidean":
            return distances(x, y)
        size = np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = (x @ y.T) / size
        zero = size == 0
        if kind == "angular":
            out = np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
            out[zero] = 0.0
            return out
        out = 1 - cosine if kind == "cosine" else np.sqrt(np.maximum(1 - cosine, 0) / 2)
        return np.ma.array(out, mask=zero) if zero.any() else out

    return far


def distances(x, y):
    """Euclidean distances of rows; those that cancellation would blur, or that are not finite, are made from differences."""
    import numpy as np

    a, b = (x * x).sum(1), (y * y).sum(1)
    with np.errstate(invalid="ignore", over="ignore"):
        square = x @ y.T
        square *= -2
        square += a[:, None]
        square += b[None]
        least = 1e-6 * (a.max(initial=0.0) + b.max(initial=0.0))
        if not square.min(initial=np.inf) > least:
            i, j = np.nonzero(~(square > least))
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                square[i[part], j[part]] = ((x[i[part]] - y[j[part]]) ** 2).sum(1)
    return np.sqrt(square, out=square)


#: Distances that ``pairwise`` makes by matrices.
KINDS = {vectors.euclidean: "euclidean", vectors.manhattan: "manhattan", vectors.cosine_distance: "cosine", vectors.angular_distance: "angular", vectors.half_chord: "half chord"}


def pairwise(points: DataFrame, distance=vectors.euclidean, places: int | None = None) -> DataFrame:
    """i, j (i < j), dist of every two genes, rounded to ``places``: the result itself has n^2 / 2 rows.

    The distances of ``functions.vectors`` are made tile by tile in numpy, and rows
    leave a task as they are made; pairs with a vector that is null or holds a null
    (and any other distance) are a join of rows.
    """
    rounds = lambda c: c if places is None else F.round(c, places)

    def joined(a, b):
        met_rows = a.select(F.col("gene").alias("p"), F.col("vec").alias("x")).join(b.select(F.col("gene").alias("q"), F.col("vec").alias("y")), F.col("p") != F.col("q"))
        return met_rows.select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), rounds(distance(F.col("x"), F.col("y"))).alias("dist"))

    if distance not in KINDS:
        a, b = points.select(F.col("gene").alias("i"), F.col("vec").alias("x")), points.select(F.col("gene").alias("j"), F.col("vec").alias("y"))
        return a.join(b, F.col("i") < F.col("j")).select("i", "j", rounds(distance(F.col("x"), F.col("y"))).alias("dist"))
    whole = F.expr("vec is not null and not exists(vec, x -> x is null)")
    far = _tile_distances(KINDS[distance])

    def work(a, b):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        same = a is b
        genes = a[0] if same else pa.concat_arrays([a[0], b[0]])
        rank = pc.rank(genes, tiebreaker="dense").to_numpy(zero_copy_only=False)
        x, y, shift = a[1][0], b[1][0], 0 if same else len(a[0])
        for r in range(0, len(x), TILE[0]):
            for c in range(0, len(y), TILE[1]):
                if same and c + TILE[1] <= r:
                    continue
                dist = far(x[r : r + TILE[0]], y[c : c + TILE[1]])
                p, q = np.arange(r, r + dist.shape[0])[:, None], np.arange(c, c + dist.shape[1])[None] + shift
                less = rank[p] < rank[q]
                kept = rank[p] != rank[q]
                if same:
                    kept &= p < q
                i, j = np.where(less, p, q)[kept], np.where(less, q, p)[kept]
                mask = np.ma.getmaskarray(dist)[kept] if isinstance(dist, np.ma.MaskedArray) else None
                value = np.ma.getdata(dist)[kept]
                if places is not None:
                    value = np.trunc(value * 10.0**places + np.copysign(0.5, value)) / 10.0**places + 0.0
                yield pa.RecordBatch.from_arrays([genes.take(pa.array(i)), genes.take(pa.array(j)), pa.array(value, mask=mask)], ["i", "j", "dist"])

    gene = points.schema["gene"].dataType.simpleString()
    made = met(points, ["vec"], points.count(), work, f"i {gene}, j {gene}, dist double")
    lacking, there = points.filter(~whole), points.filter(whole)
    among = lacking.select(F.col("gene").alias("i")).join(lacking.select(F.col("gene").alias("j")), F.col("i") < F.col("j"))
    missing = distance(F.lit(None).cast("array<double>"), F.lit(None).cast("array<double>"))
    return made.unionByName(joined(lacking, there)).unionByName(among.select("i", "j", missing.alias("dist")))


def movement(first: DataFrame, second: DataFrame, kind: str = "euclidean") -> DataFrame:
    """gene, moved: how far the row of normalised distances of a common gene changes.

    Norms are over all genes of a condition, rows over the common ones. Every two
    groups of genes meet in one task, which gives partial sums by gene of both, so no distance is ever a row and each is made once. ``kind`` is
    euclidean, manhattan or cosine.
    """
    common = materialize(first.select("gene", F.col("vec").cast("array<double>").alias("a")).join(second.select("gene", F.col("vec").cast("array<double>").alias("b")), "gene"), "moving")
    norms = distance_norm(first).toDF("n1").crossJoin(distance_norm(second).toDF("n2")).first()  # two numbers
    n1, n2 = norms["n1"] or 1.0, norms["n2"] or 1.0
    gene_type = common.schema["gene"].dataType.simpleString()

    def parts(d1, d2):
        import numpy as np

        if kind == "cosine":
            return [d1 * d2, d1 * d1, d2 * d2]
        d1 -= d2
        return [np.abs(d1, out=d1) if kind == "manhattan" else np.multiply(d1, d1, out=d1)]

    def work(a, b):
        import numpy as np
        import pyarrow as pa

        same = a is b
        (x1, x2), (y1, y2) = a[1], b[1]
        (x1, y1), (x2, y2) = (x1 / n1, y1 / n1), (x2 / n2, y2 / n2)
        of_a, of_b = np.zeros((3, len(x1))), np.zeros((3, len(y1)))
        for r in range(0, len(x1), TILE[0]):
            for c in range(0, len(y1), TILE[1]):
                here, there = slice(r, r + TILE[0]), slice(c, c + TILE[1])
                for k, part in enumerate(parts(distances(x1[here], y1[there]), distances(x2[here], y2[there]))):
                    of_a[k, here] += part.sum(axis=1)
                    if not same:
                        of_b[k, there] += part.sum(axis=0)
        for (genes, _), sums in ((a, of_a),) if same else ((a, of_a), (b, of_b)):
            yield pa.RecordBatch.from_arrays([genes, *[pa.array(s) for s in sums]], ["gene", "s", "u", "v"])

    sums = met(common, ["a", "b"], common.count(), work, f"gene {gene_type}, s double, u double, v double").groupBy("gene").agg(
        F.sum("s").alias("s"), F.sum("u").alias("u"), F.sum("v").alias("v")
    )
    value = {"euclidean": F.sqrt("s"), "manhattan": F.col("s")}.get(kind, 1 - F.col("s") / F.sqrt(F.col("u") * F.col("v")))
    return sums.select("gene", value.alias("moved"))
