"""Sparse and tall matrices as DataFrames: products, Gram matrices, truncated SVD.

A sparse matrix is (i, j, v); a tall factor is (gene, vec array<double>) with
few columns. Only k x k matrices reach the driver.
"""

from __future__ import annotations

from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocked
from sparkloom.session import discard, materialize


def adjacency(edges: DataFrame) -> DataFrame:
    """i, j, 1.0 of both directions of the distinct edges."""
    from sparkloom.operators.relational import canonical_edges

    way = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"))
    # Both ways from one row: a union would make the edges distinct twice.
    ways = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    return canonical_edges(edges).select(F.explode(ways).alias("e")).select("e.i", "e.j", F.lit(1.0).alias("v"))


def sparse_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v of A B for two sparse matrices."""
    return a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def gram(factor: DataFrame, k: int):
    """F' F as a k x k array: partial sums in the tasks, one row of k * k numbers each."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((k, k))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k * k), pa.int32()), "v": pa.array(total.reshape(-1))})

    sums = factor.select("vec").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k numbers
    out = np.zeros(k * k)
    for r in sums:
        out[r["at"]] = r["v"]
    return out.reshape(k, k)


def cross(left: DataFrame, right: DataFrame, k1: int, k2: int):
    """L' R as a k1 x k2 array for two factors with the same genes."""
    import numpy as np

    pairs = left.select("gene", F.col("vec").alias("a")).join(right.select("gene", F.col("vec").alias("b")), "gene")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((k1, k2))
        for batch in batches:
            total += batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k1).T @ batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k2)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(k1 * k2), pa.int32()), "v": pa.array(total.reshape(-1))})

    sums = pairs.select("a", "b").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k1 * k2 numbers
    out = np.zeros(k1 * k2)
    for r in sums:
        out[r["at"]] = r["v"]
    return out.reshape(k1, k2)


def times_factor(matrix: DataFrame, factor: DataFrame, k: int) -> DataFrame:
    """gene, vec of M F: a join on the column and a sum of scaled rows."""
    met = matrix.join(factor.select(F.col("gene").alias("j"), "vec"), "j")
    scaled = [F.sum(F.col("v") * F.col("vec")[c]).alias(f"c{c}") for c in range(k)]
    return met.groupBy("i").agg(*scaled).select(F.col("i").alias("gene"), F.array(*[F.col(f"c{c}") for c in range(k)]).alias("vec"))


def times_small(factor: DataFrame, small) -> DataFrame:
    """gene, vec of F S for a k x m array S, in the JVM."""
    weights = [F.array(*[F.lit(float(x)) for x in small[:, m]]) for m in range(small.shape[1])]
    value = lambda w: F.aggregate(F.zip_with("vec", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return factor.select("gene", F.array(*[value(w) for w in weights]).alias("vec"))


def squared_norm(matrix: DataFrame) -> float:
    return float(matrix.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("s")).first()["s"])


def _orthonormal(blocks: DataFrame, width: int, cutoff: float = 1e-10):
    """The small matrix that makes the columns of written blocks orthonormal, by tall-skinny QR, and the R factor.

    Every task keeps the R factor of the rows it has seen; these are stacked.
    Directions below ``cutoff`` are dropped, so the result may have fewer columns.
    """
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        r = np.zeros((0, width))
        for batch in batches:
            for k in range(batch.num_rows):
                r = np.linalg.qr(np.concatenate([r, np.frombuffer(batch.column(0)[k].as_py()).reshape(-1, width)]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["data"])

    rows = blocks.select("data").mapInArrow(run, "data binary")
    if len(blocks.inputFiles()) * width * width * 8 > blocked.DIRECT_BYTES:
        rows = rows.repartition(max(1, blocked.DIRECT_BYTES // (width * width * 8))).mapInArrow(run, "data binary")
    stacked = [np.frombuffer(r["data"]).reshape(-1, width) for r in rows.collect()]  # width * width numbers a task
    r = np.linalg.qr(np.concatenate(stacked), mode="r")
    _, s, v = np.linalg.svd(r)
    kept = s > cutoff * max(s.max(initial=0.0), 1e-300)
    return v[: len(s)][kept].T / s[kept], r


#: Entries of a strip of rows, bytes of a basis that every task may hold, degree of the filters of ``truncated_svd``.
STRIP_ENTRIES, HELD_BYTES, DEGREE = 1 << 20, 128 << 20, 16
#: How much a filter may raise the largest value above the smallest wanted one.
RAISED = 1e6
#: The last wanted and the least value of a basis that agree so far, relatively, are taken for values of one cluster.
ALIKE = 1e-4


def _spread_keys(spark, n: int) -> list[int]:
    """n numbers that a repartition by hash to n tasks deals to different ones."""
    found = spark.range(n * 64).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("task")).groupBy("task").agg(F.min("id").alias("id")).collect()  # n rows
    return sorted(r["id"] for r in found)


class _Strips:
    """A sparse matrix in strips of rows that stay with their tasks; a basis of its columns comes to each of them.

    Strips are kept on the executors' disks, dealt by task, so that a pass moves
    only the basis and the tasks' sums, once for each task.
    """

    def __init__(self, made: DataFrame):
        import itertools

        spark = made.sparkSession
        blocks = sorted(r["rb"] for r in made.select("rb").distinct().collect())  # one row for each million entries
        n = max(1, min(len(blocks), 2 * spark.sparkContext.defaultParallelism))
        keys = _spread_keys(spark, n)
        dealt = spark.createDataFrame(list(zip(blocks, itertools.cycle(keys), strict=False)), "rb int, task int")
        self.tasks = spark.createDataFrame([(k,) for k in keys], "task int")
        self.n = n
        self.dealt = made.join(F.broadcast(dealt), "rb").select("task", "net", "rb", "cb", "n_rows", "n_columns", "n", "ra", "ca", "v").repartition(n, "task").sortWithinPartitions("task").persist(StorageLevel.DISK_ONLY)

    def of(self, nets: list[int]) -> _Strips:
        """The strips of the sum of some of the matrices, over the same tiles."""
        import copy

        chosen = copy.copy(self)
        chosen.dealt = self.dealt.filter(F.col("net").isin(nets))
        return chosen

    def passed(self, basis: DataFrame, width: int, back: bool) -> DataFrame:
        """``PARTS`` of kind 0: A'A X for a basis X (block, data) of the columns (with ``back``), or kind OWN: A X by strip."""

        def run(tiles, held):
            import numpy as np
            import pyarrow as pa

            x = {b: np.frombuffer(d.as_buffer()).reshape(-1, width) for b, d in zip(held.column("block").to_pylist(), held.column("data"), strict=True)}
            z = {b: np.zeros(part.shape) for b, part in x.items()} if back else {}
            strips, out = {}, []
            for k, rb in enumerate(tiles.column("rb").to_pylist()):
                strips.setdefault(rb, []).append(k)
            for rb, mine in strips.items():
                y = None
                parts = []
                for k in mine:
                    r = {name: tiles.column(name)[k] for name in ("cb", "n_rows", "n", "ra", "ca", "v")}
                    ra, ca, v = blocked.entries(r["n"].as_py(), *(r[name].as_buffer() for name in ("ra", "ca", "v")))
                    cb = r["cb"].as_py()
                    y = np.zeros((r["n_rows"].as_py(), width)) if y is None else y
                    places, made = blocked.product(ra, ca, v, len(y), x[cb])
                    y[places] += made
                    parts.append((cb, ra, ca, v))
                if back:
                    for cb, ra, ca, v in parts:
                        places, made = blocked.product(ca, ra, v, len(z[cb]), y)
                        z[cb][places] += made
                else:
                    out.append((rb, blocked.OWN, y))
            out += [(b, 0, part) for b, part in z.items()]
            every = [np.arange(len(d), dtype="<i4").tobytes() if back else None for _, _, d in out]
            return pa.table({"block": pa.array([b for b, *_ in out], pa.int32()), "kind": pa.array([k for _, k, _ in out], pa.int32()), "places": pa.array(every, pa.binary()), "data": pa.array([d.tobytes() for *_, d in out], pa.binary())})

        copies = basis.select("block", "data").crossJoin(F.broadcast(self.tasks)).repartition(self.n, "task")
        return self.dealt.groupBy("task").cogroup(copies.groupBy("task")).applyInArrow(run, blocked.PARTS)


class _Halves:
    """The same for bases that no task may hold: A X is written in blocks, and multiplied with the transpose."""

    def __init__(self, made: DataFrame, rows: DataFrame, nets: tuple[int, ...] = (0,)):
        self.nets = nets
        self.made, self.side, self.last = made, blocked.packed([rows.select("gene", F.array(F.lit(1.0)).alias("vec"))], [1], rows), None

    def passed(self, basis: DataFrame, width: int, back: bool) -> DataFrame:
        import numpy as np

        of = {a: [slice(0, width)] for a in self.nets}
        parts = blocked.mapped(self.side, lambda x: x, 1).unionAll(blocked.products(self.made, basis, of))
        y = blocked.gathered(parts, 1, dict.fromkeys(self.nets, width), lambda own, held: (sum(held.values()), np.zeros(0)), 0)
        if not back:
            return y
        if self.last is not None:
            discard(self.last)
        self.last = materialize(y, "basis")
        return blocked.products(self.made, blocked.own(self.last), of, transposed=True).withColumn("kind", F.lit(0))


def _ritz(gram, width: int, locked: int):
    """C, values: columns orthonormal beside the locked ones, with B X = Z projected to them diagonal; descending.

    ``gram`` is of X, Z and the locked columns side by side.
    """
    import numpy as np

    x, z, v = slice(0, width), slice(width, 2 * width), slice(2 * width, 2 * width + locked)
    g = gram[x, x] - gram[x, v] @ gram[v, x]
    h = gram[x, z] - gram[x, v] @ gram[v, z]
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    w, q = np.linalg.eigh(g * scale[:, None] * scale)
    kept = w > 1e-13 * w.max(initial=0.0)
    c = scale[:, None] * q[:, kept] / np.sqrt(w[kept])
    values, turned = np.linalg.eigh((c.T @ h @ c + c.T @ h.T @ c) / 2)
    return (c @ turned)[:, ::-1], values[::-1]


def _degree(raised: float) -> int:
    """The largest degree, up to ``DEGREE``, whose Chebyshev polynomial is at most ``RAISED`` there."""
    import numpy as np

    return int(np.clip(np.floor(np.arccosh(2 * RAISED) / np.arccosh(max(raised, 1 + 1e-9))), 1, DEGREE))


def _dominant(multiplier, first: DataFrame, width: int, k: int, tolerance: float, max_iter: int):
    """(written blocks, change, columns): the change makes the blocks' arrays an orthonormal basis of the first k singular directions.

    Subspace iteration on B = A'A with Chebyshev filters: between two
    Rayleigh-Ritz steps the columns are multiplied with a polynomial of B that is
    small up to the smallest Ritz value. Leading columns whose residual is at the
    level of rounding are locked and taken out of B, so that they do not drown the
    others. It ends when the residuals show that the first k singular values are
    within ``tolerance`` of the first.
    """
    import warnings

    import numpy as np

    def step(rows: DataFrame, n_own: int, n: int, finish, size: int):
        """A multiplication of the first n columns of the rows (PARTS of kind OWN)."""
        x = rows.select("block", "data").mapInArrow(_cut_columns(n_own, n), "block int, data binary")
        made = materialize(blocked.gathered(rows.unionAll(multiplier.passed(x, n, True)), n_own, {0: n}, finish, size), "basis")
        return made, blocked.summed(made, size)

    def whole(x, z, v):
        row = np.concatenate([x, z, v], axis=1)
        return row, (row.T @ row).ravel()

    n, locked, fixed = width, 0, np.zeros(0)
    state, sums = step(blocked.mapped(first, lambda x: x, n), n, n, lambda own, held: whole(own, held[0], own[:, :0]), 4 * n * n)
    done = 0
    while True:
        wide = 2 * n + locked
        gram = sums.reshape(wide, wide)
        c, values = _ritz(gram, n, locked)
        x, z, v = slice(0, n), slice(n, 2 * n), slice(2 * n, wide)

        def turned(s, c=c, lost=(gram[v, x], gram[v, z]), x=x, z=z, v=v):
            return (s[:, x] - s[:, v] @ lost[0]) @ c, (s[:, z] - s[:, v] @ lost[1]) @ c, s[:, v]

        def residuals(s, turned=turned, values=values):
            a, b, _ = turned(s)
            return ((b - a * values) ** 2).sum(axis=0)

        norms = materialize(blocked.block_sums(blocked.own(state), residuals, wide, len(values)), "residuals")
        residual = np.sqrt(blocked.summed(norms, len(values)))
        discard(norms)
        every = np.concatenate([fixed, values])
        top, left = max(every.max(initial=0.0), 1e-300), max(0, min(k - locked, len(values)))
        apart = np.maximum(values[:left] - values[-1:], 1e-6 * np.abs(values[:left]) + 1e-300)
        off = np.minimum(residual[:left], residual[:left] ** 2 / apart)
        if len(values) + locked >= multiplier.n_columns or np.all(off <= 2 * tolerance * np.sqrt(top * np.maximum(values[:left], 1e-10 * top))):
            break
        if done >= max_iter:
            warnings.warn(f"singular values are not within the tolerance after {done} passes", stacklevel=3)
            break
        ready = 0
        while ready < len(values) - 1 and residual[ready] <= 1e-12 * top:
            ready += 1
        fixed, locked, m = np.concatenate([fixed, values[:ready]]), locked + ready, len(values) - ready
        active = values[ready:]
        # Where the last wanted value and all columns' least one agree, as in matrices of many equal parts, or differ by no more
        # than residuals explain, there is nothing between them to tell apart: what is to be made small lies further down.
        alike = left > 0 and values[left - 1] - values[-1] <= max(ALIKE * values[left - 1], residual.max() ** 2 / max(values[left - 1], 1e-300))
        edge = max(active[-1] * (0.5 if alike else 1.0), 1e-4 * active[0], 1e-14 * top)
        # A largest value that is not known yet would drown all other columns.
        degree = _degree(2 * active[0] / edge - 1) if residual[ready] <= 0.1 * active[0] else 1

        def start(s, turned=turned, ready=ready, edge=edge):
            a, b, v = turned(s)
            return np.concatenate([2 / edge * b[:, ready:] - a[:, ready:], a[:, ready:], v, a[:, :ready]], axis=1)

        rows, wide_in, wide = blocked.mapped(blocked.own(state), start, wide), 2 * m + locked, 2 * m + locked
        inside = np.zeros((locked, m))
        for turn in range(1, degree + 1):
            def finish(s, held, last=turn == degree, inside=inside, m=m, edge=edge, fixed=fixed):
                now, before, v = s[:, :m], s[:, m : 2 * m], s[:, 2 * m :]
                if last:
                    return whole(now, held[0], v)
                new = 4 / edge * (held[0] - (v * fixed) @ inside) - 2 * now - before
                return np.concatenate([new, now, v], axis=1), (v.T @ new).ravel()

            last = turn == degree
            made, sums = step(rows, wide_in, m, finish, wide * wide if last else locked * m)
            discard(state)
            state, inside = made, inside if last else sums.reshape(locked, m)
            rows = blocked.mapped(blocked.own(state), lambda s: s, wide)
        n, done = m, done + degree

    def basis(s):
        a, _, v = turned(s)
        return np.concatenate([v, a], axis=1)

    return state, basis, wide, locked + len(values)


def _cut_columns(wide: int, n: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, wide)[:, :n]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["block", "data"])

    return run


def truncated_svd(matrix: DataFrame, k: int, tolerance: float = 1e-9, max_iter: int = 1600, block_rows: int | None = None):
    """(gene, vec) with |U|, the singular values, and (cell, vec) with |V| of a sparse matrix (i, j, v).

    Filtered subspace iteration (``_dominant``) with k + 8 columns over the
    shorter side, until residuals show that the first k singular values are
    within ``tolerance`` of the first. A pass multiplies with the matrix and its
    transpose in one job while a basis is small enough for every task
    (``HELD_BYTES``, by a count), and by blocks beyond it. The signs are dropped
    as they are arbitrary; with a rank below k there are fewer values and shorter
    vectors. A matrix of at most ``block_rows`` rows a side is decomposed in a
    task.
    """
    held = materialize(matrix.select("i", "j", F.col("v").cast("double").alias("v")), "entries")
    keys = {side: held.select(F.col(side).alias("gene")).filter("gene is not null").distinct() for side in "ij"}
    n = {side: of.count() for side, of in keys.items()}
    small = block_rows or blocked.BLOCK_ROWS
    if max(n.values()) <= small:
        rows, columns = (blocked.index(keys[side], small) for side in "ij")
        made = blocked.tiles([held], rows, columns)
        discard(held)
        return _svd_of_tile(made, rows, columns, k)
    long, short = ("i", "j") if n["i"] >= n["j"] else ("j", "i")
    width = min(k + 8, n[short])
    whole = 8 * width * n[short] <= HELD_BYTES
    entries = held.count()
    # A strip or more for each task, unless they are small.
    strip = max(STRIP_ENTRIES >> 4, min(STRIP_ENTRIES, entries // (2 * matrix.sparkSession.sparkContext.defaultParallelism))) * n[long] // max(entries, 1) + 1
    fitted = blocked.fitted_rows(entries, n[long], n[short])
    rows = blocked.index(keys[long], block_rows or (min(strip, blocked.MOST_ROWS) if whole else fitted))
    columns = blocked.index(keys[short], block_rows or (blocked.MOST_ROWS if whole else fitted))
    made = blocked.tiles([held.select(F.col(long).alias("i"), F.col(short).alias("j"), "v")], rows, columns)
    discard(held)
    multiplier = _Strips(made) if whole else _Halves(made, rows)
    x, values, y = _decomposed(multiplier, rows, columns, n[short], width, k, tolerance, max_iter)
    if whole:
        multiplier.dealt.unpersist()
    discard(made)
    both = {long: x, short: y}
    return both["i"], values, both["j"].withColumnRenamed("gene", "cell")


def _decomposed(multiplier, rows: DataFrame, columns: DataFrame, n_columns: int, width: int, k: int, tolerance: float, max_iter: int):
    """(gene, vec) of both sides and the singular values between them, of the matrix that a multiplier has."""
    import numpy as np

    multiplier.n_columns = n_columns
    drawn = [F.pmod(F.xxhash64("gene", F.lit(c)), F.lit(1 << 30)).cast("double") / float(1 << 30) - 0.5 for c in range(width)]
    first = blocked.packed([columns.select("gene", F.array(*drawn).alias("vec"))], [width], columns)
    state, basis, wide, found = _dominant(multiplier, blocked.own(first), width, k, tolerance, max_iter)
    discard(first)
    ready = materialize(blocked.mapped(blocked.own(state), basis, wide), "basis")
    discard(state)
    left = blocked.own(materialize(multiplier.passed(blocked.own(ready), found, False), "basis"))
    left_small, r = _orthonormal(left, found)
    _, s, turned = np.linalg.svd(r)
    kept = int((s[:k] > 1e-10 * s.max(initial=0.0)).sum())
    rotated = turned[:kept].T
    both = []
    for blocks, change, of in ((left, lambda x: np.abs(x @ rotated / s[:kept]), rows), (blocked.own(ready), lambda x: np.abs(x @ rotated), columns)):
        both.append(materialize(blocked.unpacked(blocked.mapped(blocks, change, found), of, kept, slice(0, kept)), "singular-vectors") if kept else of.select("gene", F.array().cast("array<double>").alias("vec")))
        discard(blocks)
    if getattr(multiplier, "last", None) is not None:
        discard(multiplier.last)
    return both[0], [float(x) for x in s[:kept]], both[1]


class SharedTiles:
    """Square matrices in tiles over one index of more than a block, for the decompositions of several sums of them."""

    def __init__(self, made: DataFrame, of: DataFrame):
        self.made, self.of, self.n = made, of, of.count()
        self.strips, self.dealing = None, Lock()

    def left_vectors(self, nets: tuple[int, ...], k: int, tolerance: float = 1e-9, max_iter: int = 1600) -> DataFrame:
        """(gene, vec) with |U| of the sum of some of the matrices (see ``truncated_svd``)."""
        width = min(k + 8, self.n)
        if 8 * width * self.n <= HELD_BYTES:
            with self.dealing:  # decompositions run side by side, and the strips are dealt once
                self.strips = self.strips or _Strips(self.made)
            multiplier = self.strips.of(list(nets))
        else:
            multiplier = _Halves(self.made, self.of, nets)
        return _decomposed(multiplier, self.of, self.of, self.n, width, k, tolerance, max_iter)[0]

    def close(self) -> None:
        if self.strips is not None:
            self.strips.dealt.unpersist()


def _svd_of_tile(made: DataFrame, rows: DataFrame, columns: DataFrame, k: int):
    """``truncated_svd`` of a matrix that is one tile."""
    import numpy as np

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                dense = np.zeros((r["n_rows"], r["n_columns"]))
                ra, ca, v = blocked.entries(r["n"], r["ra"], r["ca"], r["v"])
                dense[ra, ca] = v
                u, s, v = np.linalg.svd(dense, full_matrices=False)
                n = int((s[:k] > 1e-10 * s.max(initial=0.0)).sum())
                arrays = [np.ascontiguousarray(np.abs(x)).tobytes() for x in (u[:, :n], v[:n].T)] + [s[:n].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([0] * 3, pa.int32()), pa.array(["u", "v", "s"]), pa.array(arrays, pa.binary())], ["block", "name", "data"])

    found = materialize(made.select("n_rows", "n_columns", "n", "ra", "ca", "v").mapInArrow(run, "block int, name string, data binary"), "singular-vectors")
    discard(made)
    values = [float(x) for r in found.filter("name = 's'").collect() for x in np.frombuffer(r["data"])]
    n = len(values)
    u, v = (blocked.unpacked(found.filter(F.col("name") == name), of, n, slice(0, n)) if n else of.select("gene", F.array().cast("array<double>").alias("vec")) for name, of in (("u", rows), ("v", columns)))
    return u, values, v.withColumnRenamed("gene", "cell")
