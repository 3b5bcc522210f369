"""Matrices in blocks: an index of rows, tiles of sparse entries, factors as block matrices.

An index deals keys to blocks of about ``BLOCK_ROWS`` rows, by hash, and numbers
them inside each block. A sparse matrix becomes tiles (row block, column block)
of at most the square of that many entries; tall factors become one dense array
a block, all their columns side by side. Products join tiles with the blocks of
their columns, and the partial products (only rows that a tile touches) are
added up in a stream ordered by row block: what a task holds is one block, one
tile and one partial product, however large the matrices are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialize

BLOCK_ROWS = 2048
#: Rows of a block where tiles are so sparse that larger ones have no more than so many entries.
MOST_ROWS, TILE_ENTRIES = 1 << 15, 1 << 20
#: Sums of tasks are collected as they are up to so many bytes; beyond it they are added up by Spark first.
DIRECT_BYTES = 1 << 20
#: Sparse entries whose products are held at once: few enough to stay in a core's cache.
ENTRIES = 1 << 13
#: A tile's key: numbers of matrix, row block and column block, so many bits for each block's.
BLOCK_BITS = 22
PARTS = "block int, kind int, places binary, data binary"
#: Kinds of rows beside products: a block's own columns come first, sums of tasks have no block.
OWN, SUMS = -1, -9


def index(keys: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """gene, block, at: the distinct keys (column gene, no nulls), written."""
    keys = keys.select("gene").filter("gene is not null").distinct()
    n_blocks = max(1, -(-keys.count() // rows))
    kind = keys.schema["gene"].dataType.simpleString()

    def number(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("gene")
        return table.select(["gene", "block"]).append_column("at", pa.array(np.arange(table.num_rows, dtype=np.int32)))

    dealt = keys.withColumn("block", F.pmod(F.xxhash64("gene"), F.lit(n_blocks)).cast("int"))
    return materialize(dealt.groupBy("block").applyInArrow(number, f"gene {kind}, block int, at int"), "index")


def fitted_rows(entries: int, n_rows: int, n_columns: int) -> int:
    """Rows of a block with which square tiles of a matrix have about ``TILE_ENTRIES`` entries.

    Partial products are as many rows as tiles touch: in tiles with few entries
    these are as many as the entries themselves.
    """
    side = (TILE_ENTRIES * n_rows * n_columns / max(entries, 1)) ** 0.5
    return int(min(max(side, BLOCK_ROWS), MOST_ROWS))


def even_rows(n: int, tasks: int) -> int:
    """Rows of a block with which n rows are blocks for so many tasks, ``BLOCK_ROWS`` at most; what fits into one block stays one."""
    return BLOCK_ROWS if n <= BLOCK_ROWS else max(BLOCK_ROWS >> 3, min(BLOCK_ROWS, -(-n // tasks)))


def tiles(matrices: list[DataFrame], rows: DataFrame, columns: DataFrame, first: int = 0) -> DataFrame:
    """net, rb, cb, n_rows, n_columns, n, ra, ca, v, square: the tiles of matrices (i, j, v) over two indexes, written.

    Matrices are numbered from ``first``. ``entries`` reads what a tile holds.

    Repeated entries are added up; entries with nulls, or with keys that an
    index lacks, are left out. ``square`` is the tile's sum of squares.
    """
    marked = [m.select(F.lit(k).alias("net"), "i", "j", F.col("v").cast("double").alias("v")) for k, m in enumerate(matrices, first)]
    entries = marked[0]
    for m in marked[1:]:
        entries = entries.unionAll(m)
    # Both indexes hold a number a key; Spark broadcasts what is small by its file size. Entries are moved and sorted by one
    # number that names their tile, beside one for their place in it.
    left = rows.select(F.col("gene").alias("i"), F.shiftleft(F.col("block").cast("long"), BLOCK_BITS).alias("rb"), F.shiftleft(F.col("at").cast("long"), 32).alias("ra"))
    right = columns.select(F.col("gene").alias("j"), F.col("block").alias("cb"), F.col("at").alias("ca"))
    tile = F.shiftleft(F.col("net").cast("long"), 2 * BLOCK_BITS) + F.col("rb") + F.col("cb")
    placed = entries.filter("v is not null").join(left, "i").join(right, "j").select(tile.alias("tile"), (F.col("ra") + F.col("ca")).alias("place"), "v")

    def pack(table):
        import numpy as np
        import pyarrow as pa

        tile = table.column("tile")[0].as_py()
        places, v = table.column("place").to_numpy(), table.column("v").to_numpy()
        order = np.argsort(places)
        places, v = places[order], v[order]
        first = np.flatnonzero(np.diff(places, prepend=-1))
        places, v = places[first], np.add.reduceat(v, first)
        mask = (1 << BLOCK_BITS) - 1
        head = [pa.array([x], pa.int32()) for x in (tile >> 2 * BLOCK_BITS, tile >> BLOCK_BITS & mask, tile & mask)]
        ra, ca = places >> 32, places & 0xFFFFFFFF
        kind = "<u2" if max(ra.max(), ca.max()) < 1 << 16 else "<i4"
        bodies = [pa.array([x.tobytes()], pa.binary()) for x in (ra.astype(kind), ca.astype(kind), v[:1] if np.all(v == v[0]) else v)]
        return pa.table([*head, pa.array([len(v)], pa.int32()), *bodies, pa.array([float(v @ v)])], ["net", "rb", "cb", "n", "ra", "ca", "v", "square"])

    packed = placed.groupBy("tile").applyInArrow(pack, "net int, rb int, cb int, n int, ra binary, ca binary, v binary, square double")
    sizes = lambda of, b, n: F.broadcast(of.groupBy(F.col("block").alias(b)).agg(F.count("*").cast("int").alias(n)))  # noqa: E731  # one row a block
    packed = packed.join(sizes(rows, "rb", "n_rows"), "rb").join(sizes(columns, "cb", "n_columns"), "cb").select("net", "rb", "cb", "n_rows", "n_columns", "n", "ra", "ca", "v", "square")
    return materialize(packed, "tiles")


def entries(n: int, ra, ca, v):
    """ra, ca, v as arrays: n places of 16 bits where these do, and one value for all where they are equal."""
    import numpy as np

    kind = "<u2" if len(ra) == 2 * n else "<i4"
    v = np.frombuffer(v)
    return np.frombuffer(ra, kind), np.frombuffer(ca, kind), v if len(v) == n else np.broadcast_to(v, n)


def squares(made: DataFrame) -> dict[int, float]:
    """The squared norm of each matrix of the tiles."""
    return {r["net"]: r["s"] for r in made.groupBy("net").agg(F.sum("square").alias("s")).collect()}  # one row a matrix


def product(ra, ca, v, n_rows: int, x):
    """The rows that the entries touch, and these rows of (entries) times x."""
    import numpy as np

    if 16 * len(v) >= n_rows * len(x):
        dense = np.zeros((n_rows, len(x)))
        dense[ra, ca] = v
        return np.arange(n_rows, dtype=np.int32), dense @ x
    if np.any(ra[1:] < ra[:-1]):
        # Numbers of 16 bits are sorted by counting.
        order = np.argsort(ra.astype(np.uint16, copy=False) if n_rows <= 1 << 16 else ra, kind="stable")
        ra, ca, v = ra[order], ca[order], v[order]
    starts = np.flatnonzero(np.concatenate([[True], ra[1:] != ra[:-1]]))
    places = ra[starts]
    out = np.zeros((len(places), x.shape[1]))
    row = np.repeat(np.arange(len(places)), np.diff(starts, append=len(ra)))
    for at in range(0, len(v), ENTRIES):
        part = slice(at, at + ENTRIES)
        first = np.flatnonzero(np.diff(row[part], prepend=-1))
        scaled = x.take(ca[part], axis=0)
        scaled *= v[part, None]
        out[row[part][first]] += np.add.reduceat(scaled, first, axis=0)
    return places.astype(np.int32), out


def products(made: DataFrame, factors: DataFrame, columns: dict[int, list[slice]], transposed: bool = False) -> DataFrame:
    """Partial products (``PARTS``; kind is the matrix) of tiles with factor blocks (block, data).

    ``columns`` has for each matrix the columns of the factors that it is
    multiplied with. With ``transposed`` blocks are of the tiles' rows, and the
    products belong to their columns.
    """
    mine, theirs = ("rb", "cb") if transposed else ("cb", "rb")
    wanted = made.filter(F.col("net").isin(list(columns)))
    met = wanted.join(factors.select(F.col("block").alias(mine), "data"), mine)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ra, ca, v = entries(r["n"], r["ra"], r["ca"], r["v"])
                n_rows, n_columns = (r["n_columns"], r["n_rows"]) if transposed else (r["n_rows"], r["n_columns"])
                x = np.frombuffer(r["data"]).reshape(n_columns, -1)
                x = np.concatenate([x[:, s] for s in columns[r["net"]]], axis=1)
                places, out = product(*((ca, ra) if transposed else (ra, ca)), v, n_rows, x)
                yield pa.RecordBatch.from_arrays([pa.array([r["to"]], pa.int32()), pa.array([r["net"]], pa.int32()), pa.array([places.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["block", "kind", "places", "data"])

    return met.select("net", F.col(theirs).alias("to"), "n_rows", "n_columns", "n", "ra", "ca", "v", "data").mapInArrow(run, PARTS)


def mapped(blocks: DataFrame, change: Callable, n_columns: int) -> DataFrame:
    """``PARTS`` of kind OWN: ``change`` applied to the array (rows, n_columns) of every block."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x = change(np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, n_columns))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([OWN], pa.int32()), pa.nulls(1, pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["block", "kind", "places", "data"])

    return blocks.select("block", "data").mapInArrow(run, PARTS)


def gathered(parts: DataFrame, n_own: int, widths: dict[int, int], finish: Callable, sums_size: int) -> DataFrame:
    """``PARTS`` of kind OWN with what ``finish`` makes of each block, and a row SUMS for each task.

    A block's own row comes first and says how many rows it has; partial
    products of each kind are added up. ``finish(own, products)`` returns the
    block's new array and a vector of ``sums_size`` numbers to be summed. Rows
    are ordered by block in each task, and one block is held at a time.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(sums_size)
        block, own, held = None, None, {}

        def done():
            new, sums = finish(own, held)
            total[:] += sums
            return row(block, OWN, np.ascontiguousarray(new).tobytes())

        def row(block, kind, data):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.nulls(1, pa.binary()), pa.array([data], pa.binary())], ["block", "kind", "places", "data"])

        for batch in batches:
            for k in range(batch.num_rows):
                here, kind = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                data = np.frombuffer(batch.column(3)[k].as_py())
                if kind == OWN:
                    if own is not None:
                        yield done()
                    block, own = here, data.reshape(-1, n_own)
                    held = {m: np.zeros((len(own), w)) for m, w in widths.items()}
                else:
                    held[kind][np.frombuffer(batch.column(2)[k].as_py(), "<i4")] += data.reshape(-1, widths[kind])
        if own is not None:
            yield done()
            yield row(None, SUMS, total.tobytes())

    return parts.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, PARTS)


def condensed(rows: DataFrame, size: int, tasks: int) -> DataFrame:
    """The vectors (data) of so many tasks, or at most ``DIRECT_BYTES`` of sums of them that other tasks make."""
    if tasks * size * 8 <= DIRECT_BYTES:
        return rows

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            for k in range(batch.num_rows):
                total += np.frombuffer(batch.column(0)[k].as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    # A shuffle: merging the tasks themselves would make fewer of them do the work before.
    return rows.repartition(max(1, DIRECT_BYTES // (size * 8))).mapInArrow(add, "data binary")


def summed(parts: DataFrame, size: int, tasks: int | None = None):
    """The vector of ``size`` numbers that the SUMS rows of some tasks (by default, of a written table's) add up to."""
    import numpy as np

    rows = parts.filter(F.col("kind") == SUMS).select("data")
    out = np.zeros(size)
    for r in condensed(rows, size, len(parts.inputFiles()) if tasks is None else tasks).collect():
        out += np.frombuffer(r["data"])
    return out


def block_sums(blocks: DataFrame, of: Callable, n_columns: int, size: int) -> DataFrame:
    """A row SUMS for each task: ``of(array)`` added up over its blocks."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            for k in range(batch.num_rows):
                total += of(np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, n_columns))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([SUMS], pa.int32()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["block", "kind", "places", "data"])

    return blocks.select("block", "data").mapInArrow(run, PARTS)


def own(parts: DataFrame) -> DataFrame:
    """The blocks of a written table."""
    return parts.filter(F.col("kind") == OWN).select("block", "data")


def packed(factors: list[DataFrame], widths: list[int], of: DataFrame) -> DataFrame:
    """``PARTS`` of kind OWN: factors (gene, vec) side by side; genes that a factor lacks have zeros there. Written."""
    parts = [f.select(F.lit(m).alias("m"), "gene", F.col("vec").cast("array<double>").alias("vec")) for m, f in enumerate(factors)]
    every = of.select("gene", "block", "at", F.lit(None).cast("int").alias("m"), F.lit(None).cast("array<double>").alias("vec"))
    for p in parts:
        every = every.unionByName(p.join(of, "gene"))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        m, at = table.column("m").fill_null(-1).to_numpy(), table.column("at").to_numpy()
        out = np.zeros((int(at.max()) + 1, sum(widths)))
        edge = 0
        for k, w in enumerate(widths):
            here = np.flatnonzero(m == k)
            if len(here):
                out[at[here], edge : edge + w] = np.array(table.column("vec").take(pa.array(here)).to_pylist()).reshape(len(here), w)
            edge += w
        return pa.table({"block": table.column("block")[:1], "kind": pa.array([OWN], pa.int32()), "places": pa.nulls(1, pa.binary()), "data": pa.array([out.tobytes()], pa.binary())})

    return materialize(every.groupBy("block").applyInArrow(pack, PARTS), "factors")


def unpacked(blocks: DataFrame, of: DataFrame, n_columns: int, columns: slice) -> DataFrame:
    """gene, vec: some columns of the blocks, by key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x = np.ascontiguousarray(np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, n_columns)[:, columns])
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), batch.column(0)[k].as_py(), np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), vec], ["block", "at", "vec"])

    return blocks.select("block", "data").mapInArrow(run, "block int, at int, vec array<double>").join(of, ["block", "at"]).select("gene", "vec")
