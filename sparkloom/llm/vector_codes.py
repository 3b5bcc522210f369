"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry.

Lloyd's rounds with Yinyang bounds. Components become integers floor(1024 * x),
and vectors are cut into ``PARTS`` consecutive parts. The codebook of each part
starts as that part of the rows with the ``ENTRIES`` smallest ids; a round
assigns every part to its nearest entry (squared Euclidean distance, ties to the
lower number), then replaces each entry by the floor of its parts' mean.

1. Vectors are packed into blocks of ``BLOCK_ROWS``. A block carries what the
   last pass knew of each of its parts: the entry, an upper bound of the
   distance to it, and for each group of entries a lower bound of the distance
   to any other of the group (entries are put into groups once, by a few rounds
   over the first codebook).
2. Each pass is one job. Entries have moved, so the upper bound grows by the
   entry's drift and a group's lower bound sinks by the largest drift in it;
   only parts whose upper bound is not below all lower bounds compute the
   distance to their own entry, and of these only groups whose bound still
   fails are scanned. The same pass gives the sums of its parts by entry, once
   a task, and writes the blocks for the next pass; those before are deleted.
3. Bounds are floats, rounded to the safe side. Distances in a scan are floats
   with a known error; whatever is within it of the best is compared in
   integers, so ties and near ties are decided exactly.

The driver holds the codebooks (entries times dimension) and their sums, which
do not grow with the rows.

Defined results: a null vector, or one with null or non-finite components, is
dropped, as is an empty one; the smallest id's vector (nulls last, then by
components) decides the dimension, and vectors of another are dropped; where
the dimension is no multiple of the number of parts, parts differ by one; with
fewer rows than entries the codebook has as many entries as rows; rows with
equal or null ids are rows like any other; a component of 2 ** 28 or more after
scaling is an error, as distances would not fit 64 bits; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sparkloom.session import discard

from .common import materialize, read_table, small_batches

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUPS = 16
BLOCK_ROWS = 2048
LIMIT = 1 << 28
#: A part's float distances are off by less than this share of the numbers that they are made of.
SHARE = 2.0**-40
#: Labels that are broadcast with their sums, at most.
SMALL_LABELS = 100_000


def kept_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array<long>) of the rows that take part, of any dimension."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    integers = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & clean).select(F.col("vec_id").cast("long").alias("vec_id"), "label", integers.alias("v"))


def bounds_of(dim: int, parts: int) -> list[int]:
    """Where each part begins, and the dimension."""
    return [k * dim // parts for k in range(parts + 1)]


def groups_of(book, n_groups: int):
    """A group number for each entry of a codebook (5 rounds of Lloyd over the entries themselves)."""
    import numpy as np

    k = len(book)
    centres = book[np.linspace(0, k - 1, min(n_groups, k)).astype(int)].astype(float)
    for _ in range(5):
        nearest = ((book[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(centres)):
            if (nearest == g).any():
                centres[g] = book[nearest == g].mean(axis=0)
    return nearest


def distances(x, book):
    """Squared distances of rows to entries as floats, and a bound of their errors, by row."""
    import numpy as np

    x, book = x.astype(float), book.astype(float)
    own, theirs = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", book, book)
    return np.maximum(own[:, None] - 2 * (x @ book.T) + theirs[None, :], 0), (own + theirs.max(initial=0) + 1) * SHARE


def exact(x, entries):
    """Squared distances in integers, row by row."""
    import numpy as np

    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def nearest_two(x, book, numbers):
    """For each row its nearest entry (number, exact squared distance) and a float not above the next entry's."""
    import numpy as np

    d, error = distances(x, book)
    best = d.argmin(axis=1)
    rows = np.arange(len(x))
    least = d[rows, best]
    close = d <= (least + 2 * error)[:, None]
    found, size = numbers[best], exact(x, book[best])
    for r in np.flatnonzero(close.sum(axis=1) > 1):
        some = np.flatnonzero(close[r])
        true = exact(x[r][None, :], book[some])
        k = np.lexsort((numbers[some], true))[0]
        best[r], found[r], size[r] = some[k], numbers[some[k]], true[k]
    d[rows, best] = np.inf
    return found, size, np.maximum(d.min(axis=1, initial=np.inf) - error, 0)


def below(x):
    """Square roots as float32, not above the true ones."""
    import numpy as np

    with np.errstate(over="ignore"):
        return np.nextafter(np.sqrt(x).astype(np.float32), np.float32(0))


def above(x):
    import numpy as np

    return np.nextafter(np.sqrt(x).astype(np.float32), np.float32(np.inf))


def first_assignment(x, book, groups, n_groups: int):
    """Entry, exact distance, upper bound and lower bounds of each row, from all distances."""
    import numpy as np

    n = len(x)
    own, size = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    lower = np.full((n, n_groups), np.inf, dtype=np.float32)
    nearest, following = np.full((n, n_groups), np.inf), np.full((n, n_groups), np.inf)
    for g in range(n_groups):
        members = np.flatnonzero(groups == g)
        if not len(members):
            continue
        entry, d, after = nearest_two(x, book[members], members)
        nearest[:, g], following[:, g] = d, after
        better = (d < size) | ((d == size) & (entry < own))
        own[better], size[better] = entry[better], d[better]
    lower[:] = below(nearest)
    rows = np.arange(n)
    lower[rows, groups[own]] = below(following[rows, groups[own]])
    return own, size, above(size), lower


def next_assignment(x, book, groups, drift, own, upper, lower):
    """As ``first_assignment``, from the last one and how far each entry has moved; also how many distances were computed.

    The exact distance is known only for rows that were looked at (else -1).
    """
    import numpy as np

    n, n_groups = lower.shape
    moved = np.zeros(n_groups)
    np.maximum.at(moved, groups, drift)
    upper = np.nextafter((upper + np.nextafter(drift.astype(np.float32), np.float32(np.inf))[own]).astype(np.float32), np.float32(np.inf))
    lower = np.nextafter(np.maximum(lower - np.nextafter(moved.astype(np.float32), np.float32(np.inf)), 0).astype(np.float32), np.float32(0))
    own, size = own.copy(), np.full(n, -1, dtype=np.int64)
    open_rows = np.flatnonzero(upper >= lower.min(axis=1))
    size[open_rows] = exact(x[open_rows], book[own[open_rows]])
    upper[open_rows] = above(size[open_rows])
    asked = upper[open_rows, None] >= lower[open_rows]
    before, before_size = own[open_rows].copy(), size[open_rows].copy()
    computed = len(open_rows)
    scanned = []
    for g in np.flatnonzero(asked.any(axis=0)):
        members = np.flatnonzero(groups == g)
        rows = open_rows[asked[:, g]]
        computed += len(rows) * len(members)
        entry, d, after = nearest_two(x[rows], book[members], members)
        scanned.append((g, rows, entry, d, after))
        better = (d < size[rows]) | ((d == size[rows]) & (entry < own[rows]))
        own[rows[better]], size[rows[better]] = entry[better], d[better]
    for g, rows, entry, d, after in scanned:
        lower[rows, g] = np.where(own[rows] == entry, below(after), below(d))
    # An entry that was left counts among the others of its group, if that was not scanned.
    left = own[open_rows] != before
    rows, g = open_rows[left], groups[before[left]]
    lower[rows, g] = np.minimum(lower[rows, g], below(before_size[left]))
    upper[open_rows] = above(size[open_rows])
    return own, size, upper, lower, computed


def packed(rows: DataFrame, dim: int, block_rows: int) -> DataFrame:
    """Blocks of rows: ids and labels as lists, vectors as bytes, no state yet."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                v = part.column(2)
                x = np.asarray(v.flatten()).reshape(-1, dim)
                if np.abs(x).max(initial=0) >= LIMIT:
                    raise ValueError(f"a component reaches {LIMIT} after scaling by {SCALE}: its distances do not fit 64 bits")
                small = x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x.astype("<i4")
                wrap = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c]))
                yield pa.RecordBatch.from_arrays([wrap(part.column(0)), wrap(part.column(1)), pa.array([small.tobytes()], pa.binary()), pa.array([small.itemsize], pa.int32())], ["vec_ids", "labels", "vectors", "width"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_ids array<bigint>, labels array<{kind}>, vectors binary, width int")


STATE = "own binary, upper binary, lower binary"
SUMS = "part int, entry int, n long, total array<bigint>, computed long"


def one_pass(blocks: DataFrame, books: list, groups: list, drifts: list | None, last: bool) -> DataFrame:
    """The blocks with new state, and a row of sums for each task, part and entry; of the last pass the rows themselves."""
    edges = bounds_of(sum(b.shape[1] for b in books), len(books))
    n_groups = 1 + max(int(g.max()) for g in groups)
    kind = blocks.schema["labels"].dataType.elementType.simpleString()
    block_schema = f"vec_ids array<bigint>, labels array<{kind}>, vectors binary, width int, {STATE}, {SUMS}"

    def state_of(batch, k, name, of_type, shape):
        import numpy as np

        return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_py(), of_type).reshape(shape)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        totals = [np.zeros(b.shape, dtype=np.int64) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        computed = np.zeros(len(books), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                width = batch.column(3)[k].as_py()
                x = np.frombuffer(batch.column(2)[k].as_py(), f"<i{width}").reshape(-1, edges[-1]).astype(np.int64)
                owns, uppers, lowers, error = [], [], [], np.zeros(len(x), dtype=np.int64)
                for p, (book, of) in enumerate(zip(books, groups, strict=True)):
                    mine = np.ascontiguousarray(x[:, edges[p] : edges[p + 1]])
                    if drifts is None:
                        own, size, upper, lower = first_assignment(mine, book, of, n_groups)
                        computed[p] += len(mine) * len(book)
                    else:
                        own = state_of(batch, k, "own", np.uint8, (len(books), -1))[p].astype(np.int64)
                        upper = state_of(batch, k, "upper", np.float32, (len(books), -1))[p]
                        lower = state_of(batch, k, "lower", np.float32, (len(books), -1, n_groups))[p]
                        own, size, upper, lower, some = next_assignment(mine, book, of, drifts[p], own, upper, lower)
                        computed[p] += some
                    if last:
                        unknown = size < 0
                        size[unknown] = exact(mine[unknown], book[own[unknown]])
                        error += size
                    else:
                        order = np.argsort(own, kind="stable")
                        entries, first = np.unique(own[order], return_index=True)
                        if mine.shape[1]:
                            totals[p][entries] += np.add.reduceat(mine[order], first, axis=0)
                        counts[p] += np.bincount(own, minlength=len(book))
                    owns.append(own.astype(np.uint8))
                    uppers.append(upper)
                    lowers.append(lower)
                if last:
                    codes = np.stack(owns, axis=1).tobytes().hex()
                    codes = [codes[i : i + 2 * len(books)] for i in range(0, len(codes), 2 * len(books))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).flatten(), batch.column(1).slice(k, 1).flatten(), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
                else:
                    state = [pa.array([np.stack(s).astype(t, copy=False).tobytes()], pa.binary()) for s, t in ((owns, np.uint8), (uppers, np.float32), (lowers, np.float32))]
                    nothing = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(4)], *state, *nothing], names)
        if not last:
            for p in range(len(books)):
                used = np.flatnonzero(counts[p])
                m = len(used)
                empty = [pa.nulls(m, t) for t in (pa.list_(pa.int64()), label_list, pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                work = np.zeros(m, dtype=np.int64)
                work[:1] = computed[p]
                total = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * totals[p].shape[1], pa.int32()), pa.array(totals[p][used].ravel()))
                yield pa.RecordBatch.from_arrays([*empty, pa.array([p] * m, pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]), total, pa.array(work)], names)

    names = ["vec_ids", "labels", "vectors", "width", "own", "upper", "lower", "part", "entry", "n", "total", "computed"]
    from pyspark.sql.pandas.types import to_arrow_type

    label_list = to_arrow_type(blocks.schema["labels"].dataType)
    if last:
        return blocks.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")
    return blocks.mapInArrow(run, block_schema)


def refined(written: DataFrame, books: list) -> tuple[list, list, int]:
    """New codebooks, how far each entry moved, and how many distances the pass computed."""
    import numpy as np

    width = max(b.shape[1] for b in books)
    sums = written.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(d))) for d in range(width)]).alias("total"), F.sum("computed").alias("computed"))
    new = [b.copy() for b in books]
    computed = 0
    for r in sums.collect():  # parts times entries
        book = new[r["part"]]
        book[r["entry"]] = [int(s) // r["n"] for s in r["total"][: book.shape[1]]]
        computed += r["computed"]
    drifts = [np.sqrt(((a - b).astype(float) ** 2).sum(axis=1)) * (1 + 1e-12) for a, b in zip(new, books, strict=True)]
    return new, drifts, computed


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, n_groups: int = GROUPS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list, list[int]]:
    """(vec_id, label, code, error), the codebooks, and the distances that each pass before the last computed.

    ``vectors`` has vec_id, embedding and label. At most 256 entries, so that a code is two hex digits.
    """
    import numpy as np

    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    kept = kept_rows(vectors)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    kind = kept.schema["label"].dataType.simpleString()
    if not first:
        return kept.sparkSession.createDataFrame([], StructType([StructField("vec_id", kept.schema["vec_id"].dataType), kept.schema["label"]])).select("*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [], []
    dim = len(first[0]["v"])
    edges = bounds_of(dim, parts)
    kept = kept.filter(F.size("v") == dim)
    seeds = np.array([r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()], dtype=object)
    if np.abs(seeds).max() >= LIMIT:
        raise ValueError(f"a component reaches {LIMIT} after scaling by {SCALE}: its distances do not fit 64 bits")
    seeds = seeds.astype(np.int64)
    books = [np.ascontiguousarray(seeds[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    groups = [groups_of(b, n_groups) for b in books]
    with small_batches(kept.sparkSession):
        blocks, drifts, work = materialize(packed(kept, dim, block_rows), "vector-blocks"), None, []
        for _ in range(rounds):
            written = materialize(one_pass(blocks, books, groups, drifts, False), "assigned-blocks")
            discard(blocks)
            books, drifts, computed = refined(written, books)
            work.append(computed)
            blocks = written.filter("part is null").drop("part", "entry", "n", "total", "computed")
        codes = materialize(one_pass(blocks, books, groups, drifts, True), "codes")
        discard(blocks)
    assert codes.schema["label"].dataType.simpleString() == kind
    return codes, books, work


def digest(books: list) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def coded(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (of all rows with the label, nulls together), codebooks_sha256."""
    codes, books, _ = compress(vectors, **options)
    sums = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= SMALL_LABELS else sums
    joined = codes.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the query; the dimension is a multiple of the number of parts."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, g.part, list_slice(e, g.part * len(e) // {parts} + 1, (g.part + 1) * len(e) // {parts}) AS x FROM v, range({parts}) AS g(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, part, min(row(d, entry)) AS best FROM (
    SELECT p.r, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b ON b.part = p.part)
  GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT p.part, a.best[2] AS entry, i.i, sum(p.x[i.i])::DOUBLE AS s, count(*) AS n
    FROM p JOIN a{k} a ON a.r = p.r AND a.part = p.part JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) i ON i.i <= len(p.x) GROUP BY ALL)
  GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)""")
    return "WITH " + ",".join(steps) + f""",
f AS (SELECT r, string_agg(printf('%02x', best[2]::INTEGER), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN f ON f.r = v.r
"""


OP12_SQL = oracle_sql()
