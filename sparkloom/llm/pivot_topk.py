"""Exact top-k by inner product with a pivot table (elimination by bounds).

Distances from every vector to many pivots (three quarters of the dimension,
``N_PIVOTS`` at most) are computed once, when vectors are packed into blocks.
Since 2 <x, p> = |x|^2 + |p|^2 - d(x, p)^2, they fix the part of x that lies in
the span of the pivots, and the length of what is left. So the largest lower
bound of d(q, x) that all pivots give together is

    d(q, x)^2 >= |Pq - Px|^2 + (|q - Pq| - |x - Px|)^2,

hence <q, x> <= <Pq, Px> + |q - Pq| |x - Px|. Candidates of a block are
evaluated in the order of these bounds until the next one is below the k-th
best score so far; then no other candidate of the block can enter.

Queries come as blocks too, and each meeting of a block of queries with a
group of candidate blocks is a group of its own, so the number of queries is
part of the task and no task holds all of them. A few groups go first (the
square root of their number); their k-th best scores are lines that later
groups start from, so these return only candidates at or above the line.
Results are merged by partial top-k and a final ranking.

Components become floor(1024 * x) with x as double; products are exact
integers (in 64 bits, wrapping like any long beyond that; vectors so large are
all evaluated).

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, nor do rows with a null id; vectors of different
dimensions are never compared; a query is not its own candidate, but another
row with its id is no candidate either; repeated rows with the same id are one
candidate if equal; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

TOP_K = 10
N_PIVOTS = 256
#: Pivots are chosen from this many vectors of a dimension at most.
PIVOT_SAMPLE = 2048
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Vectors of the candidate blocks that meet a block of queries in one group, about.
GROUP_ROWS = 16384
SCALE = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v (array<long>) of the distinct rows that take part."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & clean & (F.size("embedding") > 0))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    )


def hash_limit(wanted: int, rows: int) -> int:
    """The largest 64-bit hash that is drawn so that some more than ``wanted`` of ``rows`` are expected."""
    enough = 2 * wanted + 64
    return (1 << 63) - 1 if rows <= enough else (enough << 64) // rows - (1 << 63)


def choose_pivots(rows: DataFrame, n_pivots: int) -> dict[int, object]:
    """Vectors of a bounded sample for each dimension, each the farthest from the span of those before it."""
    import numpy as np

    counts = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row a dimension
    drawn = F.xxhash64("vec_id", "dim")
    out = {}
    for dim, n in sorted(counts.items()):
        sample = rows.filter((F.col("dim") == dim) & (drawn <= hash_limit(PIVOT_SAMPLE, n))).orderBy(drawn, "vec_id").limit(PIVOT_SAMPLE).collect()
        x = np.array([r["v"] for r in sample], dtype=np.float64)
        left, chosen = x.copy(), []
        for _ in range(max(1, min(n_pivots, 3 * dim // 4, len(x)))):
            size = np.einsum("ij,ij->i", left, left)
            best = int(np.argmax(size))
            if chosen and size[best] < 1.0:
                break
            chosen.append(best)
            axis = left[best] / (np.sqrt(size[best]) or 1.0)
            left -= np.outer(left @ axis, axis)
        out[dim] = x[chosen]
    return out


def distances(x, pivots):
    """From each vector to each pivot."""
    import numpy as np

    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def spanned(norms, table, pivots):
    """Coordinates in the span of the pivots, from the distances to them, and the length outside it."""
    import numpy as np

    own = (pivots * pivots).sum(axis=1)
    products = (norms[:, None] + own[None, :] - table * table) / 2
    values, vectors = np.linalg.eigh(pivots @ pivots.T)
    use = values > 1e-9 * max(values.max(initial=0), 1e-300)
    inside = products @ (vectors[:, use] / np.sqrt(values[use]))
    return inside, np.sqrt(np.maximum(norms - (inside * inside).sum(axis=1), 0))


def blocks(rows: DataFrame, pivots: dict[int, object], block_rows: int) -> DataFrame:
    """number, dim, ids, vectors, table: packed vectors with their distances to the pivots."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        held: dict[int, tuple[list, list]] = {}
        number = TaskContext.get().partitionId()

        def pack(dim, ids, vectors):
            nonlocal number
            v = np.concatenate(vectors).reshape(-1, dim)
            number += 1
            return pa.RecordBatch.from_pydict(
                {"number": pa.array([number], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 "vectors": pa.array([v.astype("<i8").tobytes()], pa.binary()), "table": pa.array([distances(v.astype(np.float64), pivots[dim]).astype("<f8").tobytes()], pa.binary())}
            )

        for batch in batches:
            column = batch.column(2)
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for k, (vec_id, dim) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids, vectors = held.setdefault(dim, ([], []))
                ids.append(vec_id)
                vectors.append(flat[offsets[k] : offsets[k + 1]].copy())
                if len(ids) == block_rows:
                    yield pack(dim, *held.pop(dim))
        for dim, (ids, vectors) in held.items():
            yield pack(dim, ids, vectors)

    return rows.filter(F.col("dim").isin(*pivots) if pivots else F.lit(False)).select("vec_id", "dim", "v").mapInArrow(run, "number long, dim int, ids binary, vectors binary, table binary")


class Packed:
    """One block: ids, integer vectors, and their coordinates by the pivots."""

    def __init__(self, ids: bytes, vectors: bytes, table: bytes, pivots):
        import numpy as np

        dim = pivots.shape[1]
        self.ids, self.vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)
        x = self.vectors.astype(np.float64)
        norms = (x * x).sum(axis=1)
        self.size, self.most = np.sqrt(norms), float(np.abs(x).max(initial=0))
        self.inside, self.outside = spanned(norms, np.frombuffer(table, "<f8").reshape(len(x), -1), pivots)


def search_block(queries: Packed, block: Packed, k: int, best: dict) -> int:
    """Merges the best of one block into ``best``; returns how many products were evaluated.

    ``best`` holds for each query's place (scores, ids, line): the best k so
    far, and a score below which nothing can enter.
    """
    import numpy as np

    evaluated = 0
    dim = block.vectors.shape[1]
    fits = block.most * queries.most * dim
    as_float = fits < 2.0**53
    x = block.vectors.astype(np.float64) if as_float else block.vectors
    bounds = queries.inside @ block.inside.T + np.outer(queries.outside, block.outside)
    # Above any rounding of distances and coordinates; products that may wrap have no bound.
    bounds += 1e-6 * np.outer(queries.size, block.size) + 1 if fits < 2.0**62 else np.inf
    for q, query_id in enumerate(queries.ids.tolist()):
        scores, ids, line = best[q]
        order = np.argsort(-bounds[q], kind="stable") if line is None else None
        if order is None:
            some = np.flatnonzero(bounds[q] >= line)
            order = some[np.argsort(-bounds[q][some], kind="stable")]
        bound, vector = bounds[q][order], queries.vectors[q].astype(x.dtype)
        at, step = 0, 4 * k
        while at < len(order) and (line is None or bound[at] >= line):
            take = order[at : at + step]
            at += len(take)
            evaluated += len(take)
            take = take[block.ids[take] != query_id]
            found = (x[take] @ vector).astype(np.int64)
            if line is not None:
                take, found = take[found >= line], found[found >= line]
            scores, ids = np.concatenate([scores, found]), np.concatenate([ids, block.ids[take]])
            # Repeated rows: the same id and score counts once.
            place = np.lexsort((ids, -scores))
            scores, ids = scores[place], ids[place]
            fresh = np.ones(len(ids), dtype=bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
            scores, ids = scores[fresh][:k], ids[fresh][:k]
            if len(scores) == k:
                line = int(scores[-1]) if line is None else max(line, int(scores[-1]))
            step *= 2
        best[q] = (scores, ids, line)
    return evaluated


HITS = "query_id long, vec_id long, score long, evaluated long"


def meetings(asked: DataFrame, candidates: DataFrame, groups: tuple[int, int], n_buckets: int, pivots: dict[int, object], k: int) -> DataFrame:
    """The best k of each query in each group of candidate blocks, from its line on if it has one.

    ``asked`` has bucket, dim, ids, vectors, table and lines (a score or null
    for each query); groups go from the first number to before the second. A
    row with a null query tells how many products a meeting took.
    """
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(pivots)  # at most N_PIVOTS vectors a dimension
    # Every bucket of queries meets every group: both sides are copied, in blocks.
    spread = asked.withColumn("g", F.explode(F.sequence(F.lit(groups[0]), F.lit(groups[1] - 1))))
    here = candidates.filter(F.col("g").between(groups[0], groups[1] - 1)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))

    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        out, evaluated = [], 0
        for i in range(left.num_rows):
            dim = left.column("dim")[i].as_py()
            p = shared.value[dim]
            queries = Packed(*(left.column(c)[i].as_py() for c in ("ids", "vectors", "table")), p)
            lines = left.column("lines")[i].as_py() or [None] * len(queries.ids)
            empty = np.zeros(0, dtype=np.int64)
            best = {q: (empty, empty, line) for q, line in enumerate(lines)}
            for j in range(right.num_rows):
                if right.column("dim")[j].as_py() == dim:
                    evaluated += search_block(queries, Packed(*(right.column(c)[j].as_py() for c in ("ids", "vectors", "table")), p), k, best)
            out += [(int(queries.ids[q]), i_, s_, None) for q, (s, ids, _) in best.items() for i_, s_ in zip(ids.tolist(), s.tolist(), strict=True)]
        out.append((None, None, None, evaluated))
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score", "evaluated"))})

    columns = ("bucket", "g", "dim", "ids", "vectors", "table")
    return spread.select(*columns, "lines").groupBy("bucket", "g").cogroup(here.select(*columns).groupBy("bucket", "g")).applyInArrow(meet, HITS)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.filter(F.col("query_id").isNotNull()).select("query_id", "vec_id", "score").distinct()
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def meet_all(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, n_pivots: int = N_PIVOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All hits of all meetings (see ``meetings``), written."""
    rows = materialize(quantised(vectors), "vectors")
    pivots = choose_pivots(rows, n_pivots)
    n_groups = max(1, -(-rows.count() // group_rows))
    n_first = max(1, round(n_groups**0.5))
    candidates = materialize(blocks(rows, pivots, BLOCK_ROWS), "vector-blocks").withColumn("g", F.pmod("number", F.lit(n_groups)).cast("int"))
    wanted = materialize(quantised(queries), "queries")
    n_buckets = max(1, -(-wanted.count() // QUERY_ROWS))
    asked = materialize(
        blocks(wanted, pivots, QUERY_ROWS).select(F.pmod("number", F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64("ids", "vectors").alias("key"), "dim", "ids", "vectors", "table"), "query-blocks"
    )
    unlined = asked.withColumn("lines", F.lit(None).cast("array<long>"))
    first = materialize(meetings(unlined, candidates, (0, n_first), n_buckets, pivots, k), "first-hits")
    if n_first == n_groups:
        return first
    kth = ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("line"))

    def attach(left, right):
        import numpy as np
        import pyarrow as pa

        line = dict(zip(right.column("query_id").to_pylist(), right.column("line").to_pylist(), strict=True))
        lists = [[line.get(i) for i in np.frombuffer(x, "<i8").tolist()] for x in left.column("ids").to_pylist()]
        return left.append_column("lines", pa.array(lists, pa.list_(pa.int64())))

    # Each query's line goes to the block that holds the query.
    def listed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            keys = np.repeat(batch.column(0).to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(ids) if ids else keys, pa.int64())], ["key", "query_id"])

    places = asked.select("key", "ids").mapInArrow(listed, "key long, query_id long")
    lined = places.join(kth, "query_id").select("key", "query_id", "line").distinct()
    again = asked.groupBy("key").cogroup(lined.groupBy("key")).applyInArrow(attach, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unlined.schema))
    later = meetings(materialize(again, "lined-queries"), candidates, (n_first, n_groups), n_buckets, pivots, k)
    return materialize(first.unionAll(later), "hits")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, n_pivots: int = N_PIVOTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: exact top k of every query among ``vectors``.

    Both have vec_id and embedding.
    """
    return ranked(meet_all(vectors, queries, k, n_pivots, group_rows), k)


def op10_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
