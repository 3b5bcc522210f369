"""k-means of many runs and restarts, and over several sets of columns, in the same passes.

Points are blocks (see ``blocked``); every model has its centres and the columns
that it clusters. A pass assigns each block's rows for all models by one matrix
product a model, and returns the sums by centre; centres that get no point stay.
Models stop by themselves; the pass goes on with the others. What reaches the
driver is (models x centres x dimension) numbers a pass.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocked
from sparkloom.session import discard, materialize

TOLERANCE = 1e-4


@dataclass
class Clustering:
    """One restart of one run over some columns; ``centres`` is filled when it is fitted."""

    columns: slice
    k: int
    run: object
    centres: object = None
    cost: float = float("inf")


def start_points(blocks: DataFrame, wide: int, of: DataFrame, models: list[Clustering], seed: int) -> None:
    """Centres from k different rows each, drawn evenly; only these rows reach the driver."""
    import numpy as np

    sizes = sorted((r["block"], r["n"]) for r in of.groupBy("block").agg(F.count("*").alias("n")).collect())  # a number a block
    ends = np.cumsum([n for _, n in sizes])
    rng, wanted = random.Random(seed), []
    for m in models:
        m.centres = np.full((m.k, m.columns.stop - m.columns.start), np.nan)
        wanted.append(rng.sample(range(int(ends[-1])), min(m.k, int(ends[-1]))))
    rows = sorted({r for picks in wanted for r in picks})
    at = np.searchsorted(ends, rows, side="right")
    where = [(int(sizes[b][0]), int(r - (ends[b - 1] if b else 0))) for r, b in zip(rows, at, strict=True)]
    asked = blocks.sparkSession.createDataFrame(where, "block int, at int").groupBy("block").agg(F.sort_array(F.collect_list("at")).alias("ats"))

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x, ats = np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, wide), batch.column(2)[k].as_py()
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(ats) + 1, dtype=np.int32) * wide), pa.array(x[ats].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(ats), pa.int32()), pa.array(ats, pa.int32()), vec], ["block", "at", "vec"])

    picked = blocks.join(asked, "block").select("block", "data", "ats").mapInArrow(pick, "block int, at int, vec array<double>").collect()  # models times k rows
    found = {(r["block"], r["at"]): r["vec"] for r in picked}
    row = dict(zip(rows, where, strict=True))
    for m, picks in zip(models, wanted, strict=True):
        for c, r in enumerate(picks):
            m.centres[c] = found[row[r]][m.columns]


def nearest(x, centres):
    """The nearest centre of each row (the first of equals; centres of nan are none) and the squared distances."""
    import numpy as np

    d = np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres)[None, :]
    d = np.where(np.isnan(d), np.inf, d)
    own = d.argmin(axis=1)
    return own, np.maximum(d[np.arange(len(x)), own], 0)


def one_pass(blocks: DataFrame, wide: int, models: list[Clustering], tasks: int):
    """For each model the counts, sums by centre, and cost."""
    import numpy as np

    shapes = [m.centres.shape for m in models]
    size = sum(k * (d + 1) + 1 for k, d in shapes)
    parts = [(m.columns, m.centres) for m in models]

    def of(x):
        out = []
        for columns, centres in parts:
            mine = x[:, columns]
            own, d = nearest(mine, centres)
            hot = np.zeros((len(mine), len(centres)))
            hot[np.arange(len(mine)), own] = 1
            out += [hot.sum(axis=0), (hot.T @ mine).ravel(), [d.sum()]]
        return np.concatenate(out)

    sums, at, out = blocked.summed(blocked.block_sums(blocks, of, wide, size), size, tasks), 0, []
    for k, d in shapes:
        out.append((sums[at : at + k], sums[at + k : at + k * (d + 1)].reshape(k, d), float(sums[at + k * (d + 1)])))
        at += k * (d + 1) + 1
    return out


def cluster_all(factors: list[DataFrame], widths: list[int], plans: list[tuple[int, int, object]], n_init: int = 10, seed: int = 1, max_iter: int = 300, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict]:
    """(run, cluster, gene) of the cheapest of ``n_init`` restarts of each plan, and the costs by run.

    ``factors`` (gene, vec) have the same genes; a plan is (factor number, k,
    name of the run). A restart ends when no centre moves by more than
    ``tolerance``.
    """
    import numpy as np

    genes = blocked.index(factors[0])
    packed = blocked.packed(factors, widths, genes)
    blocks, wide = blocked.own(packed), sum(widths)
    if not genes.limit(1).count():
        runs = factors[0].sparkSession.createDataFrame([(p[2],) for p in plans], ["run"]).schema["run"].dataType.simpleString()
        return factors[0].select(F.lit(None).cast(runs).alias("run"), F.lit(0).alias("cluster"), "gene").limit(0), {}
    edges = np.concatenate([[0], np.cumsum(widths)]).tolist()
    models = [Clustering(slice(edges[f], edges[f + 1]), k, run) for f, k, run in plans for _ in range(n_init)]
    start_points(blocks, wide, genes, models, seed)
    tasks = max(1, len(packed.inputFiles()))
    active = list(models)
    for _ in range(max_iter):
        moving = []
        for m, (n, sums, _) in zip(active, one_pass(blocks, wide, active, tasks), strict=True):
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], m.centres)
            shift = np.nanmax(((new - m.centres) ** 2).sum(axis=1), initial=0.0)
            m.centres = new
            if shift > tolerance**2:
                moving.append(m)
        active = moving
        if not active:
            break
    best: dict = {}
    for m, (_, _, cost) in zip(models, one_pass(blocks, wide, models, tasks), strict=True):
        m.cost = cost
        if m.run not in best or cost < best[m.run].cost:
            best[m.run] = m
    chosen = [(i, m.columns, m.centres) for i, m in enumerate(best.values())]

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                x, block = np.frombuffer(batch.column(1)[k].as_py()).reshape(-1, wide), batch.column(0)[k].as_py()
                for i, columns, centres in chosen:
                    own, _ = nearest(x[:, columns], centres)
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, i, np.int32)), pa.array(own.astype(np.int32))], ["block", "at", "_i", "cluster"])

    named = factors[0].sparkSession.createDataFrame([(i, run) for i, run in enumerate(best)], ["_i", "run"]).withColumn("_i", F.col("_i").cast("int"))
    out = blocks.mapInArrow(assign, "block int, at int, _i int, cluster int").join(genes, ["block", "at"]).join(F.broadcast(named), "_i")  # a row a run
    out = materialize(out.select("run", "cluster", "gene"), "clusterings")
    discard(packed)
    return out, {run: m.cost for run, m in best.items()}
