"""Non-negative matrix tri-factorisation, many models at once, on matrices in blocks.

Joint model: minimise sum_i |A_i - G1 S_i G1'|^2 + |E - G1 S_E G2'|^2 with
G1, G2 >= 0. Without networks it is the expression-only model; without an
expression matrix the symmetric model.

The models of a fit share the matrices and differ in which of them they use
(``Model``). A block of the state holds the rows of all models side by side, so
one pass over a tile serves every model that uses its matrix. A turn is two
jobs:

* over genes: G1 is updated on the fly from the last turn's products, its tiles
  are multiplied, and per block the new products A_i G1 and E G2 are written
  with the k x k sums G1'G1, G1'A_i G1, G1'E G2 and G2'G2;
* over cells: E'G1 of the updated G1, written with G1'G1.

What is written is each time the state and the products that its next update
needs; the update itself is only arithmetic on a block's rows with the k x k
matrices that the driver solves from the sums. Residuals are never formed: the
objective is in trace form. A turn's tables are deleted when the next turn has
been written, and a lost executor costs a re-read of them.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocked
from sparkloom.session import discard, materialize

EPSILON = 1e-5
TOLERANCE = 1e-3
TEST_EVERY = 10


@dataclass
class Factors:
    """The fitted model; ``trace``: (iteration, objective, relative error)."""

    g1: DataFrame | None
    g2: DataFrame | None
    s_networks: list
    s_expression: object
    trace: list[tuple[int, float, float]] = field(default_factory=list)


@dataclass
class Model:
    """The networks (by number) that a model fuses, whether with the expression matrix, and its sizes.

    ``stale_projection`` keeps the initial G1 and its Gram matrix for the
    projection that gives the expression's middle matrix.
    """

    name: str
    networks: tuple[int, ...]
    k1: int
    k2: int
    expression: bool = True
    stale_projection: bool = False


def random_factor(genes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """gene, vec: entries in (0, 1) from a hash of gene, column and seed."""
    def entry(c):
        return (F.pmod(F.xxhash64("gene", F.lit(c), F.lit(seed)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)

    return genes.select("gene", F.array(*[entry(c) for c in range(k)]).alias("vec"))


def svd_factor(matrices: list[DataFrame], genes: DataFrame, k: int, side: str = "u") -> DataFrame:
    """The absolute left (or right) singular vectors of the sum of the matrices, plus EPSILON.

    Columns beyond the rank are EPSILON.
    """
    from sparkloom.operators.linalg import truncated_svd

    total = matrices[0]
    for m in matrices[1:]:
        total = total.unionAll(m)
    u, _, v = truncated_svd(total, k)
    return _filled(genes, u if side == "u" else v.withColumnRenamed("cell", "gene"), k)


def _filled(genes: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Some genes' vectors at k entries for all genes, plus EPSILON."""
    full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.get("vec", c), F.lit(0.0)) + EPSILON)
    return genes.join(found, "gene", "left").select("gene", full.alias("vec"))


def _inverse(m):
    import numpy as np

    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


def _parts(m):
    import numpy as np

    return (np.abs(m) + m) / 2, (np.abs(m) - m) / 2


def _updated(x, products: list, plus, minus):
    """Multiplicative update of rows: x * sqrt((P+ + x minus + e) / (P- + x plus + e)) + e, P+ and P- of each product."""
    import numpy as np

    num, den = x @ minus, x @ plus
    for p in products:
        num, den = num + np.maximum(p, 0), den + np.maximum(-p, 0)
    return x * np.sqrt((num + EPSILON) / (den + EPSILON)) + EPSILON


class _Layout:
    """Where each model's columns lie in the arrays of genes and of cells."""

    def __init__(self, models: list[Model], active: list[int], n_networks: int):
        self.models, self.active, self.n_networks = models, active, n_networks
        take = lambda ks: [slice(a, a + k) for a, k in zip([sum(ks[:i]) for i in range(len(ks))], ks, strict=True)]
        self.g1, self.g2 = take([m.k1 for m in models]), take([m.k2 for m in models])
        self.wide1, self.wide2 = sum(m.k1 for m in models), sum(m.k2 for m in models)
        # The initial G1 of models with a stale projection stays beside G1.
        at, self.first = self.wide1, {}
        for i, m in enumerate(models):
            if m.stale_projection and m.expression:
                self.first[i] = slice(at, at + m.k1)
                at += m.k1
        self.state1 = at
        self.users = {a: [i for i in active if a in models[i].networks] for a in range(n_networks)}
        self.users[n_networks] = [i for i in active if models[i].expression]
        self.users = {a: who for a, who in self.users.items() if who}
        self.products: dict[tuple[int, int], slice] = {}
        for a, who in self.users.items():
            for i in who:
                k = models[i].k2 if a == n_networks else models[i].k1
                self.products[i, a] = slice(at, at + k)
                at += k
        self.row1 = at
        self.back: dict[int, slice] = {}
        at = self.wide2
        for i in self.users.get(n_networks, []):
            self.back[i] = slice(at, at + models[i].k1)
            at += models[i].k1
        self.row2 = at

    def widths(self) -> dict[int, int]:
        return {a: sum(self.products[i, a].stop - self.products[i, a].start for i in who) for a, who in self.users.items()}

    def sums(self) -> tuple[list[tuple[str, int, int, tuple[int, int]]], int]:
        """(kind, model, matrix, shape) of the k x k sums over genes and cells, and their size in all."""
        e, out = self.n_networks, []
        for i in self.active:
            m = self.models[i]
            out.append(("gram1", i, 0, (m.k1, m.k1)))
            out += [("cross", i, a, (m.k1, m.k1)) for a in m.networks]
            if m.expression:
                out += [("cross", i, e, (m.k1, m.k2)), ("gram2", i, 0, (m.k2, m.k2))]
                out += [("first", i, e, (m.k1, m.k2)), ("first_gram", i, 0, (m.k1, m.k1))] if i in self.first else []
        return out, sum(a * b for *_, (a, b) in out)


def _cut(vector, shapes) -> dict:
    out, at = {}, 0
    for kind, i, a, (rows, columns) in shapes:
        out[kind, i, a] = vector[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
    return out


def _keep(x):
    return x


class _Tables:
    """The state of a fit in Spark: written tables with the last products, and the updates that are still to be applied to them."""

    def __init__(self, base1: DataFrame, base2: DataFrame | None, net_tiles: DataFrame | None, cell_tiles: DataFrame | None, at: _Layout):
        self.base1, self.base2, self.net_tiles, self.cell_tiles = base1, base2, net_tiles, cell_tiles
        self.change1: Callable = _keep
        self.change2: Callable = _keep
        self.row1, self.row2 = at.state1, at.wide2

    def _genes(self) -> DataFrame:
        return blocked.mapped(blocked.own(self.base1), self.change1, self.row1)

    def _cells(self) -> DataFrame:
        return blocked.mapped(blocked.own(self.base2), self.change2, self.row2)

    def over_genes(self, at: _Layout):
        e, (shapes, size) = at.n_networks, at.sums()
        parts = genes = self._genes()
        of_nets = {a: [at.g1[i] for i in who] for a, who in at.users.items() if a < e}
        if of_nets:
            parts = parts.unionAll(blocked.products(self.net_tiles, genes, of_nets))
        if e in at.users:
            parts = parts.unionAll(blocked.products(self.cell_tiles, self._cells(), {e: [at.g2[i] for i in at.users[e]]}))
        made = blocked.gathered(parts, at.state1, at.widths(), _gene_sums(at, shapes), size)
        if e in at.users:
            made = made.unionAll(blocked.block_sums(blocked.own(self.base2), _cell_sums(at, shapes, self.change2), self.row2, size))
        made = materialize(made, "genes")
        sums = blocked.summed(made, size)
        discard(self.base1)
        self.base1, self.row1 = made, at.row1
        return sums

    def over_cells(self, at: _Layout, lay: _Layout):
        e, who = at.n_networks, lay.active
        cut, size = [at.g1[i] for i in who], sum(at.models[i].k1 ** 2 for i in who)
        back = blocked.products(self.cell_tiles, self._genes(), {e: cut}, transposed=True)
        made = blocked.gathered(self._cells().unionAll(back), at.wide2, {e: sum(at.models[i].k1 for i in who)}, _beside(e, size), size)
        made = materialize(made.unionAll(blocked.block_sums(blocked.own(self.base1), _grams(self.change1, cut), self.row1, size)), "cells")
        sums = blocked.summed(made, size)
        discard(self.base2)
        self.base2, self.row2 = made, lay.row2
        return sums

    def factors(self) -> tuple[DataFrame, DataFrame | None]:
        genes = materialize(self._genes(), "genes")
        cells = materialize(self._cells(), "cells") if self.base2 is not None else None
        for old in (self.base1, self.base2):
            if old is not None:
                discard(old)
        return genes, cells


class _OneBlock:
    """The same state as arrays in a task, for matrices of one block of genes and one of cells."""

    def __init__(self, x1, x2, tiles: dict, at: _Layout):
        self.x1, self.x2, self.tiles = x1, x2, tiles
        self.change1: Callable = _keep
        self.change2: Callable = _keep

    def over_genes(self, at: _Layout):
        import numpy as np

        shapes, size = at.sums()
        e, genes = at.n_networks, self.change1(self.x1)
        held = {}
        for a, who in at.users.items():
            x = self.change2(self.x2) if a == e else genes
            held[a] = self.tiles[a] @ np.concatenate([x[:, (at.g2 if a == e else at.g1)[i]] for i in who], axis=1)
        self.x1, sums = _gene_sums(at, shapes)(genes, held)
        return sums + _cell_sums(at, shapes, self.change2)(self.x2) if e in at.users else sums

    def over_cells(self, at: _Layout, lay: _Layout):
        import numpy as np

        cut = [at.g1[i] for i in lay.active]
        back = self.tiles[at.n_networks].T @ np.concatenate([self.change1(self.x1)[:, s] for s in cut], axis=1)
        self.x2 = np.concatenate([self.change2(self.x2), back], axis=1)
        return _grams(self.change1, cut)(self.x1)


def _beside(e: int, size: int) -> Callable:
    def finish(own, held):
        import numpy as np

        return np.concatenate([own, held[e]], axis=1), np.zeros(size)

    return finish


def _grams(change: Callable, cut: list[slice]) -> Callable:
    def of(x):
        import numpy as np

        new = change(x)
        return np.concatenate([(new[:, s].T @ new[:, s]).ravel() for s in cut])

    return of


def _turns(state, models: list[Model], e: int, norms: dict, max_iter: int) -> list[Factors]:
    """The turns of a fit: the middle matrices and traces of all models; factors are left in the state."""
    out = [Factors(None, None, [], None) for _ in models]
    active, last = list(range(len(models))), [None] * len(models)
    for turn in range(1, max_iter + 1):
        at = _Layout(models, active, e)
        sums = _cut(state.over_genes(at), at.sums()[0])
        middle = {i: _solved(at, i, sums) for i in active}
        stopped = []
        for i in active:
            m = models[i]
            out[i].s_networks, out[i].s_expression = [middle[i][a] for a in m.networks], middle[i].get(e)
            if turn == 1 or turn % TEST_EVERY == 0:
                objective = _objective(at, i, sums, middle[i], norms)
                total = sum(norms.get(a, 0.0) for a in (*m.networks, *([e] if m.expression else [])))
                out[i].trace.append((turn, objective, (max(objective, 0.0) / max(total, 1e-300)) ** 0.5))
                if last[i] is not None and abs(last[i] - objective) <= TOLERANCE * abs(last[i]):
                    stopped.append(i)
                last[i] = objective
        active = [i for i in active if i not in stopped]
        state.change1 = _gene_update(at, active, sums, middle)
        who = [i for i in active if models[i].expression]
        if who:
            lay = _Layout(models, who, e)
            after = _cut(state.over_cells(at, lay), [("gram1", i, 0, (models[i].k1, models[i].k1)) for i in who])
            state.change2 = _cell_update(lay, after, middle)
        if not active:
            break
    return out


def fit(models: list[Model], networks: list[DataFrame], expression: DataFrame | None, g1: list[DataFrame], g2: list[DataFrame | None], max_iter: int = 1000, block_rows: int = blocked.BLOCK_ROWS, prepared: tuple[DataFrame, DataFrame] | None = None) -> list[Factors]:
    """Fits all models from initial factors (gene, vec), one of each a model.

    Genes are those of the first model's initial G1, cells (as gene) those of
    the first G2 that there is. The middle matrices are solved from the factors
    before each update; G1 is updated with the Gram matrix from before, then G2
    with the new G1 and the old middle matrices. Tests come at iterations 1, 10,
    20, ...; a model stops when its objective changes by at most TOLERANCE,
    relatively, while others go on.

    Genes and cells of one block each need no exchange between turns: then each
    model's turns are one task's work, over at most ``block_rows`` rows.
    ``prepared`` has the index of the genes and the networks' tiles over it,
    where they are made already.
    """
    e = len(networks)
    # Models without the expression matrix have no columns among the cells.
    models = [Model(m.name, tuple(m.networks), m.k1, m.k2 if m.expression else 0, m.expression, m.stale_projection) for m in models]
    genes, made, cells = prepared[0] if prepared else blocked.index(g1[0], block_rows), [], None
    if networks:
        made.append(prepared[1] if prepared else blocked.tiles(networks, genes, genes))
    if any(m.expression for m in models):
        cells = blocked.index(next(f for f in g2 if f is not None), block_rows)
        made.append(blocked.tiles([expression], genes, cells, first=e))
    norms = {a: s for t in made for a, s in blocked.squares(t).items()}
    run = _fit_by_model if all(of is None or of.select("block").distinct().count() <= 1 for of in (genes, cells)) else _fit_by_turns
    out, (end1, at1), (end2, at2) = run(models, e, made, norms, g1, g2, genes, cells, max_iter)
    for i, m in enumerate(models):
        out[i].g1 = blocked.unpacked(end1[i], genes, *at1[i])
        out[i].g2 = blocked.unpacked(end2[i], cells, *at2[i]) if m.expression else None
    for t in made:
        discard(t)
    return out


def _start(models: list[Model], e: int, g1: list, g2: list, genes: DataFrame, cells: DataFrame | None) -> tuple[DataFrame, DataFrame | None, _Layout]:
    """The initial state of genes and cells, written, and its layout."""
    at = _Layout(models, list(range(len(models))), e)
    base1 = blocked.packed(g1 + [g1[i] for i in at.first], [m.k1 for m in models] + [models[i].k1 for i in at.first], genes)
    using = [i for i, m in enumerate(models) if m.expression]
    return base1, blocked.packed([g2[i] for i in using], [models[i].k2 for i in using], cells) if using else None, at


def _fit_by_turns(models: list[Model], e: int, made: list[DataFrame], norms: dict, g1: list, g2: list, genes: DataFrame, cells: DataFrame | None, max_iter: int):
    base1, base2, at = _start(models, e, g1, g2, genes, cells)
    state = _Tables(base1, base2, made[0] if e else None, made[-1] if cells is not None else None, at)
    out = _turns(state, models, e, norms, max_iter)
    end1, end2 = state.factors()
    n = range(len(models))
    return out, ([end1 for _ in n], [(at.state1, at.g1[i]) for i in n]), ([end2 for _ in n], [(at.wide2, at.g2[i]) for i in n])


RESULT = "model int, name string, n_columns int, block int, data binary"


def _fit_by_model(models: list[Model], e: int, made: list[DataFrame], norms: dict, g1: list, g2: list, genes: DataFrame, cells: DataFrame | None, max_iter: int):
    """Every model is a group of its own: its factors and the tiles of the matrices that it uses."""
    import numpy as np

    base1, base2, at = _start(models, e, g1, g2, genes, cells)
    spark = genes.sparkSession
    uses = spark.createDataFrame([(i, a) for i, m in enumerate(models) for a in (*m.networks, *([e] if m.expression else []))], "model int, net int")
    tiles = made[0]
    for t in made[1:]:
        tiles = tiles.unionAll(t)
    parts = F.broadcast(uses).join(tiles, "net").select("model", "net", "n_rows", "n_columns", "n", "ra", "ca", "v")
    every = spark.range(len(models)).select(F.col("id").cast("int").alias("model"))
    for net, base in ((-1, base1), (-2, base2)):
        if base is not None:
            own = blocked.own(base).select(F.lit(net).alias("net"), F.lit(0).alias("n_rows"), F.lit(0).alias("n_columns"), F.lit(0).alias("n"), F.lit(None).cast("binary").alias("ra"), F.lit(None).cast("binary").alias("ca"), F.col("data").alias("v"))
            parts = parts.unionByName(own.crossJoin(F.broadcast(every)))  # one block, a copy for each model

    def run(table):
        import numpy as np
        import pyarrow as pa

        i = table.column("model")[0].as_py()
        m, factors, tiles = models[i], {}, {}
        for r in table.to_pylist():
            if r["net"] < 0:
                factors[r["net"]] = np.frombuffer(r["v"]).reshape(-1, at.state1 if r["net"] == -1 else at.wide2)
            else:
                tiles[r["net"]] = np.zeros((r["n_rows"], r["n_columns"]))
                ra, ca, v = blocked.entries(r["n"], r["ra"], r["ca"], r["v"])
                tiles[r["net"]][ra, ca] = v
        n1, n2 = len(factors[-1]), len(factors[-2]) if -2 in factors else 0
        for a in (*m.networks, *([e] if m.expression else [])):
            tiles.setdefault(a, np.zeros((n1, n2 if a == e else n1)))
        mine = _Layout([m], [0], e)
        x1 = np.concatenate([factors[-1][:, s] for s in (at.g1[i], *([at.first[i]] if i in at.first else []))], axis=1)
        state = _OneBlock(x1, factors[-2][:, at.g2[i]] if m.expression else None, tiles, mine)
        (found,) = _turns(state, [m], e, norms, max_iter)
        rows = [("trace", 3, np.array(found.trace, dtype=float)), ("g1", m.k1, state.change1(state.x1)[:, : m.k1])]
        rows += [(f"s{k}", s.shape[1], s) for k, s in enumerate(found.s_networks)]
        if m.expression:
            rows += [("s_expression", m.k2, found.s_expression), ("g2", m.k2, state.change2(state.x2)[:, : m.k2])]
        names, widths, arrays = zip(*rows, strict=True)
        zeros = pa.array([0] * len(rows), pa.int32())
        return pa.table({"model": pa.array([i] * len(rows), pa.int32()), "name": pa.array(names), "n_columns": pa.array(widths, pa.int32()), "block": zeros, "data": pa.array([np.ascontiguousarray(x, dtype=float).tobytes() for x in arrays], pa.binary())})

    done = materialize(parts.groupBy("model").applyInArrow(run, RESULT), "fits")
    discard(base1)
    discard(base2) if base2 is not None else None
    out = [Factors(None, None, [None] * len(m.networks), None) for m in models]
    for r in done.filter("name not in ('g1', 'g2')").collect():  # k x k matrices and traces
        x = np.frombuffer(r["data"]).reshape(-1, r["n_columns"])
        if r["name"] == "trace":
            out[r["model"]].trace = [(int(t), float(o), float(err)) for t, o, err in x]
        elif r["name"] == "s_expression":
            out[r["model"]].s_expression = x
        else:
            out[r["model"]].s_networks[int(r["name"][1:])] = x
    of = lambda name: [done.filter((F.col("model") == i) & (F.col("name") == name)).select("block", "data") for i in range(len(models))]
    return out, (of("g1"), [(m.k1, slice(0, m.k1)) for m in models]), (of("g2"), [(m.k2, slice(0, m.k2)) for m in models])


def _gene_sums(at: _Layout, shapes: list) -> Callable:
    """A block of genes with its products, and its part of the sums."""

    def finish(own, held):
        import numpy as np

        x = np.concatenate([own, *[held[a] for a in sorted(held)]], axis=1)
        parts = []
        for kind, i, a, (rows, columns) in shapes:
            g, first = x[:, at.g1[i]], x[:, at.first[i]] if i in at.first else None
            if kind == "gram1":
                parts.append(g.T @ g)
            elif kind == "cross":
                parts.append(g.T @ x[:, at.products[i, a]])
            elif kind == "first":
                parts.append(first.T @ x[:, at.products[i, a]])
            elif kind == "first_gram":
                parts.append(first.T @ first)
            else:
                parts.append(np.zeros((rows, columns)))
        return x, np.concatenate([p.ravel() for p in parts])

    return finish


def _cell_sums(at: _Layout, shapes: list, change: Callable) -> Callable:
    def of(x):
        import numpy as np

        g = change(x)
        return np.concatenate([(g[:, at.g2[i]].T @ g[:, at.g2[i]] if kind == "gram2" else np.zeros(shape)).ravel() for kind, i, _, shape in shapes])

    return of


def _solved(at: _Layout, i: int, sums: dict) -> dict:
    """The middle matrix of each matrix that a model uses."""
    m, e = at.models[i], at.n_networks
    inverse1 = _inverse(sums["gram1", i, 0])
    out = {a: inverse1 @ sums["cross", i, a] @ inverse1 for a in m.networks}
    if m.expression:
        inverse2 = _inverse(sums["gram2", i, 0])
        out[e] = _inverse(sums["first_gram", i, 0]) @ sums["first", i, e] @ inverse2 if i in at.first else inverse1 @ sums["cross", i, e] @ inverse2
    return out


def _objective(at: _Layout, i: int, sums: dict, middle: dict, norms: dict) -> float:
    m, e, gram1 = at.models[i], at.n_networks, sums["gram1", i, 0]
    total = 0.0
    for a in (*m.networks, *([e] if m.expression else [])):
        s, right = middle[a], sums["gram2", i, 0] if a == e else gram1
        total += norms.get(a, 0.0) - 2 * (s * sums["cross", i, a]).sum() + (s * (gram1 @ s @ right)).sum()
    return float(total)


def _gene_update(at: _Layout, active: list[int], sums: dict, middle: dict) -> Callable:
    """The new state of a block of genes from the state and its products; models that have stopped stay."""
    import numpy as np

    e, signs = at.n_networks, {}
    for i in active:
        m = at.models[i]
        plus, minus = np.zeros((m.k1, m.k1)), np.zeros((m.k1, m.k1))
        for a in (*m.networks, *([e] if m.expression else [])):
            p, q = _parts(middle[i][a] @ (sums["gram2", i, 0] if a == e else sums["gram1", i, 0]) @ middle[i][a].T)
            plus, minus = plus + p, minus + q
        signs[i] = plus, minus
    turned = {i: {a: s.T for a, s in middle[i].items()} for i in active}

    def change(x):
        new = x[:, : at.state1].copy()
        for i in active:
            products = [x[:, at.products[i, a]] @ s for a, s in turned[i].items()]
            new[:, at.g1[i]] = _updated(x[:, at.g1[i]], products, *signs[i])
        return new

    return change


def _cell_update(lay: _Layout, after: dict, middle: dict) -> Callable:
    e = lay.n_networks
    each = {i: (middle[i][e], _parts(middle[i][e].T @ after["gram1", i, 0] @ middle[i][e])) for i in lay.active}

    def change(x):
        new = x[:, : lay.wide2].copy()
        for i, (s, (plus, minus)) in each.items():
            new[:, lay.g2[i]] = _updated(x[:, lay.g2[i]], [x[:, lay.back[i]] @ s], plus, minus)
        return new

    return change


def factorize(networks: list[DataFrame], expression: DataFrame | None, k1: int, k2: int, g1: DataFrame, g2: DataFrame | None = None, max_iter: int = 1000, stale_projection: bool = False) -> Factors:
    """One model over all the networks and the expression matrix, if there is one (see ``fit``)."""
    model = Model("model", tuple(range(len(networks))), k1, k2, expression is not None, stale_projection)
    return fit([model], networks, expression, [g1], [g2], max_iter)[0]


def combined(networks: dict[str, DataFrame], combinations: list[tuple[str, ...]], expression: DataFrame, genes: DataFrame, cells: DataFrame, k1: int, k2: int, max_iter: int = 1000, stale_alone: bool = False) -> dict[str, Factors]:
    """A fit for each combination of networks with the expression matrix, all in the same passes, by names joined by +.

    Each starts from the absolute singular vectors of the sum of its networks
    plus those of the expression matrix; without networks from the latter alone
    (EXP), where ``stale_alone`` keeps the first projection.
    """
    from sparkloom.operators.linalg import SharedTiles

    names = list(networks)
    rank = max(k1, k2)
    left, right = svd_pair(expression, genes, cells, rank)
    parts = lambda f, k: f.select("gene", F.slice("vec", 1, k).alias("vec"))
    models = [Model("+".join(chosen) or "EXP", tuple(names.index(c) for c in chosen), k1, k2, True, stale_alone and not chosen) for chosen in combinations]

    # Networks of more than a block are cut into tiles once, for all the decompositions and the fit.
    n, shared, prepared = genes.count(), None, None
    if networks and n > blocked.BLOCK_ROWS and not _beyond(list(networks.values()), genes):
        of = blocked.index(genes, blocked.even_rows(n, 2 * genes.sparkSession.sparkContext.defaultParallelism))
        prepared = of, blocked.tiles(list(networks.values()), of, of)
        shared = SharedTiles(prepared[1], of)

    def start(chosen):
        first = parts(left, k1)
        if not chosen:
            return first
        if shared is not None:
            own = _filled(genes, shared.left_vectors(tuple(names.index(c) for c in chosen), k1), k1)
        else:
            own = svd_factor([networks[c] for c in chosen], genes, k1)
        both = F.zip_with("vec", "_v", lambda a, b: a + b - EPSILON)
        return materialize(own.join(first.withColumnRenamed("vec", "_v"), "gene").select("gene", both.alias("vec")), "first-factor")

    with ThreadPoolExecutor(4) as pool:  # decompositions do not wait for each other
        g1 = list(pool.map(start, combinations))
    if shared is not None:
        shared.close()
    found = fit(models, [networks[n] for n in names], expression, g1, [parts(right, k2)] * len(models), max_iter, prepared=prepared)
    return {m.name: f for m, f in zip(models, found, strict=True)}


def _beyond(networks: list[DataFrame], genes: DataFrame) -> bool:
    """Whether some network has an end that is not among the genes."""
    ends = networks[0].select("i", "j")
    for a in networks[1:]:
        ends = ends.unionAll(a.select("i", "j"))
    inside = genes.select("gene").distinct()
    both = ends.filter("i is not null and j is not null").join(inside.withColumnRenamed("gene", "i").withColumn("_i", F.lit(True)), "i", "left").join(inside.withColumnRenamed("gene", "j").withColumn("_j", F.lit(True)), "j", "left")
    return not both.filter("_i is null or _j is null").isEmpty()


def svd_pair(matrix: DataFrame, genes: DataFrame, cells: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The absolute singular vectors of both sides, plus EPSILON, of one decomposition."""
    from sparkloom.operators.linalg import truncated_svd

    u, _, v = truncated_svd(matrix, k)
    full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce(F.get("vec", c), F.lit(0.0)) + EPSILON)
    left = materialize(genes.join(u, "gene", "left").select("gene", full.alias("vec")), "left")
    right = materialize(cells.join(v.withColumnRenamed("cell", "gene"), "gene", "left").select("gene", full.alias("vec")), "right")
    return left, right
