"""Relatives of the tri-factorisation: a given basis, a Laplacian term, and one orthonormal basis for many networks.

All keep their state in blocks (see ``blocked``), form no residual, and give the
objective from k x k sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import blocked
from sparkloom.operators.factorize import EPSILON, TEST_EVERY, _inverse, _keep, _parts, random_factor
from sparkloom.session import discard, materialize


def _width(factor: DataFrame) -> int:
    return len(factor.select("vec").first()["vec"])


def _tested(turn: int) -> bool:
    return turn <= 1 or turn % TEST_EVERY == 0


def partial_factor(matrix: DataFrame, given: DataFrame, start: DataFrame | None = None, max_iter: int = 1000, seed: int = 0) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """(gene, vec) of N >= 0 in A ~ P N' with P given (gene, vec), and (iteration, |A - P N'|, relative) of the tested turns.

    A'P is computed once; after that N's rows do not depend on each other, so
    all turns are one pass over its blocks. ``start`` has the columns of A as
    gene (random without it).
    """
    import numpy as np

    k = _width(given)
    cells = matrix.select(F.col("j").alias("gene")).distinct()
    rows, columns = blocked.index(given), blocked.index(cells)
    made = blocked.tiles([matrix], rows, columns)
    basis = blocked.packed([given], [k], rows)
    gram = blocked.summed(materialize(blocked.block_sums(blocked.own(basis), lambda x: (x.T @ x).ravel(), k, k * k), "gram"), k * k).reshape(k, k)
    turns = [t for t in range(max_iter + 1) if _tested(t)]
    size = len(turns) * (1 + k * k)

    def finish(n, held):
        sums = []
        for turn in range(max_iter + 1):
            if turn:
                n = n * (held[0] / (n @ gram + EPSILON)) + EPSILON
            if _tested(turn):
                sums += [[(n * held[0]).sum()], (n.T @ n).ravel()]
        return n, np.concatenate(sums)

    own = blocked.packed([start if start is not None else random_factor(cells, k, seed)], [k], columns)
    parts = blocked.own(own).select("block", F.lit(blocked.OWN).alias("kind"), F.lit(None).cast("binary").alias("places"), "data")
    parts = parts.unionAll(blocked.products(made, blocked.own(basis), {0: [slice(0, k)]}, transposed=True))
    done = materialize(blocked.gathered(parts, k, {0: k}, finish, size), "partial-factor")
    total, trace = blocked.squares(made).get(0, 0.0), []
    for turn, s in zip(turns, blocked.summed(done, size).reshape(len(turns), -1), strict=True):
        error = max(total - 2 * s[0] + (s[1:].reshape(k, k) * gram).sum(), 0.0) ** 0.5
        trace.append((turn, float(error), float(error / max(total, 1e-300) ** 0.5)))
    for t in (made, basis, own):
        discard(t)
    return blocked.unpacked(blocked.own(done), columns, k, slice(0, k)), trace


def laplacian_factor(matrix: DataFrame, laplacian: DataFrame, given: DataFrame, k2: int, gamma: float, start: DataFrame | None = None, max_iter: int = 1000, seed: int = 0) -> tuple[DataFrame, object, list[tuple[int, float, float, float]]]:
    """(gene, vec) of D >= 0, S, and the trace for: minimise |A - G S D'|^2 + gamma tr(D' L D) with G given.

    The Laplacian's positive and negative entries are two sparse matrices whose
    products with D enter the two sides of the update. A turn is one job over
    the blocks of D; A'G is computed once. The trace has (iteration, objective,
    relative error, tr(D' L D)) of tested turns, 0 being the start.
    """
    import numpy as np

    k1 = _width(given)
    cells = matrix.select(F.col("j").alias("gene")).unionAll(laplacian.select("i")).distinct()
    rows, columns = blocked.index(given), blocked.index(cells)
    made = blocked.tiles([matrix], rows, columns)
    signs = blocked.tiles([laplacian.filter("v > 0"), laplacian.filter("v < 0").withColumn("v", -F.col("v"))], columns, columns)
    basis = blocked.packed([given], [k1], rows)
    gram1 = blocked.summed(materialize(blocked.block_sums(blocked.own(basis), lambda x: (x.T @ x).ravel(), k1, k1 * k1), "gram"), k1 * k1).reshape(k1, k1)
    inverse1, total = _inverse(gram1), blocked.squares(made).get(0, 0.0)
    wide, size = k2 + k1, 1 + k2 * k2 + k1 * k2

    def summed_of(d, back, term=0.0):
        return np.concatenate([[term], (d.T @ d).ravel(), (back.T @ d).ravel()])

    first = blocked.packed([start if start is not None else random_factor(cells, k2, seed)], [k2], columns)
    parts = blocked.mapped(blocked.own(first), _keep, k2).unionAll(blocked.products(made, blocked.own(basis), {0: [slice(0, k1)]}, transposed=True))
    state = materialize(blocked.gathered(parts, k2, {0: k1}, lambda d, held: (np.concatenate([d, held[0]], axis=1), summed_of(d, held[0])), size), "laplacian-factor")
    sums, trace, middle = blocked.summed(state, size), [], None
    for turn in range(max_iter + 1):  # the job of a turn gives the trace term of its start, and the next D
        gram2, crossed = sums[1 : 1 + k2 * k2].reshape(k2, k2), sums[1 + k2 * k2 :].reshape(k1, k2)
        middle = inverse1 @ crossed @ _inverse(gram2)
        plus, minus = _parts(middle.T @ gram1 @ middle)
        last = turn == max_iter

        def finish(x, held, s=middle, plus=plus, minus=minus, last=last):
            d, back = x[:, :k2], x[:, k2:]
            term = (d * (held[0] - held[1])).sum()
            if not last:
                up, down = _parts(back @ s)
                d = d * np.sqrt((up + d @ minus + gamma * held[1]) / (down + d @ plus + gamma * held[0] + EPSILON)) + EPSILON
            return np.concatenate([d, back], axis=1), summed_of(d, back, term)

        own = blocked.mapped(blocked.own(state), _keep, wide)
        parts = own.unionAll(blocked.products(signs, own, {0: [slice(0, k2)], 1: [slice(0, k2)]}))
        new = materialize(blocked.gathered(parts, wide, {0: k2, 1: k2}, finish, size), "laplacian-factor")
        sums = blocked.summed(new, size)
        discard(state)
        state = new
        if _tested(turn) or last:
            error = total - 2 * (middle * crossed).sum() + (middle * (gram1 @ middle @ gram2)).sum()
            trace.append((turn, float(error + gamma * sums[0]), float((max(error, 0.0) / max(total, 1e-300)) ** 0.5), float(sums[0])))
    for t in (made, signs, basis, first):
        discard(t)
    return blocked.unpacked(blocked.own(state), columns, wide, slice(0, k2)), middle, trace


def orthonormal_factor(expression: DataFrame, networks: list[DataFrame], k_p: int, k_g: int, starts: dict | None = None, max_iter: int = 1000, seed: int = 0) -> tuple[dict, list[tuple[int, float]]]:
    """One basis B with B'B near I for all: E' ~ P S B' and A_i ~ G_i S_i B', all factors >= 0.

    Returns the factors (``B``, ``P``, ``G``: DataFrames; ``S``, ``S_networks``:
    arrays) and (iteration, sum of the norms of all residuals) of tested turns.
    B's update divides by B (B' N) for the sum N of all models' numerators, the
    rule under an orthonormality constraint; then P and each G_i follow with the
    new B, then the middle matrices. A turn is three steps: products of B's
    rows; products with the new B; sums with the new P and G_i. ``starts`` may
    give B, P, G, S and S_networks.
    """
    import numpy as np

    n, starts = len(networks), dict(starts or {})
    genes = expression.select(F.col("i").alias("gene"))
    for a in networks:
        genes = genes.unionAll(a.select("i")).unionAll(a.select("j"))
    genes, cells = genes.distinct(), expression.select(F.col("j").alias("gene")).distinct()
    of_genes, of_cells = blocked.index(genes), blocked.index(cells)
    tiles2 = blocked.tiles([expression], of_genes, of_cells, first=n)
    tiles1 = blocked.tiles(networks, of_genes, of_genes) if n else None
    norms = blocked.squares(tiles2) | (blocked.squares(tiles1) if n else {})
    rng = np.random.default_rng(seed)
    b = starts.get("B", random_factor(genes, k_g, seed))
    gs = starts.get("G", [random_factor(genes, k_g, seed + 2 + a) for a in range(n)])
    s_e = starts["S"] if "S" in starts else rng.random((k_p, k_g))
    s_n = starts["S_networks"] if "S_networks" in starts else [rng.random((k_g, k_g)) for _ in range(n)]
    state1 = blocked.packed([b, *gs], [k_g] * (n + 1), of_genes)
    state2 = blocked.packed([starts.get("P", random_factor(cells, k_p, seed + 1))], [k_p], of_cells)
    part = [slice(a * k_g, (a + 1) * k_g) for a in range(2 * n + 1)]
    wide, wide_p, square = (n + 1) * k_g, k_p, k_g * k_g
    change1: Callable = _keep
    change2: Callable = _keep
    row1, row2, trace = wide, wide_p, []

    def scaled(x, up, down):
        return x * np.sqrt(up / (down + EPSILON)) + EPSILON

    for turn in range(1, max_iter + 1):
        # Products of each model with the rows of B.
        own1, own2 = blocked.mapped(blocked.own(state1), change1, row1), blocked.mapped(blocked.own(state2), change2, row2)
        parts = own1.unionAll(blocked.products(tiles2, own2, {n: [slice(0, k_p)]}))
        if n:
            parts = parts.unionAll(blocked.products(tiles1, own1, {a: [part[a + 1]] for a in range(n)}, transposed=True))
        widths = {a: k_g for a in range(n)} | {n: k_p}
        size = n * square + k_g * k_p

        def numerators(x, held):
            b = x[:, part[0]]
            return np.concatenate([x, *[held[a] for a in range(n + 1)]], axis=1), np.concatenate([*[(b.T @ held[a]).ravel() for a in range(n)], (b.T @ held[n]).ravel()])

        made = materialize(blocked.gathered(parts, wide, widths, numerators, size), "basis-products")
        sums = blocked.summed(made, size)
        weights = [*s_n, s_e]
        inner = sums[n * square :].reshape(k_g, k_p) @ s_e
        for a in range(n):
            inner = inner + sums[a * square : (a + 1) * square].reshape(k_g, k_g) @ s_n[a]
        ends = [wide + a * k_g for a in range(n + 1)] + [wide + n * k_g + k_p]

        def new_basis(x, inner=inner, weights=weights, ends=ends):
            b = x[:, part[0]]
            up = sum(x[:, ends[a] : ends[a + 1]] @ weights[a] for a in range(n + 1))
            return np.concatenate([scaled(b, up, b @ inner), x[:, k_g:wide]], axis=1)

        # Products with the new B.
        row = ends[-1]
        own1 = blocked.mapped(blocked.own(made), new_basis, row)
        parts = own1.unionAll(blocked.products(tiles1, own1, {a: [part[0]] for a in range(n)})) if n else own1
        next1 = blocked.gathered(parts, wide, {a: k_g for a in range(n)}, lambda x, held: (np.concatenate([x, *[held[a] for a in range(n)]], axis=1), (x[:, part[0]].T @ x[:, part[0]]).ravel()), square)
        next1 = materialize(next1, "genes")
        gram = blocked.summed(next1, square).reshape(k_g, k_g)
        parts = own2.unionAll(blocked.products(tiles2, own1, {n: [part[0]]}, transposed=True))
        next2 = materialize(blocked.gathered(parts, wide_p, {n: k_g}, lambda x, held: (np.concatenate([x, held[n]], axis=1), np.zeros(0)), 0), "cells")
        for old in (state1, state2, made):
            discard(old)
        state1, state2, row1, row2 = next1, next2, (2 * n + 1) * k_g, k_p + k_g

        def new_genes(x, s_n=s_n, gram=gram):
            gs = [scaled(x[:, part[a + 1]], x[:, part[n + 1 + a]] @ s_n[a].T, x[:, part[a + 1]] @ (s_n[a] @ gram @ s_n[a].T)) for a in range(n)]
            return np.concatenate([x[:, part[0]], *gs], axis=1)

        def new_cells(x, s=s_e, gram=gram):
            return scaled(x[:, :k_p], x[:, k_p:] @ s.T, x[:, :k_p] @ (s @ gram @ s.T))

        change1, change2 = new_genes, new_cells

        # Sums with the new P and G, and from these the middle matrices.
        def of_genes_sums(x, change=new_genes):
            g = change(x)
            return np.concatenate([y for a in range(n) for y in ((g[:, part[a + 1]].T @ x[:, part[n + 1 + a]]).ravel(), (g[:, part[a + 1]].T @ g[:, part[a + 1]]).ravel())])

        def of_cells_sums(x, change=new_cells):
            p = change(x)
            return np.concatenate([(p.T @ x[:, k_p:]).ravel(), (p.T @ p).ravel()])

        size2 = k_p * k_g + k_p * k_p
        found = materialize(blocked.block_sums(blocked.own(state2), of_cells_sums, row2, size2), "sums")
        sums = blocked.summed(found, size2)
        discard(found)
        crossed, own = sums[: k_p * k_g].reshape(k_p, k_g), sums[k_p * k_g :].reshape(k_p, k_p)
        s_e = scaled(s_e, crossed, own @ s_e @ gram)
        errors = [norms.get(n, 0.0) - 2 * (s_e * crossed).sum() + (s_e * (own @ s_e @ gram)).sum()]
        if n:
            found = materialize(blocked.block_sums(blocked.own(state1), of_genes_sums, row1, 2 * n * square), "sums")
            sums = blocked.summed(found, 2 * n * square).reshape(n, 2, k_g, k_g)
            discard(found)
            s_n = [scaled(s_n[a], sums[a, 0], sums[a, 1] @ s_n[a] @ gram) for a in range(n)]
            errors += [norms.get(a, 0.0) - 2 * (s_n[a] * sums[a, 0]).sum() + (s_n[a] * (sums[a, 1] @ s_n[a] @ gram)).sum() for a in range(n)]
        if _tested(turn) or turn == max_iter:
            trace.append((turn, float(sum(max(x, 0.0) ** 0.5 for x in errors))))
    end1, end2 = materialize(blocked.mapped(blocked.own(state1), change1, row1), "genes"), materialize(blocked.mapped(blocked.own(state2), change2, row2), "cells")
    for old in (state1, state2, tiles2, *([tiles1] if n else [])):
        discard(old)
    each = [blocked.unpacked(end1, of_genes, wide, part[a]) for a in range(n + 1)]
    return {"B": each[0], "G": each[1:], "P": blocked.unpacked(end2, of_cells, wide_p, slice(0, k_p)), "S": s_e, "S_networks": s_n}, trace
