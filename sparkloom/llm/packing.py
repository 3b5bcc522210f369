"""Best-fit packing by linear grouping, planned on a histogram of lengths.

Documents become token ids and an end id; only what is longer than a sequence
is cut, into full pieces and a rest. Lengths are whole numbers from 1 to the
capacity, so a histogram of at most ``capacity`` counts describes all pieces
however many there are, and the packing is planned on it alone:

1. full pieces fill a sequence each;
2. linear grouping: large lengths, longest first, fall into groups of equal
   cardinality, each rounded up to its longest member; a length that would
   fill a group by itself is one, so few-valued lengths are not rounded;
3. the numbers of configurations over these few sizes are optimised together
   (the linear programme of the cutting-stock problem, by column generation
   with a knapsack as its pricing step) and rounded down; what is left takes
   the configurations with the largest fractions that still fit, then the
   fullest ones. A plan of fullest configurations alone is made, too, and the
   plan with fewest sequences wins;
4. actual lengths take the rounded places, so sequences get more room left;
5. small lengths, longest first, go best-fit into the sequence with the least
   room that still takes them, or into new ones.

Sequences with the same contents are one interval of sequence numbers. The
plan is a table of (length, first rank, first sequence, offset) entries whose
number depends on the capacity, not on the input. Each piece gets its rank
among the pieces of its length from counts by (length, bucket), so nothing is
sorted in one task, and finds its place in the plan by binary search.

Defined results: null text is the end id alone; null and repeated ids are
documents like others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, read_table, small_batches, trimmed
from .tokens import encoder, sliced

CAPACITY = 2048
GROUPS = 128
#: Lengths up to capacity / s are small; each s is planned, the fewest sequences win.
SMALL = (2, 3, 4)
#: The same where configurations are optimised together, and the groups there.
OPTIMISED, OPTIMISED_GROUPS = (2, 4, 8, 20), 64
VOCABULARY = "word_bpe_49k.json"
END_ID = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as 32-bit integers)."""
    kept = docs.select("doc_id", "text")
    id_type = kept.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        encode = encoder(vocabulary, keep_space=False).encode
        end = END_ID.to_bytes(4, "little")
        for batch in (x for whole in batches for x in sliced(whole, "text", 1 << 22)):
            columns = [[] for _ in names]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(columns, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return kept.mapInArrow(trimmed(cut), schema)


def equal_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, [(length, count)]), longest first, of about equal cardinality; frequent lengths alone."""
    per = max(1, -(-sum(counts.values()) // groups))
    alone = 1 if len(counts) <= groups else per
    out, members, room = [], [], per

    def close():
        nonlocal members, room
        if members:
            out.append((members[0][0], members))
        members, room = [], per

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if left >= alone:
            close()
            out.append((length, [(length, left)]))
            continue
        while left:
            n = min(left, room)
            members.append((length, n))
            left, room = left - n, room - n
            if not room:
                close()
    close()
    return out


def priced(sizes, worth, capacity: int) -> tuple[float, list[int]]:
    """The configuration of greatest worth, by the number of pieces in it."""
    import numpy as np

    best, chosen = np.zeros(capacity + 1), []
    room = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits = room >= 0
    for _ in range(capacity // int(sizes.min())):
        gain = np.where(fits, best[np.maximum(room, 0)] + worth, -1.0)
        k = gain.argmax(axis=1)
        new = gain[np.arange(capacity + 1), k]
        k[new <= best + 1e-12] = -1  # one more piece is worth nothing here
        if (k < 0).all():
            break
        chosen.append(k)
        best = np.where(k >= 0, new, best)
    used, r = [0] * len(sizes), capacity
    for k in reversed(chosen):
        if k[r] >= 0:
            used[k[r]] += 1
            r -= int(sizes[k[r]])
    return float(best[capacity]), used


def optimised(sizes: list[int], demand: list[int], capacity: int, steps: int = 10) -> list[tuple[list[int], float]]:
    """Configurations and how often each is used, with fewest sequences in all (fractions allowed).

    Revised simplex: the basis starts with configurations of one size each; the
    knapsack over the dual prices finds what to bring in, until no plan can
    have fewer sequences by more than a fraction of one, or a ten-thousandth,
    or ``steps`` times the number of sizes have been taken (every basis is a
    plan). Demands differ by tiny amounts meanwhile, so that steps do not stall.
    """
    import numpy as np

    if not sizes:
        return []
    s, d = np.array(sizes), np.array(demand) * (1 + 1e-5 * np.random.default_rng(0).random(len(sizes)))
    basis = np.diag((capacity // s).astype(float))  # a column for each configuration
    for _ in range(steps * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(s)))
        worth, new = priced(s, prices, capacity)
        value = prices @ d
        if value - value / worth < max(0.2, 1e-4 * value):  # no plan has fewer sequences than value / worth
            break
        x, step = np.linalg.solve(basis, d), np.linalg.solve(basis, np.array(new, dtype=float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    x = np.maximum(np.linalg.solve(basis, np.array(demand, dtype=float)), 0)
    return [([int(round(v)) for v in basis[:, c]], float(x[c])) for c in range(len(s)) if x[c] > 1e-9]


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Counts of the fullest configuration that holds the first size left."""
    first = next(k for k, n in enumerate(left) if n)
    used = [0] * len(sizes)
    used[first] = 1
    room = capacity - sizes[first]
    # reach[r]: the last size index used to fill exactly r, and how often.
    reach: list[tuple[int, int] | None] = [None] * (room + 1)
    reach[0] = (-1, 0)
    for k, size in enumerate(sizes):
        most = left[k] - used[k]
        if not most or size > room:
            continue
        times = [0] * (room + 1)
        for r in range(size, room + 1):
            if reach[r] is None and reach[r - size] is not None and times[r - size] < most:
                reach[r] = (k, times[r - size] + 1)
                times[r] = times[r - size] + 1
    r = max(x for x in range(room + 1) if reach[x] is not None)
    while r:
        k, _ = reach[r]
        used[k] += 1
        r -= sizes[k]
    return used


class Plan:
    """Intervals of alike sequences by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.n = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        self.rank: dict[int, int] = defaultdict(int)
        self.entries: list[tuple[int, int, int, int, int]] = []

    def new(self, count: int) -> tuple[int, int]:
        self.n += count
        return self.n - count, count

    def keep(self, room: int, run: tuple[int, int]) -> None:
        if not self.open[room]:
            bisect.insort(self.rooms, room)
        self.open[room].append(run)

    def place(self, length: int, run: tuple[int, int], room: int) -> None:
        """One piece of this length in each sequence of the run."""
        self.entries.append((length, self.rank[length], run[0], run[1], self.capacity - room))
        self.rank[length] += run[1]

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                per = self.capacity // length  # of this length alone
                n = max(1, count // per)
                self.keep(self.capacity, self.new(n))
                continue
            room = self.rooms[at]
            start, size = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            n = min(size, count)
            if n < size:
                self.keep(room, (start + n, size - n))
            self.place(length, (start, n), room)
            self.keep(room - length, (start, n))
            count -= n


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[int, ...] = SMALL) -> tuple[list[tuple], int]:
    """(length, first rank, first sequence, count, offset) entries, and how many sequences."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best = min((plan_with(counts, capacity, groups, s, False) for s in small), key=lambda plan: plan[1])
    for s in OPTIMISED:
        if best[1] > least:  # else nothing is better
            best = min(best, plan_with(counts, capacity, min(groups, OPTIMISED_GROUPS), s, True), key=lambda plan: plan[1])
    return best


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: int, together: bool) -> tuple[list[tuple], int]:
    """The plan if lengths above ``capacity // small`` are large; ``together``: configurations are optimised first."""
    made = Plan(capacity)
    if counts.get(capacity):
        made.place(capacity, made.new(counts[capacity]), capacity)
    large = {x: n for x, n in counts.items() if capacity // small < x < capacity}
    grouped = equal_groups(large, groups) if large else []
    sizes = [size for size, _ in grouped]
    stock = [list(members) for _, members in grouped]
    left = [sum(n for _, n in members) for members in stock]

    def use(used, times):
        runs = [(capacity, *made.new(times))]
        for k, u in enumerate(used):
            left[k] -= u * times
            for _ in range(u):
                runs = fill(made, runs, stock[k])
        for room, start, count in runs:
            made.keep(room, (start, count))

    if together:
        found = optimised(sizes, left, capacity)
        for used, times in found:
            times = min(int(times + 1e-6), *[n // u for n, u in zip(left, used, strict=True) if u])
            if times:
                use(used, times)
        for used, times in sorted(found, key=lambda f: (f[1] + 1e-6) % 1, reverse=True):
            if times - int(times + 1e-6) > 0.01 and all(u <= n for u, n in zip(used, left, strict=True)):
                use(used, 1)
    while any(left):
        used = fullest(sizes, left, capacity)
        use(used, min(n // u for n, u in zip(left, used, strict=True) if u))
    for length in sorted((x for x in counts if x <= capacity // small), reverse=True):
        made.best_fit(length, counts[length])
    return made.entries, made.n


def fill(made: Plan, runs: list[tuple[int, int, int]], stock: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Actual lengths take one rounded place in each sequence of the runs."""
    out = []
    for room, start, count in runs:
        while count:
            length, n = stock[0]
            n = min(n, count)
            made.place(length, (start, n), room)
            out.append((room - length, start, n))
            start, count = start + n, count - n
            if n == stock[0][1]:
                stock.pop(0)
            else:
                stock[0] = (length, stock[0][1] - n)
    return out


def ranked(cut: DataFrame) -> DataFrame:
    """Adds each piece's rank (from 0) among the pieces of its length.

    Ranks run within (length, bucket) and start at the counts of the earlier
    buckets, so a length that most pieces share is spread like any other.
    """
    n = max(16, partitions_for(cut.sparkSession))
    spread = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    counts = materialize(spread.groupBy("length", "bucket").agg(F.count("*").alias("n")), "pack-counts")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        spread.withColumn("place", F.row_number().over(order)).join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("place") - 1).drop("bucket", "place", "base")
    )


def placed(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length of 1 to ``capacity``."""
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    entries, _ = plan_packing(histogram, capacity, groups)
    rows = ranked(cut)

    def find(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
        starts = {int(x): (int(a), int(b)) for x, a, b in spans(table[:, 0])}
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                a, b = starts[int(x)]
                mine = length == x
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1] if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence, pa.int64()), pa.array(table[at, 4] if len(at) else at, pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(find, schema).drop("rank")


def spans(column) -> list[tuple[int, int, int]]:
    """(value, first, end) of the runs of a sorted array."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(column)) + 1
    edges = [0, *cuts.tolist(), len(column)]
    return [(column[a], a, b) for a, b in zip(edges, edges[1:]) if b > a]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row a piece with its sequence and its place there."""
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, capacity, vocabulary, with_ids), "pieces")
    return placed(cut, capacity, groups)


def op5_linear_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
