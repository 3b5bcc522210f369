"""SimHash near-duplicates by exact tiled comparison, and their link components.

A document's fingerprint has 64 bits; a bit is 1 if it is set in over half the
XXH64 hashes of the document's word n-grams, repeats included. Documents link
if their fingerprints differ in at most ``RADIUS`` bits.

1. Equal fingerprints are one class (a partial aggregation, however many
   documents share one); only distinct fingerprints are compared.
2. Fingerprints are sorted into tiles by the number of bits set in the whole
   and in its first two quarters, from a histogram that has fewer than 10,000
   rows whatever the corpus; a count of bits that many share is dealt over
   several tiles. A tile keeps the range of each of its counts.
3. The difference of two fingerprints' counts, and the sum of the differences
   over the four quarters, are never above the number of differing bits. So
   pairs of tiles whose ranges are further apart than the radius are skipped,
   before any fingerprint moves; the other pairs of tiles are a group each.
4. In a group, rows of one tile go by strips against those rows of the other
   that the strip's own ranges leave: exclusive or, then bit counts. Links are
   folded to a forest in the task, so a group gives at most an edge for each
   of its fingerprints, not its pairs.
5. Components of the edges are joined back to the documents.

Tiles grow with the square root of the number of fingerprints (``tile_rows``),
so what is moved grows less than the number of comparisons, which is the
square of the distinct fingerprints times the share that the counts leave.

Defined results: null text, or text without words, has the fingerprint zero
and links like any other; fewer words than n are one shingle; rows with equal
ids or null ids take part; a component without any id is null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, small_batches
from .ngram_join import components, pieces_of, settled_in_one_task, sized
from .tokens import sliced

N = 4
SEED = 42
RADIUS = 4
#: Fingerprints of a strip; a strip against its part of a tile stays in a core's cache.
STRIP = 128
#: Links that a task holds before it folds them.
MAX_LINKS = 1 << 20


def shingle_hashes(words: list[bytes], n: int):
    """XXH64 of each run of n words, joined by one space."""
    import numpy as np
    from xxhash import xxh64_intdigest

    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:m].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(line[x:y], SEED) for x, y in spans), np.uint64, m)


def fingerprint(text: bytes | None, n: int = N) -> int:
    """The unsigned fingerprint of a text in UTF-8; long texts go by pieces."""
    import numpy as np
    from xxhash import xxh64_intdigest

    ones, total, words = np.zeros(64, dtype=np.int64), 0, []
    for piece in pieces_of(text or b""):
        words += piece.lower().split()  # of bytes: A-Z and ASCII blanks only
        hashes = shingle_hashes(words, n)
        if len(hashes):
            ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        words = words[len(words) - n + 1 :] if len(words) >= n else words
    if not total:
        if not words:
            return 0
        ones += np.unpackbits(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.uint8))
        total = 1
    return int(np.packbits(2 * ones > total).view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (x for whole in batches for x in sliced(whole, "text")):
            found = np.fromiter((fingerprint(x.as_py(), n) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def quarter(k: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))


def tile_rows(n: int) -> int:
    """Fingerprints of a tile: 8 times the root of their number, from 4,096 to 65,536 (half a megabyte)."""
    return max(4096, min(1 << 16, int(8 * n**0.5)))


def tile_plan(counts: list[tuple[tuple[int, int, int], int]], rows: int) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """(bits, q0, q1, first tile, tiles) of each count of bits, and for 0 to 64 bits the last tile that begins with so many or fewer."""
    plan, tile, held, first_bits = [], -1, rows, []
    for (bits, q0, q1), n in sorted(counts):
        parts = -(-n // rows)
        if held + n > rows or parts > 1:
            tile, held = tile + 1, 0
            first_bits += [bits] * parts
        plan.append((bits, q0, q1, tile, parts))
        held += n
        if parts > 1:
            tile, held = tile + parts - 1, rows
    last, at = [], 0
    for bits in range(65):
        while at < len(first_bits) and first_bits[at] <= bits:
            at += 1
        last.append(at - 1)
    return plan, last


TILE = "tile int, bits_low int, bits_high int, low array<int>, high array<int>, data binary"


def bit_counts(fps):
    """The set bits of each quarter, a column each."""
    import numpy as np

    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int8)


def tiles(distinct: DataFrame, rows: int) -> tuple[DataFrame, list[int]]:
    """The tiles of all fingerprints, and the last tile to compare with for each number of bits."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.bit_count("fp").alias("bits"), quarter(0).alias("q0"), quarter(1).alias("q1"))
    histogram = keyed.groupBy("bits", "q0", "q1").count().collect()  # 17 * 17 * 33 rows at most
    plan, last = tile_plan([((r["bits"], r["q0"], r["q1"]), r["count"]) for r in histogram], rows)
    plan = spark.createDataFrame(plan, "bits int, q0 int, q1 int, first int, parts int")

    def packed(table):
        import numpy as np
        import pyarrow as pa

        fps = table.column("fp").to_numpy().view(np.uint64)
        of = bit_counts(fps)
        bits = of.sum(axis=1)
        order = np.lexsort((fps, of[:, 3], of[:, 2], of[:, 1], of[:, 0], bits))
        of = of.astype(np.int32)
        return pa.table({"tile": table.column("tile")[:1], "bits_low": pa.array([bits.min()], pa.int32()), "bits_high": pa.array([bits.max()], pa.int32()),
                         "low": pa.array([of.min(axis=0)], pa.list_(pa.int32())), "high": pa.array([of.max(axis=0)], pa.list_(pa.int32())), "data": pa.array([fps[order].tobytes()], pa.binary())})

    placed = keyed.join(F.broadcast(plan), ["bits", "q0", "q1"])
    tile = (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int")
    return materialize(placed.select(tile.alias("tile"), "fp").groupBy("tile").applyInArrow(packed, TILE), "tiles"), last


def tile_pairs(made: DataFrame, last: list[int], radius: int) -> DataFrame:
    """a <= b: the pairs of tiles whose counts of bits are within the radius."""
    ranges = made.select("tile", "bits_low", "bits_high", "low", "high")
    until = F.element_at(F.array(*[F.lit(x) for x in last]), F.least(F.col("bits_high") + radius, F.lit(64)) + 1)
    left = ranges.select(F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence("tile", until)).alias("b"))
    right = ranges.select(F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = lambda k: F.greatest(F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k], F.lit(0))
    return left.join(right, "b").filter(sum((gap(k) for k in range(1, 4)), gap(0)) <= radius).select("a", "b")


def close_pairs(a, b, same: bool, radius: int):
    """Arrays (x, y) of the fingerprints of a and b, in tile order, at most ``radius`` bits apart, strip by strip."""
    import numpy as np

    of_a, of_b = bit_counts(a), bit_counts(b)
    for at in range(0, len(a), STRIP):
        strip, counts = a[at : at + STRIP], of_a[at : at + STRIP]
        low, high = counts.min(axis=0), counts.max(axis=0)
        gap = np.maximum(low - of_b, 0) + np.maximum(of_b - high, 0)
        near = np.flatnonzero(gap.sum(axis=1) <= radius)
        if same:
            near = near[near >= at]
        if not len(near):
            continue
        x, y = np.nonzero(np.bitwise_count(strip[:, None] ^ b[near][None, :]) <= radius)
        if same:
            apart = near[y] > x + at
            x, y = x[apart], y[apart]
        if len(x):
            yield strip[x], b[near[y]]


def forest(parts: list):
    """node, component: the links folded to an edge for each fingerprint."""
    import numpy as np
    import pyarrow as pa

    u, v = (np.concatenate([p[k] for p in parts]).view(np.int64) for k in (0, 1))
    return next(settled_in_one_task([pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])]))


def linked_tiles(made: DataFrame, pairs: DataFrame, radius: int) -> DataFrame:
    """a, b: edges that connect all linked fingerprints of each pair of tiles."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        sides = {s: np.frombuffer(d, np.uint64) for s, d in zip(table.column("side").to_pylist(), table.column("data").to_pylist(), strict=True)}
        same = 1 not in sides
        held, size = [], 0
        for x, y in close_pairs(sides[0], sides[0] if same else sides[1], same, radius):
            held.append((x, y))
            size += len(x)
            if size > MAX_LINKS:
                folded = forest(held)
                held = [(folded.column(0).to_numpy().view(np.uint64), folded.column(1).to_numpy().view(np.uint64))]
                size = len(folded)
        if not held:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        folded = forest(held)
        return pa.Table.from_batches([folded]).rename_columns(["a", "b"])

    data = made.select("tile", "data")
    of_a = data.join(pairs, F.col("tile") == F.col("a")).select("a", "b", F.lit(0).alias("side"), "data")
    of_b = data.join(pairs.filter("a <> b"), F.col("tile") == F.col("b")).select("a", "b", F.lit(1).alias("side"), "data")
    return of_a.unionAll(of_b).groupBy("a", "b").applyInArrow(run, "a long, b long").filter("a <> b")


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS, rows: int | None = None) -> DataFrame:
    """node, component of the fingerprints (column fp, distinct, written) that link with another."""
    with small_batches(distinct.sparkSession):
        made, last = tiles(distinct, rows or tile_rows(distinct.count()))
        pairs = materialize(tile_pairs(made, last, radius), "tile-pairs")
        return components(materialize(linked_tiles(made, sized(pairs), radius), "fingerprint-links"))


def simhash_components(docs: DataFrame, n: int = N, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    with small_batches(docs.sparkSession):
        marked = materialize(fingerprints(docs, n), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs")), "fingerprint-classes")
    labels = near_fingerprints(classes.select("fp"), radius)
    joined = classes.join(sized(labels).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    # Alone with its fingerprint, a document is its own component; only other fingerprints are looked up.
    several = materialize(joined.filter(F.col("component").isNotNull() | (F.col("n_docs") > 1)).select("fp", "root", "least"), "shared-fingerprints")
    least = several.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(several.select("fp", "root").join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return marked.join(sized(found), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op13_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
