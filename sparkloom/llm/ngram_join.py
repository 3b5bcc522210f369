"""N-gram Jaccard self-join by grouped prefixes, and its link components.

A document's set holds the 64-bit hashes of its distinct word n-grams. Sets
are put in one global order, rarest first: by a count sketch over all
documents, then by hash. Any common order keeps the prefix filter exact: two
sets with Jaccard similarity t share an element within their first
size - ceil(t * size) + 1 elements. The sketch only decides how many
candidates there are.

1. Documents with equal sets form a class, and classes with equal prefix and
   size form a group; only groups are sent to the join.
2. Partitions send owners of hash ranges their prefix postings (hash, group,
   size, place) in packed blocks. An owner drops hashes that one group alone
   has and returns the others as rows.
3. In each posting list, pairs of groups pass the length and the positional
   filter. Prefixes are long enough that two similar sets must share many of
   their elements, not one: a pair of groups stays only if what the prefixes
   share and what lies behind them can reach the similarity.
4. Pairs of groups that are left, and groups of several classes, are expanded
   to their classes, and these are verified on whole sets.

A list of a few groups emits all its pairs. A longer list (near copies in
thousands) first links all its groups to a few of them, which makes as many
pairs as groups; so do two groups with many classes. What is left is the pairs
between different components of one list; hubs change by rounds while that
links much, and then all of these pairs are filtered and verified, the list
being dealt into parts. Pairs inside a component change nothing, so the
components are exact: no link between different components is left out.

Defined results: null text, or text without words, has the empty set and is
linked with nothing; fewer words than n make one shingle; rows with the same
doc_id are the same document; a row with a null id takes part in the class of
its set only; an empty table gives an empty result; ``drop_near`` keeps all
columns.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import scratch_scope

from .common import materialize, partitions_for, read_table, sized_semi_join, small_batches, trimmed
from .tokens import sliced

N = 5
NUMERATOR, DENOMINATOR = 80, 100
#: Counters of the sketch: 4 MB, whatever the corpus.
SKETCH_BITS = 20
#: Lists of up to this many groups emit all pairs at once.
SHORT_LIST = 6
MAX_ROUNDS = 8
#: Hubs go on by rounds while a list has more open pairs an entry than this, and links are this share of a round's pairs.
FEW_PAIRS, LEAST_SHARE = 8, 0.1
#: Two groups with more pairs of classes than this are compared through their first classes first.
CROWD = 64
#: Entries of a long list that meet in one part of a join, about.
PART_ROWS = 256
#: Tables of a few numbers a row are broadcast up to this many rows (about 10 MB).
SMALL_ROWS = 250_000
#: Components of up to this many edges (16 MB) are found in one task.
LOCAL_EDGES = 1_000_000
#: Bytes of text whose words are hashed at once.
PIECE_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG_WORD = 16
_powers: list = []


def mixed(x):
    """A bijective scrambling of 64-bit integers (splitmix64's finish)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_tables():
    """For each byte its value in the word hash (A-Z as a-z), and whether it is an ASCII blank."""
    import numpy as np

    codes = np.arange(256, dtype=np.uint64)
    codes[65:91] += np.uint64(32)
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return mixed((codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), blank


def powers(n: int):
    """B ** i and its inverse in 64 bits, kept by the worker."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        base = 0xD1342543DE82EF95
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 2 * PIECE_BYTES), factor, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1]


def hashed_words(data: bytes):
    """The 64-bit hash and the start of every word of some text.

    A word's hash is a polynomial in its bytes' random values, taken from one
    running sum over the text, and scrambled; no word becomes an object. Modulo
    2 ** 64 such polynomials agree on certain long words whatever the values
    are, so words of more than ``LONG_WORD`` bytes get XXH64 of their bytes.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    values, blank = byte_tables()
    octets = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(octets) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~blank[octets]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    up, down = powers(len(octets) + 1)
    total = np.zeros(len(octets) + 1, dtype=np.uint64)
    np.cumsum(values[octets] * up[:-1], out=total[1:])
    hashes = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[k] = xxh64_intdigest(data[start[k] : end[k]].lower())  # of bytes: A-Z only
    return hashes, start


def pieces_of(text: bytes, size: int = PIECE_BYTES):
    """Cuts a long text between words."""
    import re

    at = 0
    while len(text) - at > size:
        cut = re.compile(rb"[\x20\x09-\x0D]").search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def shingle_sets(texts: list[bytes | None], n: int = N) -> list:
    """The sorted distinct shingle hashes of each text in UTF-8."""
    import numpy as np

    out: list = []
    held: list[bytes] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            hashes, start = hashed_words(b" ".join(held))
            edges = np.cumsum([0] + [len(t) + 1 for t in held])
            cuts = np.searchsorted(start, edges)
            out.extend(of_words(hashes, cuts, n))
        held, size = [], 0

    for text in texts:
        text = text or b""
        if len(text) > PIECE_BYTES:
            flush()
            hashes = np.concatenate([hashed_words(p)[0] for p in pieces_of(text)])
            out.extend(of_words(hashes, np.array([0, len(hashes)]), n))
            continue
        if size + len(text) > PIECE_BYTES:
            flush()
        held.append(text)
        size += len(text) + 1
    flush()
    return out


def of_words(hashes, cuts, n: int):
    """The shingle sets of the documents whose words lie between the cuts."""
    import numpy as np

    factor = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(hashes) - n + 1), dtype=np.uint64)
    for k in range(n):
        rolled = rolled * factor + hashes[k : k + len(rolled)]
    rolled = mixed(rolled)
    for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        count = end - at
        if count >= n:
            shingles = np.sort(rolled[at : end - n + 1])
            yield shingles[np.append(True, shingles[1:] != shingles[:-1])]
        elif count:
            value = np.array([count], dtype=np.uint64)
            for k in range(at, end):
                value = (value * factor) ^ hashes[k : k + 1]
            yield mixed(value)
        else:
            yield rolled[:0]


def sketch(docs: DataFrame, n: int) -> bytes:
    """How many documents hold a shingle, by hash bucket, over all documents (uint32)."""
    width, chunk = 1 << SKETCH_BITS, 1 << 14

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(width, dtype=np.uint32)
        for batch in (x for whole in batches for x in sliced(whole, "text")):
            sets = shingle_sets(batch.column(0).to_pylist(), n)
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=width).astype(np.uint32)
        at = [k for k in range(0, width, chunk) if counts[k : k + chunk].any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(at, pa.int32()), "counts": pa.array([counts[k : k + chunk].tobytes() for k in at], pa.binary())})

    def add(table):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(chunk, dtype=np.uint64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    import numpy as np

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    whole = np.zeros(width, dtype=np.uint32)
    for r in parts:
        whole[r["chunk"] : r["chunk"] + chunk] = np.frombuffer(r["counts"], np.uint32)
    return whole.tobytes()


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


SCANNED = "doc_id long, n_shingles long, sig binary, grp long, owner int, postings binary"


def scanned(docs: DataFrame, counts: bytes, n: int, num: int, den: int, n_owners: int) -> DataFrame:
    """One row a document (owner is null) and one for each owner and slice of a partition."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 2 ** SKETCH_BITS counters

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sketched = np.frombuffer(shared.value, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("grp", pa.int64()), ("owner", pa.int32()), ("postings", pa.binary())])
        seen: set[int] = set()
        for batch in (x for whole in batches for x in sliced(whole, "text", 1 << 22)):
            ids, sizes, sigs, groups, sent = batch.column(0), [], [], [], []
            for x in shingle_sets(batch.column(1).to_pylist(), n):
                sizes.append(len(x))
                sigs.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                if not len(x):
                    groups.append(None)
                    continue
                order = np.lexsort((x, sketched[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                head = x[order[: prefix_length(len(x), num, den)]]
                key = hashlib.blake2b(len(x).to_bytes(8, "little") + head.tobytes(), digest_size=8).digest()
                group = int.from_bytes(key, "little", signed=True)
                groups.append(group)
                if group not in seen:
                    seen.add(group)
                    sent.append((group, len(x), head))
            nothing = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(groups, pa.int64()), pa.array(nothing, pa.int32()), pa.array(nothing, pa.binary())], schema=schema)
            if sent:
                rows = np.empty(sum(len(h) for _, _, h in sent), dtype=POSTING)
                at = 0
                for group, size, head in sent:
                    part = rows[at : at + len(head)]
                    part["hash"], part["grp"], part["size"], part["at"] = head, group, size, np.arange(len(head))
                    at += len(head)
                rows = rows[np.argsort(rows["hash"])]
                owner = (rows["hash"] >> np.uint64(32)) * np.uint64(n_owners) >> np.uint64(32)
                cuts = np.searchsorted(owner, np.arange(n_owners + 1))
                some = [o for o in range(n_owners) if cuts[o + 1] > cuts[o]]
                none = [None] * len(some)
                packed = [columnwise(rows[cuts[o] : cuts[o + 1]]) for o in some]
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(none, pa.int64()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), SCANNED)


POSTING = [("hash", "<u8"), ("grp", "<i8"), ("size", "<i4"), ("at", "<i4")]


def columnwise(rows) -> bytes:
    """Postings column after column, so that the repeated parts compress in the shuffle."""
    return len(rows).to_bytes(8, "little") + b"".join(rows[name].tobytes() for name, _ in POSTING)


def rowwise(data: bytes):
    import numpy as np

    n, at = int.from_bytes(data[:8], "little"), 8
    out = np.empty(n, dtype=POSTING)
    for name, kind in POSTING:
        size = n * int(kind[-1])
        out[name] = np.frombuffer(data, kind, n, at)
        at += size
    return out


MET = "hash long, grp long, size int, at int, other long, other_size int, shared int, passes boolean"


def met_in_lists(messages: DataFrame, num: int, den: int) -> DataFrame:
    """What owners find in their posting lists.

    A list of up to ``SHORT_LIST`` groups gives its pairs of groups (``grp`` <
    ``other``), each once an owner: in how many lists they meet and whether
    one lets them pass. A longer list gives its postings (``other`` is null).
    """

    def run(table):
        import numpy as np
        import pyarrow as pa

        parts = [rowwise(x) for x in table.column("postings").to_pylist()]
        hashes = np.concatenate([p["hash"] for p in parts])
        # Hashes seen twice; sorting plain integers is the cheap way to find them.
        ordered = np.sort(hashes)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.searchsorted(twice, hashes)
        at[at == len(twice)] = 0
        kept = np.flatnonzero(twice[at] == hashes) if len(twice) else np.zeros(0, dtype=np.int64)
        rows = np.unique(np.concatenate(parts)[kept])  # a group comes from several partitions
        first = np.flatnonzero(np.diff(rows["hash"], prepend=rows["hash"][:1] + np.uint64(1)))
        count = np.diff(np.append(first, len(rows)))
        a, b = pair_places(first, count)
        fits = den * np.minimum(rows["size"][a], rows["size"][b]).astype(np.int64) >= num * np.maximum(rows["size"][a], rows["size"][b]).astype(np.int64)
        a, b = a[fits], b[fits]
        swap = rows["grp"][a] > rows["grp"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        sa, sb = rows["size"][a].astype(np.int64), rows["size"][b].astype(np.int64)
        most = np.minimum(sa - rows["at"][a], sb - rows["at"][b])
        passes = most * (num + den) >= num * (sa + sb)
        order = np.lexsort((rows["grp"][b], rows["grp"][a]))
        a, b, passes = a[order], b[order], passes[order]
        head = np.ones(len(a), dtype=bool)
        head[1:] = (rows["grp"][a][1:] != rows["grp"][a][:-1]) | (rows["grp"][b][1:] != rows["grp"][b][:-1])
        head = np.flatnonzero(head)
        times = np.diff(np.append(head, len(a)))
        passes = np.logical_or.reduceat(passes, head) if len(head) else passes
        long = rows[np.repeat(count > SHORT_LIST, count)]
        none, n_long, n_pairs = pa.nulls, len(long), len(head)

        def column(kind, of_long, of_pairs):
            one = none(n_long, kind) if of_long is None else pa.array(of_long, kind)
            two = none(n_pairs, kind) if of_pairs is None else pa.array(of_pairs, kind)
            return pa.concat_arrays([one, two])

        a, b = a[head], b[head]
        return pa.table({
            "hash": column(pa.int64(), long["hash"].astype(np.int64), None), "grp": column(pa.int64(), long["grp"], rows["grp"][a]),
            "size": column(pa.int32(), long["size"], rows["size"][a]), "at": column(pa.int32(), long["at"], None),
            "other": column(pa.int64(), None, rows["grp"][b]), "other_size": column(pa.int32(), None, rows["size"][b]),
            "shared": column(pa.int32(), None, times), "passes": column(pa.bool_(), None, passes),
        })

    return messages.select("owner", "postings").groupBy("owner").applyInArrow(run, MET)


def pair_places(first, count):
    """The places of the two ends of every pair in the short lists that begin at ``first``."""
    import numpy as np

    left, right = [], []
    for size in range(2, SHORT_LIST + 1):
        begins = first[count == size]
        x, y = np.triu_indices(size, 1)
        left.append((begins[:, None] + x).ravel())
        right.append((begins[:, None] + y).ravel())
    return np.concatenate(left), np.concatenate(right)


def may_link(num: int, den: int):
    """The filters for rows with {a,b}_size, _at, _ahead and _short: lengths, places, and what prefixes can share."""
    sa, sb, pa, pb, la, lb = (F.col(f"{x}_{y}").cast("long") for y in ("size", "at", "ahead") for x in ("a", "b"))
    # The first shared element of a pair satisfies both in the list of that element:
    # overlap * (num + den) >= num * (|a| + |b|).
    most = F.least(sa - pa, sb - pb)
    shared = F.least(la, lb) + F.least("a_short", "b_short")
    return (den * F.least(sa, sb) >= num * F.greatest(sa, sb)) & (most * (num + den) >= num * (sa + sb)) & can_reach(shared, sa, sb, num, den)


def can_reach(shared, sa, sb, num: int, den: int):
    """Whether sets of these sizes can be similar if their prefixes share so much.

    Of the set whose prefix ends first in the global order, only the elements
    behind its prefix can add to that.
    """
    behind = lambda size: F.floor(F.lit(num) * size / den + F.lit(1 - 1e-9)) - 1  # noqa: E731  size - prefix_length(size)
    return (shared + F.greatest(behind(sa), behind(sb))) * (num + den) >= num * (sa + sb)


def hopeful(long: DataFrame, in_short: DataFrame, num: int, den: int) -> DataFrame:
    """hash, grp, size, at, ahead, short: the postings of long lists that may be a pair's first shared element.

    A pair that meets in a list first shares no more than the long lists
    ``ahead`` of either, and the ``short`` lists that either has with any other
    group. A group stays in a list only if that could make it similar to a set
    of some size in the list; so a copy with many words of its own, which no
    other group has, drops out before any pair is made.
    """
    ends = few(in_short.select("grp", "shared").unionAll(in_short.select(F.col("other").alias("grp"), "shared")))
    short = written(ends.join(sized(written(long.select("grp").distinct(), "in-long")), "grp", "left_semi").groupBy("grp").agg(F.max("shared").alias("short")), "most-short")
    sizes = sized(written(long.groupBy("hash").agg(F.min("size").alias("least"), F.max("size").alias("most")), "list-sizes"))
    ahead = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("at")))  # as many rows as the prefix has
    rows = long.withColumn("ahead", ahead).join(sized(short), "grp", "left").withColumn("short", F.coalesce("short", F.lit(0))).join(sizes, "hash")
    size, behind = F.col("size").cast("long"), (F.col("size") - F.col("at")).cast("long")
    hope = F.col("ahead") + F.col("short") + 1  # one more, as sizes are rounded
    fewest = F.greatest(F.col("least").cast("long"), F.ceil(F.lit(num) * size / den))
    widest = F.least(F.col("most").cast("long"), F.floor(F.lit(den) * size / num))
    # In between, the similarity that can be reached is smaller than at one of the ends.
    some = can_reach(hope, size, fewest, num, den) | can_reach(hope, size, widest, num, den)
    return rows.filter(some & (behind * (num + den) >= num * (size + F.col("least")))).select("hash", "grp", "size", "at", "ahead", F.col("short").cast("int").alias("short"))


def few(df: DataFrame, limit_rows: int = SMALL_ROWS) -> DataFrame:
    """Written rows of a few numbers, read by one task if a count shows that they are few.

    Grouping and joining them needs no shuffle then, whose many small tasks
    would take far longer than the work.
    """
    return df.coalesce(1) if df.count() <= limit_rows else df


def written(df: DataFrame, name: str) -> DataFrame:
    return few(materialize(df, name))


def sized(df: DataFrame, limit_rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= limit_rows else df


def reachable(pairs: DataFrame, in_short: DataFrame, in_long: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of groups (a, b) whose overlap can reach the similarity, by what their prefixes share.

    Shared prefix elements are known for short lists and at most the smaller
    number of long lists of the two.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("a_size").alias("a_size"), F.max("b_size").alias("b_size"))
    counts = in_short.select(F.col("grp").alias("a"), F.col("other").alias("b"), "shared")
    lists = sized(in_long)
    met = (
        pairs.join(counts, ["a", "b"], "left")
        .join(lists.select(F.col("grp").alias("a"), F.col("n_long").alias("a_long")), "a", "left")
        .join(lists.select(F.col("grp").alias("b"), F.col("n_long").alias("b_long")), "b", "left")
    )
    shared = F.coalesce("shared", F.lit(0)) + F.least(F.coalesce("a_long", F.lit(0)), F.coalesce("b_long", F.lit(0)))
    return met.filter(can_reach(shared, F.col("a_size").cast("long"), F.col("b_size").cast("long"), num, den)).select("a", "b")


def hub_pairs(entries: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Every group of a list with its hubs, where these have another component.

    Up to six hubs: three groups of the component that has most groups in the
    list, and three of all. One of three is the group with most long lists,
    which the others resemble most; two are drawn anew each turn.
    """
    entry = F.struct("grp", "size", "at", "ahead", "short", "component")
    drawn = lambda k: F.xxhash64(F.col("grp"), F.lit(turn + 100 * k))
    picks = [F.max(F.struct(F.col("ahead").cast("long").alias("d"), entry.alias("e"))), *[F.max(F.struct(drawn(k).alias("d"), entry.alias("e"))) for k in (1, 2)]]
    parts = entries.groupBy("hash", "component").agg(F.count("*").alias("m"), *[p.alias(f"h{k}") for k, p in enumerate(picks)])
    hubs = parts.groupBy("hash").agg(
        F.max(F.struct("m", "component", F.array("h0.e", "h1.e", "h2.e").alias("hubs"))).alias("top"), F.array(*[F.max(f"h{k}") for k in range(3)]).alias("any")
    ).select("hash", F.explode(F.array_distinct(F.concat("top.hubs", F.transform("any", lambda x: x["e"])))).alias("hub"))
    hubs = written(hubs.select("hash", F.col("hub.component").alias("cb"), *[F.col(f"hub.{c}").alias(n) for c, n in zip(("grp", "size", "at", "ahead", "short"), named("b"), strict=True)]), "hubs")
    met = entries.select("hash", F.col("component").alias("ca"), *side_of("a")).join(sized(hubs), "hash")
    return in_order(met.filter((F.col("ca") != F.col("cb")) & (F.col("a") != F.col("b")) & may_link(num, den)))


def named(side: str) -> list[str]:
    """What a posting's columns are called in pairs: the group itself, then what is known of it."""
    return [side, *[f"{side}_{c}" for c in ("size", "at", "ahead", "short")]]


def side_of(side: str) -> list:
    return [F.col(c).alias(n) for c, n in zip(("grp", "size", "at", "ahead", "short"), named(side), strict=True)]


def in_order(pairs: DataFrame) -> DataFrame:
    """a, b and their sizes with a < b."""
    swap = F.col("a") > F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("b_size")).otherwise(F.col("a_size")).alias("a_size"), F.when(swap, F.col("a_size")).otherwise(F.col("b_size")).alias("b_size"),
    )


def unsettled(long: DataFrame, in_lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries of the long lists that still hold several components: one for each component of a group."""
    here = in_lists.join(sized(labels), "node", "left").select("grp", F.coalesce("component", "node").alias("component")).distinct()
    entries = long.join(sized(written(here, "group-labels")), "grp")
    entries = written(entries, "labelled-lists")
    several = written(
        entries.groupBy("hash").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).filter("x <> y").select("hash", "k"), "open"
    )
    return entries.join(sized(several), "hash").select("hash", "grp", "size", "at", "ahead", "short", "component", "k")


def cross_pairs_bound(entries: DataFrame) -> int:
    """How many pairs of a list lie in different components, at most."""
    parts = entries.groupBy("hash", "component").agg(F.count("*").alias("m"))
    sums = parts.groupBy("hash").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return int(sums.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)).alias("n")).first()["n"])


def cross_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of groups between different components of a list that pass the filters.

    A list is dealt into parts of about ``PART_ROWS`` entries, and pairs of
    parts are joined, so a list that many groups have is the work of many tasks.
    """
    parts = F.ceil(F.col("k") / F.lit(PART_ROWS)).cast("int")
    dealt = entries.withColumn("n_parts", parts).withColumn("mine", F.pmod(F.xxhash64("grp", "component"), F.col("n_parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("n_parts") - 1)

    def side(name, mine, other):
        return dealt.select("hash", F.col("mine").alias(mine), F.explode(every).alias(other), F.col("component").alias(f"c{name}"), *side_of(name))

    met = side("a", "x", "y").join(side("b", "y", "x"), ["hash", "x", "y"])
    return met.filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_link(num, den)).select("a", "b", "a_size", "b_size")


def expanded(pairs: DataFrame, members: DataFrame, crowds: DataFrame, crowded: bool, labels: DataFrame | None = None) -> DataFrame:
    """a, b: the pairs of classes behind pairs of groups (a group with itself, too).

    Two groups with more than ``CROWD`` pairs between them give the first class
    of each with all of the other; with ``labels`` they give all pairs of
    classes in different components.
    """
    named = members.select("grp", "node") if labels is None else members.join(sized(labels), "node", "left").select("grp", "node", F.coalesce("component", "node").alias("component"))
    some = sized(crowds)
    counted = (
        pairs.join(some.select(F.col("grp").alias("a"), F.col("k").alias("ka"), F.col("first").alias("fa")), "a", "left")
        .join(some.select(F.col("grp").alias("b"), F.col("k").alias("kb"), F.col("first").alias("fb")), "b", "left")
        .withColumn("crowded", F.coalesce("ka", F.lit(1)) * F.coalesce("kb", F.lit(1)) > CROWD)
    )

    def ends(part, keep_a, keep_b):
        left = part.join(named.select(F.col("grp").alias("a"), F.col("node").alias("na"), *([F.col("component").alias("ca")] if labels is not None else [])), "a").filter(keep_a)
        right = named.select(F.col("grp").alias("b"), F.col("node").alias("nb"), *([F.col("component").alias("cb")] if labels is not None else []))
        differ = (F.col("na") != F.col("nb")) if labels is None else (F.col("ca") != F.col("cb"))
        return left.join(right, "b").filter(keep_b & differ).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

    every = F.lit(True)
    if labels is not None or not crowded:
        return ends(counted, every, every).distinct()
    apart, many = counted.filter(~F.col("crowded")), counted.filter("crowded")
    # A group of one class has no first class written down: its only one is the first.
    a_first, b_first = F.col("na") == F.coalesce("fa", "na"), F.col("nb") == F.coalesce("fb", "nb")
    return ends(apart, every, every).unionAll(ends(many, a_first, every)).unionAll(ends(many, every, b_first)).distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, component (its smallest node) of the graph with edges (a, b), written.

    Up to ``local_edges`` edges (16 bytes each) are one task's work; more are
    joined by large-star and small-star steps by turns.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if edges.count() <= local_edges:
        return materialize(edges.coalesce(1).mapInArrow(settled_in_one_task, "node long, component long"), "components")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
            .filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        edges = materialize(small, "edges")
        # Done when nobody is below two others, and nobody is both above and below.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("root")))
        open_ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("root").alias("root")).filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("root") > 0)))
        if not open_ends.limit(1).count():
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return materialize(nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def settled_in_one_task(batches):
    """Components of all the edges (u, v) of one task: roots are hooked to smaller ones, then paths cut short."""
    import numpy as np
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        rx, ry = root[x], root[y]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], ["node", "component"])


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of node ids whose whole sets reach the similarity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for x, y in zip(a, b, strict=True):
                merged = np.sort(np.frombuffer(x + y, "<u8"))  # each set is distinct
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(den * common >= num * (len(merged) - common))
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    both_ends = few(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))).distinct()
    sets = sized_semi_join(sets, written(both_ends, "ends"), "node")
    # Sets are the bulk, so both joins shuffle at every size, but only the sets of these pairs.
    left = pairs.hint("merge").join(sets.select(F.col("node").alias("a"), F.col("set").alias("a_set")), "a")
    both = left.hint("merge").join(sets.select(F.col("node").alias("b"), F.col("set").alias("b_set")), "b")
    return both.select("a", "b", "a_set", "b_set").mapInArrow(trimmed(run), "a long, b long")


def node_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, set: the shingle sets of the documents that are in some candidate pair."""

    def run(batches):
        import pyarrow as pa

        for batch in (x for whole in batches for x in sliced(whole, "text")):
            sets = [x.tobytes() for x in shingle_sets(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    wanted = sized_semi_join(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text")), nodes, "node")
    return wanted.mapInArrow(trimmed(run), "node long, set binary")


def similar_groups(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR, max_rounds: int = MAX_ROUNDS, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) by row, and (node, component) of linked nodes.

    A node is a class of documents with equal sets, named by its smallest id.
    """
    with small_batches(docs.sparkSession):
        return linked(docs, n, num, den, max_rounds, local_edges)


def linked(docs: DataFrame, n: int, num: int, den: int, max_rounds: int, local_edges: int) -> tuple[DataFrame, DataFrame]:
    """What ``similar_groups`` returns; every stage in Python is written here."""
    spark = docs.sparkSession
    n_owners = max(32, 4 * partitions_for(spark))  # an owner's postings are what a Python worker holds
    whole = materialize(scanned(docs, sketch(docs, n), n, num, den, n_owners), "shingled")
    rows = whole.filter("owner is null").select("doc_id", "n_shingles", "sig", "grp")
    members = written(
        rows.filter("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.max("grp").alias("grp"), F.max("n_shingles").cast("int").alias("size")).filter("node is not null"), "classes"
    )
    crowds = members.groupBy("grp").agg(F.count("*").alias("k"), F.min("node").alias("first")).filter("k > 1")
    crowds = written(crowds, "crowds")
    crowded = crowds.filter(F.col("k") * F.col("k") > CROWD).limit(1).count() > 0  # else no two groups have more pairs
    met = written(met_in_lists(whole.filter("owner is not null"), num, den), "lists")
    in_short = written(
        met.filter("other is not null").groupBy("grp", "other").agg(F.max("size").alias("size"), F.max("other_size").alias("other_size"), F.sum("shared").alias("shared"), F.max("passes").alias("passes")), "short-pairs"
    )
    long = met.filter("other is null").select("hash", "grp", "size", "at")
    in_long = written(long.groupBy("grp").agg(F.count("*").alias("n_long")), "long-lists")
    in_lists = written(sized_semi_join(members.select("grp", "node"), in_long.select("grp"), "grp"), "listed-classes")
    long = written(hopeful(long, in_short, num, den), "long")
    hubs = hub_pairs(long.withColumn("component", F.col("grp")), 0, num, den)
    short = in_short.filter("passes").select(F.col("grp").alias("a"), F.col("other").alias("b"), F.col("size").alias("a_size"), F.col("other_size").alias("b_size"))
    asked = written(reachable(few(short.unionAll(hubs)), in_short, in_long, num, den), "group-pairs")
    inside = crowds.select(F.col("grp").alias("a"), F.col("grp").alias("b"))  # equal prefixes and sizes always pass
    pairs = written(expanded(few(asked.unionAll(inside)), members, crowds, crowded), "pairs")
    nodes = written(few(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(in_lists.select("node"))).distinct(), "nodes")
    sets = materialize(node_sets(docs, nodes, n), "sets")
    labels = components(verified(pairs, sets, num, den), local_edges)
    last = False
    for turn in range(1, max_rounds + 1):
        entries = written(unsettled(long, in_lists, labels), "open-lists")
        size = entries.count()
        if not size and not crowded:
            break
        last = last or turn == max_rounds or cross_pairs_bound(entries) <= FEW_PAIRS * size
        tried = cross_pairs(entries, num, den) if last else hub_pairs(entries, turn, num, den)
        new = written(reachable(tried.join(asked, ["a", "b"], "left_anti"), in_short, in_long, num, den), "group-pairs")
        asked = few(asked.unionAll(new))
        # Crowded groups gave their first classes only: in the end all of their classes meet.
        final = few(asked.unionAll(inside)) if crowded else new
        pairs = written(expanded(final if last else new, members, crowds, crowded, labels if last else None), "pairs")
        links = written(verified(pairs, sets, num, den), "links")
        found = links.count()
        if found:
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links), local_edges)
        if last:
            break
        # Hubs that link few of their list any more have done their work.
        last = found < LEAST_SHARE * pairs.count()
    return rows.select("doc_id", "n_shingles", "sig").join(members.select("sig", "node"), "sig", "left"), labels


def similarity_classes(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, labels = similar_groups(docs, n, num, den)
    return rows.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")
    )


def drop_near(docs: DataFrame, n: int = N, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest id of each component, all columns."""
    with scratch_scope():  # sets and postings are not read again
        found = similarity_classes(docs, n, num, den)
        gone = materialize(found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct(), "near-copies", keep=True)
    few = gone.count() <= 1_000_000
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    return kept


def op8_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS g
  FROM w WHERE words IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id
"""
