"""Removal of repeated byte strings, by suffix arrays in shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Each start position (window) is judged by itself:

1. Documents are packed into blocks of about ``BLOCK_BYTES``, written once to
   the shared folder. A window is named by its smallest ``GRAM``-byte hash, so
   equal windows have equal names wherever they stand; neighbouring windows
   with one name form a run (16 or so windows on average, ``RUN_WINDOWS`` at
   most). Runs of a block with the same bytes are one entry.
2. Blocks send owners of name ranges the names of their entries. A name that
   one entry alone has can match nothing; this is all that names decide. The
   bytes of every other entry are sent to the owner.
3. Owners build suffix arrays over these bytes, one for each shard of about
   ``SHARD_BYTES``: Larsson-Sadakane refinement (ranks of 5, 10, 20, ... bytes,
   where only groups that are still tied are sorted again, until none is), and
   from the finished array Kasai's common prefixes of neighbours. Neighbours
   that share ``LENGTH`` bytes form a group; a window is matched if its group
   holds a smaller document. Entries of one name share a shard; if they are too
   many for one, its shards are merged by binary search of one shard's groups
   among the other's.
4. Blocks mark what the answers match, in their own positions.

So bytes decide every removal. Memory is bounded by blocks and shards; a
document longer than a block is a block by itself.

Defined results: null text is empty (nothing removed, the hash of no bytes);
a null id counts as larger than any other; documents with equal ids do not
remove each other's bytes; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions_for, read_table, small_batches

LENGTH = 50
#: Long enough that few texts share one by chance: common words alone fill 12 bytes.
GRAM = 20
BLOCK_BYTES = 1 << 19
#: Arrays over so many bytes stay in a core's cache, which makes both steps about twice as fast as over a block.
PART_BYTES = SHARD_BYTES = 1 << 17
#: Longer runs are cut, so that no entry is much longer than others.
RUN_WINDOWS = 1024
#: A rank, the rank further on and a position share 64 bits.
SHARD_LIMIT = 1 << 20
NO_ID = (1 << 63) - 1
#: Bitmaps, and answers about windows, are broadcast to the blocks up to this many bytes; beyond it Spark shuffles blocks and answers.
BROADCAST_BYTES, BROADCAST_WINDOWS = 64 << 20, 8 << 20
_powers: list = []


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(n: int):
    """B ** i and its inverse in 64 bits, kept by the worker."""
    import numpy as np

    if not _powers or len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, PART_BYTES + LENGTH), factor, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, ids, ends, data (compressed): documents in blocks; numbers are fixed once they are written."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 24
        ids, parts, size = [], [], 0

        def made():
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([number], pa.int64()), "ids": pa.array([np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()], pa.binary()),
                 "nulls": pa.array([bytes(i is None for i in ids)], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()), "data": pa.array([pack(b"".join(parts))], pa.binary())}
            )

        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or b""
                if parts and size + len(text) > block_bytes:
                    yield made()
                    number += 1
                    ids, parts, size = [], [], 0
                ids.append(batch.column(0)[k].as_py())
                parts.append(text)
                size += len(text)
        if parts:
            yield made()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "block long, ids binary, nulls binary, ends binary, data binary")


def rows_of(batch):
    """The blocks of an Arrow batch as dicts, one at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for k in range(batch.num_rows):
        row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
        yield row | {"data": unpack(row["data"])}


def runs_of(data: bytes, ends, length: int):
    """lo, hi (first and last start), name and hash of the runs of some documents."""
    import numpy as np

    n = len(data)
    span = length - GRAM + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    room = ends - starts >= length
    if not room.any():
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    padded = data + bytes(GRAM)
    a = np.ndarray((n,), "<u8", padded, 0, (1,)) * np.uint64(0x9FB21C651E98DF25)
    b = np.ndarray((n,), "<u8", padded, 8, (1,)) * np.uint64(0xD6E8FEB86659FD93)
    c = np.ndarray((n,), "<u4", padded, 16, (1,)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    grams = mixed(a ^ (b + (a >> np.uint64(31))) ^ (c + (b >> np.uint64(33))))
    least, wide = grams, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < span:
        least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
    # Valid starts: a whole window inside one document.
    edge = np.zeros(n + 1, dtype=np.int8)
    np.add.at(edge, starts[room], 1)
    np.add.at(edge, ends[room] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    name = least[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (valid[1:] != valid[:-1] + 1)
    # Adjacent documents of exactly one window have adjacent valid starts only across an end.
    begins = np.zeros(n + 1, dtype=bool)
    begins[starts] = True
    new |= begins[valid]
    first = np.flatnonzero(new)
    if np.diff(np.append(first, len(valid))).max() > RUN_WINDOWS:
        inside = np.arange(len(valid)) - np.repeat(first, np.diff(np.append(first, len(valid))))
        first = np.flatnonzero(new | (inside % RUN_WINDOWS == 0))
    name = mixed(mixed(name[first]))  # smallest hashes are small; owners have even ranges of names
    lo, hi = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(grams * up, out=total[1:])
    size = (hi - lo).astype(np.uint64)
    return lo, hi, name, mixed((total[hi + span] - total[lo]) * down[lo] + size * np.uint64(0x94D049BB133111EB))


class Block:
    """The runs of one block and its distinct entries (name, run), in order of their names."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes, length: int = LENGTH):
        import numpy as np

        self.ids, self.ends = np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
        self.data, self.length = np.frombuffer(data, np.uint8), length
        parts, doc = [], 0
        while doc < len(self.ends):
            base = int(self.ends[doc - 1]) if doc else 0
            stop = max(doc + 1, int(np.searchsorted(self.ends, base + PART_BYTES, side="right")))
            top = int(self.ends[stop - 1])
            if top - base <= PART_BYTES:
                pieces = [(base, top, self.ends[doc:stop] - base)]
            else:  # one long document: its windows are dealt to pieces that overlap, which cuts runs and loses none
                pieces = [(x, y, np.array([y - x])) for x in range(base, top, PART_BYTES) for y in (min(top, x + PART_BYTES + length - 1),)]
            for x, y, ends_here in pieces:
                lo, hi, name, run = runs_of(data[x:y], ends_here, length)
                parts.append((lo + x, hi + x, name, run))
            doc = stop
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.lo, self.hi, name, run = (np.concatenate(c) for c in zip(*(parts or [empty]), strict=True))
        self.doc = np.searchsorted(self.ends, self.lo, side="right")
        apart = np.zeros(len(name), dtype=np.int64)
        while True:
            order = np.lexsort((self.ids[self.doc], apart, run, name))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (name[order][1:] != name[order][:-1]) | (run[order][1:] != run[order][:-1]) | (apart[order][1:] != apart[order][:-1])
            self.entry = np.empty(len(order), dtype=np.int64)
            self.entry[order] = np.cumsum(fresh) - 1
            chosen = order[fresh]
            differs = self.unlike(chosen[self.entry])
            if not differs.any():
                break
            apart[differs] = np.flatnonzero(differs) + 1  # equal hashes, other bytes: an entry of its own
        self.names, self.least, self.example = name[chosen], self.ids[self.doc[chosen]], chosen

    def unlike(self, example):
        """Which runs have other bytes than their examples."""
        import numpy as np

        copies = np.flatnonzero(example != np.arange(len(example)))
        size = self.hi[copies] - self.lo[copies] + self.length
        other = example[copies]
        out = np.zeros(len(example), dtype=bool)
        same_size = size == self.hi[other] - self.lo[other] + self.length
        out[copies[~same_size]] = True
        copies, size, other = copies[same_size], size[same_size], other[same_size]
        if len(copies):
            begins = np.cumsum(size) - size
            inside = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begins, size).astype(np.int32)
            here, there = np.repeat(self.lo[copies].astype(np.int32), size), np.repeat(self.lo[other].astype(np.int32), size)
            out[copies] = np.logical_or.reduceat(self.data[here + inside] != self.data[there + inside], begins)
        return out


def short_names(names, n_owners: int):
    """32 bits of each name, taken below the bits that choose the owner; a clash only makes an owner see more bytes."""
    import numpy as np

    return (names >> np.uint64(max(0, 32 - n_owners.bit_length()))).astype(np.uint32)


def owner_cuts(names, n_owners: int):
    import numpy as np

    owner = (names >> np.uint64(32)) * np.uint64(n_owners) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(n_owners + 1))


def announced(blocks: DataFrame, n_owners: int) -> DataFrame:
    """owner, block, at, payload: the names of a block's entries in an owner's range."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["ids"], row["ends"], row["data"])
                cuts = owner_cuts(b.names, n_owners)
                some = [o for o in range(n_owners) if cuts[o + 1] > cuts[o]]
                brief = short_names(b.names, n_owners)
                payload = [brief[cuts[o] : cuts[o + 1]].tobytes() for o in some]
                yield pa.RecordBatch.from_pydict(
                    {"owner": pa.array(some, pa.int32()), "block": pa.array([row["block"]] * len(some), pa.int64()),
                     "at": pa.array([int(cuts[o]) for o in some], pa.int64()), "payload": pa.array(payload, pa.binary())}
                )

    return blocks.select("block", "ids", "ends", "data").mapInArrow(run, "owner int, block long, at long, payload binary")


def answered(messages: DataFrame) -> DataFrame:
    """block, at, n, contested: a bitmap over each message's entries of the names that other entries have."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        parts = [np.frombuffer(p, "<u4") for p in table.column("payload").to_pylist()]
        everything = np.sort(np.concatenate(parts))
        shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
        maps, some = [], []
        for k, names in enumerate(parts):
            at = np.searchsorted(shared, names)
            at[at == len(shared)] = 0
            found = shared[at] == names if len(shared) else np.zeros(len(names), dtype=bool)
            if found.any():
                some.append(k)
                maps.append(np.packbits(found).tobytes())
        kept = table.select(["block", "at"]).take(pa.array(some, pa.int64()))
        sizes = pa.array([len(parts[k]) for k in some], pa.int64())
        return kept.append_column("n", sizes).append_column("contested", pa.array(maps, pa.binary()))

    return messages.groupBy("owner").applyInArrow(run, "block long, at long, n long, contested binary")


def flags(block: Block, answers):
    """The answers' bitmap over all entries of a block."""
    import numpy as np

    out = np.zeros(len(block.names), dtype=bool)
    for a in answers or []:
        out[a["at"] : a["at"] + a["n"]] = np.unpackbits(np.frombuffer(a["contested"], np.uint8), count=a["n"])
    return out


def joined(blocks: DataFrame, answers: DataFrame, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Blocks with their answers; a broadcast only if these are small in bytes."""
    size = answers.select(F.sum(F.col("bytes")).alias("b")).first()["b"] or 0
    answers = answers.drop("bytes")
    return blocks.join(F.broadcast(answers) if size <= limit else answers, "block", how)


def disputed(blocks: DataFrame, answers: DataFrame, n_owners: int) -> DataFrame:
    """owner, block, entries, names, docs, sizes, data: the bytes (compressed) of entries whose names others have."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["ids"], row["ends"], row["data"])
                wanted = np.flatnonzero(flags(b, row["answers"]))
                if not len(wanted):
                    continue
                lo, hi = b.lo[b.example[wanted]], b.hi[b.example[wanted]] + b.length
                cuts = owner_cuts(b.names[wanted], n_owners)
                brief = short_names(b.names[wanted], n_owners)
                data, out = row["data"], []
                for o in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = slice(cuts[o], cuts[o + 1])
                    parts = b"".join(data[x:y] for x, y in zip(lo[mine].tolist(), hi[mine].tolist(), strict=True))
                    sizes = (hi[mine] - lo[mine]).astype("<u2")  # at most RUN_WINDOWS + LENGTH
                    out.append((o, row["block"], wanted[mine].astype("<i4").tobytes(), brief[mine].tobytes(), b.least[wanted[mine]].astype("<i8").tobytes(), sizes.tobytes(), pack(parts)))
                types = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
                names = ("owner", "block", "entries", "names", "docs", "sizes", "data")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], list(names))

    return joined(blocks, answers, "inner").select("block", "ids", "ends", "data", "answers").mapInArrow(
        run, "owner int, block long, entries binary, names binary, docs binary, sizes binary, data binary"
    )


def big_words(data: bytes, width: int = 8):
    """The big-endian number of the 8 bytes from each position (zeros after the end)."""
    import numpy as np

    padded = data + bytes(width)
    return np.ndarray((len(data),), ">u8", padded, 0, (1,)).astype(np.uint64)


def suffix_order(data: bytes, ends):
    """The order of all suffixes of the strings that end at ``ends`` (a string's end comes before any byte).

    Ranks cover every position; only positions in groups that are still tied
    are sorted at twice the depth, as Larsson and Sadakane do. A rank, the rank
    of the suffix further on and the position go into one 64-bit number, since
    sorting plain numbers is several times faster. Equal suffixes stand in the
    order of their places.
    """
    import numpy as np

    n = len(data)
    if n >= SHARD_LIMIT:
        raise ValueError(f"a shard must be smaller than {SHARD_LIMIT} bytes")
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    rest = bytes_left(n, ends)
    short = np.minimum(rest, 5)
    keep = np.array([((1 << 40) - 1) ^ ((1 << 8 * (5 - k)) - 1) for k in range(6)], dtype=np.uint64)
    key = (big_words(data) >> np.uint64(24) & keep[short]) << np.uint64(3) | short.astype(np.uint64)
    key = key << bits | np.arange(n, dtype=np.uint64)
    key.sort()
    order, key = (key & mask).astype(np.int32), key >> bits
    head = np.ones(n, dtype=bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    depth = 5
    while True:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        goes_on = rest[at] > depth
        after = np.where(goes_on, rank[np.where(goes_on, at + depth, 0)] + 1, 0)
        key = ((rank[at].astype(np.uint64) << bits) | after.astype(np.uint64)) << bits | at.astype(np.uint64)
        key.sort()
        at, key = (key & mask).astype(np.int32), key >> bits
        fresh = (key & mask) == 0  # strings that end here are told apart by their places
        fresh[1:] |= key[1:] != key[:-1]
        fresh[:1] = True
        order[tied] = at  # groups keep their places, members change theirs
        head[tied] = fresh
        rank[at] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        depth *= 2


def bytes_left(n: int, ends):
    """How many bytes there are from each position to the end of its string."""
    import numpy as np

    return (np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)).astype(np.int32)


def common_prefixes(data: bytes, order, ends, length: int = LENGTH, stride: int = 8):
    """Kasai's array at the windows, counted up to ``length``: bytes each shares with the suffix before it.

    A window is a suffix of ``length`` bytes at least; elsewhere the array is
    0, as no shorter suffix is asked for. A suffix shares at most one byte less
    with its neighbour than the suffix one place to the left of it does.
    Places are taken ``stride`` apart in each string, all at once, then those
    to the right of them, which start from that bound.
    """
    import numpy as np

    n = len(order)
    shared = np.zeros(n, dtype=np.int32)
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    words, rest = big_words(data + bytes(length + 8)), bytes_left(n, ends)
    windows = np.flatnonzero(rest >= length).astype(np.int32)
    sizes = np.diff(ends, prepend=0)
    phase = (np.repeat(sizes, np.maximum(sizes - length + 1, 0)) - rest[windows]) % stride
    for first in range(stride):
        at = windows[phase == first]
        at = at[before[at] >= 0]
        other = before[at]
        most = np.minimum(rest[other], length)
        known = np.maximum(shared[at - 1] - 1, 0) if first else np.zeros(len(at), dtype=np.int32)
        live = np.arange(len(at))
        while len(live):
            differs = words[at[live] + known[live]] ^ words[other[live] + known[live]]
            known[live] += np.where(differs == 0, 8, (64 - bit_length(differs)) // 8).astype(np.int32)
            live = live[(differs == 0) & (known[live] < most[live])]
        shared[at] = np.minimum(known, most)
    return shared[order]


def bit_length(x):
    """Bits of 64-bit integers, exactly."""
    import numpy as np

    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def equal_strings(data, begins, sizes):
    """For each string the place of the first one with the same bytes."""
    import numpy as np

    inside = np.arange(len(data)) - np.repeat(begins, sizes)
    up, _ = powers(int(sizes.max(initial=0)))
    value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    hashes = np.add.reduceat((value ^ (value >> np.uint64(29))) * up[inside], begins)
    order = np.lexsort((np.arange(len(sizes)), hashes, sizes))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (hashes[order][1:] != hashes[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    copies = np.flatnonzero(first != np.arange(len(first)))
    if len(copies):
        # Bytes decide: a string that only shares the hash stands for itself.
        size = sizes[copies]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        other = np.logical_or.reduceat(data[np.repeat(begins[copies], size) + place] != data[np.repeat(begins[first[copies]], size) + place], np.cumsum(size) - size)
        first[copies[other]] = copies[other]
    return first


class Shard:
    """A suffix array over some entries, its groups of equal windows and their least documents.

    Entries with the same bytes are one string of the array, with their least document.
    """

    def __init__(self, data: bytes, ends, docs, length: int = LENGTH):
        import numpy as np

        self.length, self.docs = length, np.asarray(docs)
        self.sizes = np.diff(ends, prepend=0)
        octets, begins = np.frombuffer(data, np.uint8), ends - self.sizes
        same = equal_strings(octets, begins, self.sizes)
        kept = np.flatnonzero(same == np.arange(len(same)))
        self.string = np.searchsorted(kept, same)
        least = np.full(len(kept), NO_ID, dtype=np.int64)
        np.minimum.at(least, self.string, self.docs)
        size = self.sizes[kept]
        ends = np.cumsum(size)
        self.begins = ends - size
        self.data = data = octets[np.repeat(begins[kept] - self.begins, size) + np.arange(int(size.sum()))].tobytes()
        order = suffix_order(data, ends)
        group = np.cumsum(common_prefixes(data, order, ends, length) < length)
        window = bytes_left(len(data), ends)[order] >= length
        self.order, group = order[window], group[window]
        head = np.ones(len(group), dtype=bool)
        head[1:] = group[1:] != group[:-1]
        self.group, self.first = np.cumsum(head) - 1, np.flatnonzero(head)
        doc = np.repeat(least, size)[self.order]
        self.least = np.minimum.reduceat(doc, self.first) if len(doc) else doc

    def keys(self):
        """The bytes of each group as big-endian words, in order; what is beyond the length is cleared."""
        import numpy as np

        words = big_words(self.data + bytes(self.length))
        at = self.order[self.first]
        out = np.stack([words[at + k] for k in range(0, self.length, 8)], axis=1) if len(at) else np.zeros((0, -(-self.length // 8)), np.uint64)
        spare = 8 * (-(-self.length // 8)) - self.length
        out[:, -1] &= np.uint64(((1 << 64) - 1) ^ ((1 << (8 * spare)) - 1))
        return out

    def matched(self):
        """Of each start, in the order of the entries: whether a smaller document has its window."""
        import numpy as np

        least = np.full(len(self.data), NO_ID, dtype=np.int64)
        least[self.order] = self.least[self.group]
        inside = np.arange(int(self.sizes.sum())) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        return least[np.repeat(self.begins[self.string], self.sizes) + inside] < np.repeat(self.docs, self.sizes)


def binary_search(keys, wanted):
    """The place of each wanted key among sorted keys, or -1 (rows of big-endian words)."""
    import numpy as np

    low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(keys), dtype=np.int64)
    if not len(keys):
        return low - 1
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(keys) - 1)
        less, settled = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=bool)
        for k in range(keys.shape[1]):
            a, b = keys[middle, k], wanted[:, k]
            less |= ~settled & (a < b)
            settled |= a != b
        active = low < high
        low = np.where(active & less, middle + 1, low)
        high = np.where(active & ~less, middle, high)
    at = np.minimum(low, len(keys) - 1)
    return np.where((keys[at] == wanted).all(axis=1), at, -1)


def merge(shards: list[Shard]) -> None:
    """Gives groups that several shards have the least document of all."""
    keys = [s.keys() for s in shards] if len(shards) > 1 else []
    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            at = binary_search(keys[i], keys[j])
            hit = at >= 0
            a, b = shards[i].least, shards[j].least
            low = a[at[hit]].copy()
            low[b[hit] < low] = b[hit][b[hit] < low]
            a[at[hit]] = low
            b[hit] = low
    # A second pass lets the last shard's least reach the first ones.
    for i in reversed(range(len(keys))):
        for j in reversed(range(i)):
            at = binary_search(keys[j], keys[i])
            hit = at >= 0
            a = shards[j].least
            better = shards[i].least[hit] < a[at[hit]]
            a[at[hit][better]] = shards[i].least[hit][better]


def settled(messages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """block, entries, sizes, bits: the windows of contested runs that a smaller document has."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        column = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        unpack = zstandard.ZstdDecompressor().decompress
        entries = column("entries", "<i4")
        names, docs = np.concatenate(column("names", "<u4")), np.concatenate(column("docs", "<i8"))
        data = np.frombuffer(b"".join(unpack(x) for x in table.column("data").to_pylist()), np.uint8)
        sizes = np.concatenate(column("sizes", "<u2")).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(names, kind="stable")
        hit = np.zeros(len(data), dtype=bool)
        for same_name, groups in shard_cuts(names[order], sizes[order], shard_bytes):
            shards, places = [], []
            for a, b in groups:  # a shard is held only while its group of shards is settled
                mine = order[a:b]
                stops = np.cumsum(sizes[mine])
                place = np.repeat(begins[mine] - (stops - sizes[mine]), sizes[mine]) + np.arange(stops[-1])
                shards.append(Shard(data[place].tobytes(), stops, docs[mine]))
                places.append(place)
            if same_name:
                merge(shards)
            for shard, place in zip(shards, places, strict=True):
                hit[place] = shard.matched()
        out = {"block": [], "entries": [], "sizes": [], "bits": []}
        at, any_hit = 0, np.logical_or.reduceat(hit, begins) if len(begins) else hit
        for block, ids in zip(table.column("block").to_pylist(), entries, strict=True):
            first, size, some = begins[at : at + len(ids)], sizes[at : at + len(ids)], np.flatnonzero(any_hit[at : at + len(ids)])
            at += len(ids)
            if len(some):
                windows = size[some] - LENGTH + 1
                bits = hit[np.repeat(first[some] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))]
                for key, value in zip(out, (block, ids[some].tobytes(), windows.astype("<u2").tobytes(), np.packbits(bits).tobytes()), strict=True):
                    out[key].append(value)
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return messages.groupBy("owner").applyInArrow(run, "block long, entries binary, sizes binary, bits binary")


def shard_cuts(names, sizes, shard_bytes: int):
    """(whether all have one name, [(from, to)]) over runs in the order of their names.

    Names are kept together; one that is too large for a shard gets several of its own.
    """
    import numpy as np

    edges = np.append(np.flatnonzero(np.append(True, names[1:] != names[:-1])), len(names)).tolist()
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if total[b] - total[start] <= shard_bytes:
            continue
        if a > start:
            yield False, [(start, a)]
        start = a
        if total[b] - total[a] > shard_bytes:
            cuts = [a]
            while cuts[-1] < b:
                cuts.append(max(cuts[-1] + 1, min(b, int(np.searchsorted(total, total[cuts[-1]] + shard_bytes, side="right")) - 1)))
            yield True, list(zip(cuts[:-1], cuts[1:], strict=True))
            start = b
    if start < len(names):
        yield False, [(start, len(names))]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def marked(blocks: DataFrame, with_parts: bool) -> DataFrame:
    """The rows of the result from blocks with ``windows``."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in rows_of(batch):
                yield from judge(row, with_parts, np, pa)

    parts = ", spans array<struct<start: long, end: long>>, kept binary" if with_parts else ""
    return blocks.select("block", "ids", "nulls", "ends", "data", "windows").mapInArrow(run, RESULT + parts)


def judge(row: dict, with_parts: bool, np, pa):
    b = Block(row["ids"], row["ends"], row["data"])
    n, docs = len(b.data), b.ids
    change = np.zeros(n + 1, dtype=np.int64)
    whole = docs[b.doc] > b.least[b.entry]  # the same bytes stand in a smaller document of this block
    np.add.at(change, b.lo[whole], 1)
    np.add.at(change, b.hi[whole] + b.length, -1)
    answers = row["windows"] or []
    if answers:
        entries, sizes = (np.concatenate([np.frombuffer(w[key], kind) for w in answers]).astype(np.int64) for key, kind in (("entries", "<i4"), ("sizes", "<u2")))
        bits = [np.unpackbits(np.frombuffer(w["bits"], np.uint8), count=int(np.frombuffer(w["sizes"], "<u2").sum(dtype=np.int64))) for w in answers]
        bits, place = np.concatenate(bits).astype(bool), np.full(len(b.names), -1, dtype=np.int64)
        place[entries] = np.cumsum(sizes) - sizes
        runs = np.flatnonzero(~whole & (place[b.entry] >= 0))
        lo, n_windows = b.lo[runs], b.hi[runs] - b.lo[runs] + 1
        inside = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        starts = (np.repeat(lo, n_windows) + inside)[bits[np.repeat(place[b.entry[runs]], n_windows) + inside]]
        change += np.bincount(starts, minlength=n + 1) - np.bincount(starts + b.length, minlength=n + 1)
    gone = np.cumsum(change[:-1]) > 0
    begins = np.concatenate([[0], b.ends[:-1]]).astype(np.int64)
    count = np.concatenate([[0], np.cumsum(gone)])
    removed = count[b.ends] - count[begins]
    # A span begins where a byte goes and the one before it stays or is another document's.
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    first = begins[begins < n]
    edge[first] = gone[first]
    spans = np.concatenate([[0], np.cumsum(edge)])
    n_spans = spans[b.ends] - spans[begins]
    left = b.data[~gone].tobytes()
    stay = np.concatenate([[0], np.cumsum(~gone)])
    view = memoryview(left)
    cuts = [(int(stay[x]), int(stay[y])) for x, y in zip(begins, b.ends, strict=True)]
    ids = pa.array(docs, pa.int64(), mask=np.frombuffer(row["nulls"], np.uint8).astype(bool))
    columns = [ids, pa.array(b.ends - begins, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
               pa.array([hashlib.sha256(view[x:y]).hexdigest() for x, y in cuts], pa.string())]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_parts:
        listed = []
        for x, y in zip(begins.tolist(), b.ends.tolist(), strict=True):
            change_at = np.flatnonzero(np.diff(gone[x:y].astype(np.int8), prepend=0, append=0))
            listed.append([{"start": int(s), "end": int(e)} for s, e in zip(change_at[::2], change_at[1::2], strict=True)])
        columns += [pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([left[x:y] for x, y in cuts], pa.binary())]
        names += ["spans", "kept"]
    yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, with_parts: bool = False, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (and spans, kept)."""
    with small_batches(docs.sparkSession):
        return materialize(judged(docs, with_parts, block_bytes, shard_bytes), "repeats")


def judged(docs: DataFrame, with_parts: bool, block_bytes: int, shard_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    n_owners = max(32, 2 * partitions_for(spark))  # a group is what a Python worker holds
    blocks = materialize(packed(docs, block_bytes), "blocks")
    raw = materialize(answered(announced(blocks, n_owners)), "answers")
    answers = materialize(
        raw.groupBy("block").agg(F.collect_list(F.struct("at", "n", "contested")).alias("answers"), F.sum(F.length("contested") + 40).alias("bytes")), "answers-by-block"
    )
    windows = materialize(
        settled(disputed(blocks, answers, n_owners), shard_bytes).groupBy("block").agg(
            F.collect_list(F.struct("entries", "sizes", "bits")).alias("windows"), F.sum(F.length("entries") + F.length("sizes") + F.length("bits") + 40).alias("bytes")
        ), "windows-by-block",
    )
    return marked(joined(blocks, windows, "left", BROADCAST_WINDOWS), with_parts)


def op9_sharded_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
