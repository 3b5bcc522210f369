"""Periodic runs of words in each text, and their removal.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that no neighbouring word extends; asked are the runs of at
least ``MIN_LENGTH`` words and ``MIN_POWER`` periods. All are found:

1. A run of L words and period q repeats L - q of them, so a text where no
   string of ``repeat_length`` words occurs twice has none. Sorted hashes of
   these strings drop such texts (equal strings have equal hashes, so nothing
   that has a run is dropped).
2. The other texts get a suffix array by prefix doubling, whose ranks at 1, 2,
   4, ... words stay as names of all strings of these lengths; names give the
   common prefix or suffix of any two places, and so the LCP array.
3. One pass over a linked list of the suffix order turns LCP into the longest
   previous factor of every place, and these give the LZ blocks.
4. A run that lies inside a block, away from both ends, is a copy of a run in
   the block's earlier occurrence. Any other touches a border of blocks, where
   Main's extensions find it: for each period that the lengths of the blocks
   at the border allow, the common prefixes and suffixes of what is one period
   apart. Runs are kept in order of their starts, and blocks from left to right
   copy what their earlier occurrence holds.

Words are compared as words (numbered by a dictionary), never by hashes. A text
is one task's work: the ranks take 4 bytes a word and doubling, some 200 bytes a
word in all with the words themselves.

Defined results: null text has no words; a row with a null id is a row like any
other (and is never rewritten by ``tail``); texts with equal ids are judged one
by one; an empty table gives an empty result; ``collapsed`` keeps all columns,
and a text without runs as it is.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, read_table
from .tokens import sliced

MIN_LENGTH = 24
MIN_POWER = 3
#: Words of the texts that are looked at together.
BATCH_WORDS = 1 << 17


def repeat_length(min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> int:
    """Every asked run holds some string of so many words twice."""
    return min_length - min_length // min_power


def numbered(texts: list[list[bytes]]) -> list:
    """Each text's words as numbers; equal words of the list have equal numbers."""
    import numpy as np

    known: dict[bytes, int] = {}
    for words in texts:
        for w in set(words).difference(known):
            known[w] = len(known)
    return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in texts]


def may_repeat(texts: list, width: int) -> list[bool]:
    """Which texts (arrays of numbers) hold a string of ``width`` words twice; some others may pass, too."""
    import numpy as np

    out = [False] * len(texts)
    sizes = np.array([len(t) for t in texts])
    if not len(texts) or sizes.max() <= width:
        return out
    h = np.concatenate(texts).astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    have, rolled, done = h, None, 0
    for bit in range(width.bit_length()):  # strings of 1, 2, 4, ... words; those in ``width`` are put together
        if width >> bit & 1:
            rolled = have if rolled is None else spliced(rolled, have, done)
            done += 1 << bit
        if done < width:
            have = spliced(have, have, 1 << bit)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.maximum(sizes - width + 1, 0))
    starts = np.cumsum(sizes) - sizes
    at = np.concatenate([np.arange(s, s + max(0, n - width + 1)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    shift = np.uint64(max(1, len(texts).bit_length()))
    keys = np.sort((rolled[at] >> shift) | (owner << (np.uint64(64) - shift)))
    for k in np.unique(keys[1:][keys[1:] == keys[:-1]] >> (np.uint64(64) - shift)).tolist():
        out[int(k)] = True
    return out


def spliced(a, b, gap: int):
    """The hashes of strings of a followed, ``gap`` words on, by strings of b."""
    import numpy as np

    h = a[: len(b) - gap] * np.uint64(0xBF58476D1CE4E5B9) + b[gap:]
    return h ^ (h >> np.uint64(31))


class Names:
    """Names of all strings of 1, 2, 4, ... words of one text, in suffix order, and the suffix array."""

    def __init__(self, words):
        import numpy as np

        n = len(words)
        self.n = n
        order = np.argsort(words, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = words[order][1:] != words[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of a group names it
        self.levels, width = [rank.astype(np.int32)], 1
        while True:
            # Only groups that are still tied are sorted again, by what follows.
            count = np.diff(np.append(np.flatnonzero(new), n))
            places = np.flatnonzero(np.repeat(count > 1, count))
            if not len(places):
                break
            at = order[places]
            after = np.zeros(len(at), dtype=np.int64)
            inside = at + width < n
            after[inside] = rank[at[inside] + width] + 1
            key = rank[at] * (n + 1) + after
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[places] = at
            head = np.ones(len(at), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            new[places] = head
            rank = rank.copy()
            rank[at] = places[np.flatnonzero(head)[np.cumsum(head) - 1]]
            width *= 2
            self.levels.append(rank.astype(np.int32))
        self.suffixes = order

    def forward(self, x, y):
        """Common prefix lengths of the suffixes at x and y (x <> y; the length of the text is a place, too)."""
        import numpy as np

        x, y, out = x.copy(), y.copy(), np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.maximum(x, y) + (1 << k) <= self.n
            same = inside & (self.levels[k][np.minimum(x, self.n - 1)] == self.levels[k][np.minimum(y, self.n - 1)])
            step = same.astype(np.int64) << k
            x, y, out = x + step, y + step, out + step
        return out

    def backward(self, x, y):
        """Common suffix lengths of the prefixes that end before x and y."""
        import numpy as np

        x, y, out = x.copy(), y.copy(), np.zeros(len(x), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.minimum(x, y) >= 1 << k
            same = inside & (self.levels[k][np.maximum(x - (1 << k), 0)] == self.levels[k][np.maximum(y - (1 << k), 0)])
            step = same.astype(np.int64) << k
            x, y, out = x - step, y - step, out + step
        return out


def previous_factors(names: Names) -> tuple[list[int], list[int]]:
    """The longest previous factor of every place, and where it occurs before (-1: nowhere).

    Places leave the list of the suffix order from the last to the first, so a
    place's neighbours when it leaves are the nearest suffixes that begin before
    it; a removal leaves the smaller of the two common prefixes.
    """
    import numpy as np

    n, sa = names.n, names.suffixes
    lcp = np.zeros(n + 1, dtype=np.int64)
    if n > 1:
        lcp[sa[1:]] = names.forward(sa[:-1], sa[1:])  # of a place with the one before it in suffix order
    before, after = np.full(n + 1, -1), np.full(n + 1, n)
    before[sa[1:]], after[sa[:-1]] = sa[:-1], sa[1:]
    left, right, common = before.tolist(), after.tolist(), lcp.tolist()  # the place n is behind the last suffix
    length, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        x, y = left[i], right[i]
        p, q = common[i], common[y]
        if p >= q:
            if p:
                length[i], source[i] = p, x
            common[y] = q
        else:
            length[i], source[i] = q, y
            common[y] = p
        left[y] = x
        if x >= 0:
            right[x] = y
    return length, source


def blocks_of(length: list[int]) -> list[int]:
    """Where the LZ blocks begin, and the length of the text."""
    starts, at = [], 0
    while at < len(length):
        starts.append(at)
        at += max(1, length[at])
    return [*starts, len(length)]


def border_runs(names: Names, starts: list[int], min_length: int, min_power: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the asked runs that touch a border of blocks, perhaps with a multiple of the period."""
    import numpy as np

    at = np.array(starts[1:], dtype=np.int64)
    left = np.diff(np.array(starts, dtype=np.int64))
    right = np.append(left[1:], 0)
    # A run over a border has at most one block that begins after its first period and
    # before its end, which bounds its period by the two blocks; shorter blocks hold no run.
    enough = left + right > repeat_length(min_length, min_power)
    at, left, right = at[enough], left[enough], right[enough]
    out: set[tuple[int, int, int]] = set()
    for before, most in ((True, (left + right) // (min_power - 1)), (False, right // (min_power - 1))):
        border, q = np.repeat(at, most), np.arange(int(most.sum())) - np.repeat(np.cumsum(most) - most, most) + 1
        base = border - q if before else border
        inside = (base >= 0) & (base + q <= names.n)
        base, q = base[inside], q[inside]
        ahead, behind = names.forward(base, base + q), names.backward(base, base + q)
        size = ahead + behind + q
        found = (size >= min_length) & (size >= min_power * q)
        first = (base - behind)[found]
        out.update(zip(first.tolist(), (first + size[found]).tolist(), q[found].tolist(), strict=True))
    return out


def runs_of(words, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all asked runs of a text (an array of word numbers), by start, then period."""
    if len(words) < min_length:
        return []
    names = Names(words)
    length, source = previous_factors(names)
    starts = blocks_of(length)
    least: dict[tuple[int, int], int] = {}
    for first, end, q in border_runs(names, starts, min_length, min_power):
        least[first, end] = min(q, least.get((first, end), q))
    runs = sorted((first, end, q) for (first, end), q in least.items())
    for begin, stop in zip(starts[:-1], starts[1:], strict=True):
        if stop - begin < min_length + 2:
            continue
        old = source[begin]
        ahead, shift = old + (stop - begin), begin - old
        k = bisect_left(runs, (old + 1,))
        while k < len(runs) and runs[k][0] < ahead:  # a copy begins further on than its source: the loop meets it, too
            first, end, q = runs[k]
            if end < ahead:
                copy = (first + shift, end + shift, q)
                if runs[bisect_left(runs, copy) : bisect_left(runs, copy) + 1] != [copy]:
                    insort(runs, copy)
            k += 1
    return [(first, end - first, q) for first, end, q in sorted(runs, key=lambda r: (r[0], r[2]))]


def periodic_tail(words: list[bytes], mark: int | None) -> list[bytes]:
    """The words with a periodic end if the mark (the id's CRC-32) is divisible by 10."""
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for first, end in sorted((start + q, start + length) for start, length, q in runs):
        if end > at:
            kept += words[at : max(at, first)]
            at = end
    return kept + words[at:]


def judged(texts: list[list[bytes]], min_length: int, min_power: int):
    """The runs of each text."""
    numbers = numbered(texts)
    for words, some in zip(numbers, may_repeat(numbers, repeat_length(min_length, min_power)), strict=True):
        yield runs_of(words, min_length, min_power) if some else []


def grouped(batch, size: int):
    """The rows of a batch with their words, about ``size`` words at a time."""
    rows, held = [], 0
    for k in range(batch.num_rows):
        words = (batch.column(0)[k].as_py() or b"").split()  # of bytes: ASCII blanks only
        rows.append((k, words))
        held += len(words)
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


REPORT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_report(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER, tail: bool = False) -> DataFrame:
    """doc_id, the number of runs, the run with the greatest exponent, and digests of all runs and of the collapsed text.

    With ``tail``, texts whose id has a CRC-32 divisible by 10 get a periodic end first (see ``periodic_tail``).
    """

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for batch in (x for whole in batches for x in sliced(whole, "text")):
            marks = batch.column(1).to_pylist() if tail else [None] * batch.num_rows
            for rows in grouped(batch, BATCH_WORDS):
                texts = [periodic_tail(words, marks[k]) for k, words in rows]
                out = []
                for (k, _), words, runs in zip(rows, texts, judged(texts, min_length, min_power), strict=True):
                    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
                    listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
                    out.append((batch.column(2)[k].as_py(), len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha256(listed.encode()).hexdigest(), sha256(b" ".join(without_repeats(words, runs))).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col("text").cast("binary").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id long, {REPORT}")


def collapsed(docs: DataFrame, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER) -> DataFrame:
    """All columns of ``docs``; a text with runs keeps the first period of each, its words joined by one space.

    What has no run keeps its blanks. Only the text goes through Python, beside
    the other columns in the same batch.
    """
    made = fresh(docs.columns, "collapsed_text")
    schema = StructType([*docs.schema.fields, StructField(made, StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in (x for whole in batches for x in sliced(whole, made)):
            at = batch.schema.get_field_index(made)
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            out = [None] * batch.num_rows
            for rows in grouped(texts, BATCH_WORDS):
                words = [w for _, w in rows]
                for (k, mine), runs in zip(rows, judged(words, min_length, min_power), strict=True):
                    out[k] = b" ".join(without_repeats(mine, runs)).decode() if runs else None
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string())], names=batch.schema.names)

    whole = docs.select("*", F.col("text").cast("binary").alias(made))
    found = whole.mapInArrow(run, schema)
    return found.select(*[F.coalesce(made, "text").alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(read_table(spark, sf_dir, "documents"), tail=True)
