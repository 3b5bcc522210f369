import hashlib
import random

import numpy as np

from sparkloom.llm import substring_dedup
from tests.llm.conftest import rows_of

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=50):
    key = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], (True, 1)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(3)
    words = ["ab", "the", "xyz", "éa", "qwerty", "lo", "rem", "\n", "ip", "sum"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(12, 30)) for _ in range(6)]
    rows = []
    for i in range(120):
        r = rng.random()
        if r < 0.15 and rows:
            t = rng.choice(rows)[1]
        elif r < 0.4 and rows:
            t = list(rng.choice(rows)[1] or "zzz")
            for _ in range(3):
                t[rng.randrange(len(t))] = rng.choice("abcXYZ")
            t = "".join(t)
        else:
            t = text(rng.randint(0, 60)) + " " + (rng.choice(passages) if rng.random() < 0.7 else "") + " " + text(rng.randint(0, 40))
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "a" * 180), (None, rows[3][1]), (None, rows[3][1]), (7, rows[9][1]), (504, "ab" * 100), (505, "\0" * 120), (506, "\0" * 60 + "x"), (2001, rows[2][1][:50]), (2002, rows[2][1][:49])]
    rng.shuffle(rows)
    return rows


def test_suffix_array_and_prefixes():
    strings = [(t or "").encode() for _, t in planted()][:90]
    strings = [x for x in strings if x]
    data, ends = b"".join(strings), np.cumsum([len(x) for x in strings])
    order = substring_dedup.suffix_order(data, ends)
    stop = ends[np.searchsorted(ends, order, side="right")]
    keys = [(data[i:e], i) for i, e in zip(order.tolist(), stop.tolist(), strict=True)]
    assert sorted(order.tolist()) == list(range(len(data))) and keys == sorted(keys)
    shared = substring_dedup.common_prefixes(data, order, ends)
    for k in range(1, len(keys)):
        x, y = keys[k - 1][0][:50], keys[k][0][:50]
        assert shared[k] == (next((n for n, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y))) if len(y) == 50 else 0)


def test_equal_hashes_do_not_remove(monkeypatch):
    # Every run gets the same hash: entries are told apart by their bytes.
    texts = [("%03d " % k) * 30 for k in range(20)] * 2
    data, ends = "".join(texts).encode(), np.cumsum([len(t) for t in texts])
    plain = substring_dedup.Block(np.arange(40).tobytes(), ends.tobytes(), data)
    scrambled = substring_dedup.mixed
    calls = []

    def blunt(x):
        calls.append(1)
        return np.zeros_like(x) if len(calls) == 4 else scrambled(x)  # grams, twice the names, then the runs

    monkeypatch.setattr(substring_dedup, "mixed", blunt)
    forced = substring_dedup.Block(np.arange(40).tobytes(), ends.tobytes(), data)
    pieces = lambda b: [data[x : y + 50] for x, y in zip(b.lo.tolist(), b.hi.tolist(), strict=True)]
    assert pieces(plain) == pieces(forced)
    for r, piece in enumerate(pieces(forced)):
        assert pieces(forced)[forced.example[forced.entry[r]]] == piece


def test_matches_brute_force_and_small_shards(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substring_dedup.remove_repeats(docs), *NAMES) == brute(rows)
    # Tiny blocks and shards: names larger than a shard are merged by binary search.
    assert rows_of(substring_dedup.remove_repeats(docs, block_bytes=1500, shard_bytes=300), *NAMES) == brute(rows)


def test_long_documents_are_cut_into_pieces(monkeypatch):
    data = "".join(t or "" for _, t in planted()).encode()
    starts = []
    for size in (1 << 17, 211):
        monkeypatch.setattr(substring_dedup, "PART_BYTES", size)
        block = substring_dedup.Block(np.array([1]).tobytes(), np.array([len(data)]).tobytes(), data)
        starts.append({x: name for lo, hi, name in zip(block.lo.tolist(), block.hi.tolist(), block.names[block.entry].tolist(), strict=True) for x in range(lo, hi + 1)})
    assert starts[0] == starts[1] and sorted(starts[0]) == list(range(len(data) - 49))


def test_spans_give_the_kept_bytes(spark, clashing, odd_rows, empty):
    found = substring_dedup.remove_repeats(clashing, with_parts=True).collect()
    assert sorted(((r["doc_id"], r["n_bytes"]) for r in found), key=str) == sorted(((d, len((t or "").encode())) for d, t, *_ in odd_rows), key=str)
    for r in found:
        assert r["n_spans"] == len(r["spans"]) and r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_common_words_do_not_make_texts_contested():
    """Texts of the same words in other orders share no window, so few of their bytes should go to owners."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    names = []
    for _ in range(4):
        data = " ".join(rng.choice(words) for _ in range(4000)).encode()
        names.append(substring_dedup.Block(np.array([1], "<i8").tobytes(), np.array([len(data)], "<i8").tobytes(), data).names)
    every, times = np.unique(np.concatenate(names), return_counts=True)
    assert times[times > 1].sum() < 0.2 * times.sum()
