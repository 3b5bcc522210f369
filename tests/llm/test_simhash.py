import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import ngram_join, simhash
from tests.llm.conftest import DOC_SCHEMA


def plain(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_by_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "Straße", "b", "É", "stone"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 50, 400)] + [None, " \x0b\x0c ", "x" * 500]
    for size in (1 << 18, 40, 7):
        monkeypatch.setattr(simhash, "pieces_of", lambda text, size=size: ngram_join.pieces_of(text, size))
        assert [simhash.fingerprint(t and t.encode()) for t in texts] == [plain(t) for t in texts]


def test_hash_is_the_one_of_the_engine(spark):
    assert spark.sql("select xxhash64('a straße') as h").first()["h"] == np.uint64(xxhash.xxh64_intdigest("a straße".encode(), 42)).view(np.int64)


def planted(rng, n, groups=40):
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains: each a few bits from the last
            for b in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << b
            out.add(base)
    while len(out) < n:
        out.add(rng.getrandbits(64) & rng.getrandbits(64) if rng.random() < 0.3 else rng.getrandbits(64))
    return sorted(out)


def brute_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("rows", [64, 300, 5000])
def test_tiles_find_every_link(spark, rows):
    rng = random.Random(rows)
    fps = planted(rng, 900)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["component"] for r in simhash.near_fingerprints(df, rows=rows).collect()}
    groups = {}
    for f, r in brute_components(fps).items():
        groups.setdefault(r, []).append(signed(f))
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


def test_close_pairs_and_skipped_tiles(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 60, (300, 4)).astype(np.uint64))
    b = np.unique(a[:300] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2] ^ flips[:, 3])
    for same, y in ((False, b), (True, np.concatenate([a, b]))):
        x = y if same else a
        got = {tuple(sorted(p)) for u, v in simhash.close_pairs(x, y, same, 4) for p in zip(u.tolist(), v.tolist(), strict=True)}
        d = np.bitwise_count(x[:, None] ^ y[None, :])
        expected = {tuple(sorted((int(x[i]), int(y[j])))) for i, j in zip(*np.nonzero(d <= 4), strict=True) if not same or i < j}
        assert got == expected and got
    few = spark.createDataFrame([(v,) for v in (0, 1, (1 << 40) - 1, -1, -2)], "fp long")
    made, last = simhash.tiles(few, 1)
    assert made.count() == 5 and simhash.tile_pairs(made, last, 4).filter("a <> b").count() == 2  # 0 with 1, -1 with -2
    plan, last = simhash.tile_plan([((3, 1, 1), 2), ((4, 1, 1), 9), ((9, 0, 0), 1)], 4)
    assert plan == [(3, 1, 1, 0, 1), (4, 1, 1, 1, 3), (9, 0, 0, 4, 1)] and last[:10] == [-1, -1, -1, 0, 3, 3, 3, 3, 3, 4]


def test_many_links_are_folded(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_LINKS", 100)
    near = [sum(1 << b for b in (i, j)) for i in range(30) for j in range(i)]
    df = spark.createDataFrame([(f,) for f in near], "fp long")
    got = simhash.near_fingerprints(df).collect()
    assert len(got) == len(near) and {r["component"] for r in got} == {min(near)}


def test_components_match_brute_force(odd, odd_rows, clashing, empty):
    of = [(d, plain(t)) for d, t, *_ in odd_rows]
    roots = brute_components(sorted({f for _, f in of}))
    least = {}
    for d, f in of:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    expected = sorted(((d, f"{f:016x}", least.get(roots[f])) for d, f in of), key=str)
    for docs in (odd, clashing.withColumn("fp", F.lit("other")).withColumn("fingerprint", F.lit("other"))):
        assert sorted((tuple(r) for r in simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str) == expected
    assert simhash.simhash_components(empty).count() == 0
    one = odd.sparkSession.createDataFrame([(None, "only one", None, None, None)], DOC_SCHEMA)
    assert [r["component_id"] for r in simhash.simhash_components(one).collect()] == [None]
